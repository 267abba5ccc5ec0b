"""From issues to actions, and views of an action table."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F, Window

from rowmender.functions import text as t
from rowmender.operators.issues import issue_id
from rowmender.operators.skew import position_within, salted_join
from rowmender.schemas import ACTION_SCHEMA

# fixed values: action per issue type, and what can be undone
ACTION_TYPES = {
    "missing_required_field": "update_property",
    "invalid_email_format": "update_property",
    "invalid_phone_format": "update_property",
    "invalid_url_format": "update_property",
    "obvious_typo": "update_property",
    "name_typo": "update_property",
    "semantic_anomaly": "update_property",
    "stale_contact": "set_marketing_status",
    "duplicate": "merge_contacts",
}
REVERSIBLE = ("update_property", "remove_from_list", "set_marketing_status", "create_association")
FORMAT_PROPERTIES = {"invalid_email_format": "email", "invalid_phone_format": "phone", "invalid_url_format": "website"}
CONFIDENCE_RANK = {"high": 3, "medium": 2, "low": 1}
# fixed values: what speaks for a recommendation, by confidence and by method
CONFIDENCE_FACTORS = {
    "high": ("Clear pattern match", "Supported by data analysis"),
    "medium": ("Requires human review", "Some ambiguity in data"),
    "low": ("Uncertain recommendation", "May need additional context"),
}
METHOD_FACTORS = {
    "ai_reasoning": "Detected using AI reasoning",
    "ai_exploratory": "Detected using AI data exploration",
}
# fixed values: execution batch of each audit
MODULE_BATCH = {"data-quality": 1, "company-quality": 1, "properties": 1, "duplicates": 2, "marketing": 3, "lists": 3}


def _lookup(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for item in table.items() for x in item]), key)


def display_name() -> Column:
    object_id = F.col("object_id")
    is_address = (F.col("type") != "duplicate") & F.contains("current_value", F.lit("@"))
    return (
        F.when((F.col("object_type") == "contact") & F.coalesce(is_address, F.lit(False)), F.col("current_value"))
        .when(F.col("object_type") == "contact", F.concat(F.lit("Contact "), object_id))
        .when(F.col("object_type") == "company", F.concat(F.lit("Company "), object_id))
        .otherwise(F.concat("object_type", F.lit(" "), object_id))
    )


def property_name(infer_property: bool = False) -> Column:
    """Property an action changes; a spacing finding names none unless inferred."""
    kind = F.col("type")
    named = F.when(kind == "missing_required_field", t.trim_spaces(F.try_element_at(
        F.split("description", ":"), F.lit(2))))
    by_word = (
        F.when(F.contains(kind, F.lit("firstname")), "firstname")
        .when(F.contains(kind, F.lit("lastname")), "lastname")
        .when(F.contains(kind, F.lit("company")), "company")
    )
    found = F.coalesce(named, _lookup(FORMAT_PROPERTIES, kind), by_word)
    return F.coalesce(found, t.nonempty("field")) if infer_property else found


def confidence_factors() -> Column:
    base = F.create_map(*[
        x for level, texts in CONFIDENCE_FACTORS.items() for x in (F.lit(level), F.array(*map(F.lit, texts)))])
    method = _lookup(METHOD_FACTORS, F.col("detection_method"))
    return F.concat(
        F.coalesce(F.try_element_at(base, F.col("confidence")), F.array().cast("array<string>")),
        F.array_compact(F.array(method)))


def ai_reasoning(include: bool = True) -> Column:
    none = F.lit(None).cast(ACTION_SCHEMA["ai_reasoning"].dataType)
    if not include:
        return none
    body = F.struct(
        F.col("reasoning").alias("primary_reason"), confidence_factors().alias("confidence_factors"),
        F.lit(None).cast("string").alias("thinking_excerpt"),
        F.lit(None).cast("array<string>").alias("explored_alternatives"))
    return F.when((F.col("detection_method") != "rule") & t.present("reasoning"), body).otherwise(none)


def build_actions(issues: DataFrame, plan_id: str, include_low: bool = True, include_ai_reasoning: bool = True,
                  infer_property: bool = False) -> DataFrame:
    """One action per issue of a known type. A projection: it never shuffles."""
    df = issues if include_low else issues.filter(F.col("confidence") != "low")
    action = _lookup(ACTION_TYPES, F.col("type"))
    df = df.withColumn("action", action).filter(F.col("action").isNotNull())
    reversible = F.col("action").isin(*REVERSIBLE)
    confirm = ~reversible | (F.col("confidence") == "low") | F.col("severity").isin("critical", "high")
    action_id = issue_id(F.lit("action"), F.lit(plan_id), F.col("issue_id"))
    return df.select(
        F.lit(plan_id).alias("plan_id"),
        action_id.alias("action_id"),
        F.concat_ws("/", "object_id", F.lpad(F.col("rule_no").cast("string"), 4, "0"), action_id).alias("seq"),
        F.col("action").alias("type"),
        "confidence",
        F.struct("object_type", "object_id", display_name().alias("display_name")).alias("target"),
        F.struct(
            "description", property_name(infer_property).alias("property"), "current_value",
            F.col("suggested_value").alias("new_value")).alias("change"),
        F.coalesce(t.nonempty("reasoning"), F.concat(F.lit("Fix data quality issue: "), "description")).alias("reasoning"),
        "detection_method",
        ai_reasoning(include_ai_reasoning).alias("ai_reasoning"),
        reversible.alias("reversible"),
        confirm.alias("requires_confirmation"),
        F.array().cast("array<string>").alias("dependencies"),
    )


def summarize_actions(actions: DataFrame, ai_cost: float | Column = 0.0) -> DataFrame:
    """One row per plan: totals and counts by type, confidence and method."""
    levels = tuple(CONFIDENCE_RANK)
    methods = {"rule": "rule_based", "ai_reasoning": "ai_reasoning", "ai_exploratory": "ai_exploratory"}
    per_type = actions.groupBy("plan_id", "type").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col("confidence") == c).alias(c) for c in levels],
        *[F.count_if(F.col("detection_method") == m).alias(name) for m, name in methods.items()],
    )
    cost = ai_cost if isinstance(ai_cost, Column) else F.lit(float(ai_cost))
    return per_type.groupBy("plan_id").agg(
        F.sum("n").alias("total_actions"),
        *[F.sum(c).alias(c) for c in (*levels, *methods.values())],
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("by_type"),
        F.sum("n").alias("estimated_api_calls"),
    ).withColumn("estimated_ai_cost_usd", cost)


def plan_row(actions: DataFrame, insights: DataFrame, source_audit: str, created_at,
             ai_cost: float = 0.0, thinking_summary: str | None = None) -> DataFrame:
    """The plan record: summary plus the context taken from the audit insights."""
    context = insights.select(F.struct(
        F.col("patterns_detected").alias("patterns_identified"),
        F.col("recommendations").alias("strategic_recommendations"),
        F.coalesce(F.lit(thinking_summary), F.col("summary")).alias("thinking_summary")).alias("ai_context"))
    return summarize_actions(actions, ai_cost).select(
        "*", F.lit(source_audit).alias("source_audit"), t.as_timestamp(created_at).alias("created_at"),
        context.scalar().alias("ai_context"))


def filter_actions(actions: DataFrame, confidence: Iterable[str] = (), methods: Iterable[str] = (),
                   types: Iterable[str] = (), reversible_only: bool = False) -> DataFrame:
    """Keep the actions that meet every given condition; an empty set is no condition."""
    for column, allowed in (("confidence", list(confidence)), ("detection_method", list(methods)), ("type", list(types))):
        if allowed:
            actions = actions.filter(F.col(column).isin(*allowed))
    return actions.filter("reversible") if reversible_only else actions


def filter_by_word(actions: DataFrame, word: str) -> DataFrame:
    """Filter by one word that names a confidence or a detection method."""
    if word in CONFIDENCE_RANK:
        return filter_actions(actions, confidence=[word])
    return filter_actions(actions, methods=[word])


def min_confidence(actions: DataFrame, least: str) -> DataFrame:
    kept = [c for c, rank in CONFIDENCE_RANK.items() if rank >= CONFIDENCE_RANK[least]]
    return filter_actions(actions, confidence=kept)


def high_risk(actions: DataFrame) -> DataFrame:
    return actions.filter(~F.col("reversible") | F.col("requires_confirmation"))


def non_reversible(actions: DataFrame) -> DataFrame:
    return actions.filter(~F.col("reversible"))


def ai_made(actions: DataFrame) -> DataFrame:
    return actions.filter(F.col("detection_method") != "rule")


def preview(actions: DataFrame, per_group: int = 5) -> DataFrame:
    """The first actions of each confidence level.

    Spark keeps ``per_group`` rows per task before the shuffle (window group limit).
    """
    order = Window.partitionBy("plan_id", "confidence").orderBy("seq")
    return actions.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= per_group)


def group_views(actions: DataFrame) -> DataFrame:
    """Every action once under its confidence and once under its detection method."""
    groups = F.array(
        F.struct(F.lit("confidence").alias("view"), F.col("confidence").alias("group")),
        F.struct(F.lit("detection_method").alias("view"), F.col("detection_method").alias("group")))
    return actions.select("plan_id", "action_id", F.inline(groups))


def flatten(actions: DataFrame) -> DataFrame:
    """Plain columns, for CSV or line-based JSON."""
    return actions.select(
        "plan_id", "action_id", "seq", "type", "confidence", "target.object_type", "target.object_id",
        "target.display_name", "change.description", F.col("change.property").alias("property"),
        "change.current_value", "change.new_value", "reasoning", "detection_method", "reversible",
        "requires_confirmation", F.array_join("dependencies", ",").alias("dependencies"))


def batch_numbers(actions: DataFrame, size: int = 100) -> DataFrame:
    """Consecutive batches of ``size`` actions inside each plan."""
    placed = position_within(actions, ["plan_id"], ["seq", "action_id"])
    return placed.withColumn("batch", F.floor((F.col("position") - 1) / size))


def conflicts(actions: DataFrame) -> DataFrame:
    """Several actions on one property, and actions on a contact that another one removes."""
    flat = actions.select(
        "plan_id", "type", F.col("target.object_type").alias("object_type"),
        F.col("target.object_id").alias("object_id"), F.col("change.property").alias("property"),
        F.col("change.new_value").alias("new_value"))
    same = (
        flat.filter(F.col("property").isNotNull()).groupBy("plan_id", "object_type", "object_id", "property")
        .agg(F.count(F.lit(1)).alias("actions")).filter(F.col("actions") > 1)
        .withColumn("kind", F.lit("same_property"))
    )
    gone = F.when(F.col("type") == "merge_contacts", F.col("new_value")).when(
        F.col("type") == "delete_contact", F.col("object_id"))
    removed = flat.select("plan_id", gone.alias("object_id")).dropna().distinct()
    touched = (
        flat.filter((F.col("type") != "delete_contact") & (F.col("object_type") == "contact"))
        .groupBy("plan_id", "object_type", "object_id").agg(F.count(F.lit(1)).alias("actions"))
    )
    lost = touched.join(removed, ["plan_id", "object_id"], "left_semi").select(
        "plan_id", "object_type", "object_id", F.lit(None).cast("string").alias("property"), "actions",
        F.lit("target_removed").alias("kind"))
    return same.unionByName(lost)


def audit_batches(actions: DataFrame, module: str = "source_audit") -> DataFrame:
    """Execution batch of each action when the plans of several audits run together.

    The batch of an audit is fixed; batches without actions leave no gap. The
    gathered set holds at most one number per known audit.
    """
    ranked = actions.withColumn("_rank", F.coalesce(_lookup(MODULE_BATCH, F.col(module)), F.lit(4)))
    present = ranked.agg(F.sort_array(F.collect_set("_rank")).alias("ranks")).scalar()
    return ranked.withColumn("batch", F.array_position(present, F.col("_rank")).cast("int")).drop("_rank")


def plan_file_name(source_audit: Column, created_at: Column) -> Column:
    return F.concat(source_audit, F.lit("-"), F.date_format(created_at.cast("timestamp"), "yyyy-MM-dd'T'HH-mm-ss"),
                    F.lit(".json"))


def parse_plan_name(path: Column) -> Column:
    """Audit and instant in a plan file name; null when the name has another shape."""
    name = F.regexp_replace(F.regexp_extract(path, r"[^/]*\z", 0), r"\.json\z", "")
    shape = r"^(.+?)-(\d{4}-\d{2}-\d{2})T(\d{2})-(\d{2})-(\d{2})\z"
    stamp = F.regexp_replace(name, r"^.+?-(\d{4}-\d{2}-\d{2})T(\d{2})-(\d{2})-(\d{2})\z", "$1 $2:$3:$4")
    body = F.struct(
        F.regexp_extract(name, shape, 1).alias("source_audit"),
        F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd HH:mm:ss")).alias("created_at"))
    return F.when(name.rlike(shape), body)


def resume(actions: DataFrame, stops: DataFrame) -> DataFrame:
    """What is left of each stopped plan: ``stops`` has one (plan_id, resume_from) per plan."""
    marks = stops.select("plan_id", F.col("resume_from").alias("action_id"))
    starts = actions.join(marks, ["plan_id", "action_id"]).groupBy("plan_id").agg(F.min("seq").alias("_start"))
    return salted_join(actions, starts, ["plan_id"], "inner", spread=["action_id"]).filter(
        F.col("seq") >= F.col("_start")).drop("_start")
