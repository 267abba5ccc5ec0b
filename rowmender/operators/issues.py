"""Issue identity, summaries, insights and comparisons between audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rowmender.operators.skew import salted_join


def issue_id(*parts: Column) -> Column:
    """Same finding, same id, in every run."""
    return F.sha2(F.concat_ws("|", *parts), 256)


def counts_by(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def row_total(df: DataFrame) -> Column:
    """Row count of another table as a scalar subquery."""
    return df.agg(F.count(F.lit(1)).alias("n")).scalar()


def _method_count(name: str) -> Column:
    return F.count_if(F.col("detection_method") == name)


def summarize(issues: DataFrame, records: DataFrame, ai_cost: float | Column = 0.0) -> DataFrame:
    """One row: totals and counts by severity, detection method and type.

    Counts are reduced per type first, so only one row per type is gathered.
    """
    severities = ("low", "medium", "high", "critical")
    per_type = issues.groupBy("type").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col("severity") == s).alias(s) for s in severities],
        _method_count("rule").alias("rule_based"),
        _method_count("ai_reasoning").alias("ai_reasoning"),
        _method_count("ai_exploratory").alias("ai_exploratory"),
    )
    total = per_type.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("issues_found"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in (*severities, "rule_based", "ai_reasoning", "ai_exploratory")],
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("by_type"),
    )
    cost = ai_cost if isinstance(ai_cost, Column) else F.lit(float(ai_cost))
    return total.select(row_total(records).alias("total_records"), "*", cost.alias("ai_cost_usd"))


def _kept(*texts: Column) -> Column:
    return F.array_compact(F.array(*texts))


def top_entry(counts: Column) -> Column:
    """The most frequent entry of a count map; ties go to the smaller name."""
    return F.element_at(
        F.array_sort(
            F.map_entries(counts),
            lambda a, b: F.when(a["value"] != b["value"], F.when(a["value"] > b["value"], -1).otherwise(1))
            .otherwise(F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)),
        ),
        1,
    )


def quality_insights(summary: DataFrame, used_ai: bool = False) -> DataFrame:
    """Sentences derived from the one-row summary of a data-quality audit."""
    with_top = summary.withColumn("top", F.when(F.size("by_type") > 0, top_entry(F.col("by_type"))))
    found = F.col("issues_found").cast("string")

    def advice(kind: str, text: str) -> Column:
        return F.when(F.col("by_type").getItem(kind).isNotNull(), F.lit(text))

    rule_only = F.concat(F.lit("Found "), found, F.lit(" data quality issues using rule-based analysis"))
    ai_found = (F.col("issues_found") - F.col("rule_based")).cast("string")
    mixed = F.concat(
        F.lit("Found "), found, F.lit(" data quality issues using two-phase analysis ("),
        F.col("rule_based").cast("string"), F.lit(" rule-based, "), ai_found, F.lit(" AI-detected)"),
    )
    return with_top.select(
        (mixed if used_ai else rule_only).alias("summary"),
        _kept(F.when(
            F.col("top.value") > 5,
            F.concat(F.col("top.key"), F.lit(" is the most common issue ("), F.col("top.value").cast("string"),
                     F.lit(" occurrences)")),
        )).alias("patterns_detected"),
        _kept(
            advice("missing_required_field",
                   "Review data collection processes to ensure required fields are captured"),
            advice("invalid_email_format", "Implement email validation at point of entry"),
            advice("stale_contact", "Consider archiving or re-engaging contacts with no recent activity"),
        ).alias("recommendations"),
    )


def compare_audits(before: DataFrame, after: DataFrame) -> DataFrame:
    """Counts by type in two audits, with absolute and percent change."""
    old = counts_by(before, "type").withColumnRenamed("n", "before")
    new = counts_by(after, "type").withColumnRenamed("n", "after")
    both = old.join(new, "type", "full_outer").fillna(0, ["before", "after"])
    change = F.col("after") - F.col("before")
    return both.select(
        "type", "before", "after", change.alias("change"),
        F.when(F.col("before") > 0, F.round(F.lit(100.0) * change / F.col("before"), 4)).alias("change_pct"),
    )


def issue_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Each issue of two audits as new, resolved or remaining, by its stable id."""
    old = before.select("issue_id", F.lit(1).alias("was"), F.lit(0).alias("now"), "type", "object_id")
    new = after.select("issue_id", F.lit(0).alias("was"), F.lit(1).alias("now"), "type", "object_id")
    seen = old.unionByName(new).groupBy("issue_id").agg(
        F.max("was").alias("was"), F.max("now").alias("now"),
        F.any_value("type").alias("type"), F.any_value("object_id").alias("object_id"),
    )
    status = F.when(F.col("was") == 0, "new").when(F.col("now") == 0, "resolved").otherwise("remaining")
    return seen.select("issue_id", "type", "object_id", status.alias("status"))


def audit_overlap(issues: DataFrame) -> DataFrame:
    """Share of the objects found by one audit that another audit found too.

    The distinct audits of an object are gathered: at most one per module.
    """
    per_object = issues.groupBy("object_type", "object_id").agg(F.collect_set("module").alias("modules"))
    per_set = per_object.groupBy("modules").agg(F.count(F.lit(1)).alias("n"))
    flat = per_set.select("n", "modules", F.explode("modules").alias("module_1"))
    pairs = flat.select("n", "module_1", F.explode("modules").alias("module_2"))
    shared = pairs.groupBy("module_1", "module_2").agg(F.sum("n").alias("shared"))
    totals = shared.filter("module_1 = module_2").select("module_1", F.col("shared").alias("objects"))
    return (
        shared.filter("module_1 <> module_2").join(totals, "module_1")
        .select("module_1", "module_2", "objects", "shared",
                F.round(F.lit(100.0) * F.col("shared") / F.col("objects"), 4).alias("pct"))
    )


def share_by_source(issues: DataFrame, contacts: DataFrame, source: str) -> DataFrame:
    """For each issue type, the percentage of findings from each contact source."""
    per_contact = issues.groupBy(F.col("object_id").alias("id"), "type").agg(F.count(F.lit(1)).alias("n"))
    origin = contacts.select("id", F.coalesce(F.col(source), F.lit("unknown")).alias("source"))
    counts = per_contact.join(origin, "id").groupBy("type", "source").agg(F.sum("n").alias("issues"))
    totals = counts.groupBy("type").agg(F.sum("issues").alias("_total"))
    return counts.join(totals, "type").select(
        "type", "source", "issues", F.round(F.lit(100.0) * F.col("issues") / F.col("_total"), 4).alias("pct"))


def attach_findings(cases: DataFrame, findings: DataFrame, method: str, module: str = "data-quality") -> DataFrame:
    """Turn outside findings on review cases into issues; unknown contacts are left out.

    ``findings``: contact_id, type, severity, confidence, description, reasoning,
    suggested_value. One contact may own very many findings, hence the salting.
    """
    known = cases.select(F.col("contact_id")).distinct()
    joined = salted_join(findings, known, ["contact_id"], "inner", spread=["type", "description"])
    return joined.select(
        issue_id(F.lit(module), F.col("type"), F.col("contact_id"), F.lit(method), F.col("description")).alias("issue_id"),
        F.lit(module).alias("module"), "type", "severity", F.lit("contact").alias("object_type"),
        F.col("contact_id").alias("object_id"), "description", F.lit(None).cast("string").alias("current_value"),
        "suggested_value", "confidence", F.lit(method).alias("detection_method"), "reasoning",
        F.lit("").alias("field"), F.lit(100).alias("rule_no"),
    )


def unknown_findings(cases: DataFrame, findings: DataFrame) -> DataFrame:
    """How many findings name a contact without a case."""
    known = cases.select("contact_id").distinct()
    per_contact = findings.groupBy("contact_id").agg(F.count(F.lit(1)).alias("n"))
    return per_contact.join(known, "contact_id", "left_anti").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("unknown"))
