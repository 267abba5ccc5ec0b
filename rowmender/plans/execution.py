"""What running a plan does to each action, and what a run amounts to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rowmender.functions import text as t
from rowmender.operators.skew import hot_counted, salted_join

UPDATABLE = ("contact", "company", "deal")


def action_error() -> Column:
    """Why an action cannot run; null when it can."""
    kind, prop, value = F.col("type"), F.col("change.property"), F.col("change.new_value")
    return (
        F.when(kind == "update_property",
               F.when(~t.present(prop), "Missing property name")
               .when(~F.col("target.object_type").isin(*UPDATABLE),
                     F.concat(F.lit("Unsupported object type for update: "), F.col("target.object_type"))))
        .when(kind == "merge_contacts",
              F.when(~t.present(value), "Missing secondary contact ID for merge"))
        .when(kind == "remove_from_list",
              F.when(~t.present(value), "Missing contact ID for list removal"))
        .when(kind == "create_association",
              F.when(~t.present(F.get_json_object(value, "$.type")) | ~t.present(F.get_json_object(value, "$.id")),
                     "Invalid association data"))
        .when(kind.isin("delete_contact", "set_marketing_status"), F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("Unknown action type: "), kind))
    )


def stop_on_error(outcomes: DataFrame, plan: str = "plan_id", order: str = "seq") -> DataFrame:
    """Drop what comes after the first failure of each plan; adds ``resume_from``.

    One row per plan holds the first failure, so no plan is ordered in one task.
    """
    failed = F.when(F.col("status") == "failed", F.struct(F.col(order).alias("at"), F.col("action_id").alias("first")))
    first = outcomes.groupBy(plan).agg(F.min(failed).alias("_fail"), F.count(F.lit(1)).alias("_n"))
    hot = hot_counted(first, [plan], "_n")
    joined = salted_join(outcomes, first.drop("_n"), [plan], "inner", ["action_id"], hot)
    kept = joined.filter(F.col("_fail").isNull() | (F.col(order) <= F.col("_fail.at")))
    return kept.withColumn("resume_from", F.col("_fail.first")).drop("_fail")


def unknown_targets(actions: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """action_id of the actions whose target, or for a merge the other contact, is in no table."""
    asked = actions.select("action_id", F.inline(F.array_compact(F.array(
        F.struct(F.col("target.object_type").alias("object_type"), F.col("target.object_id").alias("id")),
        F.when((F.col("type") == "merge_contacts") & t.present("change.new_value"), F.struct(
            F.col("target.object_type").alias("object_type"), F.col("change.new_value").alias("id")))))))
    out = None
    for object_type, table in tables.items():
        mine = asked.filter(F.col("object_type") == object_type)
        lost = salted_join(mine, table.select("id").distinct(), ["id"], "left_anti", ["action_id"]).select("action_id")
        out = lost if out is None else out.unionByName(lost)
    return out.distinct()


def run_actions(actions: DataFrame, before: DataFrame | None, execution_id: str, executed_at,
                dry_run: bool = False, continue_on_error: bool = False, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """The per-action log of a run: status, error and before-image.

    ``before`` is the output of :func:`rowmender.plans.rollback.before_images`. With
    ``tables``, by object type, an action on a row that is not there fails.
    """
    error = F.lit(None).cast("string") if dry_run else action_error()
    if tables and not dry_run:
        lost = unknown_targets(actions, tables).withColumn("_lost", F.lit("Target not found"))
        actions = actions.join(lost, "action_id", "left")
        error = F.coalesce(error, F.col("_lost"))
    status = F.lit("skipped") if dry_run else F.when(F.col("error").isNotNull(), "failed").otherwise("success")
    log = actions.select(
        "plan_id", "action_id", "seq", "type", F.col("reversible").alias("is_reversible"), error.alias("error")
    ).withColumn("status", status)
    if not continue_on_error and not dry_run:
        log = stop_on_error(log)
    else:
        log = log.withColumn("resume_from", F.lit(None).cast("string"))
    when = F.when(F.col("status") == "success", t.as_timestamp(executed_at))
    log = log.withColumns({"execution_id": F.lit(execution_id), "executed_at": when})
    if before is None or dry_run:
        return log.withColumn("rollback_data", F.lit(None).cast(
            "struct<object_type:string,object_id:string,property:string,original_value:string>"))
    return log.join(before.select("action_id", "rollback_data"), "action_id", "left")


def run_results(log: DataFrame, run: str = "execution_id") -> DataFrame:
    """Counts and final status per run."""
    counts = log.groupBy(run).agg(
        F.count_if(F.col("status") == "success").alias("successful"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("status") == "skipped").alias("skipped"),
        F.count_if((F.col("status") == "success") & ~F.col("is_reversible")).alias("non_reversible"),
        F.max("resume_from").alias("resume_from"),
    )
    status = (
        F.when(F.col("resume_from").isNotNull(), "failed")
        .when(F.col("failed") == 0, "completed")
        .when(F.col("successful") > 0, "partially_completed")
        .otherwise("failed")
    )
    return counts.withColumn("status", status)


def can_roll_back(log: DataFrame, run: str = "execution_id") -> DataFrame:
    """Whether a run can be undone, how much of it, and why not."""
    done = F.col("status") == "success"
    counts = log.groupBy(run).agg(
        F.count_if(done & F.col("is_reversible") & F.col("rollback_data").isNotNull()).alias("reversible_count"),
        F.count_if(done & ~F.col("is_reversible")).alias("non_reversible_count"),
    )
    none_back = (F.col("reversible_count") == 0) & (F.col("non_reversible_count") > 0)
    return counts.select(
        run, (F.col("reversible_count") > 0).alias("can_rollback"), "reversible_count", "non_reversible_count",
        F.when(none_back, "All actions are non-reversible").alias("reason"))
