"""Before-images of a run and its reversal."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from rowmender.operators.skew import salted_join
from rowmender.plans.apply import apply_changes


def long_form(table: DataFrame, properties: Sequence[str]) -> DataFrame:
    """(id, property, value) of the given columns; no other column is read."""
    entries = F.array(*[F.struct(F.lit(p).alias("property"), F.col(p).cast("string").alias("value")) for p in properties])
    return table.select("id", F.inline(entries))


def before_images(actions: DataFrame, tables: dict[str, DataFrame], properties: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """Current value of what each reversible action will change: (action_id, rollback_data).

    ``tables`` maps an object type to its table, ``properties`` to the columns that the
    actions may change (by default all but the id). Other action types have none. One
    row may be the target of very many actions, hence the salted join. An action on a
    column outside ``properties`` gets an image without a value.
    """
    prop = F.when(F.col("type") == "set_marketing_status", F.lit("hs_marketable_status")).when(
        F.col("type") == "update_property", F.col("change.property"))
    wanted = actions.filter("reversible").select(
        "action_id", F.col("target.object_type").alias("object_type"), F.col("target.object_id").alias("id"),
        prop.alias("property")).filter(F.col("property").isNotNull())
    parts = []
    for object_type, table in tables.items():
        names = (properties or {}).get(object_type) or [c for c in table.columns if c != "id"]
        mine = wanted.filter(F.col("object_type") == object_type)
        # a column that the table lacks has no value, but its row must be there
        known = mine.withColumn("_name", F.when(F.col("property").isin(*names), F.col("property")).otherwise(names[0]))
        rows = long_form(table, names).withColumnRenamed("property", "_name")
        parts.append(salted_join(known, rows, ["id", "_name"], "inner", spread=["action_id"]).select(
            "action_id", F.struct(
                "object_type", F.col("id").alias("object_id"), "property",
                F.when(F.col("_name") == F.col("property"), F.col("value")).alias("original_value")).alias("rollback_data")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def rollback_changes(log: DataFrame, object_type: str = "contact") -> DataFrame:
    """The values to write back: successful, reversible actions with a before-image."""
    kept = log.filter(
        (F.col("status") == "success") & F.col("is_reversible")
        & (F.col("rollback_data.object_type") == object_type))
    return kept.select(
        F.col("rollback_data.object_id").alias("id"), F.col("rollback_data.property").alias("property"),
        F.col("rollback_data.original_value").alias("value"), "seq")


def roll_back(table: DataFrame, log: DataFrame, object_type: str = "contact") -> DataFrame:
    """Undo a run. The earliest before-image of a property is what was there first."""
    return apply_changes(table, rollback_changes(log, object_type), keep="first")


def rollback_results(log: DataFrame, run: str = "execution_id") -> DataFrame:
    done = F.col("status") == "success"
    image = F.col("rollback_data").isNotNull()
    return log.groupBy(run).agg(
        F.count_if(done & F.col("is_reversible") & image).alias("rolled_back"),
        F.count_if(done & F.col("is_reversible") & ~image).alias("failed"),
        F.count_if(done & ~F.col("is_reversible")).alias("non_reversible"))


def rollback_errors(log: DataFrame) -> DataFrame:
    return log.filter((F.col("status") == "success") & F.col("is_reversible") & F.col("rollback_data").isNull()).select(
        "action_id", F.lit("No rollback data available").alias("error"))
