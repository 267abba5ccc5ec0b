"""Table layouts and the adapter from property bags to columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F, types as T

ISSUE_COLUMNS = (
    "issue_id", "module", "type", "severity", "object_type", "object_id", "description",
    "current_value", "suggested_value", "confidence", "detection_method", "reasoning",
    "field", "rule_no",
)

ACTION_SCHEMA = T.StructType([
    T.StructField("plan_id", T.StringType()),
    T.StructField("action_id", T.StringType()),
    T.StructField("seq", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("confidence", T.StringType()),
    T.StructField("target", T.StructType([
        T.StructField("object_type", T.StringType()),
        T.StructField("object_id", T.StringType()),
        T.StructField("display_name", T.StringType()),
    ])),
    T.StructField("change", T.StructType([
        T.StructField("description", T.StringType()),
        T.StructField("property", T.StringType()),
        T.StructField("current_value", T.StringType()),
        T.StructField("new_value", T.StringType()),
    ])),
    T.StructField("reasoning", T.StringType()),
    T.StructField("detection_method", T.StringType()),
    T.StructField("ai_reasoning", T.StructType([
        T.StructField("primary_reason", T.StringType()),
        T.StructField("confidence_factors", T.ArrayType(T.StringType())),
        T.StructField("thinking_excerpt", T.StringType()),
        T.StructField("explored_alternatives", T.ArrayType(T.StringType())),
    ])),
    T.StructField("reversible", T.BooleanType()),
    T.StructField("requires_confirmation", T.BooleanType()),
    T.StructField("dependencies", T.ArrayType(T.StringType())),
])

BAG_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("updated_at", T.TimestampType()),
    T.StructField("archived", T.BooleanType()),
])

EXECUTION_ACTION_SCHEMA = T.StructType([
    T.StructField("execution_id", T.StringType()),
    T.StructField("action_id", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("error", T.StringType()),
    T.StructField("executed_at", T.TimestampType()),
    T.StructField("rollback_data", T.StructType([
        T.StructField("object_type", T.StringType()),
        T.StructField("object_id", T.StringType()),
        T.StructField("property", T.StringType()),
        T.StructField("original_value", T.StringType()),
    ])),
    T.StructField("is_reversible", T.BooleanType()),
])


def require_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Add the optional properties that ``df`` lacks as null strings."""
    have = set(df.columns)
    missing = {n: F.lit(None).cast("string") for n in dict.fromkeys(names) if n not in have}
    return df.withColumns(missing) if missing else df


def bag_to_columns(bag: DataFrame, properties: Iterable[str]) -> DataFrame:
    """Project the wanted keys of the property map, so that the map is read once."""
    wanted = [F.col("properties").getItem(p).alias(p) for p in dict.fromkeys(properties)]
    return bag.select("id", *wanted, "created_at", "updated_at", "archived")


def columns_to_bag(df: DataFrame, properties: Iterable[str]) -> DataFrame:
    pairs = [x for p in dict.fromkeys(properties) for x in (F.lit(p), F.col(p).cast("string"))]
    rest = [c for c in ("created_at", "updated_at", "archived") if c in df.columns]
    return df.select("id", F.create_map(*pairs).alias("properties"), *rest)
