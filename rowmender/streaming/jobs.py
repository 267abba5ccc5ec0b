"""Checks on arriving rows, as Structured Streaming jobs over files.

Each function takes and returns a streaming DataFrame; ``run_to_table`` and
``run_updates`` drive one through everything available and stop.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rowmender.config import QualityRules
from rowmender.functions import text as t
from rowmender.operators.rules import audit_contacts
from rowmender.session import scratch_path


def read_files(spark: SparkSession, folder: str, schema, pattern: str = "*", fmt: str = "parquet",
               files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema).option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(folder)


def validate(arrivals: DataFrame, as_of, rules: QualityRules = QualityRules()) -> DataFrame:
    """Rule findings of arriving contacts; stateless, so it scales with the partitions."""
    return audit_contacts(arrivals, as_of, rules)


def new_addresses(arrivals: DataFrame, existing: DataFrame, event_time: str, delay: str = "7 days") -> DataFrame:
    """Arrivals whose address is neither in the table nor among recent arrivals.

    The state holds the addresses of the watermark delay, not of all time.
    """
    known = existing.select(t.email_key("email").alias("email_key")).dropna().distinct()
    keyed = arrivals.withColumn("email_key", t.email_key("email")).dropna(subset=["email_key"])
    fresh = keyed.join(known, "email_key", "left_anti")
    return fresh.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["email_key"])


def rate_alerts(events: DataFrame, event_time: str, kind: str, least: int, window: str = "1 hour",
                delay: str = "10 minutes") -> DataFrame:
    """Kinds with at least ``least`` events in a tumbling window; later rows are dropped."""
    counts = events.withWatermark(event_time, delay).groupBy(F.window(event_time, window).alias("w"), kind).agg(
        F.count(F.lit(1)).alias("n"))
    return counts.filter(F.col("n") >= least).select(F.col("w.start").alias("window_start"), kind, "n")


def bounce_counts(events: DataFrame, kinds: Sequence[str] = ("BOUNCE",), hard: Column | None = None) -> DataFrame:
    """Running numbers of hard and soft bounces per contact (two counters of state each).

    ``hard`` tells which bounces are permanent; without it all are soft.
    """
    is_hard = F.lit(False) if hard is None else F.coalesce(hard, F.lit(False))
    return events.filter(F.col("event_type").isin(*kinds)).groupBy("contact_id").agg(
        F.count_if(is_hard).alias("hard"), F.count_if(~is_hard).alias("soft"))


def run_to_table(df: DataFrame, name: str, output_mode: str = "append") -> DataFrame:
    """Process what is available into a table below the shared folder and read it back."""
    spark = df.sparkSession
    path, state = scratch_path(spark, name), scratch_path(spark, f"{name}-state")
    query = (
        df.writeStream.format("parquet").outputMode(output_mode).option("path", path)
        .option("checkpointLocation", state).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


def run_updates(df: DataFrame, name: str) -> DataFrame:
    """As :func:`run_to_table`, for changing aggregates: every update is one row.

    A repeated batch writes to its own directory again, so a retry adds nothing.
    """
    spark = df.sparkSession
    path, state = scratch_path(spark, name), scratch_path(spark, f"{name}-state")

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    query = (
        df.writeStream.outputMode("update").foreachBatch(store)
        .option("checkpointLocation", state).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.parquet(path)


def bounced_members(members: DataFrame, updates: DataFrame, soft_limit: int = 3) -> tuple[DataFrame, DataFrame]:
    """What to do with bounced contacts, and the list members that stay.

    A hard bounce leaves all lists at once (``remove``); soft bounces at the limit ask for
    a review and leave the lists as they are.
    """
    latest = updates.groupBy("contact_id").agg(F.max("hard").alias("hard"), F.max("soft").alias("soft"))
    flagged = latest.withColumn("action", F.when(F.col("hard") > 0, "remove").when(F.col("soft") >= soft_limit, "review")).dropna(subset=["action"])
    return flagged, members.join(flagged.filter("action = 'remove'"), "contact_id", "left_anti")
