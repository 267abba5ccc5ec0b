"""Plans, audit results and execution logs as partitioned tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rowmender.functions import text as t
from rowmender.plans.build import flatten
from rowmender.schemas import ACTION_SCHEMA, EXECUTION_ACTION_SCHEMA

# keep the blanks that the findings are about, and tell null (a character no text holds) from ''
CSV_OPTIONS = {"header": True, "escape": '"', "quoteAll": True, "multiLine": True, "nullValue": "\u0001", "emptyValue": "",
               "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
# a file with line breaks inside values is read by one task, so files are kept small
EXPORT_ROWS = 1_000_000


def write_plan(actions: DataFrame, path: str, fmt: str = "parquet", mode: str = "append") -> None:
    """Store actions, one directory per plan."""
    actions.write.partitionBy("plan_id").mode(mode).format(fmt).save(path)


def read_plan(spark: SparkSession, path: str, plan_id: str | None = None, fmt: str = "parquet",
              schema=ACTION_SCHEMA) -> DataFrame:
    """Read stored actions; one plan reads only its own directory."""
    df = spark.read.schema(schema).format(fmt).load(path)
    return df if plan_id is None else df.filter(F.col("plan_id") == plan_id)


def export_plan(actions: DataFrame, path: str, fmt: str = "csv") -> None:
    writer = flatten(actions).write.mode("overwrite").option("maxRecordsPerFile", EXPORT_ROWS)
    (writer.options(**CSV_OPTIONS) if fmt == "csv" else writer).format(fmt).save(path)


def read_export(spark: SparkSession, path: str, schema, fmt: str = "csv") -> DataFrame:
    reader = spark.read.schema(schema)
    if fmt == "csv":
        reader = reader.options(**CSV_OPTIONS)
    return reader.format(fmt).load(path)


def write_audit(issues: DataFrame, path: str) -> None:
    issues.write.partitionBy("module").mode("append").json(path)


def write_execution(log: DataFrame, path: str) -> None:
    """Append a per-action log, by execution date so that retention drops whole directories."""
    log.withColumn("run_date", F.to_date("started_at")).write.partitionBy("run_date").mode("append").parquet(path)


def read_execution(spark: SparkSession, path: str, schema=EXECUTION_ACTION_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def list_executions(runs: DataFrame) -> DataFrame:
    """All executions, newest first."""
    return runs.orderBy(F.desc("executed_at"), "execution_id")


def get_execution(runs: DataFrame, execution_id: str) -> DataFrame:
    return runs.filter(F.col("execution_id") == execution_id)


def retained(runs: DataFrame, as_of, days: int = 30, column: str = "executed_at") -> DataFrame:
    """Executions that are not older than ``days``."""
    return runs.filter(F.col(column) >= t.as_timestamp(as_of) - F.make_dt_interval(F.lit(days)))


def clean_up(spark: SparkSession, path: str, target: str, as_of, days: int = 30) -> None:
    """Write what is retained of a stored log to ``target``.

    Whole dates before the cut are pruned by their directory; only the date of
    the cut itself is filtered row by row.
    """
    df = spark.read.parquet(path)
    cut = t.as_timestamp(as_of) - F.make_dt_interval(F.lit(days))
    kept = retained(df.filter(F.col("run_date") >= F.to_date(cut)), as_of, days, "started_at")
    kept.write.partitionBy("run_date").mode("overwrite").parquet(target)
