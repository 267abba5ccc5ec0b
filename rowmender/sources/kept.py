"""Stored tables that are changed in place, partition by partition.

A change is *staged* first: the new rows of every partition that it touches are written beside
the tables, then a note that names these partitions. Only a change with a note counts;
it is *applied* by overwriting the named partitions with the staged rows, which may be done any
number of times with the same outcome. So a crash leaves either the old tables, or a staged
change that the next reader or writer carries through (:meth:`KeptTables.recover`). A change
has a tag; one that was applied before, such as a repeated micro-batch, is not made again.

Partitions without a changed row are neither read nor written. Partition columns hold whole
numbers or dates. One writer at a time.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from rowmender.functions import text as t


@dataclass(frozen=True)
class Change:
    """New rows of a table for the partitions ``touched`` (a column of partition values)."""

    rows: DataFrame
    touched: DataFrame


class KeptTables:
    """Tables below one folder; ``schemas`` gives their columns, ``by`` the partition column of each."""

    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, StructType], by: dict[str, str]) -> None:
        self.spark, self.root, self.schemas, self.by = spark, root.rstrip("/"), schemas, by
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, *parts: str) -> str:
        return "/".join([self.root, *parts])

    def _exists(self, *parts: str) -> bool:
        return self._fs.exists(self._path(self.path(*parts)))

    def _drop(self, *parts: str) -> None:
        self._fs.delete(self._path(self.path(*parts)), True)

    def _names(self, *parts: str) -> list[str]:
        if not self._exists(*parts):
            return []
        return sorted(f.getPath().getName() for f in self._fs.listStatus(self._path(self.path(*parts))))

    def _note(self, text: str, *parts: str) -> None:
        """A small file that appears as a whole or not at all."""
        target, half = self._path(self.path(*parts)), self._path(self.path(*parts) + f".{uuid.uuid4().hex}")
        out = self._fs.create(half, True)
        out.write(bytearray(text.encode()))
        out.close()
        self._fs.delete(target, False)
        self._fs.rename(half, target)

    def _read_note(self, *parts: str) -> dict:
        return json.loads(self.spark.read.text(self.path(*parts), wholetext=True).first()[0])

    def create(self, name: str, rows: DataFrame) -> None:
        """Write a table anew; partitions get few files, large ones several."""
        by = self.by[name]
        rows.select(*self.schemas[name].names).hint("rebalance", by).write.partitionBy(by).mode("overwrite").parquet(self.path(name))

    def read(self, name: str) -> DataFrame:
        self.recover()
        if not self._exists(name):
            return self.spark.createDataFrame([], self.schemas[name])
        return self.spark.read.schema(self.schemas[name]).parquet(self.path(name)).select(*self.schemas[name].names)

    def rows_of(self, name: str, touched: DataFrame) -> DataFrame:
        """The rows of the touched partitions; the scan lists these alone."""
        by = self.by[name]
        # at most one value for each partition of the table
        values = [r[0] for r in touched.select(by).distinct().collect()]
        return self.read(name).filter(F.col(by).isin(values))

    def done(self, tag: str) -> bool:
        return self._exists("_applied", tag)

    def change(self, tag: str, changes: dict[str, Change]) -> bool:
        """Stage and apply the changes as one; False if they were made before."""
        self.recover()
        if self.done(tag):
            return False
        self.stage(tag, changes)
        self.apply(tag)
        return True

    def stage(self, tag: str, changes: dict[str, Change]) -> None:
        touched = {}
        for name, change in changes.items():
            by = self.by[name]
            # at most one value for each partition of the table
            touched[name] = sorted(f"{by}={r[0]}" for r in change.touched.select(F.col(by).cast("string")).distinct().collect())
            change.rows.select(*self.schemas[name].names).write.partitionBy(by).mode("overwrite").parquet(self.path("_staged", tag, name))
        self._note(json.dumps(touched), "_staged", tag, "READY")

    def apply(self, tag: str) -> None:
        for name, partitions in self._read_note("_staged", tag, "READY").items():
            there = {n for n in self._names("_staged", tag, name) if "=" in n}
            if there:
                staged = self.spark.read.schema(self.schemas[name]).parquet(self.path("_staged", tag, name))
                staged.write.option("partitionOverwriteMode", "dynamic").partitionBy(self.by[name]).mode("overwrite").parquet(self.path(name))
            for gone in set(partitions) - there:
                self._drop(name, gone)
        self._note("", "_applied", tag)
        self._drop("_staged", tag)

    def recover(self) -> None:
        """Carry through what was staged as a whole, forget what was not."""
        for tag in self._names("_staged"):
            if self._exists("_staged", tag, "READY") and not self.done(tag):
                self.apply(tag)
            else:
                self._drop("_staged", tag)


def buckets_of(df: DataFrame, column: str, buckets: int, name: str = "bucket") -> DataFrame:
    """``df`` with the partition that a key belongs to; rows without a key are in partition 0."""
    key = F.pmod(F.xxhash64(column), F.lit(buckets)).cast("int")
    return df.withColumn(name, F.when(F.col(column).isNull(), 0).otherwise(key))


def apply_in_place(tables: KeptTables, name: str, changes: DataFrame, buckets: int, tag: str, properties=None) -> bool:
    """Set properties of stored rows by id, see :func:`rowmender.plans.apply.apply_changes`.

    The table is partitioned by the bucket of the id, so the changed ids tell which partitions
    to read and to write.
    """
    from rowmender.plans.apply import apply_changes

    by = tables.by[name]
    touched = buckets_of(changes.select("id").distinct(), "id", buckets, by).select(by).distinct()
    rows = tables.rows_of(name, touched)
    inner = [c for c in rows.columns if c not in ("id", by)] if properties is None else list(properties)
    return tables.change(tag, {name: Change(apply_changes(rows, changes, inner), touched)})


def clean_up_in_place(tables: KeptTables, name: str, as_of, days: int = 30, column: str = "started_at",
                      period: str = "day", tag: str | None = None) -> bool:
    """Remove rows older than ``days`` from a table partitioned by the first date of ``column``'s period.

    Whole periods before the cut go without being read; only the period of the cut is
    read and written anew; later ones are not touched.
    """
    by = tables.by[name]
    cut = t.as_timestamp(as_of) - F.make_dt_interval(F.lit(days))
    first = F.to_date(F.date_trunc(period, cut))
    rows = tables.read(name)
    old = rows.filter(F.col(by) <= first)
    kept = rows.filter((F.col(by) == first) & (F.col(column) >= cut))
    return tables.change(tag or f"retention-{uuid.uuid4().hex}", {name: Change(kept, old.select(by).distinct())})
