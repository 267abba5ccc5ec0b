"""Joins and numbering that stay balanced when one key holds much of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, Row, Window
from pyspark.sql.types import LongType, StructField, StructType

from rowmender.session import cut_lineage

# At most this many keys are treated as hot. Every other key then holds less
# than one part in a thousand of the rows, so it cannot dominate a partition.
MAX_HOT_KEYS = 1000
MIN_HOT_ROWS = 100_000
# A hot key is spread over this many partitions, or over more where it has so many rows
# that a partition would get above ROWS_PER_SALT of them.
SALTS = 64
ROWS_PER_SALT = 1_000_000
# A task that makes several keys of each row gets about this many rows.
ROWS_PER_TASK = 50_000


def tasks_for(rows: int, per_task: int | None = None) -> int:
    """Tasks for so many rows, with ``per_task`` (or ``ROWS_PER_TASK``) in each."""
    return max(1, -(-rows // (per_task or ROWS_PER_TASK)))


def spread_rows(df: DataFrame, per_task: int | None = None) -> DataFrame:
    """``df`` with at most about ``per_task`` rows in a partition, for steps that widen each row.

    Compressed tables come in few and large splits, and Spark joins small partitions by their bytes,
    so a task's rows, and its memory, would grow with the table. The rows are counted here.
    """
    tasks = tasks_for(df.count(), per_task)
    return df if tasks == 1 else df.repartition(tasks)


def spread_keys(df: DataFrame, keys: Sequence[str], rows: int, per_task: int | None = None) -> DataFrame:
    """``df``, of so many rows, dealt out by ``keys`` with about ``per_task`` rows in a partition, for a grouping or join by them."""
    tasks = tasks_for(rows, per_task)
    return df if tasks == 1 else df.repartition(tasks, *keys)


def hot_keys(df: DataFrame, keys: Sequence[str], min_rows: int | None = None) -> list[Row]:
    """The heaviest keys of ``df``, null included: never more than ``MAX_HOT_KEYS`` rows.

    One pass over the key columns; partial counts are what is shuffled.
    """
    return hot_counted(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")), keys, "_rows", min_rows)


def hot_counted(counts: DataFrame, keys: Sequence[str], rows: str, min_rows: int | None = None) -> list[Row]:
    """As :func:`hot_keys`, from a table that has the row count of each key already.

    Each row holds the values of the keys and, last, the number of rows.
    """
    heavy = counts.filter(F.col(rows) >= (MIN_HOT_ROWS if min_rows is None else min_rows)).orderBy(F.desc(rows), *keys)
    return heavy.limit(MAX_HOT_KEYS).select(*keys, F.col(rows).cast("bigint").alias("_rows")).collect()


def salted_join(
    big: DataFrame,
    single: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    spread: Sequence[str] = ("id",),
    hot: Sequence[Row] | None = None,
    min_rows: int | None = None,
    keep_salt: bool = False,
) -> DataFrame:
    """Join ``big`` to ``single``, which has one row per key.

    Rows of a hot key are spread over partitions by ``spread``, at most about
    ``ROWS_PER_SALT`` in each, and the one matching row is repeated for each; rows
    without a key are spread when they are many. ``hot_keys`` bounds the list of hot keys, so it is broadcast.
    Without hot keys this is a plain join. ``keep_salt`` leaves the column
    ``_salt`` for a grouping that reuses the partitioning of the join.
    """
    keys = list(keys)
    if hot is None:
        hot = hot_keys(big, keys, min_rows)
    if not hot:
        joined = big.join(single, keys, how)
        return joined.withColumn("_salt", F.lit(0)) if keep_salt else joined
    fields = [big.schema[k] for k in keys]
    salts = [max(SALTS, -(-row[-1] // ROWS_PER_SALT)) for row in hot]
    known = [(*row[:-1], n) for row, n in zip(hot, salts) if all(v is not None for v in row)]
    table = big.sparkSession.createDataFrame(known, StructType([*fields, StructField("_hot", LongType())]))
    table = F.broadcast(table)
    missing = F.lit(False)
    for k in keys:
        missing = missing | F.col(k).isNull()
    row_salt = F.pmod(F.xxhash64(*spread), F.coalesce("_hot", F.lit(max(salts)))).cast("int")
    left = (
        big.join(table, keys, "left")
        .withColumn("_salt", F.when(F.col("_hot").isNotNull() | missing, row_salt).otherwise(0))
        .drop("_hot")
    )
    copies = F.when(F.col("_hot").isNotNull(), F.sequence(F.lit(0), F.col("_hot").cast("int") - 1)).otherwise(F.array(F.lit(0)))
    right = single.join(table, keys, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    joined = left.join(right, [*keys, "_salt"], how)
    return joined if keep_salt else joined.drop("_salt")


# A cell of a grid join holds about this many rows of either side.
CELL_ROWS = 10_000


def grid_join(left: DataFrame, right: DataFrame, keys: Sequence[str], spread_left: Sequence[str], spread_right: Sequence[str],
              cell_rows: int | None = None) -> DataFrame:
    """Inner join where both sides may have very many rows of a key.

    A heavy key becomes a grid: its left rows are dealt to rows of cells and copied along them,
    its right rows to columns, by the counts of both sides, so that a pair meets in one cell
    and no cell holds more than about ``cell_rows`` rows of either side. At most
    ``MAX_HOT_KEYS`` keys are split; without heavy keys this is a plain join.
    """
    keys, most = list(keys), cell_rows or CELL_ROWS
    n_left = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_nl"))
    n_right = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_nr"))
    both = n_left.join(n_right, keys).filter((F.col("_nl") > most) | (F.col("_nr") > most))
    heavy = both.orderBy(F.desc(F.col("_nl").cast("double") * F.col("_nr")), *keys).limit(MAX_HOT_KEYS).collect()
    if not heavy:
        return left.join(right, keys)
    fields = [left.schema[k] for k in keys]
    grid = [(*r[:-2], -(-r[-2] // most), -(-r[-1] // most)) for r in heavy]
    table = F.broadcast(left.sparkSession.createDataFrame(grid, StructType([*fields, StructField("_rows", LongType()), StructField("_columns", LongType())])))

    def dealt(df: DataFrame, own: str, other: str, spread: Sequence[str]) -> DataFrame:
        """Salt ``own`` by content, and a copy for every salt of ``other``."""
        mine = F.when(F.col(own).isNull(), F.lit(0).cast("bigint")).otherwise(F.pmod(F.xxhash64(*spread), F.col(own)))
        copies = F.sequence(F.lit(0).cast("bigint"), F.coalesce(F.col(other), F.lit(1)) - 1)
        salted = df.join(table, keys, "left").withColumn(f"_s{own}", mine)
        return salted.withColumn(f"_s{other}", F.explode(copies)).drop(own, other)

    cells = [*keys, "_s_rows", "_s_columns"]
    return dealt(left, "_rows", "_columns", spread_left).join(dealt(right, "_columns", "_rows", spread_right), cells).drop("_s_rows", "_s_columns")


def ordered_position(df: DataFrame, order: Sequence[str | Column], name: str = "position") -> DataFrame:
    """Number the rows 1..n in the order of ``order``, without a one-task window.

    The rows are range-partitioned and numbered inside their partition; only the
    row count of each partition, one row per partition, is summed in one place.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranged = cut_lineage(ranged.withColumn("_mid", F.monotonically_increasing_id()))
    part = F.shiftright("_mid", 33)
    sizes = ranged.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        ranged.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_before") + inside + 1)
        .drop("_part", "_mid", "_before")
    )


def position_within(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str = "position") -> DataFrame:
    """Number the rows 1..n inside each group, whatever the size of the group."""
    numbered = ordered_position(df, [*group, *order], "_global")
    starts = numbered.groupBy(*group).agg(F.min("_global").alias("_start"), F.count(F.lit(1)).alias("_count"))
    hot = hot_counted(starts, group, "_count")
    joined = salted_join(numbered, starts, group, "inner", ["_global"], hot)
    return joined.withColumn(name, F.col("_global") - F.col("_start") + 1).drop("_global", "_start", "_count")
