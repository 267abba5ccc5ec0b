"""Search with filter groups: any group may match, all filters of a group must."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from rowmender.functions import text as t
from rowmender.operators.skew import ordered_position


def _words(c: Column) -> Column:
    return F.split(F.lower(c.cast("string")), "[^a-z0-9]+")


def condition(prop: str, operator: str, value: Any = None, high: Any = None) -> Column:
    """One filter; the negative operators keep rows without a value."""
    c = F.col(prop)

    def token() -> Column:
        return F.coalesce(F.array_contains(_words(c), str(value).lower()), F.lit(False))

    def absent_or(test: Column) -> Column:
        return c.isNull() | test

    table = {
        "EQ": lambda: c == value,
        "NEQ": lambda: absent_or(c != value),
        "LT": lambda: c < value,
        "LTE": lambda: c <= value,
        "GT": lambda: c > value,
        "GTE": lambda: c >= value,
        "BETWEEN": lambda: c.between(value, high),
        "IN": lambda: c.isin(*value),
        "NOT_IN": lambda: absent_or(~c.isin(*value)),
        "HAS_PROPERTY": lambda: t.present(c.cast("string")),
        "NOT_HAS_PROPERTY": lambda: ~t.present(c.cast("string")),
        "CONTAINS_TOKEN": token,
        "NOT_CONTAINS_TOKEN": lambda: ~token(),
    }
    return table[operator]()


def matches(groups: Sequence[Sequence[tuple]]) -> Column:
    if not groups:
        return F.lit(True)
    return reduce(lambda a, b: a | b, [
        reduce(lambda a, b: a & b, [condition(*f) for f in group], F.lit(True)) for group in groups])


def search(df: DataFrame, groups: Sequence[Sequence[tuple]]) -> DataFrame:
    return df.filter(matches(groups))


def page(df: DataFrame, sorts: Sequence[tuple[str, str]] = (), limit: int = 100, after: int = 0) -> DataFrame:
    """One page of a search; the id breaks ties. Spark keeps only the page's rows per task."""
    order = [F.col(c).desc_nulls_last() if d.upper().startswith("DESC") else F.col(c).asc_nulls_last() for c, d in sorts]
    return df.orderBy(*order, "id").offset(after).limit(limit)


def _direction(order: str) -> bool:
    return order.upper().startswith("DESC")


def keyset_order(sorts: Sequence[tuple[str, str]]) -> list[Column]:
    """The sort columns and the id that makes them unique, empty values last."""
    return [F.col(c).desc_nulls_last() if _direction(d) else F.col(c).asc_nulls_last() for c, d in sorts] + [F.col("id").asc()]


def behind(sorts: Sequence[tuple[str, str]], cursor: Sequence[Any]) -> Column:
    """Rows that come after the row whose sort values and id are ``cursor``.

    Plain comparisons alone, so that a scan can skip files and row groups before it.
    """
    wanted, same = F.lit(False), F.lit(True)
    for (c, d), value in zip([*sorts, ("id", "ASC")], cursor):
        column = F.col(c)
        if value is not None:
            further = column < F.lit(value) if _direction(d) else column > F.lit(value)
            wanted = wanted | (same & (further | column.isNull()))
        same = same & column.eqNullSafe(F.lit(value))
    return wanted


def page_behind(df: DataFrame, sorts: Sequence[tuple[str, str]] = (), limit: int = 100,
                cursor: Sequence[Any] | None = None) -> DataFrame:
    """The next ``limit`` rows behind a cursor, or the first ones; the order is total by the id.

    No rows before the cursor are sorted or counted, so a deep page costs what the first one does.
    """
    rows = df if cursor is None else df.filter(behind(sorts, cursor))
    return rows.orderBy(*keyset_order(sorts)).limit(limit)


def next_cursor(rows: DataFrame, sorts: Sequence[tuple[str, str]] = (), limit: int = 100) -> tuple | None:
    """The cursor behind a full page (its last row's sort values and id), None behind the last page."""
    names = [c for c, _ in sorts] + ["id"]
    # the page is at most ``limit`` rows
    keys = [tuple(r) for r in rows.select(*names).collect()]
    return keys[-1] if len(keys) == limit else None


def pages_behind(df: DataFrame, sorts: Sequence[tuple[str, str]] = (), limit: int = 100,
                 cursor: Sequence[Any] | None = None) -> DataFrame:
    """All pages behind a cursor, or all there are: the rows with their ``page`` (from 0) and ``row`` (from 1).

    The same pages as :func:`page_behind` gives one after the other, each from the cursor of the one before,
    but the rows are sorted once, by ranges, however many pages there are. Rows that agree in all sort values
    and the id are all listed.
    """
    rows = df if cursor is None else df.filter(behind(sorts, cursor))
    placed = ordered_position(rows, keyset_order(sorts), "_place")
    before = F.col("_place") - 1
    page, row = F.floor(before / limit).cast("int"), (F.pmod(before, F.lit(limit)) + 1).cast("int")
    return placed.select(*df.columns, page.alias("page"), row.alias("row"))


def total(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"))
