"""Measures per period, for alerts: pairs added, members of lists, quality of what is new."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, Window

from rowmender.config import DuplicateSettings
from rowmender.operators.duplicates import KEY_PROPERTIES, combined_keys, match_keys, pairs_in
from rowmender.operators.properties import quality_score

# fixed steps between the starts of two periods
STEPS = {"day": "interval 1 day", "week": "interval 7 days", "month": "interval 1 month"}


def start_of(time: Column, period: str) -> Column:
    return F.date_trunc(period, time.cast("timestamp"))


def pairs_added(contacts: DataFrame, created: str = "createdate", period: str = "week",
                settings: DuplicateSettings = DuplicateSettings()) -> DataFrame:
    """Exact duplicate pairs that each period adds: (period, n), listing no pair.

    A pair belongs to the period of its later contact. In a group with ``b`` contacts before
    a period and ``n`` new ones, the period adds b * n + n(n-1)/2 pairs. Rows are counted
    per key and period first, so the running size of a key, however hot, has one row
    per period. Pairs that several key types have are counted once, by inclusion-exclusion
    over the combined keys. Contacts without a date were there before all others; pairs
    among them belong to no period.
    """
    tagged = contacts.select(F.struct("id", start_of(F.col(created), period).alias("period")).alias("id"), *KEY_PROPERTIES)
    keys = match_keys(tagged, settings.default_country_code).withColumn("period", F.col("id.period"))
    group = ["part", "sign", "k0", "k1", "k2"]
    sizes = combined_keys(keys, settings, ["period"]).groupBy(*group, "period").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy(*group).orderBy(F.col("period").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(earlier), F.lit(0))
    # two counts of a few billion multiply beyond a bigint
    added = before.cast("decimal(19,0)") * F.col("n").cast("decimal(19,0)") + pairs_in(F.col("n"))
    grown = sizes.withColumn("added", F.col("sign") * added)
    totals = grown.filter("period is not null").groupBy("period").agg(F.sum("added").cast("decimal(38,0)").alias("n"))
    return totals.filter("n > 0")


def without_gaps(counts: DataFrame, period: str = "week") -> DataFrame:
    """``counts`` (kind, period, n) with a nought for every period in between that has no row."""
    ends = counts.groupBy("kind").agg(F.min("period").alias("low"), F.max("period").alias("high"))
    calendar = ends.select("kind", F.explode(F.sequence("low", "high", F.expr(STEPS[period]))).alias("period"))
    return calendar.join(counts, ["kind", "period"], "left").fillna(0, ["n"])


def membership_series(moves: DataFrame, period: str = "day") -> DataFrame:
    """Size of each list after each period in which it changed, and before.

    ``moves`` has (list_id, at, step) with +1 for a contact that joins and -1 for one that
    leaves. Moves are added up per list and period before the running sum.
    """
    net = moves.groupBy(F.col("list_id").alias("kind"), start_of(F.col("at"), period).alias("period")).agg(
        F.sum("step").alias("net"))
    order = Window.partitionBy("kind").orderBy("period")
    after = F.sum("net").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return net.select("kind", "period", after.alias("n"), (after - F.col("net")).alias("before"))


def membership_alerts(moves: DataFrame, percent: float = 20.0, period: str = "day") -> DataFrame:
    """Lists whose size changed by more than ``percent`` within a period; a list that was empty has no rate."""
    change = F.try_divide(F.lit(100.0) * (F.col("n") - F.col("before")), F.col("before"))
    rated = membership_series(moves, period).withColumn("change_pct", F.round(change, 4))
    alert = F.when(F.col("change_pct") > 0, "spike").otherwise("drop")
    return rated.filter(F.abs("change_pct") > percent).withColumn("alert", alert)


def quality_series(contacts: DataFrame, as_of, required: Sequence[str], created: str = "createdate",
                   period: str = "month", kind: str = "contacts") -> DataFrame:
    """Mean quality score of the contacts that each period brought: (kind, period, score)."""
    tagged = contacts.withColumn("id", F.struct("id", start_of(F.col(created), period).alias("period")))
    scores = quality_score(tagged, as_of, required).filter("id.period is not null")
    return scores.groupBy(F.lit(kind).alias("kind"), F.col("id.period").alias("period")).agg(
        (F.sum("score") / F.count(F.lit(1))).alias("score"))
