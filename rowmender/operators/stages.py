"""Stage history of deals: moves, skipped and backward steps, time in stage.

The history is a table of (deal, stage, time). The next stage of an event is found by a join of
numbered events on (deal, number + 1), which is spread by number, so that a deal of
very many events is worked on by many tasks like any other rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from rowmender.functions import text as t
from rowmender.operators.skew import position_within
from rowmender.session import cut_lineage


def stage_rank(stages: Sequence[str], stage: str = "stage") -> Column:
    table = F.create_map(*[x for i, s in enumerate(stages) for x in (F.lit(s), F.lit(i))])
    return F.try_element_at(table, F.col(stage))


def stage_steps(history: DataFrame, order: Sequence[str] = ("at",)) -> DataFrame:
    """Each event with its number in the deal and the stage and time of the next one.

    ``history`` has (deal_id, stage, at); ``order`` must tell the events of a deal apart.
    """
    rows = history.filter("deal_id is not null").select("deal_id", "stage", F.col("at").cast("timestamp").alias("at"), *[c for c in order if c != "at"])
    placed = cut_lineage(position_within(rows, ["deal_id"], list(order)).select("deal_id", "position", "stage", "at"))
    follower = placed.select("deal_id", (F.col("position") - 1).alias("position"), F.col("stage").alias("next_stage"), F.col("at").alias("next_at"))
    return placed.join(follower, ["deal_id", "position"], "left")


def move_kind(stages: Sequence[str]) -> Column:
    here, there = stage_rank(stages), stage_rank(stages, "next_stage")
    return (
        F.when(F.col("next_stage").isNull(), "open")
        .when(here.isNull() | there.isNull(), "unknown")
        .when(there == here, "repeat").when(there == here + 1, "forward")
        .when(there > here, "skipped").otherwise("backward")
    )


def stage_paths(steps: DataFrame, stages: Sequence[str], as_of) -> DataFrame:
    """Moves from stage to stage with their number, the deals that made them and the days spent before.

    The last event of a deal is ``open`` until ``as_of``. Deals are counted per move first,
    then per pair of stages.
    """
    until = F.coalesce("next_at", t.as_timestamp(as_of))
    seconds = F.unix_seconds(until) - F.unix_seconds("at")
    per_deal = steps.groupBy("stage", "next_stage", "deal_id").agg(F.count(F.lit(1)).alias("n"), F.sum(seconds).alias("s"))
    moves = per_deal.groupBy("stage", "next_stage").agg(
        F.sum("n").alias("moves"), F.count(F.lit(1)).alias("deals"), F.sum("s").alias("_s"))
    days = F.col("_s") / F.lit(86400.0)
    return moves.select(
        "stage", "next_stage", move_kind(stages).alias("kind"), "moves", "deals",
        F.round(days, 4).alias("days"), F.round(days / F.col("moves"), 4).alias("mean_days"))


def stage_reach(steps: DataFrame, stages: Sequence[str]) -> DataFrame:
    """Per stage: deals that were in it, and of these the deals that were in a higher one afterwards.

    A deal is one row with the first and last event of every stage, so skipped stages do not
    count as reached.
    """
    rank = stage_rank(stages)
    ranked = steps.select("deal_id", "position", rank.alias("rank"))
    seen = ranked.groupBy("deal_id").agg(
        *[F.min(F.when(F.col("rank") == i, F.col("position"))).alias(f"first_{i}") for i in range(len(stages))],
        *[F.max(F.when(F.col("rank") == i, F.col("position"))).alias(f"last_{i}") for i in range(len(stages))])
    rows = []
    for i, stage in enumerate(stages):
        higher = [F.col(f"last_{j}") for j in range(i + 1, len(stages))]
        later = F.greatest(*higher) if len(higher) > 1 else higher[0] if higher else F.lit(None).cast("bigint")
        rows.append(F.struct(
            F.lit(stage).alias("stage"), F.lit(i).alias("rank"), F.col(f"first_{i}").isNotNull().alias("was"),
            F.coalesce(later > F.col(f"first_{i}"), F.lit(False)).alias("moved")))
    flat = seen.select(F.inline(F.array(*rows))).filter("was")
    counted = flat.groupBy("stage", "rank").agg(F.count(F.lit(1)).alias("deals"), F.count_if("moved").alias("moved_on"))
    return counted.select("stage", "deals", "moved_on", F.round(F.lit(100.0) * F.col("moved_on") / F.col("deals"), 4).alias("moved_pct"))
