"""Deals, forms, alerts and call costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window

from rowmender.functions import text as t


def stuck_deals(deals: DataFrame, as_of, idle_days: int = 30) -> DataFrame:
    """Open deals without activity, by stage."""
    cut = t.as_timestamp(as_of) - F.make_dt_interval(F.lit(idle_days))
    open_ = ~F.col("stage").isin("closedwon", "closedlost")
    return deals.filter(open_ & (F.col("updated_at") <= cut)).groupBy("stage").agg(
        F.count(F.lit(1)).alias("deals"), F.sum(F.col("amount").cast("decimal(18,2)")).cast("double").alias("amount"))


def stage_conversion(deals: DataFrame, stages: list[str]) -> DataFrame:
    """Of the deals that reached a stage, the share that reached the next one.

    A deal has reached every stage up to its own. Counting per stage first
    leaves one row per stage for the running sum.
    """
    ranks = F.create_map(*[x for i, s in enumerate(stages) for x in (F.lit(s), F.lit(i))])
    counts = deals.groupBy("stage").agg(F.count(F.lit(1)).alias("n")).filter(F.col("stage").isin(*stages))
    ranked = counts.withColumn("rank", ranks[F.col("stage")])
    down = Window.orderBy(F.desc("rank")).rowsBetween(Window.unboundedPreceding, 0)
    reached = ranked.withColumn("reached", F.sum("n").over(down))
    nexts = reached.withColumn("reached_next", F.lead("reached").over(Window.orderBy("rank")))
    return nexts.select("stage", "reached", "reached_next",
                        F.round(F.lit(100.0) * F.col("reached_next") / F.col("reached"), 4).alias("conversion_pct"))


def form_dropoff(events: DataFrame, form: str, field: str, done: Column) -> DataFrame:
    """Abandonment per form and per field, a null field being the form itself."""
    counts = events.groupBy(form, field).agg(F.count(F.lit(1)).alias("starts"), F.count_if(done).alias("finished"))
    both = counts.select(form, F.explode(F.array(F.col(field), F.lit(None).cast("string"))).alias(field), "starts", "finished")
    total = both.groupBy(form, field).agg(F.sum("starts").alias("starts"), F.sum("finished").alias("finished"))
    rate = F.lit(100.0) * (F.col("starts") - F.col("finished")) / F.col("starts")
    return total.withColumn("abandonment_pct", F.round(rate, 4))


def period_counts(events: DataFrame, time: str, kind: str, period: str = "week") -> DataFrame:
    return events.groupBy(F.col(kind).alias("kind"), F.date_trunc(period, F.col(time).cast("timestamp")).alias("period")).agg(
        F.count(F.lit(1)).alias("n"))


def spikes(counts: DataFrame, rise_pct: float = 50.0, drop_pct: float = 30.0) -> DataFrame:
    """Periods that rose or fell too much against the one before; after a nought there is no rate.

    The input has one row per kind and period, so a window holds one kind's periods.
    """
    w = Window.partitionBy("kind").orderBy("period")
    with_before = counts.withColumn("before", F.lag("n").over(w))
    change = F.try_divide(F.lit(100.0) * (F.col("n") - F.col("before")), F.col("before"))
    flagged = with_before.withColumn("change_pct", F.round(change, 4))
    alert = F.when(F.col("change_pct") > rise_pct, "spike").when(F.col("change_pct") < -drop_pct, "drop")
    return flagged.withColumn("alert", alert).filter(F.col("alert").isNotNull())


def call_cost(prices: dict[str, tuple[float, float, float]]) -> list[Column]:
    """Cost columns of a call, from its model and token counts.

    ``prices`` gives a model's price of a million input, output and thinking tokens.
    """
    table = F.create_map(*[x for m, p in prices.items() for x in (F.lit(m), F.array(*map(F.lit, p)))])
    own = F.try_element_at(table, F.col("model"))

    def part(tokens: str, i: int) -> Column:
        return F.col(tokens) / F.lit(1_000_000) * own[i]

    a, b, c = part("input_tokens", 0), part("output_tokens", 1), part("thinking_tokens", 2)
    return [a.alias("input_cost"), b.alias("output_cost"), c.alias("thinking_cost"), (a + b + c).alias("cost_usd")]


def usage_rollup(calls: DataFrame, prices: dict[str, tuple[float, float, float]]) -> DataFrame:
    """Requests, tokens, tool calls, cost and errors by operation, by mode and in total.

    A failed call counts as an error and nothing else. The calls are counted per
    (operation, mode) first; the grouping sets then work on those few rows.
    """
    ok = ~F.col("is_error")
    priced = calls.select("*", *call_cost(prices))
    # whole micro-units add up without rounding drift
    micro = F.round(F.col("cost_usd") * 1e9).cast("bigint")
    sums = ["input_tokens", "output_tokens", "thinking_tokens", "tool_calls"]
    small = priced.groupBy("operation", "mode").agg(
        F.count_if(ok).alias("requests"), *[F.coalesce(F.sum(F.when(ok, F.col(c))), F.lit(0)).alias(c) for c in sums],
        F.coalesce(F.sum(F.when(ok, micro)), F.lit(0)).alias("_nano"), F.count_if(~ok).alias("errors"))
    names = ["requests", *sums, "_nano", "errors"]
    sets = small.groupingSets([["operation"], ["mode"], []], "operation", "mode").agg(
        *[F.sum(c).alias(c) for c in names], F.grouping("operation").alias("_no_op"), F.grouping("mode").alias("_no_mode"))
    scope = F.when(F.col("_no_op") == 0, "operation").when(F.col("_no_mode") == 0, "mode").otherwise("total")
    # errors are tracked per operation and mode only
    return sets.select(
        scope.alias("scope"), F.coalesce("operation", "mode", F.lit("all")).alias("name"), "requests", *sums,
        (F.col("_nano") / F.lit(1e9)).alias("cost_usd"), "errors")


def score_drops(scores: DataFrame, points: float = 10.0) -> DataFrame:
    """Periods whose score (kind, period, score) fell by more than ``points`` against the one before."""
    w = Window.partitionBy("kind").orderBy("period")
    with_before = scores.withColumn("before", F.lag("score").over(w))
    return with_before.filter(F.col("before") - F.col("score") > points)
