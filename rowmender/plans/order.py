"""Dependencies between the actions of a plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rowmender.operators import skew
from rowmender.operators.skew import hot_keys, salted_join
from rowmender.session import cut_lineage


def dependency_edges(actions: DataFrame) -> DataFrame:
    return actions.select("action_id", F.explode("dependencies").alias("dependency")).distinct()


def missing_dependencies(actions: DataFrame) -> DataFrame:
    """Dependencies on actions that the plan does not hold."""
    ids = actions.select(F.col("action_id").alias("dependency"))
    edges = dependency_edges(actions)
    return salted_join(edges, ids, ["dependency"], "left_anti", spread=["action_id"])


#: Above any true level; steps around a circle stop growing here.
CAP = 1 << 60


def dependency_levels(actions: DataFrame) -> DataFrame:
    """Level of each action: 0 without dependencies, else one above the highest of them.

    An action's level is the highest of a floor and of its open links, each the level of another
    action plus a number of steps. A round turns links to placed actions into floors and places the
    actions without open links. Rounds 1, 2, 4, 8 and so on also follow links to actions with a
    single open link on to where these lead. Such actions form chains, which are followed by
    doubling; several links that end up in one place become one, so that an action with several
    dependencies may turn into a chain link itself. So chains, and paths that part and meet again, take
    a logarithmic number of rounds; only layers crossed by independent paths go one by one.

    What waits, directly or not, for an action outside the plan is ``missing_dependency``. A round that
    places nothing is the last: what is left then is in or behind a cycle (``cyclic``).
    """
    ids = cut_lineage(actions.select("action_id").distinct())
    edges = cut_lineage(dependency_edges(actions))
    number = edges.count()
    outside = edges.select(F.col("dependency").alias("anchor")).distinct().join(ids.withColumnRenamed("action_id", "anchor"), "anchor", "left_anti")
    zero, no = F.lit(0).cast("bigint"), F.lit(False)
    placed = cut_lineage(outside.select(F.col("anchor").alias("action_id"), zero.alias("level"), F.lit(True).alias("lost")))
    links = cut_lineage(edges.select("action_id", F.col("dependency").alias("anchor"), F.lit(1).cast("bigint").alias("steps")))
    floors = cut_lineage(ids.select("action_id", zero.alias("floor"), no.alias("lost")))
    results: list[DataFrame] = []
    while not links.isEmpty() or not results:
        known = placed.select(F.col("action_id").alias("anchor"), F.col("level").alias("_level"), F.col("lost").alias("_lost"))
        met = cut_lineage(salted_join(links, known, ["anchor"], "left", ["action_id"], _hot(links, "anchor", number)))
        closed = met.filter("_level is not null").select("action_id", _sum("_level", "steps").alias("_floor"), "_lost")
        links = met.filter("_level is null").select("action_id", "anchor", "steps")
        degree = links.groupBy("action_id").agg(F.count(F.lit(1)).alias("open"))
        state = cut_lineage(raised(floors, closed).join(degree, "action_id", "left").fillna(0, ["open"]))
        placed = state.filter("open = 0").select("action_id", F.col("floor").alias("level"), "lost")
        if placed.isEmpty():
            break
        results.append(placed)
        state = state.filter("open > 0")
        floors = state.select("action_id", "floor", "lost")
        turn = len(results)
        if turn & (turn - 1) == 0:
            links, floors = contracted(links, state, number)
    links, floors = contracted(links, state.filter("open > 0"), number)
    stuck = behind_lost(links, floors, number)
    out = stuck.select("action_id", F.lit(None).cast("bigint").alias("level"), "lost")
    for part in results:
        out = out.unionByName(part)
    status = F.when(F.col("lost"), "missing_dependency").when(F.col("level").isNull(), "cyclic").otherwise("placed")
    return out.select("action_id", F.when(~F.col("lost"), F.col("level")).cast("int").alias("level"), status.alias("status"))


def _hot(rows: DataFrame, key: str, number: int) -> list:
    """Hot keys of a table that cannot have more than ``number`` rows."""
    return hot_keys(rows, [key]) if number >= skew.MIN_HOT_ROWS else []


def _sum(a: str, b: str) -> Column:
    return F.least(F.col(a) + F.col(b), F.lit(CAP))


def raised(floors: DataFrame, more: DataFrame) -> DataFrame:
    """Floors (action_id, floor, lost) after others (action_id, _floor, _lost) are taken in."""
    most = more.groupBy("action_id").agg(F.max("_floor").alias("_floor"), F.max("_lost").alias("_lost"))
    return floors.join(most, "action_id", "left").select(
        "action_id", F.greatest("floor", F.coalesce("_floor", F.lit(0))).alias("floor"), (F.col("lost") | F.coalesce("_lost", F.lit(False))).alias("lost"))


def contracted(links: DataFrame, state: DataFrame, number: int) -> tuple[DataFrame, DataFrame]:
    """Links and floors after links to actions with one open link were followed to where these lead.

    A chain link stands for level = max(low, level of the anchor + steps), which composes.
    """
    floors = state.select("action_id", "floor", "lost")
    single = state.filter("open = 1").select("action_id", F.col("floor").alias("low"), "lost")
    jump = cut_lineage(links.join(single, "action_id").select("action_id", "anchor", "steps", "low", "lost", F.lit(False).alias("ended")))
    if jump.isEmpty():
        return links, floors
    while True:
        onward = jump.select(F.col("action_id").alias("anchor"), *[F.col(c).alias(f"_{c}") for c in ("anchor", "steps", "low", "lost")])
        joined = salted_join(jump, onward, ["anchor"], "left", ["action_id"], _hot(jump, "anchor", number))
        # what leads back to itself is a circle and stays
        go = F.col("_anchor").isNotNull() & (F.col("_anchor") != F.col("action_id")) & (F.col("anchor") != F.col("action_id"))

        def step(name: str, further: Column) -> Column:
            return F.when(go, further).otherwise(F.col(name)).alias(name)

        ends = F.col("_anchor").isNull()
        moved = cut_lineage(joined.select(
            "action_id", step("anchor", F.col("_anchor")), step("steps", _sum("steps", "_steps")),
            step("low", F.greatest(F.col("low"), _sum("_low", "steps"))), step("lost", F.col("lost") | F.col("_lost")),
            (F.col("ended") | ends).alias("ended"), (~F.col("ended") & ends).alias("_new")))
        jump = moved.drop("_new")
        # every doubling ends some way, as long as there are ways with an end; the others run in circles
        if moved.filter("_new").isEmpty():
            break
    ways = jump.select(F.col("action_id").alias("anchor"), *[F.col(c).alias(f"_{c}") for c in ("anchor", "steps", "low", "lost")])
    several = links.join(single, "action_id", "left_anti")
    led = cut_lineage(salted_join(several, ways, ["anchor"], "left", ["action_id"], _hot(links, "anchor", number)))
    onto = led.select("action_id", F.coalesce("_anchor", "anchor").alias("anchor"), F.least(F.col("steps") + F.coalesce("_steps", F.lit(0)), F.lit(CAP)).alias("steps"))
    merged = onto.groupBy("action_id", "anchor").agg(F.max("steps").alias("steps"))
    met = led.filter("_anchor is not null").select("action_id", _sum("_low", "steps").alias("_floor"), "_lost")
    own = jump.select("action_id", F.col("low").alias("_floor"), F.col("lost").alias("_lost"))
    return cut_lineage(merged.unionByName(jump.select("action_id", "anchor", "steps"))), cut_lineage(raised(floors, met.unionByName(own)))


def behind_lost(links: DataFrame, floors: DataFrame, number: int) -> DataFrame:
    """(action_id, lost) of what could not be placed: lost if some way leads outside the plan.

    All of it is in or behind a cycle and has been contracted, so the ways are short.
    """
    lost = cut_lineage(floors.filter("lost").select("action_id"))
    fresh = lost
    while not fresh.isEmpty():
        waiting = salted_join(links, fresh.withColumnRenamed("action_id", "anchor"), ["anchor"], "left_semi", ["action_id"], _hot(links, "anchor", number))
        fresh = cut_lineage(waiting.select("action_id").distinct().join(lost, "action_id", "left_anti"))
        lost = cut_lineage(lost.unionByName(fresh))
    marked = floors.select("action_id").join(lost.withColumn("_lost", F.lit(True)), "action_id", "left")
    return marked.select("action_id", F.coalesce("_lost", F.lit(False)).alias("lost"))
