"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rowmender.operators import skew
from rowmender.operators.skew import hot_counted, salted_join
from rowmender.session import drop_path, written


def oriented(links: DataFrame) -> DataFrame:
    low, high = F.least("a", "b"), F.greatest("a", "b")
    return links.filter("a <> b").select(low.alias("a"), high.alias("b")).distinct()


def relabel(links: DataFrame, end: str, parents: DataFrame, hot: list) -> DataFrame:
    """``links`` with the column ``end`` replaced by its parent."""
    other = "b" if end == "a" else "a"
    table = parents.select(F.col("id").alias(end), "parent")
    return salted_join(links, table, [end], "inner", [other], hot).select(F.col("parent").alias(end), other)


def connected(links: DataFrame) -> DataFrame:
    """Smallest id reachable from every linked id: (id, set_id) from links (id_1, id_2).

    In each round every id chooses the first of its neighbours and itself in a fresh
    order, links are redrawn between the chosen ids, and links inside one id vanish, so
    they shrink by a constant factor per round whatever the shape. The first order is that of
    the ids, which finishes stars around their smallest id at once; the later ones are
    hashes, which keep long chains short. Ids that many links share are salted. Each round
    writes what is left, and deletes the links of the round before; the choices of all
    rounds are then followed backwards. An id can be hot only among very many links, so
    only then are the hot ones looked for.
    """
    spark = links.sparkSession
    left, path = written(oriented(links.select(F.col("id_1").alias("a"), F.col("id_2").alias("b"))), "links")
    choices: list[tuple[DataFrame, list]] = []
    paths: list[str] = []

    def hot_ids(counts: DataFrame, key: str, rows: str) -> list:
        return hot_counted(counts, [key], rows) if 2 * number >= skew.MIN_HOT_ROWS else []

    while (number := left.count()) > 0:
        turn = len(choices)
        rank = (lambda c: F.struct(F.col(c).alias("id"))) if not turn else (lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), F.col(c).alias("id")))
        ends = left.select(F.col("a").alias("id"), rank("b").alias("r")).unionByName(left.select(F.col("b").alias("id"), rank("a").alias("r")))
        nearest = ends.groupBy("id").agg(F.min("r").alias("r"), F.count(F.lit(1)).alias("links"))
        parents, parents_path = written(nearest.select("id", F.least(F.col("r"), rank("id"))["id"].alias("parent"), "links"), "parents")
        paths.append(parents_path)
        hot = hot_ids(parents, "id", "links")
        followers = hot_ids(parents.groupBy("parent").agg(F.count(F.lit(1)).alias("n")), "parent", "n")
        parents = parents.drop("links")
        redrawn = relabel(relabel(left, "a", parents, hot), "b", parents, hot)
        smaller, smaller_path = written(oriented(redrawn), "links")
        choices.append((parents, followers))
        drop_path(spark, path)
        left, path = smaller, smaller_path
    drop_path(spark, path)
    if not choices:
        return links.select(F.col("id_1").alias("id"), F.col("id_2").alias("set_id")).limit(0)
    roots, _ = choices[-1]
    roots = roots.select("id", F.col("parent").alias("root"))
    for parents, followers in reversed(choices[:-1]):
        onward = roots.select(F.col("id").alias("parent"), "root")
        roots = salted_join(parents, onward, ["parent"], "left", ["id"], followers).select("id", F.coalesce("root", "parent").alias("root"))
    roots, _ = written(roots, "roots")
    for path in paths:
        drop_path(spark, path)
    least = roots.groupBy("root").agg(F.min("id").alias("_least"), F.count(F.lit(1)).alias("n"))
    number = roots.count()
    joined = salted_join(roots, least.drop("n"), ["root"], "inner", ["id"], hot_ids(least, "root", "n"))
    return joined.select("id", F.least("_least", "root").alias("set_id"))
