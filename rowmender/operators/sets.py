"""Duplicate sets: groups of contacts linked directly or through others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rowmender.config import DuplicateSettings
from rowmender.operators.components import connected
from rowmender.operators.duplicates import enabled_tiers, group_members, match_keys
from rowmender.operators.skew import hot_counted, salted_join
from rowmender.session import cut_lineage


def links_of_groups(members: DataFrame) -> DataFrame:
    """One link per member, to the smallest id of its group: enough to connect the group."""
    keys = ["tier", "key"]
    rows = members.select(*keys, "id")
    heads = cut_lineage(rows.groupBy(*keys).agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    joined = salted_join(rows, heads.drop("n"), keys, "inner", ["id"], hot_counted(heads, keys, "n"))
    return joined.filter("id <> head").select(F.col("head").alias("id_1"), F.col("id").alias("id_2"))


def duplicate_sets(contacts: DataFrame, settings: DuplicateSettings = DuplicateSettings()) -> DataFrame:
    """The set of every contact that duplicates another one by an exact key."""
    keys = match_keys(contacts, settings.default_country_code)
    return connected(links_of_groups(group_members(keys, enabled_tiers(settings))))


def update_sets(sets: DataFrame, links: DataFrame) -> DataFrame:
    """``sets`` (id, set_id) brought up to date with new ``links`` (id_1, id_2).

    Every end of a new link stands for its set, or for itself; only these sets are
    contracted, and only labels that change are looked up. The links behind the old sets are not
    read again. As before, a set has its smallest id.
    """
    labels = sets.select(F.col("id"), "set_id")
    ends = links.select("id_1", "id_2").filter("id_1 <> id_2")
    for end in ("id_1", "id_2"):
        own = labels.select(F.col("id").alias(end), F.col("set_id").alias(f"_{end}"))
        ends = salted_join(ends, own, [end], "left", ["id_1", "id_2"])
    met = cut_lineage(ends.select("id_1", "id_2", F.coalesce("_id_1", "id_1").alias("s_1"), F.coalesce("_id_2", "id_2").alias("s_2")))
    moved = cut_lineage(connected(met.select(F.col("s_1").alias("id_1"), F.col("s_2").alias("id_2"))))
    changed = moved.filter("id <> set_id").select(F.col("id").alias("set_id"), F.col("set_id").alias("_new"))
    kept = salted_join(labels, changed, ["set_id"], "left", ["id"]).select("id", F.coalesce("_new", "set_id").alias("set_id"))
    # ids that were in no set so far
    fresh = met.select(F.explode(F.array("id_1", "id_2")).alias("id")).distinct().join(labels.select("id"), "id", "left_anti")
    return kept.unionByName(fresh.join(moved, "id"))


def new_links(recent: DataFrame, contacts: DataFrame, settings: DuplicateSettings = DuplicateSettings()) -> DataFrame:
    """Links that connect ``recent`` contacts with each other and with ``contacts``, by the exact keys.

    Of every key that a recent contact has, the smallest id among all contacts is enough;
    other keys are left before the grouping.
    """
    tiers = enabled_tiers(settings)
    keys = ["tier", "key"]
    arrived = group_members(match_keys(recent, settings.default_country_code), tiers).select(*keys, "id")
    present = group_members(match_keys(contacts, settings.default_country_code), tiers).select(*keys, "id")
    asked = arrived.select(*keys).distinct()
    known = salted_join(present, asked, keys, "left_semi", ["id"])
    heads = cut_lineage(known.unionByName(arrived).groupBy(*keys).agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("n")))
    joined = salted_join(arrived, heads.drop("n"), keys, "inner", ["id"])
    own = joined.filter("id <> head").select(F.col("head").alias("id_1"), F.col("id").alias("id_2"))
    # a recent contact may be the smallest of a key: it takes over the former head
    former = known.groupBy(*keys).agg(F.min("id").alias("id_2")).join(heads, keys).filter("head <> id_2")
    return own.unionByName(former.select(F.col("head").alias("id_1"), "id_2")).distinct()


def completeness(df: DataFrame, properties: list[str] | None = None) -> Column:
    """How many properties of the row are filled."""
    names = [c for c in df.columns if c != "id"] if properties is None else properties
    total = F.lit(0)
    for c in names:
        total = total + F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), 1).otherwise(0)
    return total


def primaries(sets: DataFrame, contacts: DataFrame, modified: str = "lastmodifieddate") -> DataFrame:
    """The record to keep of each set: most complete, then latest, then smallest id."""
    scored = contacts.select(
        "id", (-completeness(contacts)).alias("_c"),
        (-F.unix_millis(F.coalesce(F.col(modified).cast("timestamp"), F.lit(0).cast("timestamp")))).alias("_m"))
    best = sets.join(scored, "id").groupBy("set_id").agg(
        F.min(F.struct("_c", "_m", "id")).alias("b"), F.count(F.lit(1)).alias("members"))
    return best.select("set_id", F.col("b.id").alias("primary_id"), (-F.col("b._c")).alias("filled"), "members")
