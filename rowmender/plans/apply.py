"""Applying actions to tables: each function returns the new version of a table."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from rowmender.functions import text as t
from rowmender.operators.skew import salted_join, spread_keys
from rowmender.schemas import require_columns
from rowmender.session import cut_lineage


def property_changes(actions: DataFrame, object_type: str = "contact") -> DataFrame:
    """The property updates of a plan as (id, property, value, seq)."""
    kept = actions.filter(
        (F.col("type") == "update_property") & (F.col("target.object_type") == object_type)
        & t.present("change.property"))
    return kept.select(
        F.col("target.object_id").alias("id"), F.col("change.property").alias("property"),
        F.col("change.new_value").alias("value"), "seq")


def truthy(c: Column) -> Column:
    """A missing or empty value, ``false`` or 0 counts as no."""
    return t.present(c) & ~F.lower(c).isin("false", "0")


def marketing_changes(actions: DataFrame) -> DataFrame:
    """Marketing-status actions; without a new value the contact stops being marketable."""
    return actions.filter(F.col("type") == "set_marketing_status").select(
        F.col("target.object_id").alias("id"), F.lit("hs_marketable_status").alias("property"),
        F.when(truthy(F.col("change.new_value")), "true").otherwise("false").alias("value"), "seq")


def apply_changes(table: DataFrame, changes: DataFrame, properties: Sequence[str] | None = None,
                  keep: str = "last") -> DataFrame:
    """Set properties of the rows with the given ids; null is written as ''.

    Of several changes to one property the last one wins, or the first with
    ``keep='first'``. Changes are reduced to one row per id before the join, so
    both sides of it have unique keys.
    """
    kinds = dict(table.dtypes)
    if properties is None:
        properties = [c for c in table.columns if c != "id"]
    pick = F.max if keep == "last" else F.min
    value = F.struct("seq", F.coalesce("value", F.lit("")).alias("value"))
    wide = changes.filter(F.col("property").isin(*properties)).groupBy("id").agg(
        *[pick(F.when(F.col("property") == p, value)).alias(f"_{p}") for p in properties])
    joined = table.join(wide, "id", "left")
    updated = {
        p: F.when(F.col(f"_{p}").isNotNull(), F.col(f"_{p}.value").try_cast(kinds[p])).otherwise(F.col(p))
        for p in properties
    }
    return joined.withColumns(updated).select(*table.columns)


def batch_update(table: DataFrame, changes: DataFrame, properties: Sequence[str] | None = None):
    """The updated table, and each id with whether it was found."""
    ids = table.select("id", F.lit(True).alias("_known"))
    asked = changes.groupBy("id").agg(F.count(F.lit(1)).alias("changes"))
    outcome = asked.join(ids, "id", "left").select(
        "id", "changes", F.when(F.col("_known"), "success").otherwise("error").alias("status"))
    return apply_changes(table, changes, properties), outcome


def apply_deletes(contacts: DataFrame, ids: DataFrame) -> DataFrame:
    """Archive the contacts named in ``ids`` (a column ``id``)."""
    gone = ids.select("id").distinct().withColumn("_gone", F.lit(True))
    contacts = contacts if "archived" in contacts.columns else contacts.withColumn("archived", F.lit(False))
    return contacts.join(gone, "id", "left").withColumn(
        "archived", F.coalesce(F.col("_gone"), F.col("archived"))).drop("_gone").select(*contacts.columns)


def merge_actions(actions: DataFrame) -> DataFrame:
    return actions.filter((F.col("type") == "merge_contacts") & t.present("change.new_value")).select(
        "action_id", "seq", F.col("target.object_id").alias("primary_id"),
        F.col("change.new_value").alias("secondary_id"))


def survivors(merges: DataFrame) -> DataFrame:
    """Where each merged contact ends up: (id, survivor_id, seq).

    A contact merged twice goes to the first target. Chains are shortened by
    pointer jumping, so k rounds resolve chains of 2**k. Merges that form a
    cycle have no survivor and are left out.
    """
    valid = merges.filter(F.col("primary_id") != F.col("secondary_id"))
    first = valid.groupBy("secondary_id").agg(F.min(F.struct("seq", "primary_id")).alias("m"))
    hop = cut_lineage(first.select(
        F.col("secondary_id").alias("id"), F.col("m.primary_id").alias("survivor_id"), F.col("m.seq").alias("seq")))
    rounds = max(1, math.ceil(math.log2(max(2, hop.count()))) + 1)
    for _ in range(rounds):
        onward = hop.select(F.col("id").alias("survivor_id"), F.col("survivor_id").alias("_next"))
        step = cut_lineage(salted_join(hop, onward, ["survivor_id"], "left", spread=["id"]))
        moved = not step.filter("_next IS NOT NULL").isEmpty()
        hop = step.select("id", F.coalesce("_next", "survivor_id").alias("survivor_id"), "seq")
        if not moved:
            return hop
    ends = hop.select(F.col("id").alias("survivor_id"))
    return salted_join(hop, ends, ["survivor_id"], "left_anti", spread=["id"])


def apply_merges(contacts: DataFrame, moves: DataFrame, properties: Sequence[str] | None = None,
                 policy: str = "fill", modified: str = "lastmodifieddate") -> DataFrame:
    """Remove merged contacts and carry their values over to the survivor.

    ``fill`` gives the survivor's empty properties the value of the earliest
    merged contact that has one; ``recent`` takes the most recently modified
    value of all, the survivor included.
    """
    properties = [c for c in contacts.columns if c != "id"] if properties is None else list(properties)
    # a merge into a contact that does not exist is not carried out
    heads = contacts.select(F.col("id").alias("survivor_id"))
    moves = salted_join(moves, heads, ["survivor_id"], "left_semi", spread=["id"])
    merged = contacts.join(moves, "id").select("survivor_id", "seq", *contacts.columns)

    def filled(p: str) -> Column:
        c = F.col(p)
        return c.isNotNull() & (c.cast("string") != "")

    if policy == "fill":
        donors = merged.groupBy(F.col("survivor_id").alias("id")).agg(
            *[F.min(F.when(filled(p), F.struct("seq", F.col("id").alias("i"), F.col(p).alias("v")))).alias(f"_{p}")
              for p in properties])
        values = {p: F.when(filled(p), F.col(p)).otherwise(F.coalesce(F.col(f"_{p}.v"), F.col(p))) for p in properties}
    else:
        heads = merged.select(F.col("survivor_id").alias("id")).distinct()
        own = contacts.join(heads, "id", "left_semi").withColumn("survivor_id", F.col("id"))
        both = merged.drop("seq").unionByName(own)
        donors = both.groupBy(F.col("survivor_id").alias("id")).agg(
            *[F.max(F.when(filled(p), F.struct(F.col(modified).alias("m"), F.col("id").alias("i"), F.col(p).alias("v"))))
              .alias(f"_{p}") for p in properties])
        values = {p: F.coalesce(F.col(f"_{p}.v"), F.col(p)) for p in properties}
    kept = contacts.join(moves.select("id"), "id", "left_anti")
    return kept.join(donors, "id", "left").withColumns(values).select(*contacts.columns)


def repoint(table: DataFrame, column: str, moves: DataFrame) -> DataFrame:
    """Point a column of ids at the survivors and drop the duplicates that arise."""
    target = moves.select(F.col("id").alias(column), F.col("survivor_id").alias("_to"))
    spread = [c for c in table.columns if c != column] or [column]
    joined = salted_join(table, target, [column], "left", spread=spread)
    return joined.withColumn(column, F.coalesce("_to", column)).select(*table.columns).distinct()


def apply_list_changes(members: DataFrame, add: DataFrame | None = None, remove: DataFrame | None = None) -> DataFrame:
    """Membership after removals, then additions; each member once."""
    pair = ["list_id", "contact_id"]
    out = members.select(*pair)
    if remove is not None:
        out = out.join(remove.select(*pair).distinct(), pair, "left_anti")
    if add is not None:
        out = out.unionByName(add.select(*pair))
    return out.distinct()


def list_removals(actions: DataFrame) -> DataFrame:
    return actions.filter((F.col("type") == "remove_from_list") & t.present("change.new_value")).select(
        F.col("target.object_id").alias("list_id"), F.col("change.new_value").alias("contact_id"))


EDGE = ("from_type", "from_id", "to_type", "to_id")
# A task holds about this many edges.
EDGES_PER_TASK = 250_000


def apply_associations(edges: DataFrame, create: DataFrame | None = None, remove: DataFrame | None = None,
                       default_type: str = "contact_to_company") -> DataFrame:
    """The edge table after removals of the default type, then additions; each edge once.

    Edges, removals and additions are marked and meet in one grouping by edge. Their rows are counted
    first, so that a task holds about ``EDGES_PER_TASK`` of them whatever the size of the tables.
    """
    there, gone, added = 1, 2, 4
    keys = [*EDGE, "assoc_type"]

    def marked(df: DataFrame, assoc_type: Column, mark: int) -> DataFrame:
        return df.select(*EDGE, assoc_type.alias("assoc_type"), F.lit(mark).alias("_mark"))

    rows = marked(edges, F.coalesce("assoc_type", F.col("to_type")), there)
    if remove is not None:
        # an edge with a null equals no other, so no removal meets it
        rows = rows.unionByName(marked(remove.dropna(subset=list(EDGE)), F.lit(default_type), gone))
    if create is not None:
        new = require_columns(create, ["assoc_type"])
        new = new.filter(t.present("to_type") & t.present("to_id"))
        rows = rows.unionByName(marked(new, F.coalesce(t.nonempty("assoc_type"), F.lit(default_type)), added))
    dealt = spread_keys(rows, keys, rows.count(), EDGES_PER_TASK)
    marks = dealt.groupBy(*keys).agg(F.bit_or("_mark").alias("_marks"))
    return marks.filter((F.col("_marks") == there) | (F.col("_marks") >= added)).select(*keys)


def association_actions(actions: DataFrame) -> DataFrame:
    value = F.col("change.new_value")
    return actions.filter(F.col("type") == "create_association").select(
        F.col("target.object_type").alias("from_type"), F.col("target.object_id").alias("from_id"),
        F.get_json_object(value, "$.type").alias("to_type"), F.get_json_object(value, "$.id").alias("to_id"))


def bulk_changes(table: DataFrame, condition: Column, values: dict[str, str]) -> DataFrame:
    """The change set that gives every row meeting ``condition`` new property values."""
    sets = F.array(*[F.struct(F.lit(p).alias("property"), F.lit(v).alias("value")) for p, v in values.items()])
    return table.filter(condition).select("id", F.inline(sets)).withColumn("seq", F.col("id"))


def preview_update(table: DataFrame, condition: Column, values: dict[str, str]) -> DataFrame:
    """One row: how many rows match, and how many of them a bulk update would change."""
    differs = F.lit(False)
    for name, value in values.items():
        differs = differs | ~F.col(name).eqNullSafe(F.lit(value))
    hit = F.coalesce(condition, F.lit(False))
    return table.agg(F.count_if(hit).alias("matching"), F.count_if(hit & differs).alias("changing"))


def bulk_update(table: DataFrame, condition: Column, values: dict[str, str]) -> DataFrame:
    """Update the matching rows in place: a projection, as the condition is in the row."""
    return table.withColumns({p: F.when(condition, F.lit(v)).otherwise(F.col(p)) for p, v in values.items()})
