"""A compacted trie of conversations with handles at two-fattest depths (a z-fast trie).

A conversation is a path of turns. Every prefix of a path has a key of 128 bits, the
exclusive or of hashes of (turn, position), so that keys of all prefixes come from one
running aggregate, in blocks of bounded size. Of the trie only the *nodes* are kept: prefixes that
end a conversation or branch. A node holds its depth, the depth of the node above (its ``top``),
a conversation that runs through it, and its *handle*: the prefix key at the two-fattest
depth in (top, depth], the one divisible by the highest power of two.

Conversations are inserted in batches, each as large as all before. A fat binary search
finds the exit of each: it asks for the handle at the two-fattest depth of what is left
of the path, and goes on below the node that has it or above that depth, so there are
as many rounds as the length has binary digits, each a join. Only the turns beyond the deepest
node above the exit, and those of the edges that are hit, are looked at again; there prefixes
that end or branch become nodes, and edges are cut. At last edges are expanded to one row per prefix.

Copies count as one path from the start. All is joins and aggregates; Python takes part
in hashing the ids that end in a node alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, Window

from rowmender.llm.common import drop_path, pa_schema, scratch_path, written
from rowmender.operators.skew import position_within, salted_join

BLOCK = 1024  # turns of a conversation whose keys are aggregated together
KEY = ["depth", "h1", "h2"]


@dataclass(frozen=True)
class TrieSettings:
    first: int = 1_000_000  # paths of the first batch at most, unless two batches are enough
    batches: int = 3  # at least


def two_fattest(low: Column, high: Column) -> Column:
    """The number in (low, high] that the highest power of two divides."""
    bits = F.length(F.bin(low.bitwiseXOR(high))) - 1
    step = F.call_function("shiftleft", F.lit(1).cast("long"), bits)
    return (high - F.pmod(high, step)).cast("long")


def turn_rows(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, t1, t2, words): texts reduced to a hash of role and text and a number of words."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return conversations.filter("conv_id is not null").select(
        "conv_id", "turn", F.xxhash64(role, text).alias("t1"), F.xxhash64(F.lit(1), text, role).alias("t2"),
        F.size(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")).cast("long").alias("words"))


def numbered(turns: DataFrame) -> DataFrame:
    """``turns`` with their place ``pos`` in the conversation, by turn, nulls first, then by content."""
    return position_within(turns, ["conv_id"], ["turn", "t1", "t2"], "pos").drop("turn")


def with_shared_heads(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt on the first turns of every twentieth one: (conv_id, depth, t1, t2, words), and all ids.

    The first h turns of conversation c - c % 20 stand for the first h turns of c, h = crc32(c) % 4.
    """
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4
    base = F.col("conv_id") - F.col("conv_id") % 20
    ids = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    shared = turns.filter((F.col("conv_id") % 20 == 0) & (F.col("pos") <= 3)).withColumnRenamed("conv_id", "base")
    own_heads = ids.select("conv_id", base.alias("base"), head.alias("h"))
    heads = own_heads.join(shared, "base").filter("pos <= h").select("conv_id", F.col("pos").alias("depth"), "t1", "t2", "words")
    there = shared.groupBy("base").agg(F.count(F.lit(1)).alias("n_base"))
    rest = turns.withColumn("base", base).withColumn("h", head).filter("pos > h")
    rest = salted_join(rest, there, ["base"], "left", ["conv_id", "pos"])
    depth = F.least("h", F.coalesce("n_base", F.lit(0))) + F.col("pos") - F.col("h")
    return heads.unionByName(rest.select("conv_id", depth.alias("depth"), "t1", "t2", "words")), ids.select("conv_id")


def prefix_keys(turns: DataFrame) -> DataFrame:
    """(conv, depth, h1, h2, b1, b2, words, total): the key of each prefix, that of the prefix before, words so far."""
    marked = turns.select(
        F.col("conv_id").alias("conv"), F.col("depth").cast("long").alias("depth"), "words", F.xxhash64("t1", "t2", "depth").alias("x1"),
        F.xxhash64("depth", "t2", "t1").alias("x2"), F.floor((F.col("depth") - 1) / BLOCK).alias("block"))
    inside = Window.partitionBy("conv", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    run = marked.select("*", F.bit_xor("x1").over(inside).alias("r1"), F.bit_xor("x2").over(inside).alias("r2"), F.sum("words").over(inside).alias("r3"))
    blocks = marked.groupBy("conv", "block").agg(F.bit_xor("x1").alias("o1"), F.bit_xor("x2").alias("o2"), F.sum("words").alias("o3"))
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("conv", "block", *[F.coalesce(f(c).over(before), F.lit(0)).alias(c) for f, c in ((F.bit_xor, "o1"), (F.bit_xor, "o2"), (F.sum, "o3"))])
    keyed = run.join(offsets, ["conv", "block"]).select(
        "conv", "depth", F.col("r1").bitwiseXOR(F.col("o1")).alias("h1"), F.col("r2").bitwiseXOR(F.col("o2")).alias("h2"), "x1", "x2", "words", (F.col("r3") + F.col("o3")).alias("total"))
    return keyed.select("conv", "depth", "h1", "h2", F.col("h1").bitwiseXOR(F.col("x1")).alias("b1"), F.col("h2").bitwiseXOR(F.col("x2")).alias("b2"), "words", "total")


class Trie:
    """Nodes but the root in a written table: depth, h1, h2, top, path, handle, g1, g2, f1, f2.

    ``f1, f2`` is the key at depth top + 1, which tells edges of a node apart.
    """

    def __init__(self, prefixes: DataFrame) -> None:
        self.prefixes = prefixes
        self.nodes: DataFrame | None = None
        self.path: str | None = None

    def key_at(self, rows: DataFrame, conv: str, depth: Column, names: Sequence[str]) -> DataFrame:
        """``rows`` with the prefix key of their conversation at a depth."""
        keys = self.prefixes.select(F.col("conv").alias("_conv"), F.col("depth").alias("_depth"), F.col("h1").alias(names[0]), F.col("h2").alias(names[1]))
        return rows.withColumn("_at", depth).join(keys, (F.col(conv) == F.col("_conv")) & (F.col("_at") == F.col("_depth"))).drop("_conv", "_depth", "_at")

    def exits(self, paths: DataFrame) -> tuple[DataFrame, list[str]]:
        """(conv, len, above) of each path: the depth of the deepest node on it, 0 for the root; and what may be dropped later."""
        start = paths.select("conv", "len", F.lit(0).cast("long").alias("a"), F.col("len").alias("b"), F.lit(0).cast("long").alias("top"))
        zero = F.lit(0).cast("long")
        state, used = start.withColumns({"u1": zero, "u2": zero}), []
        handles = self.nodes.select("handle", "g1", "g2", F.col("depth").alias("node"), F.col("top").alias("node_top"), F.col("h1").alias("n1"), F.col("h2").alias("n2"))
        done = []
        while True:
            asked = self.key_at(state.withColumn("handle", two_fattest(F.col("a"), F.col("b"))), "conv", F.col("handle"), ["g1", "g2"])
            met = asked.join(handles, ["handle", "g1", "g2"], "left")
            found = F.col("node").isNotNull()
            moved, path = written(met.select(
                "conv", "len", F.when(found, F.col("node")).otherwise(F.col("a")).alias("a"), F.when(found, F.col("b")).otherwise(F.col("handle") - 1).alias("b"),
                F.when(found, F.col("node_top")).otherwise(F.col("top")).alias("top"), *[F.when(found, F.col(n)).otherwise(F.col(u)).alias(u) for n, u in (("n1", "u1"), ("n2", "u2"))]), "trie-round")
            used.append(path)
            done.append(moved.filter("a >= b"))
            state = moved.filter("a < b")
            if state.isEmpty():
                break
        last = done[0]
        for part in done[1:]:
            last = last.unionByName(part)
        # the last node met is on the path as a whole, or the path leaves it on its edge
        whole = self.prefixes.select("conv", F.col("depth").alias("a"), F.col("h1").alias("u1"), F.col("h2").alias("u2"), F.lit(True).alias("whole"))
        judged = last.join(whole, ["conv", "a", "u1", "u2"], "left")
        return judged.select("conv", "len", F.when(F.col("whole"), F.col("a")).otherwise(F.col("top")).alias("above")), used

    def insert(self, paths: DataFrame) -> None:
        """Add the paths (conv, len), which are new and differ from each other."""
        used: list[str] = []
        if self.nodes is None:
            located = paths.select("conv", "len", F.lit(0).cast("long").alias("above"))
        else:
            located, used = self.exits(paths)
        located, path = written(located, "trie-exits")
        used.append(path)
        own = self.prefixes.join(located, "conv").filter(F.col("depth") > F.col("above"))
        rows = own.select("conv", *KEY, "b1", "b2", "above", (F.col("depth") == F.col("len")).alias("stop"))
        cut = None
        if self.nodes is not None:
            first = rows.filter(F.col("depth") == F.col("above") + 1).select(F.col("above").alias("top"), F.col("h1").alias("f1"), F.col("h2").alias("f2")).distinct()
            cut, path = written(self.nodes.join(first, ["top", "f1", "f2"], "left_semi").select(*KEY, "top", "path"), "trie-cut")
            used.append(path)
            span = cut.select(F.col("path").alias("conv"), "top", F.col("depth").alias("bottom"))
            edge = self.prefixes.join(span, "conv").filter((F.col("depth") > F.col("top")) & (F.col("depth") <= F.col("bottom")))
            rows = rows.unionByName(edge.select("conv", *KEY, "b1", "b2", F.col("top").alias("above"), (F.col("depth") == F.col("bottom")).alias("stop")))
        rows, path = written(rows, "trie-rows")
        used.append(path)
        # a prefix is a node where a path stops or two go on differently
        merged = rows.groupBy(*KEY).agg(F.first("b1").alias("b1"), F.first("b2").alias("b2"), F.min("conv").alias("path"), F.max("stop").alias("stop"))
        onward = merged.groupBy((F.col("depth") - 1).alias("depth"), F.col("b1").alias("h1"), F.col("b2").alias("h2")).agg(F.count(F.lit(1)).alias("ways"))
        made = merged.join(onward, KEY, "left").filter("stop or ways > 1").select(*KEY, "path")
        # the node above each, along the path that it keeps
        along = rows.select("conv", *KEY, "above").distinct().join(made, KEY)
        above = F.lag("depth").over(Window.partitionBy("conv", "above").orderBy("depth"))
        placed = along.withColumn("top", F.coalesce(above, F.col("above"))).filter("conv = path").select(*KEY, "top", "path")
        handled = self.key_at(placed.withColumn("handle", two_fattest(F.col("top"), F.col("depth"))), "path", F.col("handle"), ["g1", "g2"])
        new = self.key_at(handled, "path", F.col("top") + 1, ["f1", "f2"])
        if self.nodes is not None:
            new = self.nodes.join(cut, KEY, "left_anti").unionByName(new)
        before, self.path = self.path, scratch_path(rows.sparkSession, "trie")
        new.write.parquet(self.path)
        self.nodes = rows.sparkSession.read.schema(new.schema).parquet(self.path)
        for path in [*used, *([before] if before else [])]:
            drop_path(rows.sparkSession, path)


def build(prefixes: DataFrame, paths: DataFrame, settings: TrieSettings) -> Trie:
    """The trie of ``paths`` (conv, len), inserted in batches that double."""
    trie, number = Trie(prefixes), paths.count()
    batches = max(settings.batches, (max(number - 1, 0) // settings.first).bit_length() + 1)
    share = F.pmod(F.xxhash64("conv"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    low = 0.0
    for turn in range(batches):
        high = 0.5 ** (batches - 1 - turn)
        batch = paths.filter((share >= low) & (share < high))
        low = high
        if not batch.isEmpty():
            trie.insert(batch)
    return trie


def member_hashes(ends: DataFrame) -> DataFrame:
    """(depth, h1, h2, ends_sha256) of the ids that end there, ascending, hashed as they stream by."""
    spark = ends.sparkSession
    schema = "depth bigint, h1 bigint, h2 bigint, ends_sha256 string"
    types = pa_schema(spark, schema)

    def run(batches):
        key, digest = None, None
        for part in batches:
            out = []
            for *now, conv in zip(*[part.column(c).to_pylist() for c in (*KEY, "conv")]):
                if now != key:
                    if key is not None:
                        out.append((*key, digest.hexdigest()))
                    key, digest = now, hashlib.sha256(str(conv).encode())
                else:
                    digest.update(b",%d" % conv)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(types)], schema=types)
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*key, digest.hexdigest()), types)], schema=types)

    return ends.select(*KEY, "conv").repartition(*KEY).sortWithinPartitions(*KEY, "conv").mapInArrow(run, schema)


def prefix_nodes(turns: DataFrame, ids: DataFrame, settings: TrieSettings = TrieSettings()) -> DataFrame:
    """One row per distinct prefix of the conversations, from the expanded trie.

    ``turns`` has (conv_id, depth from 1 without gaps, t1, t2, words), ``ids`` all conv_id, those
    without turns too. Gives conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens and ends_sha256. Without conversations there is no row, not even a root.
    """
    spark = turns.sparkSession
    prefixes, prefixes_path = written(prefix_keys(turns), "trie-prefixes")
    used = [prefixes_path]

    # copies are one path, kept under the smallest id
    last = prefixes.groupBy("conv").agg(F.max(F.struct(*KEY)).alias("e"))
    zero = F.lit(0).cast("long")
    everyone = ids.select(F.col("conv_id").alias("conv")).join(last, "conv", "left")
    ends, path = written(everyone.select("conv", *[F.coalesce(F.col(f"e.{c}"), zero).alias(c) for c in KEY]), "trie-ends")
    used.append(path)
    paths, path = written(ends.groupBy(*KEY).agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n")), "trie-paths")
    used.append(path)
    trie = build(prefixes, paths.filter("depth > 0").select("conv", F.col("depth").alias("len")), settings)

    # every turn of every path, marked where it is a node; the root stands before all
    kept = prefixes.join(paths.select("conv"), "conv", "left_semi").select("conv", *KEY, "words", "total")
    if trie.nodes is None:
        marked = kept.withColumn("node", F.lit(True))
    else:
        marked = kept.join(trie.nodes.select(*KEY, F.lit(True).alias("node")), KEY, "left")
    root = paths.select("conv", *[zero.alias(c) for c in KEY], zero.alias("words"), zero.alias("total"), F.lit(True).alias("node"))
    marked, path = written(marked.unionByName(root), "trie-marked")
    used.append(path)

    down = Window.partitionBy("conv").orderBy("depth")
    lines = marked.filter("node").select(
        "conv", *KEY, "total", *[F.lag(c).over(down).alias(a) for c, a in (("depth", "top"), ("h1", "p1"), ("h2", "p2"), ("total", "total_top"))],
        F.lead("depth").over(down).isNull().alias("ends_here"))
    lines, path = written(lines.join(paths.select("conv", "n"), "conv"), "trie-lines")
    used.append(path)
    sizes = lines.groupBy(*KEY).agg(F.sum("n").alias("n_convs"), F.min("conv").alias("owner"))
    sizes, path = written(sizes, "trie-sizes")
    used.append(path)
    # each node once, by its owner: what it adds to the nodes above
    hot = [r for r in _hot(lines)]
    owned = salted_join(lines, sizes, KEY, "inner", ["conv"], hot).withColumn("own", F.col("conv") == F.col("owner"))
    edge = F.when(F.col("own") & F.col("top").isNotNull(), (F.col("n_convs") - 1) * (F.col("total") - F.col("total_top"))).otherwise(0)
    children = owned.filter("own and top is not null").groupBy(F.col("top").alias("depth"), F.col("p1").alias("h1"), F.col("p2").alias("h2")).agg(F.count(F.lit(1)).alias("n_children"))
    sizes, path = written(sizes.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", zero)), "trie-children")
    used.append(path)
    leaves = lines.filter("ends_here").select("conv", *KEY).join(sizes.filter("n_children = 0").select(*KEY), KEY, "left_semi").select("conv", F.lit(1).alias("leaf"))
    up = Window.partitionBy("conv").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, -1)
    gathered = owned.withColumn("edge", edge).withColumn("under", F.coalesce(F.sum("edge").over(up), zero)).join(leaves, "conv", "left")
    sums = gathered.groupBy(*KEY).agg(F.sum("under").alias("under"), F.sum(F.coalesce("leaf", F.lit(0))).cast("long").alias("n_leaves"))
    upper = owned.filter("own").select(*KEY, F.col("top"), F.col("p1"), F.col("p2"), F.col("total").alias("total_here"))
    stats = sizes.join(sums, KEY).join(upper, KEY).join(member_hashes(ends), KEY, "left")
    over = sizes.select(F.col("depth").alias("top"), F.col("h1").alias("p1"), F.col("h2").alias("p2"), F.col("owner").alias("over"))
    stats, path = written(stats.join(over, ["top", "p1", "p2"], "left").drop("p1", "p2"), "trie-stats")
    used.append(path)

    # edges, expanded along the path of the owner: every turn belongs to the next node below
    info = F.struct("depth", "owner", "over", "top", "n_convs", "n_children", "n_leaves", "under", "total_here", "ends_sha256").alias("info")
    placed = marked.drop("node").join(stats.select(*KEY, info), KEY, "left")
    below = F.last("info", ignorenulls=True).over(Window.partitionBy("conv").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0))
    rows = placed.withColumn("info", below).filter("info.owner = conv and depth > coalesce(info.top, -1)")
    at_node = F.col("depth") == F.col("info.depth")
    none = hashlib.sha256(b"").hexdigest()
    result = rows.select(
        F.col("conv").alias("conv_id"), "depth",
        F.when(F.col("depth") == F.col("info.top") + 1, F.col("info.over")).when(F.col("depth") > 0, F.col("conv")).alias("parent_conv_id"),
        "info.n_convs", F.when(at_node, F.col("info.n_children")).otherwise(1).alias("n_children"), "info.n_leaves",
        (F.col("info.under") + (F.col("info.n_convs") - 1) * (F.col("info.total_here") - F.col("total") + F.col("words"))).alias("saved_tokens"),
        F.when(at_node, F.coalesce("info.ends_sha256", F.lit(none))).otherwise(none).alias("ends_sha256"))
    done, _ = written(result, "trie-result")
    for path in [*used, *([trie.path] if trie.path else [])]:
        drop_path(spark, path)
    return done


def _hot(lines: DataFrame) -> list:
    from rowmender.operators.skew import hot_keys

    return hot_keys(lines, KEY)


def conversation_trie(conversations: DataFrame, settings: TrieSettings = TrieSettings()) -> DataFrame:
    """The prefix nodes of conversations rebuilt on shared heads, see :func:`prefix_nodes`.

    Turns are ordered by ``turn``, nulls first; turns of one number stand in an order given
    by their content. Null roles and texts are empty. Rows without a conv_id are left out;
    repeated rows are turns of their own; further columns are left out.
    """
    turns, turns_path = written(numbered(turn_rows(conversations)), "trie-turns")
    rebuilt, ids = with_shared_heads(turns)
    done = prefix_nodes(rebuilt, ids, settings)
    drop_path(conversations.sparkSession, turns_path)
    return done
