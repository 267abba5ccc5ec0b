"""Near-duplicate documents through SetSketch registers.

The set of a document holds its distinct word shingles. Register ``i`` keeps the smallest
value of hash ``i`` over the set, as the number of the exponentially spaced interval it
falls in, cut off at both ends; the registers of a union are the maxima, so sketches merge.
Groups of registers (bands) are the keys of candidate pairs. For a pair, the numbers of larger,
smaller and equal registers give the most likely similarity; what is clearly too low is
dropped, and the others are confirmed on their full sets.

Equal sets are one class from the start, and only classes are compared. In a band bucket
every class meets the smallest and the largest one; after the links found so have been joined
to components, classes of a bucket still apart meet each other. So a large group of near
copies costs a linear number of comparisons, and no candidate is left out.

A document below ``words`` words is one shingle; without words it has an empty set and no
links. Rows without an id, and nulls as texts, have no links either. An id names one
document: rows that repeat it share its component. Other columns are left out.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from rowmender.llm.common import map_rows, pa_schema, slices, utf8, written
from rowmender.operators.components import connected

WORDS = re.compile(rb"[^\x20\x09-\x0D]+").findall
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


@dataclass(frozen=True)
class SketchSettings:
    words: int = 5
    percent: int = 80  # 100 * intersection >= percent * union
    bands: int = 40
    rows: int = 6
    base: float = 1.02
    rate: float = 32.0
    intervals: int = 4094
    chunk: int = 2048  # classes of a bucket that one task compares
    task_rows: int = 2000  # about as many rows of smaller buckets share a task
    slack: float = 0.15  # how far below the limit an estimate may lie: over five deviations

    @property
    def registers(self) -> int:
        return self.bands * self.rows


class Shingles:
    """The sorted 64-bit hashes of the distinct shingles of a text."""

    def __init__(self, words: int):
        self.width = words
        self.memo: dict[bytes, int] = {}

    def __call__(self, text: bytes) -> np.ndarray:
        words = WORDS(text.lower())  # of bytes: A-Z only
        if not words:
            return np.zeros(0, np.uint64)
        if len(words) < self.width:
            return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], np.uint64)
        memo = self.memo
        if len(memo) > 500_000:
            memo.clear()
        get = memo.get
        codes = []
        for w in words:
            code = get(w)
            if code is None:
                code = memo[w] = xxhash.xxh3_64_intdigest(w)
            codes.append(code)
        h = np.array(codes, np.uint64)
        count = len(h) - self.width + 1
        out = np.zeros(count, np.uint64)
        for i in range(self.width):
            out = (out ^ h[i : i + count]) * FACTORS[i % 4]
            out ^= out >> np.uint64(29)
        return np.unique(out)


def register_values(shingles: np.ndarray, settings: SketchSettings, factors: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    values = (shingles >> np.uint64(32)).astype(np.uint32) ^ shingles.astype(np.uint32)
    low = np.full(settings.registers, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(values), 512):
        part = values[at : at + 512, None] * factors
        part += shifts
        np.minimum(low, part.min(axis=0), out=low)
    exponential = -np.log1p(-(low.astype(np.float64) + 0.5) / 4294967296.0)
    numbers = np.floor(1 - np.log(exponential / settings.rate) / np.log(settings.base))
    return np.clip(numbers, 0, settings.intervals + 1).astype("<u2")


def likely_similarity(above: np.ndarray, below: np.ndarray, equal: np.ndarray, share: np.ndarray, base: float) -> np.ndarray:
    """Most likely similarity from register comparisons; ``share`` is n1 / (n1 + n2)."""
    grid = np.linspace(0, 1, 101)[None, :]
    u, v = share[:, None], 1 - share[:, None]
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (base - 1) / base) / np.log(base)
    more, less = p(u - v * grid), p(v - u * grid)
    same = 1 - more - less
    possible = grid <= np.minimum(u / v, v / u) + 1e-9
    log = lambda x: np.log(np.maximum(x, 1e-12))
    fit = above[:, None] * log(more) + below[:, None] * log(less) + equal[:, None] * log(same)
    return grid[0][np.argmax(np.where(possible, fit, -np.inf), axis=1)]


def sketch(docs: DataFrame, settings: SketchSettings) -> DataFrame:
    """doc_id, set size, two hashes of the set, registers."""

    def make():
        rng = np.random.Generator(np.random.PCG64(7))
        factors = rng.integers(0, 1 << 31, settings.registers, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        shifts = rng.integers(0, 1 << 32, settings.registers, dtype=np.uint32)
        shingles = Shingles(settings.words)

        def work(cols):
            out = {c: [] for c in ("doc_id", "n_shingles", "s1", "s2", "registers")}
            for doc, text in zip(cols["doc_id"], cols["text"]):
                own = shingles(utf8(text))
                digest = np.frombuffer(xxhash.xxh3_128_digest(own.tobytes()), "<i8").tolist() if len(own) else (None, None)
                regs = register_values(own, settings, factors, shifts).tobytes() if len(own) else None
                for name, value in (("doc_id", doc), ("n_shingles", len(own)), ("s1", digest[0]), ("s2", digest[1]), ("registers", regs)):
                    out[name].append(value)
            return out

        return work

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_rows(docs.select("doc_id", "text"), make, f"doc_id {kind}, n_shingles bigint, s1 bigint, s2 bigint, registers binary")


def bands(classes: DataFrame, settings: SketchSettings) -> DataFrame:
    """(bucket, node): one row per band."""

    def make():
        def work(cols):
            out = {"bucket": [], "node": []}
            for node, regs in zip(cols["node"], cols["registers"]):
                out["bucket"] += band_keys(regs, settings)
                out["node"] += [node] * settings.bands
            return out

        return work

    kind = classes.schema["node"].dataType.simpleString()
    return map_rows(classes.select("node", "registers"), make, f"bucket bigint, node {kind}")


def promising(pairs: DataFrame, classes: DataFrame, settings: SketchSettings) -> DataFrame:
    """The pairs (a, b) whose likely similarity is not clearly too low."""
    side = lambda x: classes.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("registers").alias(f"r{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "ra", "rb")

    def make():
        def work(cols):
            if not cols["a"]:
                return {"a": [], "b": []}
            ra, rb = (np.frombuffer(b"".join(cols[x]), "<u2").reshape(-1, settings.registers) for x in ("ra", "rb"))
            na, nb = np.array(cols["na"], float), np.array(cols["nb"], float)
            above, below = (ra > rb).sum(1), (ra < rb).sum(1)
            found = likely_similarity(above, below, settings.registers - above - below, na / (na + nb), settings.base)
            keep = np.flatnonzero(found >= settings.percent / 100 - settings.slack)
            return {x: [cols[x][i] for i in keep] for x in ("a", "b")}

        return work

    kind = classes.schema["node"].dataType.simpleString()
    return map_rows(both, make, f"a {kind}, b {kind}")


def confirmed(pairs: DataFrame, bodies: DataFrame, settings: SketchSettings) -> DataFrame:
    """The pairs that reach the limit on their full sets; ``bodies`` has node and _z."""
    side = lambda x: bodies.select(F.col("node").alias(x), F.col("_z").alias(f"z{x}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "za", "zb")

    def make():
        unpress = zstandard.ZstdDecompressor()
        shingles = Shingles(settings.words)
        last: dict[object, np.ndarray] = {}

        def shingled(node, z):
            if node not in last:
                if len(last) >= 64:
                    last.clear()
                last[node] = shingles(unpress.decompress(z))
            return last[node]

        def work(cols):
            out = {"a": [], "b": []}
            for a, b, za, zb in zip(cols["a"], cols["b"], cols["za"], cols["zb"]):
                if similar(shingled(a, za), shingled(b, zb), settings):
                    out["a"].append(a)
                    out["b"].append(b)
            return out

        return work

    kind = bodies.schema["node"].dataType.simpleString()
    return map_rows(both, make, f"a {kind}, b {kind}")


def links_across(members: DataFrame, sets: DataFrame, classes: DataFrame, bodies: DataFrame, settings: SketchSettings) -> DataFrame:
    """Links (a, b) between classes of a bucket whose components are still apart.

    The two classes that all others of a bucket met are left out. A bucket, or two chunks of
    a large one, is a group of its own; only small buckets share one. It returns confirmed links
    only: a pair is looked at in the first band that it shares, unless its components have met meanwhile.
    """
    apart = members.filter("node <> low and node <> high").join(sets.withColumnRenamed("id", "node"), "node", "left").select(
        "bucket", "node", F.coalesce("set_id", "node").alias("set_id"))
    split = apart.groupBy("bucket").agg(F.min("set_id").alias("x"), F.max("set_id").alias("y"), F.count(F.lit(1)).alias("m")).filter("x < y")
    small = (F.col("m") <= settings.chunk) & (F.col("m") <= settings.task_rows // 16)
    split = split.select("bucket", F.ceil(F.col("m") / settings.chunk).cast("int").alias("chunks"), small.alias("small"))
    apart, _ = written(apart.join(split, "bucket"), "apart")
    slots = 1 + apart.filter("small").count() // settings.task_rows
    own = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    dealt = apart.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(
        "bucket", "node", "set_id", "own", "small", F.least("own", "other").alias("c1"), F.greatest("own", "other").alias("c2"))
    rows = dealt.join(classes.select("node", "n_shingles", "registers"), "node").join(bodies, "node").withColumn(
        "slot", F.when(F.col("small"), F.pmod(F.xxhash64("bucket"), F.lit(slots)))).withColumn("alone", F.when(~F.col("small"), F.col("bucket")))
    kind = classes.schema["node"].dataType.simpleString()
    schema = f"a {kind}, b {kind}"
    return rows.groupBy("slot", "alone", "c1", "c2").applyInArrow(bucket_task(settings, pa_schema(members.sparkSession, schema)), schema)


def band_keys(registers: bytes, settings: SketchSettings) -> list[int]:
    size = 2 * settings.rows
    return [xxhash.xxh3_64_intdigest(registers[i * size : (i + 1) * size], seed=i) - (1 << 63) for i in range(settings.bands)]


def bucket_task(settings: SketchSettings, types: pa.Schema):
    def close(bucket: int, rows: list[dict], crossing: bool, shingled) -> list[tuple]:
        rows.sort(key=lambda r: r["node"])
        keys = np.array([band_keys(r["registers"], settings) for r in rows])
        registers = np.frombuffer(b"".join(r["registers"] for r in rows), "<u2").reshape(len(rows), -1)
        sizes = np.array([r["n_shingles"] for r in rows], float)
        chunks = np.array([r["own"] for r in rows])
        numbers = {s: i for i, s in enumerate(sorted({r["set_id"] for r in rows}))}
        sets = np.array([numbers[r["set_id"]] for r in rows])  # merged as links are found
        band = int(np.argmax(keys[0] == bucket))
        least = settings.percent / 100 - settings.slack
        found = []
        for i in range(len(rows) - 1):
            j = np.arange(i + 1, len(rows))
            j = j[(sets[j] != sets[i]) & ((chunks[j] != chunks[i]) if crossing else True)]
            j = j[(keys[j] == keys[i]).argmax(axis=1) == band]
            if not len(j):
                continue
            equal = (registers[j] == registers[i]).sum(axis=1)
            # equal registers never fall short of the similarity by more than chance does
            likely = equal >= (least - 0.05) * settings.registers
            j, equal = j[likely], equal[likely]
            if not len(j):
                continue
            above = (registers[i] > registers[j]).sum(axis=1)
            share = sizes[i] / (sizes[i] + sizes[j])
            guess = likely_similarity(above, settings.registers - above - equal, equal, share, settings.base)
            for k in j[guess >= least].tolist():
                if sets[k] == sets[i]:
                    continue
                if similar(shingled(rows[i]), shingled(rows[k]), settings):
                    found.append((rows[i]["node"], rows[k]["node"]))
                    sets[sets == sets[k]] = sets[i]
        return found

    def step(table):
        unpress = zstandard.ZstdDecompressor()
        shingles = Shingles(settings.words)
        memo: dict[object, np.ndarray] = {}

        def shingled(row):
            if row["node"] not in memo:
                memo[row["node"]] = shingles(unpress.decompress(row["_z"]))
            return memo[row["node"]]

        groups: dict[tuple, list[dict]] = {}
        for row in table.to_pylist():
            groups.setdefault((row["bucket"], row["c1"], row["c2"]), []).append(row)
        links: set[tuple] = set()
        for (bucket, c1, c2), rows in sorted(groups.items()):
            links.update(close(bucket, rows, c1 != c2, shingled))
            if len(memo) > 10_000:
                memo.clear()
        return pa.Table.from_pydict({"a": [a for a, _ in links], "b": [b for _, b in links]}, schema=types)

    return step


def similar(x: np.ndarray, y: np.ndarray, settings: SketchSettings) -> bool:
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * shared >= settings.percent * (len(x) + len(y) - shared)


def compressed(docs: DataFrame) -> DataFrame:
    """node and compressed text."""
    kind = docs.schema["node"].dataType.simpleString()
    types = pa_schema(docs.sparkSession, f"node {kind}, _z binary")

    def run(batches):
        press = zstandard.ZstdCompressor(level=1)
        for part in slices(batches):
            blobs = pa.array([press.compress(utf8(t)) for t in part.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0).cast(types.field(0).type), blobs], schema=types)

    return docs.select("node", "text").mapInArrow(run, f"node {kind}, _z binary")


def components(docs: DataFrame, settings: SketchSettings = SketchSettings()) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable) and kept of every row."""
    sketches, _ = written(sketch(docs, settings), "sketches")
    classes, _ = written(
        sketches.filter("n_shingles > 0 and doc_id is not null").groupBy("s1", "s2").agg(F.min(F.struct("doc_id", "n_shingles", "registers")).alias("x")).select(
            "s1", "s2", F.col("x.doc_id").alias("node"), F.col("x.n_shingles").alias("n_shingles"), F.col("x.registers").alias("registers")), "classes")
    banded = bands(classes, settings)
    full = banded.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high")
    members, _ = written(banded.join(full, "bucket"), "members")
    stars = members.select(F.explode(F.array(F.struct(F.col("low").alias("a"), F.col("node").alias("b")), F.struct(F.col("node").alias("a"), F.col("high").alias("b")))).alias("p"))
    first, _ = written(promising(stars.select("p.a", "p.b").filter("a < b").distinct(), classes, settings), "pairs")
    wanted = members.select("node").distinct()
    bodies = compressed(docs.select(F.col("doc_id").alias("node"), "text")).join(wanted, "node", "left_semi")
    bodies, _ = written(bodies.dropDuplicates(["node"]), "bodies")
    links, _ = written(confirmed(first, bodies, settings), "near")
    sets, _ = written(connected(links.select(F.col("a").alias("id_1"), F.col("b").alias("id_2"))), "sets")
    more, _ = written(links_across(members, sets, classes, bodies, settings), "near")
    if not more.isEmpty():
        known = sets.select(F.col("set_id").alias("id_1"), F.col("id").alias("id_2"))
        sets = connected(known.unionByName(more.select(F.col("a").alias("id_1"), F.col("b").alias("id_2"))))
    labels = classes.select("s1", "s2", "node").join(sets.withColumnRenamed("id", "node"), "node", "left").select(
        "s1", "s2", F.coalesce("set_id", "node").alias("component_id"))
    own = sketches.select("doc_id", "n_shingles", "s1", "s2").join(labels, ["s1", "s2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return own.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
