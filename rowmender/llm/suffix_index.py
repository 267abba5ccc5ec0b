"""Removal of long repeated byte strings by a logarithmic family of suffix arrays.

Every string of ``length`` bytes that also starts elsewhere is found, in all texts
together, and each byte that such a string covers is removed.

1. Texts are cut into segments (:mod:`.windows`). Equal strings share the key of their
   segment, so only keys that occur twice can hold repeats; of a segment whose whole
   content recurs, all strings are repeats and nothing has to be sorted.
2. For the other recurring keys, one text of each distinct segment enters the index.
   The index is a family of levels; a level is a suffix array (the sorted starts of all
   strings of ``length`` bytes) in shards by key. Texts arrive in batches: a batch gets
   its suffix array, is merge-scanned against every level, where neighbours in the
   merged order that agree in ``length`` bytes are repeats, and merges with the levels
   of its own size, so ``b`` batches leave ``log2(b)`` levels.
3. The repeats of the distinct segments are carried back to all their occurrences.

A key with very many distinct segments would overload its shard. Its strings are spread
by their own 128-bit hash and counted instead, with the same outcome.

With ``unit="words"`` a text is the sequence of its words instead, four hashed bytes to a
word; whole words are then removed, each with the blanks behind it.

Nulls count as empty texts; texts shorter than ``length`` keep all bytes; repeated rows
are repeats of each other. All columns but the text pass through, whatever their names,
save those that have the name of an added one.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from rowmender.llm.common import drop_path, map_rows, pa_schema, slices, utf8, written
from rowmender.llm.windows import Powers, segments

PART = "shard int, level int, keys binary, lens binary, body binary, starts binary"
RAW, MATCH = -1, -2
ADDED = ("kept", "n_bytes", "n_removed", "n_spans")


@dataclass(frozen=True)
class RepeatSettings:
    length: int = 400  # bytes, or four for each word
    unit: str = "bytes"
    gram: int = 200  # at most ``length``; smaller values make fewer but less selective segments
    batches: int = 4
    longest_segment: int = 1024
    hot_segments: int = 500  # a key with more distinct segments is spread by string
    shard_windows: int = 100_000


#: Bytes that stand for a word; chance equality of 50 such words in a row is out of the question.
SYMBOL = 4
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def word_settings(count: int, **settings) -> RepeatSettings:
    """Settings for repeats of ``count`` words and more."""
    return RepeatSettings(length=SYMBOL * count, gram=SYMBOL * count // 2, unit="words", **settings)


def symbols(body: bytes, unit: str) -> bytes:
    """What is searched for repeats: the bytes of the text, or those that stand for its words."""
    if unit == "bytes":
        return body
    known: dict[bytes, bytes] = {}
    out = []
    for word in WORD.findall(body):
        code = known.get(word)
        if code is None:
            code = known[word] = xxhash.xxh3_64_intdigest(word).to_bytes(8, "little")[:SYMBOL]
        out.append(code)
    return b"".join(out)


def byte_runs(body: bytes, runs: list[list[int]], unit: str) -> list[list[int]]:
    """Runs of symbol bytes as runs of bytes of the text."""
    if unit == "bytes" or not runs:
        return runs
    starts = [m.start() for m in WORD.finditer(body)] + [len(body)]
    out = []
    for lo, hi in runs:
        first, last = -(-lo // SYMBOL), hi // SYMBOL
        if last > first:
            out.append([starts[first], starts[last]])
    return out


def signed(digest: int) -> int:
    return digest - (1 << 64) if digest >= 1 << 63 else digest


def pack_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with the text replaced by its hash and its compressed bytes."""
    kept = [c for c in docs.columns if c != text]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), "__t bigint", "__z binary"])
    types = pa_schema(docs.sparkSession, schema)

    def run(batches):
        press = zstandard.ZstdCompressor(level=1)
        for part in slices(batches):
            bodies = [utf8(x) for x in part.column(len(kept)).to_pylist()]
            hashes = pa.array([signed(xxhash.xxh3_64_intdigest(b)) for b in bodies], pa.int64())
            blobs = pa.array([press.compress(b) for b in bodies], pa.binary())
            columns = [part.column(i).cast(types.field(i).type) for i in range(len(kept))]
            yield pa.RecordBatch.from_arrays([*columns, hashes, blobs], schema=types)

    return docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`")).mapInArrow(run, schema)


def mark(docs: DataFrame, settings: RepeatSettings) -> DataFrame:
    """One row per segment: its key, its content hash, where it stands, its number of strings."""

    def make():
        powers = Powers()

        def work(cols):
            out = {c: [] for c in ("_id", "_t", "k", "c", "s", "n", "inner")}
            for doc, text in zip(cols["_id"], cols["_text"]):
                body = utf8(text)
                t = signed(xxhash.xxh3_64_intdigest(body))
                body = symbols(body, settings.unit)
                if len(body) < settings.length:
                    continue
                for key, start, count, inner in segments(body, settings.length, settings.gram, settings.longest_segment, powers):
                    content = xxhash.xxh3_64_intdigest(body[start : start + count + settings.length - 1])
                    for name, value in (("_id", doc), ("_t", t), ("k", key), ("c", signed(content)), ("s", start), ("n", count), ("inner", inner)):
                        out[name].append(value)
            return out

        return work

    kind = docs.schema["_id"].dataType.simpleString()
    return map_rows(docs, make, f"_id {kind}, _t bigint, k bigint, c bigint, s int, n int, inner boolean")


class Part:
    """A suffix array over segments of one shard: their texts joined, and the sorted starts."""

    def __init__(self, length: int, keys: bytes, lens: bytes, body: bytes, starts: bytes | None = None):
        self.length, self.keys, self.lens, self.body = length, keys, lens, body
        if starts is None:
            sizes = np.frombuffer(lens, "<i4").astype(np.int64)
            offsets = np.cumsum(sizes) - sizes
            self.starts = self.ordered([p for o, n in zip(offsets.tolist(), sizes.tolist()) for p in range(o, o + n - length + 1)])
        else:
            self.starts = np.frombuffer(starts, "<i4").tolist()

    def ordered(self, starts: list[int]) -> list[int]:
        body, length = self.body, self.length
        return sorted(starts, key=lambda p: body[p : p + length])

    def merged(self, other: Part) -> Part:
        """Both suffix arrays in one; the sort meets two sorted runs, so it is a linear merge."""
        shift = len(self.body)
        both = Part(self.length, self.keys + other.keys, self.lens + other.lens, self.body + other.body, b"")
        both.starts = both.ordered(self.starts + [p + shift for p in other.starts])
        return both

    def repeats(self) -> list[tuple[bytes, int, int]]:
        """Runs of strings that equal a neighbour in the order: segment keys, first and last string."""
        body, length = self.body, self.length
        found = np.zeros(len(body) + 1, bool)
        before, last = b"", 0
        for p in self.starts:
            here = body[p : p + length]
            if here == before:
                found[p] = found[last] = True
            before, last = here, p
        sizes = np.frombuffer(self.lens, "<i4").astype(np.int64)
        ends = np.cumsum(sizes)
        edge = np.flatnonzero(np.diff(np.concatenate([[False], found]).astype(np.int8)))
        out = []
        for lo, hi in zip(edge[::2].tolist(), edge[1::2].tolist()):
            # a run never leaves its segment: the last bytes of a segment start no string
            j = int(np.searchsorted(ends, lo, side="right"))
            base = int(ends[j] - sizes[j])
            out.append((self.keys[16 * j : 16 * j + 16], lo - base, hi - 1 - base))
        return out


def levels_after(present: set[int]) -> int:
    """The level a new batch ends in: it merges with levels 0, 1, ... as long as they are there."""
    level = 0
    while level in present:
        level += 1
    return level


def scan_and_merge(length: int, top: int, types: pa.Schema):
    """The work on one shard: array of the new texts, scan of all levels, merge with those below ``top``."""

    def step(table):
        rows = table.to_pylist()
        fresh = [r for r in rows if r["level"] == RAW]
        old = {r["level"]: Part(length, r["keys"], r["lens"], r["body"], r["starts"]) for r in rows if r["level"] != RAW}
        found: set[tuple[bytes, int, int]] = set()
        new = Part(length, b"".join(r["keys"] for r in fresh), b"".join(r["lens"] for r in fresh), b"".join(r["body"] for r in fresh))
        found.update(new.repeats())
        carried = new
        for level in sorted(old):
            if level < top:
                carried = carried.merged(old[level])
                found.update(carried.repeats())
            elif fresh:
                found.update(new.merged(old[level]).repeats())
        shard = rows[0]["shard"]
        out = [{"shard": shard, "level": MATCH, "keys": b"".join(k for k, _, _ in found), "lens": np.array([x for _, x, _ in found], "<i4").tobytes(),
                "body": None, "starts": np.array([x for _, _, x in found], "<i4").tobytes()}] if found else []
        if carried.keys:
            out.append({"shard": shard, "level": top, "keys": carried.keys, "lens": carried.lens, "body": carried.body, "starts": np.array(carried.starts, "<i4").tobytes()})
        return pa.Table.from_pylist(out, schema=types)

    return step


def index_repeats(pieces: DataFrame, settings: RepeatSettings) -> tuple[DataFrame, list[str]]:
    """Repeated strings (k, c, lo, hi) among distinct segments (shard, batch, k, c, body), and the tables they are read from."""
    spark = pieces.sparkSession
    types = pa_schema(spark, PART)
    length = settings.length
    raw = pieces.select(
        "shard", "batch", F.lit(RAW).alias("level"), F.concat(*[F.unhex(F.lpad(F.hex(x), 16, "0")) for x in ("k", "c")]).alias("keys"),
        F.octet_length("body").alias("_len"), "body")
    levels: dict[int, DataFrame] = {}
    matches, paths = [], []
    for batch in range(settings.batches):
        top = levels_after(set(levels))
        # the length of each fresh text as four bytes, lowest first
        lens = F.unhex(F.concat(*[F.lpad(F.hex(F.shiftright("_len", s).bitwiseAND(F.lit(255))), 2, "0") for s in (0, 8, 16, 24)]))
        rows = raw.filter(F.col("batch") == batch).select("shard", "level", "keys", lens.alias("lens"), "body", F.lit(None).cast("binary").alias("starts"))
        for df in levels.values():
            rows = rows.unionByName(df)
        table, path = written(rows.groupBy("shard").applyInArrow(scan_and_merge(length, top, types), PART), "suffix-level")
        paths.append(path)
        matches.append(table.filter(F.col("level") == MATCH))
        for level in range(top):
            del levels[level]
        levels[top] = table.filter(F.col("level") == top)
    found = matches[0]
    for df in matches[1:]:
        found = found.unionByName(df)

    def make():
        def work(cols):
            out = {c: [] for c in ("k", "c", "lo", "hi")}
            for keys, lo, hi in zip(cols["keys"], cols["lens"], cols["starts"]):
                pair = np.frombuffer(keys, ">i8").reshape(-1, 2)
                out["k"] += pair[:, 0].tolist()
                out["c"] += pair[:, 1].tolist()
                out["lo"] += np.frombuffer(lo, "<i4").tolist()
                out["hi"] += np.frombuffer(hi, "<i4").tolist()
            return out

        return work

    return map_rows(found.select("keys", "lens", "starts"), make, "k bigint, c bigint, lo int, hi int"), paths


def spread_repeats(pieces: DataFrame, settings: RepeatSettings) -> DataFrame:
    """The same for keys with very many segments: strings are counted by their own hash."""

    def make():
        def work(cols):
            out = {c: [] for c in ("k", "c", "p", "h1", "h2")}
            for k, c, body in zip(cols["k"], cols["c"], cols["body"]):
                for p in range(len(body) - settings.length + 1):
                    digest = xxhash.xxh3_128_intdigest(body[p : p + settings.length])
                    for name, value in (("k", k), ("c", c), ("p", p), ("h1", signed(digest >> 64)), ("h2", signed(digest & (1 << 64) - 1))):
                        out[name].append(value)
            return out

        return work

    strings = map_rows(pieces.select("k", "c", "body"), make, "k bigint, c bigint, p int, h1 bigint, h2 bigint")
    often = strings.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("h1", "h2")
    return strings.join(often, ["h1", "h2"]).select("k", "c", F.col("p").alias("lo"), F.col("p").alias("hi"))


def cut_pieces(wanted: DataFrame, packed: DataFrame, length: int, unit: str = "bytes") -> DataFrame:
    """The texts of the wanted segments (_id, _t, and columns k, c, s, n, shard, batch, hot)."""
    lists = wanted.groupBy("_id", "_t").agg(F.collect_list(F.struct("k", "c", "s", "n", "shard", "batch", "hot")).alias("want"))
    joined = packed.join(lists, packed["_id"].eqNullSafe(lists["_id"]) & (packed["__t"] == lists["_t"])).select("want", "__z")

    def make():
        unpress = zstandard.ZstdDecompressor()

        def work(cols):
            out = {c: [] for c in ("k", "c", "shard", "batch", "hot", "body")}
            for want, z in zip(cols["want"], cols["__z"]):
                body = symbols(unpress.decompress(z), unit)
                for w in want:
                    for name in ("k", "c", "shard", "batch", "hot"):
                        out[name].append(w[name])
                    out["body"].append(body[w["s"] : w["s"] + w["n"] + length - 1])
            return out

        return work

    return map_rows(joined, make, "k bigint, c bigint, shard int, batch int, hot boolean, body binary")


def remove_repeats(docs: DataFrame, settings: RepeatSettings = RepeatSettings(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows without ``text``, plus ``kept`` (the bytes that stay), ``n_bytes``, ``n_removed`` and ``n_spans``."""
    spark = docs.sparkSession
    length = settings.length
    # columns get names of their own, so that none can clash with a helper's
    docs = docs.drop(*ADDED)
    names = docs.columns
    inner = [f"c{i}" for i in range(len(names))]
    doc_id, text = (inner[[n.lower() for n in names].index(c.lower())] for c in (doc_id, text))
    docs = docs.toDF(*inner)
    plain = docs.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{text}`").alias("_text"))
    marks, marks_path = written(mark(plain, settings), "segments")
    # keys that occur once hold no repeat
    keys = marks.groupBy("k").agg(F.count(F.lit(1)).alias("m"), F.max("inner").alias("inner")).filter("m > 1 or inner").select("k")
    seen, seen_path = written(marks.join(keys, "k"), "recurring-segments")
    drop_path(spark, marks_path)
    classes = seen.groupBy("k", "c").agg(
        F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.max("inner").alias("inner"), F.min(F.struct("_id", "_t", "s")).alias("at"))
    several = classes.groupBy("k").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("windows"), F.max("inner").alias("inner")).filter("m > 1 or inner")
    total = several.agg(F.sum("windows")).first()[0] or 0
    shards = max(1, -(-total // settings.shard_windows))
    wanted = classes.drop("inner").join(several.select("k", (F.col("m") > settings.hot_segments).alias("hot")), "k").select(
        "at._id", "at._t", "at.s", "k", "c", "n", "hot",
        F.pmod("k", F.lit(shards)).cast("int").alias("shard"),
        F.pmod(F.xxhash64("at._id"), F.lit(settings.batches)).cast("int").alias("batch"))
    packed = pack_texts(docs, text)
    slim = pack_texts(docs.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{text}`")), text)
    # repeated rows give a segment twice; one of each is enough
    pieces, pieces_path = written(cut_pieces(wanted, slim, length, settings.unit), "index-pieces")
    cool = pieces.filter("not hot").dropDuplicates(["k", "c"])
    found, paths = index_repeats(cool, settings)
    found = found.unionByName(spread_repeats(pieces.filter("hot").dropDuplicates(["k", "c"]), settings))
    whole = classes.filter("copies > 1").select("k", "c", F.lit(0).alias("lo"), (F.col("n") - 1).alias("hi"))
    runs = found.unionByName(whole).groupBy("k", "c").agg(F.collect_set(F.struct("lo", "hi")).alias("runs"))
    spans = seen.join(runs, ["k", "c"]).groupBy("_id", "_t").agg(F.collect_list(F.struct("s", "runs")).alias("__spans"))
    spans = spans.withColumnRenamed("_id", "__span_id").withColumnRenamed("_t", "__span_t")
    spans = spans.withColumn("__spans", F.flatten(F.transform(
        "__spans", lambda x: F.transform(x["runs"], lambda r: F.struct((x["s"] + r["lo"]).alias("from"), (x["s"] + r["hi"] + length).alias("to"))))))
    joined = packed.join(spans, packed[doc_id].eqNullSafe(spans["__span_id"]) & (packed["__t"] == spans["__span_t"]), "left")
    carved = carve(joined.drop("__span_id", "__span_t", "__t"), settings.unit)
    return carved.toDF(*[n for n, i in zip(names, inner) if i != text], *ADDED)


def carve(rows: DataFrame, unit: str = "bytes") -> DataFrame:
    """Cut the spans out of the packed texts."""
    kept = [c for c in rows.columns if c not in ("__z", "__spans")]
    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept), "kept binary, n_bytes bigint, n_removed bigint, n_spans bigint"])
    types = pa_schema(rows.sparkSession, schema)

    def run(batches):
        unpress = zstandard.ZstdDecompressor()
        for part in slices(batches):
            columns = [part.column(i).cast(types.field(i).type) for i in range(len(kept))]
            bodies, sizes, removed, counts = [], [], [], []
            for z, spans in zip(part.column(len(kept)).to_pylist(), part.column(len(kept) + 1).to_pylist()):
                body = unpress.decompress(z)
                rest, at, gone = [], 0, []
                for span in sorted(((x["from"], x["to"]) for x in spans or ())):
                    if gone and span[0] <= gone[-1][1]:
                        gone[-1][1] = max(gone[-1][1], span[1])
                    else:
                        gone.append([*span])
                gone = byte_runs(body, gone, unit)
                for lo, hi in gone:
                    rest.append(body[at:lo])
                    at = hi
                rest.append(body[at:])
                bodies.append(b"".join(rest))
                sizes.append(len(body))
                removed.append(sum(hi - lo for lo, hi in gone))
                counts.append(len(gone))
            out = [pa.array(bodies, pa.binary()), *(pa.array(x, pa.int64()) for x in (sizes, removed, counts))]
            yield pa.RecordBatch.from_arrays([*columns, *out], schema=types)

    return rows.select(*[F.col(f"`{c}`") for c in kept], "__z", "__spans").mapInArrow(run, schema)


def readable(kept):
    """The kept bytes as text, without the rest of a character that a cut went through."""

    @F.pandas_udf("string")
    def text(bodies):
        return bodies.map(lambda b: None if b is None else bytes(b).decode("utf-8", "ignore"))

    return text(kept)
