"""Drawing documents towards a target distribution, by hashed word and word-pair features.

The features of a text are its words and its pairs of neighbouring words, each hashed to a
bucket by the CRC of its bytes. The frequent part of the vocabulary, the *head*, is counted
over all documents first and broadcast: for each frequent word the CRC state behind it and
behind the blank that follows, for each frequent pair of such words its bucket. All other
features, the *tail*, take the CRC of their bytes directly, going on from the state of the
first word where that is in the head. Either way the bucket is exact, so the head decides
the speed alone. Bucket numbers are written once; the totals and the weights read them.

The head is bounded by parameters; the counts of a task are Misra-Gries counters, merged by
feature. Totals, gains and the two vocabularies are what the driver sees.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from rowmender.llm.common import drop_path, pa_schema, slices, written
from rowmender.operators.skew import ordered_position


@dataclass(frozen=True)
class SampleSettings:
    buckets: int = 10_000
    head_words: int = 1 << 15
    head_pairs: int = 1 << 17
    counters: int = 1 << 17  # of one task, per kind of feature
    min_words: int = 20
    percent: int = 25
    seed: int = 7


#: Lower case for A to Z, a blank for every other ASCII character that is no digit or letter.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


def bytes_column(part: pa.RecordBatch, name: str) -> list[bytes | None]:
    return part.column(name).cast(pa.binary()).to_pylist()


class Counters:
    """Misra-Gries counters: what occurs more often than a share of 1/``most`` is never lost."""

    def __init__(self, most: int) -> None:
        self.most, self.counts = most, Counter()

    def add(self, features) -> None:
        self.counts.update(features)
        if len(self.counts) > 2 * self.most:
            self.shrink()

    def shrink(self) -> None:
        if len(self.counts) > self.most:
            cut = int(np.partition(np.fromiter(self.counts.values(), np.int64, len(self.counts)), -self.most - 1)[-self.most - 1])
            self.counts = Counter({f: n - cut for f, n in self.counts.items() if n > cut})


def frequent(docs: DataFrame, settings: SampleSettings) -> DataFrame:
    """(kind, feature, n): counters of words (kind 1) and pairs (kind 2) over all of ``docs``."""
    schema = "kind int, feature binary, n bigint"
    types, most = pa_schema(docs.sparkSession, schema), settings.counters

    def run(batches):
        words, pairs = Counters(most), Counters(most)
        for part in slices(batches):
            for text in bytes_column(part, "text"):
                own = words_of(text)
                words.add(own)
                pairs.add(zip(own, own[1:]))
        for kind, counters in ((1, words), (2, pairs)):
            counters.shrink()
            rows = list(counters.counts.items())
            for at in range(0, len(rows), 10_000):
                some = rows[at: at + 10_000]
                features = [f if kind == 1 else b" ".join(f) for f, _ in some]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([kind] * len(some), pa.int32()), pa.array(features, pa.binary()), pa.array([n for _, n in some], pa.int64())], schema=types)

    return docs.select("text").mapInArrow(run, schema).groupBy("kind", "feature").agg(F.sum("n").alias("n"))


def frequent_words(docs: DataFrame, settings: SampleSettings = SampleSettings()) -> DataFrame:
    """(word, n): the words that no task's counters lost, with their counts."""
    schema = "word string, n bigint"
    types, most = pa_schema(docs.sparkSession, schema), settings.counters

    def run(batches):
        words = Counters(most)
        for part in slices(batches):
            for text in bytes_column(part, "text"):
                words.add(words_of(text))
        words.shrink()
        rows = list(words.counts.items())
        for at in range(0, len(rows), 10_000):
            some = rows[at: at + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array([w.decode("utf-8", "replace") for w, _ in some], pa.string()), pa.array([n for _, n in some], pa.int64())], schema=types)

    return docs.select("text").mapInArrow(run, schema).groupBy("word").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, kind: int, most: int) -> list[bytes]:
    """At most ``most`` of the largest features of a kind, found by a histogram of their counts."""
    own = counts.filter(F.col("kind") == kind)
    step = F.floor(F.log2("n") * 8).cast("int")
    room, least = most, None
    for level, number in sorted(own.groupBy(step.alias("level")).agg(F.count(F.lit(1))).collect(), reverse=True):
        room -= number
        if room < 0:
            break
        least = level
    if least is None:
        return []
    return sorted(bytes(r[0]) for r in own.filter(step >= least).select("feature").collect())


@dataclass
class Head:
    """Frequent words with their states and buckets, frequent pairs with their buckets."""

    numbers: dict[bytes, int]
    states: np.ndarray  # behind the word and a blank
    buckets: np.ndarray
    pairs: np.ndarray  # sorted, first number * words + second number
    pair_buckets: np.ndarray


def make_head(words: list[bytes], pairs: list[bytes], buckets: int) -> Head:
    numbers = {w: i for i, w in enumerate(words)}
    known = {}
    for pair in pairs:
        a, b = pair.split(b" ")
        if a in numbers and b in numbers:
            known[numbers[a] * len(words) + numbers[b]] = zlib.crc32(pair) % buckets
    codes = sorted(known)
    return Head(
        numbers, np.array([zlib.crc32(w + b" ") for w in words], np.int64), np.array([zlib.crc32(w) % buckets for w in words], np.int64),
        np.array(codes, np.int64), np.array([known[c] for c in codes], np.int64))


def feature_buckets(words: list[bytes], lengths: np.ndarray, head: Head, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all words, buckets of all pairs, and the number of pairs of each text.

    ``words`` are those of several texts, one after another, ``lengths`` their numbers of words.
    """
    size = len(words)
    ids = np.fromiter(map(head.numbers.get, words, repeat(-1)), np.int64, size)
    tail = np.flatnonzero(ids < 0)
    single = head.buckets[ids] if len(head.buckets) else np.zeros(size, np.int64)
    single[tail] = np.fromiter((zlib.crc32(words[i]) for i in tail.tolist()), np.int64, len(tail)) % buckets

    first = np.ones(size, bool)  # words with a word behind them in the same text
    first[np.cumsum(lengths)[lengths > 0] - 1] = False
    at = np.flatnonzero(first)
    a, b = ids[at], ids[at + 1]
    double = np.full(len(at), -1, np.int64)
    if len(head.pairs):
        code = np.where((a >= 0) & (b >= 0), a * len(head.buckets) + b, -1)
        place = np.minimum(np.searchsorted(head.pairs, code), len(head.pairs) - 1)
        hit = head.pairs[place] == code
        double[hit] = head.pair_buckets[place[hit]]
    rest = np.flatnonzero(double < 0)
    where = at[rest]
    states = head.states[a[rest]] if len(head.states) else np.zeros(len(rest), np.int64)
    new = np.flatnonzero(a[rest] < 0)
    states[new] = np.fromiter((zlib.crc32(words[i] + b" ") for i in where[new].tolist()), np.int64, len(new))
    double[rest] = np.fromiter((zlib.crc32(words[i + 1], s) for i, s in zip(where.tolist(), states.tolist())), np.int64, len(rest)) % buckets
    return single, double, np.maximum(lengths - 1, 0)


def hashed(docs: DataFrame, key: str, head: Head, settings: SampleSettings) -> DataFrame:
    """(key, n_words, n_features, buckets): the bucket numbers of every text as little-endian integers."""
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_words bigint, n_features bigint, buckets binary"
    types, buckets = pa_schema(docs.sparkSession, schema), settings.buckets
    width = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batches):
        for part in slices(batches):
            split = [words_of(t) for t in bytes_column(part, "text")]
            lengths = np.array([len(w) for w in split], np.int64)
            single, double, pairs = feature_buckets([w for own in split for w in own], lengths, head, buckets)
            single, double = single.astype(width), double.astype(width)
            ends, pair_ends = np.cumsum(lengths), np.cumsum(pairs)
            body = [single[e - n: e].tobytes() + double[p - m: p].tobytes() for e, n, p, m in zip(ends, lengths, pair_ends, pairs)]
            yield pa.RecordBatch.from_arrays(
                [part.column(key).cast(types.field(0).type), pa.array(lengths), pa.array(lengths + pairs), pa.array(body, pa.binary())], schema=types)

    return docs.select(key, "text").mapInArrow(run, schema)


def totals(features: DataFrame, settings: SampleSettings) -> np.ndarray:
    """Features per bucket; a task sends at most one row for each bucket."""
    schema = "bucket int, n bigint"
    types, buckets = pa_schema(features.sparkSession, schema), settings.buckets
    width = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batches):
        counts = np.zeros(buckets, np.int64)
        for part in slices(batches):
            counts += np.bincount(np.frombuffer(b"".join(part.column("buckets").to_pylist()), width), minlength=buckets)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(counts[some])], schema=types)

    found = np.zeros(buckets, np.int64)
    for bucket, n in features.select("buckets").mapInArrow(run, schema).groupBy("bucket").agg(F.sum("n")).collect():
        found[bucket] = n
    return found


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the log ratio of the smoothed shares of target and source, floored."""
    all_s, all_t, size = int(source.sum()), int(target.sum()), len(source)
    return np.array([
        math.floor(1000 * math.log(float(t + 1) * (all_s + size) / (float(s + 1) * (all_t + size))))
        for s, t in zip(source.tolist(), target.tolist())], np.int64)


def weighted(features: DataFrame, key: str, gains: np.ndarray, settings: SampleSettings) -> DataFrame:
    """``features`` with the floored mean gain as ``weight`` instead of the buckets."""
    kind = features.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_words bigint, n_features bigint, weight bigint"
    types = pa_schema(features.sparkSession, schema)
    width = "<u2" if settings.buckets <= 1 << 16 else "<u4"

    def run(batches):
        for part in slices(batches):
            numbers = np.array(part.column("n_features").to_pylist(), np.int64)
            own = gains[np.frombuffer(b"".join(part.column("buckets").to_pylist()), width)]
            before = np.concatenate([[0], np.cumsum(own)])
            ends = np.cumsum(numbers)
            sums = before[ends] - before[ends - numbers]
            weight = np.where(numbers > 0, sums // np.maximum(numbers, 1), 0)
            yield pa.RecordBatch.from_arrays([part.column(key), part.column("n_words"), part.column("n_features"), pa.array(weight)], schema=types)

    return features.mapInArrow(run, schema)


def luck(key: Column, seed: int) -> Column:
    """Gumbel noise in thousandths from the hash of the id, floored."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def draw(docs: DataFrame, target: DataFrame, key: str = "doc_id", settings: SampleSettings = SampleSettings()) -> DataFrame:
    """(key, n_words, n_features, weight, score, rank) of every row of ``docs``.

    Of the rows with at least ``min_words`` words, ``percent`` per cent are drawn: the highest
    scores, then smaller keys (a null key first, and counted as empty text in the hash), then
    fewer features. Others have no rank. Null and empty texts have no features and weight 0.
    Repeated rows are rows of their own. ``target`` needs a column text; further columns of
    either table are left out. Without target texts all gains favour rare buckets alike.
    """
    spark = docs.sparkSession
    counts, counts_path = written(frequent(docs, settings), "importance-head")
    words = most_frequent(counts, 1, settings.head_words)
    head = make_head(words, most_frequent(counts, 2, settings.head_pairs), settings.buckets)
    own, own_path = written(hashed(docs, key, head, settings), "importance-buckets")
    wanted = hashed(target.select(F.lit(0).alias("k"), "text"), "k", head, settings)
    gains = gains_of(totals(own, settings), totals(wanted, settings))
    scored, scored_path = written(weighted(own, key, gains, settings).withColumn("score", F.col("weight") + luck(F.col(key), settings.seed)), "importance-scored")
    able = scored.filter(F.col("n_words") >= settings.min_words)
    drawn = settings.percent * able.count() // 100
    order = ["_minus", key, "n_features", "weight"]
    placed = ordered_position(able.withColumn("_minus", -F.col("score")), order, "_place").drop("_minus")
    rank = F.when(F.col("_place") <= drawn, F.col("_place")).cast("long").alias("rank")
    rest = scored.filter(F.col("n_words") < settings.min_words)
    names = [key, "n_words", "n_features", "weight", "score"]
    done, _ = written(placed.select(*names, rank).unionByName(rest.select(*names, F.lit(None).cast("long").alias("rank"))), "importance")
    for path in (counts_path, own_path, scored_path):
        drop_path(spark, path)
    return done
