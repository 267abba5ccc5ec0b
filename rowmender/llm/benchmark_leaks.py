"""Benchmark passages inside documents, by a prefix-filtered set join.

An item falls into windows of ten words (a shorter one is one window). A window lies in
a document just if all of its shingles do, so any one shingle is a sufficient prefix of
the set; the rarest one over all documents brings the fewest candidates. Candidates that
would begin before the document or end after it go by their position, and the words
around the place decide.

Only DataFrame functions are used. One pass over the documents keeps the places whose
shingle may belong to the benchmark, by a bit table of fixed size; all else works on these.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, Window

from rowmender.llm.common import drop_path, written
from rowmender.llm.folded_words import folded_words


@dataclass(frozen=True)
class LeakSettings:
    window: int = 10
    shingle: int = 5
    # bits of the table that is broadcast; it has at most a 64th of them as rows
    bits: int = 1 << 26


def shingle_hash(words: Column, at: Column, size: int) -> Column:
    return F.xxhash64(F.lit(size), *[F.get(words, at + j) for j in range(size)])


def item_windows(items: DataFrame, settings: LeakSettings) -> DataFrame:
    """(item_id, passage, len, words) of every window of every item."""
    words = F.col("words")
    last = F.greatest(F.size("words") - settings.window, F.lit(0))
    texts = items.select("item_id", folded_words(F.col("text")).alias("words")).filter(F.size("words") > 0)
    starts = texts.select("item_id", "words", F.explode(F.sequence(F.lit(0), last)).alias("at"))
    cut = F.slice(words, F.col("at") + 1, settings.window)
    return starts.select("item_id", cut.alias("words")).withColumn("len", F.size("words")).withColumn("passage", F.concat_ws(" ", "words"))


def window_shingles(windows: DataFrame, sizes: list[int]) -> DataFrame:
    """(wid, len, passage, back, size, h): the shingles of each window, ``back`` words after its start."""
    per_size = []
    for size in sizes:
        own = windows.filter(F.col("size") == size)
        placed = own.select("wid", "len", "passage", "words", "size", F.explode(F.sequence(F.lit(0), F.col("len") - size)).alias("back"))
        per_size.append(placed.withColumn("h", shingle_hash(F.col("words"), F.col("back"), size)).drop("words"))
    union = per_size[0]
    for other in per_size[1:]:
        union = union.unionByName(other)
    return union


def bit_table(shingles: DataFrame, bits: int) -> DataFrame:
    """(word, mask): the set bits of a table of ``bits`` bits, 64 to a row."""
    slot = F.pmod("h", F.lit(bits))
    masks = shingles.select((slot / 64).cast("long").alias("word"), F.expr(f"shiftleft(1L, cast(pmod(h, {bits}) % 64 as int))").alias("mask"))
    return masks.groupBy("word").agg(F.bit_or("mask").alias("mask"))


def places(docs: DataFrame, table: DataFrame, sizes: list[int], settings: LeakSettings) -> DataFrame:
    """One row per document (``pos`` null, ``n_words``), and one per place whose shingle may be a benchmark's.

    The row of the document comes out of the same pass as a place behind the last word.
    """
    reach = settings.window
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_key"), folded_words(F.col("text")).alias("words"))
    rows = texts.select("*", F.posexplode(F.array_append("words", F.lit(""))).alias("pos", "word"))
    end = F.col("pos") == F.size("words")
    found = None
    for turn, size in enumerate(sizes):
        inside = F.col("pos") + size <= F.size("words")
        keyed = rows.select("doc_id", "text_key", "words", "pos", F.when(inside, shingle_hash(F.col("words"), F.col("pos"), size)).alias("h"))
        slot = F.pmod("h", F.lit(settings.bits))
        tested = keyed.withColumn("word", (slot / 64).cast("long")).join(F.broadcast(table), "word", "left")
        may = F.expr(f"(shiftrightunsigned(mask, cast(pmod(h, {settings.bits}) % 64 as int)) & 1L) = 1")
        first = F.greatest(F.col("pos") - (reach - size), F.lit(0))
        kept = tested.filter(F.coalesce(may, F.lit(False)) | (end if not turn else F.lit(False)))
        part = kept.select(
            "doc_id", "text_key",
            F.when(~end, F.col("pos")).alias("pos"), "h", F.lit(size).alias("size"),
            F.when(end, F.size("words")).alias("n_words"),
            F.when(~end, F.col("pos") - first).alias("before"),
            F.when(~end, F.slice("words", first + 1, F.col("pos") - first + reach)).alias("around"))
        found = part if found is None else found.unionByName(part)
    return found


def find_leaks(docs: DataFrame, items: DataFrame, settings: LeakSettings = LeakSettings()) -> DataFrame:
    """Per row of ``docs``: n_words, n_hit, ``spans`` of hit words and the ``items`` found.

    ``docs`` has doc_id and text, ``items`` has item_id and text; further columns are left
    out. A span is (start, end) in words, end exclusive; items are distinct ids as strings,
    sorted. Null and empty texts have no words; an item without words is never found; an item
    without an id marks words but is not listed. Rows that repeat give one row each; an id
    with several texts gives a row for each text. Without items nothing is hit.
    """
    spark = docs.sparkSession
    cuts, cuts_path = written(item_windows(items, settings), "leak-cuts")
    size = F.least(F.col("len"), F.lit(settings.shingle))
    distinct = cuts.groupBy("passage").agg(F.first("words").alias("words"), F.first("len").alias("len"))
    windows, windows_path = written(distinct.withColumn("size", size).withColumn("wid", F.monotonically_increasing_id()), "leak-windows")
    # at most ``shingle`` different numbers
    sizes = sorted(r[0] for r in windows.select("size").distinct().collect()) or [settings.shingle]
    shingles = window_shingles(windows, sizes)
    wanted = shingles.select("size", "h").distinct()
    found, found_path = written(places(docs, bit_table(wanted, settings.bits), sizes, settings), "leak-places")

    # the rarest shingle of each window is its prefix; one that no document has cannot be found
    at = found.filter("pos is not null")
    seen, seen_path = written(at.join(wanted, ["size", "h"], "left_semi"), "leak-seen")
    rarity = seen.groupBy("size", "h").agg(F.count(F.lit(1)).alias("times"))
    rated = shingles.join(rarity, ["size", "h"], "left").withColumn("times", F.coalesce("times", F.lit(0)))
    rarest = rated.groupBy("wid").agg(
        F.min(F.struct("times", "h", "back", "size")).alias("p"), F.first("len").alias("len"), F.first("passage").alias("passage"))
    prefixes = rarest.filter("p.times > 0").select("wid", "len", "passage", "p.h", "p.back", "p.size")

    # place by place: inside the document at both ends, and the same words
    placed = seen.join(prefixes, ["size", "h"]).filter(
        (F.col("before") >= F.col("back")) & (F.col("before") - F.col("back") + F.col("len") <= F.size("around")))
    same = F.concat_ws(" ", F.slice("around", F.col("before") - F.col("back") + 1, F.col("len"))) == F.col("passage")
    start = F.col("pos") - F.col("back")
    hits, hits_path = written(
        placed.filter(same).select("doc_id", "text_key", start.alias("start"), (start + F.col("len")).alias("end"), "wid").distinct(), "leak-hits")

    key = ["doc_id", "text_key"]
    spans = merged_spans(hits.select(*key, "start", "end").distinct(), key)
    # documents with the same windows have the same items, so these are looked up once
    own = hits.groupBy(*key).agg(F.sort_array(F.collect_set("wid")).alias("wids"))
    kinds = own.select("wids").distinct()
    of_window = cuts.filter("item_id is not null").join(windows.select("passage", "wid"), "passage").select("wid", F.col("item_id").cast("string").alias("item_id")).distinct()
    listed = kinds.select("wids", F.explode("wids").alias("wid")).join(of_window, "wid").groupBy("wids").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    result = spans.join(own, matches(spans, own, key)).select(*[spans[c] for c in key], "spans", "n_hit", "wids").join(listed, "wids", "left").drop("wids")
    rows = found.filter("n_words is not null").select(*key, F.col("n_words").cast("long").alias("n_words"))
    none = F.array().cast("array<struct<start:int,end:int>>")
    full = rows.join(result, matches(rows, result, key), "left").select(
        rows["doc_id"], "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("spans", none).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    done, _ = written(full, "leaks")
    for path in (cuts_path, windows_path, found_path, seen_path, hits_path):
        drop_path(spark, path)
    return done


def matches(a: DataFrame, b: DataFrame, key: list[str]) -> Column:
    """Equal keys, nulls included."""
    same = F.lit(True)
    for c in key:
        same = same & a[c].eqNullSafe(b[c])
    return same


def merged_spans(spans: DataFrame, key: list[str]) -> DataFrame:
    """Per key the maximal runs of covered words, and their number of words."""
    order = Window.partitionBy(*key).orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = spans.withColumn("new", F.when(before >= F.col("start"), 0).otherwise(1))
    runs = new.withColumn("run", F.sum("new").over(order)).groupBy(*key, "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return runs.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"), F.sum(F.col("end") - F.col("start")).alias("n_hit"))
