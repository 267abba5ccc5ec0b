"""Pairs of similar texts by edit distance, without comparing all of a block.

Two texts within distance k must share a piece: cut the shorter one into k+1
pieces, and at least one of them occurs unchanged in the longer one, near its
place (the partition scheme of Li, Deng, Wang and Feng, "Pass-Join", VLDB 2011).
Pieces meet in an equi-join, and the true distance decides. The result is exact.

A piece of a word that very many texts share would bring all of these together. Texts
with such a piece are cut finer, into k+m pieces, of which m stay unchanged, so two of any k+2
do; the k+2 rarest are taken, and two of them together are the key of the join. The
pieces of the common word are then left out, as long as the rest of the text has enough.

Texts that are too short for that, and those within one change, have few spellings with k changes
undone, so they meet by these: letters that one text has alone are deleted, letters that differ are masked,
and what is left must be equal. A common word is then never a key by itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from rowmender.operators.skew import spread_rows, tasks_for
from rowmender.session import cut_lineage

#: A piece of more texts than this makes them be cut finer.
HOT_TEXTS = 200
#: Pieces above the distance of texts that are cut finer: at least and at most.
EXTRA, MOST_EXTRA = 4, 8
#: Texts meet by what is left of them within one change up to this length, and within so many changes if they are short.
ONE_CHANGE_LENGTH, MOST_CHANGES = 64, 3
#: Texts in a task that lists their pieces or spellings.
TEXTS_PER_TASK = 10_000
#: Stands for a letter that differs.
MASK = "\x00"


def _limit(length: Column, max_distance: int, threshold: float | None) -> Column:
    """Largest distance allowed when the longer text has this length."""
    fixed = F.lit(max_distance)
    if threshold is None:
        return fixed
    share = F.floor(length * F.lit(1.0 - threshold) + F.lit(1e-9)).cast("int")
    return F.greatest(fixed, share)


def _piece(length: Column, pieces: Column, i: Column) -> tuple[Column, Column]:
    """Start (from 0) and length of piece ``i`` of a text cut into even pieces."""
    base = F.floor(length / pieces).cast("int")
    short = pieces - (length - base * pieces)
    return i * base + F.greatest(F.lit(0), i - short), base + F.when(i >= short, 1).otherwise(0)


def _fine(short_len: Column, k: Column) -> Column:
    """Whether a text can be cut into k + EXTRA pieces of two characters at least."""
    return short_len >= 2 * (k + EXTRA)


def _fine_pieces(short_len: Column, k: Column) -> Column:
    """Their number: pieces of about two characters, so that those of a common word stay by themselves."""
    return F.least(F.floor(short_len / 2).cast("int"), k + MOST_EXTRA)


def _few_spellings(short_len: Column, k: Column) -> Column:
    """Whether what is left after k changes is listed: some hundred spellings at most."""
    return ((k == 1) & (short_len <= ONE_CHANGE_LENGTH)) | (k.between(2, MOST_CHANGES) & ~_fine(short_len, k))


def _left_over(text: Column, deleted: int, masked: int) -> Column:
    """The spellings of a text with so many letters deleted and so many masked."""
    found = F.array(text)
    for mark in [""] * deleted + [MASK] * masked:
        found = F.array_distinct(F.flatten(F.transform(found, _replaced_once(mark))))
    return found


def _replaced_once(mark: str):
    """A text with each one of its letters replaced, or itself if it has none."""
    def texts(x: Column) -> Column:
        places = F.sequence(F.lit(1), F.length(x))
        return F.when(x == "", F.array(x)).otherwise(F.transform(places, lambda i: F.overlay(x, F.lit(mark), i, F.lit(1))))
    return texts


def left_overs(text: Column, k: Column, gap: Column, longer: bool) -> Column:
    """What is left of a text when it is matched with one that is ``gap`` letters longer (or shorter, for the ``longer`` one).

    Within k changes the shorter text loses d letters, the longer one d + gap, and at most k - gap - 2d differ.
    """
    def spelled(deleted: int, spellings: Column) -> Column:
        return F.transform(spellings, lambda x: F.struct(F.lit(deleted).alias("deleted"), x.alias("spelling")))

    cases = F.array().cast("array<struct<deleted:int,spelling:string>>")
    for n in range(1, MOST_CHANGES + 1):
        for g in range(n + 1):
            lists = [spelled(d, _left_over(text, d + g if longer else d, n - g - 2 * d)) for d in range((n - g) // 2 + 1)]
            cases = F.when((k == n) & (gap == g), F.concat(*lists)).otherwise(cases)
    return cases


def similar_texts(df: DataFrame, text: str, block: Sequence[str], payload: Sequence[str],
                  max_distance: int = 0, threshold: float | None = None) -> DataFrame:
    """Pairs of different texts of one block whose distance or similarity is close enough.

    ``df`` must have each (block, text) once. A pair qualifies when its distance is
    at most ``max_distance`` or its similarity is at least ``threshold``. Gives the
    block, text_1 < text_2 in (length, text) order, the payloads as structs
    ``row_1`` and ``row_2``, the distance and the similarity.
    """
    # each candidate once, so that its distance is taken once, and only as far as the limit of the longer text
    found = candidates(df, text, block, payload, max_distance, threshold).dropDuplicates([*block, "text_1", "text_2"])
    far = _limit(F.col("len_2"), max_distance, threshold)
    near = found.withColumn("distance", F.call_function("levenshtein", F.col("text_1"), F.col("text_2"), far)).filter("distance >= 0")
    scored = near.withColumn("similarity", F.lit(1.0) - F.col("distance") / F.col("len_2"))
    good = F.col("distance") <= max_distance
    if threshold is not None:
        good = good | (F.col("similarity") >= threshold)
    return scored.filter(good).select(*block, "text_1", "text_2", "row_1", "row_2", "distance", "similarity")


def candidates(df: DataFrame, text: str, block: Sequence[str], payload: Sequence[str],
               max_distance: int = 0, threshold: float | None = None) -> DataFrame:
    """Pairs that share a piece, or two rare ones, at fitting places; a pair may come several times."""
    rows = df.select(*block, F.col(text).alias("text"), F.length(text).cast("int").alias("len"),
                     F.struct(*payload).alias("row"))
    # several lists are made of them
    rows = spread_rows(cut_lineage(rows), TEXTS_PER_TASK)
    length = F.col("len")
    k = _limit(length, max_distance, threshold)

    # a longer partner may allow a larger distance, so index once per limit it can bring
    slack = 0.0 if threshold is None else (1.0 - threshold) / threshold
    reach = F.greatest(F.lit(max_distance), F.floor(length * F.lit(slack) + F.lit(1e-9)).cast("int"))
    limits = F.array_distinct(F.transform(F.sequence(F.lit(0), reach), lambda more: _limit(length + more, max_distance, threshold)))
    short = rows.select(*block, F.col("text").alias("text_1"), F.col("row").alias("row_1"), length.alias("short_len"), F.explode(limits).alias("k"))

    def index_entries(n: Column) -> Column:
        def entry(i: Column) -> Column:
            start, size = _piece(F.col("short_len"), n, i)
            return F.struct(i.alias("piece"), F.substring("text_1", start + 1, size).alias("part"))
        return F.inline(F.transform(F.sequence(F.lit(0), n - 1), entry))

    indexed = short.select("*", index_entries(F.col("k") + 1))
    spot = [*block, "short_len", "k"]
    common = indexed.groupBy(*spot, "piece", "part").agg(F.count(F.lit(1)).alias("texts")).filter(
        (F.col("texts") > HOT_TEXTS) & (_fine(F.col("short_len"), F.col("k")) | _few_spellings(F.col("short_len"), F.col("k"))))
    common = cut_lineage(common.drop("texts"))
    longer = rows.select(*block, F.col("text").alias("text_2"), length.alias("len_2"), F.col("row").alias("row_2"), k.alias("k"))
    # with equal lengths both texts probe, so the text order keeps one direction
    different = (F.col("short_len") < F.col("len_2")) | (F.col("text_1") < F.col("text_2"))
    kept = [*block, "text_1", "row_1", "text_2", "row_2", "len_2"]
    if common.isEmpty():
        return indexed.join(single_probes(longer, block), [*spot, "piece", "part"]).filter(different).select(*kept)

    crowded = cut_lineage(indexed.join(common, [*spot, "piece", "part"], "left_semi").select(*spot, "text_1").distinct())
    plain = indexed.join(crowded, [*spot, "text_1"], "left_anti")
    one = plain.join(single_probes(longer, block), [*spot, "piece", "part"])
    whole = _few_spellings(F.col("short_len"), F.col("k"))
    finer = short.join(crowded.filter(~whole), [*spot, "text_1"], "left_semi")
    keys = rare_pairs(finer.select("*", index_entries(_fine_pieces(F.col("short_len"), F.col("k")))), spot)
    both = ["piece_1", "part_1", "piece_2", "part_2"]
    two = finer.join(keys, [*spot, "text_1"]).join(pair_probes(longer, block, crowded.filter(~whole).select(*spot).distinct()), [*spot, *both])

    spelled = crowded.filter(whole)
    listed = short.join(spelled, [*spot, "text_1"], "left_semi").select("*", F.explode(F.sequence(F.lit(0), F.col("k"))).alias("gap"))
    listed = listed.select(*spot, "gap", "text_1", "row_1", F.inline(left_overs(F.col("text_1"), F.col("k"), F.col("gap"), False)))
    probes = spelling_probes(longer, block, spelled.select(*spot).distinct())
    alike = [*spot, "gap", "deleted", "spelling"]
    tasks = tasks_for(spelled.count(), TEXTS_PER_TASK)
    if tasks > 1:
        # few bytes make many pairs
        listed, probes = listed.repartition(tasks, *alike), probes.repartition(tasks, *alike)
    three = listed.join(probes, alike)
    parts = [x.filter(different).select(*kept) for x in (one, two, three)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def spelling_probes(longer: DataFrame, block: Sequence[str], spots: DataFrame) -> DataFrame:
    """What is left of the longer texts, for the lengths in ``spots``."""
    gaps = longer.select("*", F.explode(F.sequence(F.lit(0), F.least("k", "len_2"))).alias("gap"))
    wanted = gaps.withColumn("short_len", F.col("len_2") - F.col("gap")).join(spots, [*block, "short_len", "k"], "left_semi")
    return wanted.select(*block, "text_2", "len_2", "row_2", "k", "short_len", "gap", F.inline(left_overs(F.col("text_2"), F.col("k"), F.col("gap"), True)))


def single_probes(longer: DataFrame, block: Sequence[str]) -> DataFrame:
    """Where each piece of a shorter text may stand in ``longer`` (text_2, len_2, row_2, k)."""
    length, k = F.col("len_2"), F.col("k")

    def probe_entries(short_len: Column) -> Column:
        gap = length - short_len

        def entry(i: Column) -> Column:
            start, size = _piece(short_len, k + 1, i)
            low = F.greatest(F.lit(0), start - F.floor((k - gap) / 2).cast("int"))
            high = F.least(length - size, start + F.floor((k + gap) / 2).cast("int"))
            places = F.when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
            return F.transform(places, lambda at: F.struct(
                short_len.alias("short_len"), i.alias("piece"), F.substring("text_2", at + 1, size).alias("part")))
        return F.flatten(F.transform(F.sequence(F.lit(0), k), entry))

    shorter = F.sequence(F.greatest(F.lit(0), length - k), length)
    probes = F.array_distinct(F.flatten(F.transform(shorter, probe_entries)))
    return longer.select(*block, "text_2", "len_2", "row_2", "k", F.inline(probes))


def rare_pairs(pieces: DataFrame, spot: Sequence[str]) -> DataFrame:
    """Two at a time of the k + 2 rarest pieces of each text (spot, text_1, piece, part)."""
    times = pieces.groupBy(*spot, "piece", "part").agg(F.count(F.lit(1)).alias("texts"))
    rated = pieces.select(*spot, "text_1", "piece", "part").join(times, [*spot, "piece", "part"])
    # a text has at most k + MOST_EXTRA pieces
    own = rated.groupBy(*spot, "text_1").agg(F.sort_array(F.collect_list(F.struct("texts", "piece", "part"))).alias("all"))
    rare = own.withColumn("rare", F.slice("all", F.lit(1), F.col("k") + 2))
    a = rare.select(*spot, "text_1", "rare", F.explode("rare").alias("a"))
    b = a.select(*spot, "text_1", "a", F.explode("rare").alias("b")).filter("a.piece < b.piece")
    return b.select(*spot, "text_1", F.col("a.piece").alias("piece_1"), F.col("a.part").alias("part_1"),
                    F.col("b.piece").alias("piece_2"), F.col("b.part").alias("part_2"))


def pair_probes(longer: DataFrame, block: Sequence[str], spots: DataFrame) -> DataFrame:
    """Where two pieces of a shorter text may stand together in ``longer``, for the lengths in ``spots``.

    Unchanged pieces that stand s and u places off, in a text that is g longer, cost at
    least |s| + |u - s| + |g - u| changes before, between and behind them.
    """
    length, k = F.col("len_2"), F.col("k")
    lengths = longer.select("*", F.explode(F.sequence(F.greatest(F.lit(0), length - k), length)).alias("short_len"))
    wanted = lengths.join(spots, [*block, "short_len", "k"], "left_semi")
    pieces = _fine_pieces(F.col("short_len"), k)
    gap = length - F.col("short_len")
    first = wanted.select("*", F.explode(F.sequence(F.lit(0), pieces - 2)).alias("piece_1")).select(
        "*", F.explode(F.sequence(F.col("piece_1") + 1, pieces - 1)).alias("piece_2"))
    moved = first.select("*", F.explode(F.sequence(-k, k)).alias("s")).select("*", F.explode(F.sequence(-k, k)).alias("u"))
    fitting = moved.filter(F.abs("s") + F.abs(F.col("u") - F.col("s")) + F.abs(gap - F.col("u")) <= k)
    start_1, size_1 = _piece(F.col("short_len"), pieces, F.col("piece_1"))
    start_2, size_2 = _piece(F.col("short_len"), pieces, F.col("piece_2"))
    inside = (start_1 + F.col("s") >= 0) & (start_2 + F.col("u") + size_2 <= length)
    return fitting.filter(inside).select(
        *block, "text_2", "len_2", "row_2", "k", "short_len", "piece_1", "piece_2",
        F.substring("text_2", start_1 + F.col("s") + 1, size_1).alias("part_1"),
        F.substring("text_2", start_2 + F.col("u") + 1, size_2).alias("part_2"))
