"""Packing of tokenised documents into sequences of a fixed length.

Texts become token ids plus a closing id; only a document longer than a sequence is cut,
into full pieces after a possibly shorter first one. Which piece goes where depends on
the number of pieces of each length alone, and there are at most ``capacity`` lengths, so
the plan is made from that histogram and has a bounded size, whatever the data:

* pieces above a third of the capacity: two at most fit into a sequence; the longest left
  takes the longest partner that fits beside it;
* the others, longest first, go into the smallest gap that holds them, or open a sequence.

Pieces are then numbered in the order (length, document, piece) by a range partitioning,
and each finds its place from its number. Nulls count as empty texts and give one piece
with the closing id; repeated rows are packed each. Other columns are left out.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rowmender.llm.common import map_rows, pa_schema, slices, written
from rowmender.llm.pretokens import Split, json_vocabulary
from rowmender.operators.skew import ordered_position


def piece_lengths(total: int, capacity: int) -> list[int]:
    first = total % capacity
    return [first] * bool(first) + [capacity] * (total // capacity)


def tokenize(docs: DataFrame, vocabulary: str, capacity: int, closing: int = 0, with_ids: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces of every document: doc_id, piece, start, length, ids_crc32 and, on demand, ids."""

    def make():
        import public_tokenizers
        import tiktoken

        ranks, special = json_vocabulary(vocabulary)
        # the same ids as the tokenizers library gives for this file, several times faster (checked by a test)
        encoder = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        encode = lambda part: np.array(encoder.encode(part, allowed_special="all"), "<u4").tobytes()
        split = Split(encode)
        end = np.array([closing], "<u4").tobytes()

        def work(cols):
            out = {c: [] for c in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
            for doc, body in zip(cols["doc_id"], cols["text"]):
                body = body or ""
                # a special token may hold blanks in other vocabularies; then the text stays whole
                parts = [encode(body)] if any(s in body for s in special) else split.parts(body)
                ids = b"".join([*parts, end])
                start = 0
                for piece, length in enumerate(piece_lengths(len(ids) // 4, capacity)):
                    own = ids[4 * start : 4 * (start + length)]
                    for name, value in (("doc_id", doc), ("piece", piece), ("start", start), ("length", length), ("ids_crc32", zlib.crc32(own))):
                        out[name].append(value)
                    out["ids"].append(own)
                    start += length
            return out

        return work

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    return map_rows(rows, make, schema)


def plan(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Places for ``counts[length]`` pieces, numbered by rising length.

    Gives the first piece number, the first sequence and the offset of each run of places,
    sorted by piece number, and the number of sequences. A piece ``n`` of the run that
    starts at ``a`` goes to the sequence of the run plus ``n - a``.
    """
    left = {s: n for s, n in counts.items() if n}
    large = sorted(s for s in left if 3 * s > capacity)
    bins: list[tuple[tuple, int]] = []  # (lengths as nested pairs, number of such sequences)
    gaps: dict[int, list] = defaultdict(list)

    def close(content, number: int, room: int) -> None:
        gaps[room].append((content, number))

    while large:
        a = large[-1]
        n = left[a]
        i = bisect.bisect_right(large, capacity - a) - 1
        b = large[i] if i >= 0 else None
        if b is None:
            close((a, None), n, capacity - a)
            left[a] = 0
        elif b == a:
            close((a, (a, None)), n // 2, capacity - 2 * a) if n > 1 else None
            left[a] = n % 2
            if left[a]:  # one is left over: it takes the next smaller partner
                lower = large[i - 1] if i >= 1 else None
                if lower is None:
                    close((a, None), 1, capacity - a)
                else:
                    close((lower, (a, None)), 1, capacity - a - lower)
                    left[lower] -= 1
                    if not left[lower]:
                        large.remove(lower)
                left[a] = 0
        else:
            m = min(n, left[b])
            close((b, (a, None)), m, capacity - a - b)
            left[a] -= m
            left[b] -= m
            if not left[b]:
                large.remove(b)
        if not left[a]:
            large.remove(a)
    open_gaps = sorted(g for g in gaps if g)
    for s in sorted((s for s in left if left[s] and 3 * s <= capacity), reverse=True):
        n = left[s]
        while n:
            i = bisect.bisect_left(open_gaps, s)
            if i == len(open_gaps):
                per = capacity // s
                for content_size, number in ((per, n // per), (n % per, 1)):
                    if content_size and number:
                        content = None
                        for _ in range(content_size):
                            content = (s, content)
                        room = capacity - content_size * s
                        if room and room not in open_gaps:
                            bisect.insort(open_gaps, room)
                        close(content, number, room)
                break
            room = open_gaps[i]
            content, number = gaps[room].pop()
            m = min(n, number)
            if number > m:
                gaps[room].append((content, number - m))
            n -= m
            if not gaps[room]:
                del open_gaps[i]
            if room - s and room - s not in open_gaps:
                bisect.insort(open_gaps, room - s)
            close((s, content), m, room - s)
    bins = [x for room in sorted(gaps) for x in gaps[room]]
    begin, at = {}, 0
    for s in sorted(counts):
        begin[s] = at
        at += counts[s]
    runs, sequence = [], 0
    for content, number in bins:
        offset = 0
        while content is not None:
            s, content = content
            runs.append((begin[s], sequence, offset))
            begin[s] += number
            offset += s
        sequence += number
    table = np.array(sorted(runs), np.int64).reshape(-1, 3)
    return table[:, 0], table[:, 1], table[:, 2], sequence


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``; ``pieces`` has doc_id, piece and length.

    Token ids, if there are any, stay out of the numbering and are joined to the places afterwards.
    """
    if "ids" in pieces.columns:
        whole, _ = written(pieces.withColumn("__row", F.monotonically_increasing_id()), "pieces")
        places = pack(whole.select("__row", "doc_id", "piece", "length"), capacity).select("__row", "sequence_id", "offset")
        return whole.join(places, "__row").drop("__row")
    pieces, _ = written(pieces, "pieces")
    # at most ``capacity`` rows
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    numbered = ordered_position(pieces, ["length", "doc_id", "piece"], "_number")
    first, sequence, offset, _ = plan(counts, capacity)
    kept = pieces.columns
    schema = ", ".join([*(f"`{c}` {pieces.schema[c].dataType.simpleString()}" for c in kept), "sequence_id bigint, offset bigint"])
    types = pa_schema(pieces.sparkSession, schema)

    def run(batches):
        for part in slices(batches, 10_000):
            number = part.column(len(kept)).to_numpy(zero_copy_only=False) - 1
            i = np.searchsorted(first, number, side="right") - 1
            places = [pa.array(sequence[i] + number - first[i], pa.int64()), pa.array(offset[i], pa.int64())]
            yield pa.RecordBatch.from_arrays([*(part.column(j).cast(types.field(j).type) for j in range(len(kept))), *places], schema=types)

    return numbered.select(*kept, "_number").mapInArrow(run, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """The finished sequences: ids in order, as bytes of little-endian unsigned 32-bit numbers."""
    grouped = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return grouped.select("sequence_id", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
