"""Byte-level BPE of a corpus through its distinct words.

Blocks of documents are split into pre-tokens; a block keeps the position of every
pre-token as a number in its own word list. Only word lists are shuffled, by a hash
of the word: there each distinct word of the corpus is encoded once, and its ids return to
the blocks that hold it, where the documents are put together again by position. The
words of one block and hash bucket travel as one row, so a frequent word costs one entry
per block. Decoding looks every id up in the table of token bytes, which has as many
entries as the vocabulary.

Nulls count as empty texts; every row gives one row; other columns are left out. ``docs``
should be a table or a scan, so that a task that runs again sees the same rows in the same order.
"""

from __future__ import annotations

import xxhash
import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from rowmender.llm.common import map_rows, pa_schema, slices
from rowmender.llm.pretokens import Split, rank_file

BLOCK_CHARS = 16_000_000
ROW_CHARS = 1_000_000


def planes(numbers: np.ndarray) -> bytes:
    """32-bit numbers byte plane by byte plane, which compresses well."""
    return np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).reshape(-1).view("<u4")


def blocks(docs: DataFrame, buckets: int, doc_id: str, text: str) -> DataFrame:
    """Rows of two kinds: word lists (bucket >= 0) and documents in terms of them (bucket -1)."""
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"block bigint, bucket int, docs array<{kind}>, sizes array<int>, body binary"
    types = pa_schema(docs.sparkSession, schema)

    def run(batches):
        import public_tokenizers
        import regex

        find = regex.compile(public_tokenizers.PATTERN).findall
        press = zstandard.ZstdCompressor(level=3)
        block = TaskContext.get().partitionId() << 32
        lists, words, ids, sizes, codes, chars, total = [], {}, [], [], [], 0, 0

        def number(word):
            return words.setdefault(word, len(words)).to_bytes(4, "little")

        def numbered(part):
            """The word numbers of a part of a text, as bytes."""
            # letters after at most one blank are one pre-token; which ones are letters is the same everywhere below U+0250
            if part[1:].isalpha() and (part[0] == " " or part[0].isalpha()) and max(part) < "\u0250":
                return number(part)
            return b"".join(map(number, find(part)))

        def rows():
            if ids:
                numbers = np.frombuffer(b"".join(codes), "<u4")
                lists.append((block, -1, list(ids), list(sizes), press.compress(planes(numbers))))
                for x in (ids, sizes, codes):
                    x.clear()

        def flush():
            nonlocal block, words, split
            rows()
            dealt = [[] for _ in range(buckets)]
            for word in words:
                dealt[xxhash.xxh3_64_intdigest(word) % buckets].append(word)
            for bucket, own in enumerate(dealt):
                if own:
                    own.sort()
                    lengths = planes(np.array(list(map(len, own)), np.uint32))
                    joined = len(own).to_bytes(4, "little") + lengths + "".join(own).encode("utf-8", "surrogatepass")
                    lists.append((block, bucket, [], list(map(words.__getitem__, own)), press.compress(joined)))
            block += 1
            words = {}
            split = Split(numbered)

        split = Split(numbered)
        for batch in slices(batches):
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                body = body or ""
                found = split.parts(body)
                ids.append(doc)
                sizes.append(sum(map(len, found)) // 4)
                codes.extend(found)
                chars += len(body)
                total += len(body)
                if chars >= ROW_CHARS:
                    rows()
                    chars = 0
                if total >= BLOCK_CHARS:
                    flush()
                    total = chars = 0
                while lists:
                    made = [lists.pop(0)]
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*made), types)], schema=types)
        flush()
        for row in lists:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, types)], schema=types)

    return docs.select(F.col(f"`{doc_id}`"), F.col(f"`{text}`")).mapInArrow(run, schema)


def encode_lists(lists: DataFrame, ranks_path: str) -> DataFrame:
    """The word lists with the ids of each word; rows come sorted by bucket, so a word is encoded once."""

    def make():
        import public_tokenizers
        import tiktoken

        encoder = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=rank_file(ranks_path), special_tokens={})
        press, unpress = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
        known: dict[str, list[int]] = {}
        current = -1

        def work(cols):
            nonlocal known, current
            out = {c: [] for c in ("block", "words", "counts", "ids")}
            for block, bucket, numbers, body in zip(cols["block"], cols["bucket"], cols["sizes"], cols["body"]):
                if bucket != current:
                    known, current = {}, bucket
                data, at, counts, ids = unpress.decompress(body), 0, [], []
                number = int.from_bytes(data[:4], "little")
                text = data[4 + 4 * number :].decode("utf-8", "surrogatepass")
                for size in from_planes(data[4 : 4 + 4 * number]).tolist():
                    word = text[at : at + size]
                    at += size
                    own = known.get(word)
                    if own is None:
                        own = known[word] = encoder.encode_ordinary(word)
                    counts.append(len(own))
                    ids += own
                out["block"].append(block)
                for name, value in (("words", numbers), ("counts", counts), ("ids", ids)):
                    out[name].append(press.compress(planes(np.array(value, np.uint32))))
            return out

        return work

    return map_rows(lists.select("block", "bucket", "sizes", "body"), make, "block bigint, words binary, counts binary, ids binary")


def assemble(types: pa.Schema):
    def step(documents: pa.Table, lists: pa.Table) -> pa.Table:
        unpress = zstandard.ZstdDecompressor()
        read = lambda data: from_planes(unpress.decompress(data)).astype(np.int64)
        numbers, counts, ids = (
            np.concatenate([np.zeros(0, np.int64), *(read(x) for x in lists.column(c).to_pylist())]) for c in ("words", "counts", "ids"))
        begins = np.cumsum(counts) - counts
        size = np.zeros(len(numbers), np.int64)
        begin = np.zeros(len(numbers), np.int64)
        size[numbers], begin[numbers] = counts, begins
        ids = ids.astype("<u4")
        batches = []
        for bucket, docs, lengths, body in zip(*(documents.column(c).to_pylist() for c in ("bucket", "docs", "sizes", "body"))):
            if bucket >= 0:
                continue
            codes = read(body)
            own = size[codes]
            ends = np.concatenate([[0], np.cumsum(own)])
            take = np.repeat(begin[codes] - ends[:-1], own) + np.arange(ends[-1])
            flat = ids[take]
            edges = ends[np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])].tolist()
            parts = [flat[a:b].tobytes() for a, b in zip(edges, edges[1:])]
            batches.append(pa.RecordBatch.from_arrays(
                [pa.array(x, f.type) for x, f in zip((docs, [len(p) // 4 for p in parts], parts), types)], schema=types))
        return pa.Table.from_batches(batches, schema=types)

    step.__annotations__ = {"documents": pa.Table, "lists": pa.Table, "return": pa.Table}
    return step


def encode(docs: DataFrame, ranks_path: str, doc_id: str = "doc_id", text: str = "text", buckets: int | None = None) -> DataFrame:
    """doc_id, n_tokens and ids (bytes of little-endian unsigned 32-bit numbers) of every row."""
    spark = docs.sparkSession
    buckets = buckets or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    # one shuffle serves both kinds of rows, so both branches read all of it and neither filters below it
    rows = blocks(docs, buckets, doc_id, text).repartition("block")
    listed = (F.col("bucket") >= 0) & (F.size("docs") == 0)
    lists = rows.select(F.inline(F.when(listed, F.array(F.struct("block", "bucket", "sizes", "body")))))
    encoded = encode_lists(lists.repartition("bucket").sortWithinPartitions("bucket"), ranks_path)
    documents = rows.select("block", "bucket", "docs", "sizes", "body")
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens bigint, ids binary"
    types = pa_schema(spark, schema)
    return documents.groupBy("block").cogroup(encoded.groupBy("block")).applyInArrow(assemble(types), schema)


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """The rows of :func:`encode` with ``decoded``, the bytes of the tokens one after another."""

    def make():
        table = {i: word for word, i in rank_file(ranks_path).items()}
        names = ("doc_id", "n_tokens", "ids")

        def work(cols):
            found = [b"".join(map(table.__getitem__, np.frombuffer(x, "<u4").tolist())) for x in cols["ids"]]
            return {n: cols[n] for n in names} | {"decoded": found}

        return work

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return map_rows(encoded.select("doc_id", "n_tokens", "ids"), make, f"doc_id {kind}, n_tokens bigint, ids binary, decoded binary")
