import random
import zlib

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

from rowmender.llm import packing, word_bpe
from rowmender.llm.packing import pack, piece_lengths, plan, sequences, tokenize
from rowmender.llm.pretokens import rank_file

JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
DOCS = "doc_id long, text string, ids string"
TEXTS = [
    None, "", " ", "\n", "a", "Hello there, it's  two blanks", "tab\tand \n newline \n\n end ", "  lead", "trail  ", "é ñ ß 日本語 🙂 ok",
    "x" * 500, " nb   sp em", "don't we'll 'tis 12 345", "<|endoftext|> in <|endoftext|>text", "a\x1cb \x1c c \x85 d", "same words same words", "same words same words",
]


def docs(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], DOCS)


def test_ids_are_those_of_the_tokenizers_library(spark):
    library = Tokenizer.from_file(JSON)
    got = {r.doc_id: r for r in tokenize(docs(spark), JSON, 4096, with_ids=True).collect()}
    for i, text in enumerate(TEXTS):
        want = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        assert bytes(got[i].ids) == want and got[i].ids_crc32 == zlib.crc32(want) and got[i].piece == 0, text


def test_plan_places_every_piece_once():
    rng = random.Random(1)
    for case in range(60):
        capacity = rng.choice([7, 12, 30, 100])
        counts = {rng.randrange(1, capacity + 1): rng.randrange(1, 40) for _ in range(rng.randrange(1, 25))}
        first, sequence, offset, number = plan(counts, capacity)
        lengths = [s for s in sorted(counts) for _ in range(counts[s])]
        filled = {}
        for n, s in enumerate(lengths):
            i = np.searchsorted(first, n, side="right") - 1
            filled.setdefault(int(sequence[i] + n - first[i]), []).append((int(offset[i]), s))
        assert len(filled) == number >= -(-sum(lengths) // capacity)
        for places in filled.values():
            at = 0
            for o, s in sorted(places):
                assert o == at
                at += s
            assert at <= capacity
        # first-fit decreasing needs no fewer sequences than half of one more
        bins = []
        for s in sorted(lengths, reverse=True):
            for b in bins:
                if b[0] + s <= capacity:
                    b[0] += s
                    break
            else:
                bins.append([s])
        assert number <= len(bins) + 1


def test_pack(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["one", "two", "three"]) for _ in range(rng.randrange(90))) for _ in range(80)] + [None, None]
    pieces = pack(tokenize(docs(spark, texts), JSON, 32, with_ids=True), 32)
    rows = pieces.collect()
    library = Tokenizer.from_file(JSON)
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for i, text in enumerate(texts):
        own = sorted(by_doc[i], key=lambda r: r.piece)
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        assert [r.length for r in own] == piece_lengths(len(ids), 32) and [r.start for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
        assert b"".join(bytes(r.ids) for r in own) == np.array(ids, "<u4").tobytes()
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 32
    full = {r.sequence_id: bytes(r.ids) for r in sequences(pieces).collect()}
    assert all(full[k] == b"".join(bytes(r.ids) for r in sorted(v, key=lambda r: r.offset)) for k, v in by_sequence.items())


def test_empty_tables(spark):
    assert pack(tokenize(docs(spark, []), JSON, 32), 32).count() == 0
    assert word_bpe.decode(word_bpe.encode(docs(spark, []), RANKS), RANKS).count() == 0
    assert packing.plan({}, 10)[3] == 0


def test_word_encoding_equals_the_library(spark, monkeypatch):
    monkeypatch.setattr(word_bpe, "BLOCK_CHARS", 300)
    monkeypatch.setattr(word_bpe, "ROW_CHARS", 60)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=rank_file(RANKS), special_tokens={})
    rows = word_bpe.decode(word_bpe.encode(docs(spark), RANKS, buckets=5), RANKS).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(TEXTS)))
    for r in rows:
        text = TEXTS[r.doc_id] or ""
        assert np.frombuffer(r.ids, "<u4").tolist() == own.encode_ordinary(text), text
        assert r.n_tokens == len(r.ids) // 4 and bytes(r.decoded) == text.encode()
