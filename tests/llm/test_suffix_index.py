import random

import pytest
from pyspark.sql import functions as F

from rowmender.llm.suffix_index import RepeatSettings, remove_repeats

DOCS = "doc_id long, text string, source string, _extra int"


def brute(texts, length):
    from collections import Counter

    bodies = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in bodies for i in range(len(b) - length + 1))
    out = []
    for b in bodies:
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((bytes(c for c, g in zip(b, gone) if not g), len(b), sum(gone), spans))
    return out


def texts():
    rng = random.Random(5)
    words = ["ab", "cde", "f", "ghij", "é", "日本", "k l"]
    make = lambda n: " ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(n))
    shared = make(12)
    out = [make(rng.randrange(1, 60)) for _ in range(30)]
    out += [make(8) + shared + make(5) for _ in range(12)]  # one passage in different surroundings
    copy = make(50)
    out += [copy, copy, copy[:90] + "x" + copy[91:], copy[10:], None, "", "ab", "ab" * 80, "ab" * 81 + "c", "z" * 30]
    return out


@pytest.mark.parametrize("settings", [
    RepeatSettings(length=24, gram=9, batches=4, longest_segment=32, shard_windows=50),
    RepeatSettings(length=24, gram=24, batches=1, longest_segment=1024),
    RepeatSettings(length=24, gram=1, batches=3, hot_segments=1),
])
def test_equals_brute_force(spark, settings):
    rows = [(i, t, "s", 1) for i, t in enumerate(texts())]
    got = {r.doc_id: r for r in remove_repeats(spark.createDataFrame(rows, DOCS), settings).collect()}
    want = brute([r[1] for r in rows], 24)
    assert len(got) == len(rows)
    for i, expected in enumerate(want):
        r = got[i]
        assert (bytes(r.kept), r.n_bytes, r.n_removed, r.n_spans) == expected, i
        assert r.source == "s" and r._extra == 1


def test_repeated_rows_and_null_ids(spark):
    body = "the quick brown fox jumps over it"
    rows = [(None, body, "a", 1), (None, body, "a", 1), (7, "unrelated text that stays as it is", "b", 2)]
    got = remove_repeats(spark.createDataFrame(rows, DOCS), RepeatSettings(length=24, gram=9, batches=2)).orderBy("n_removed").collect()
    assert [(r.doc_id, r.n_removed) for r in got] == [(7, 0), (None, len(body)), (None, len(body))]


def test_empty_table(spark):
    empty = spark.createDataFrame([], DOCS)
    out = remove_repeats(empty, RepeatSettings(length=24, gram=9))
    assert out.count() == 0 and {"kept", "n_bytes", "n_removed", "n_spans"} <= set(out.columns)
    assert remove_repeats(spark.createDataFrame([(1, None, None, None)], DOCS)).select(F.length("kept")).first()[0] == 0
