import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from rowmender.llm import importance
from rowmender.llm.importance import SampleSettings, draw

DOCS = "doc_id long, text string, n_words string, score int, rank string"


def features(text):
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))
    return words, words + [a + b" " + b for a, b in zip(words, words[1:])]


def brute(docs, target, buckets=10_000):
    ours, theirs = Counter(), Counter()
    for texts, counts in ((docs, ours), (target, theirs)):
        for row in texts:
            counts.update(zlib.crc32(f) % buckets for f in features(row[1])[1])
    s_all, t_all = sum(ours.values()), sum(theirs.values())
    gain = [math.floor(1000 * math.log((theirs[b] + 1) * (s_all + buckets) / ((ours[b] + 1) * (t_all + buckets)))) for b in range(buckets)]
    rows = []
    for doc, text, *_ in docs:
        words, own = features(text)
        weight = sum(gain[zlib.crc32(f) % buckets] for f in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        rows.append([doc, len(words), len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], -1 if r[0] is None else r[0], r[2], r[3]))
    for place, r in enumerate(able[: 25 * len(able) // 100]):
        r[5] = place + 1
    return sorted(map(tuple, rows), key=str)


def tables():
    rng = random.Random(8)
    words = ["The", "of", "ÉTÉ", "日本", "x-1", "Zürich", "2024", "don't", "end.\nNew"]
    make = lambda n: " ".join(rng.choice(words) + ("" if rng.random() < 0.6 else str(rng.randrange(200))) for _ in range(n))
    docs = [(i, make(rng.randrange(60)), "x", 1, "y") for i in range(120)]
    docs += [(200, None, None, None, None), (201, "", "", 1, ""), (202, "--", "", 1, ""), (None, make(40), "", 1, ""), docs[5], docs[5], (203, make(30_000), "", 1, "")]
    return docs, [(i, make(25)) for i in range(10)] + [(50, None), (51, "")]


@pytest.mark.parametrize("settings", [SampleSettings(), SampleSettings(head_words=3, head_pairs=2, counters=4), SampleSettings(head_words=0, head_pairs=0), SampleSettings(buckets=70_000)])
def test_equals_brute_force(spark, settings):
    docs, target = tables()
    got = draw(spark.createDataFrame(docs, DOCS), spark.createDataFrame(target, "item_id long, text string"), settings=settings)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, target, settings.buckets)


def test_empty_tables(spark):
    docs, target = tables()
    some, none = spark.createDataFrame(docs, DOCS), spark.createDataFrame([], "item_id long, text string")
    assert draw(some.limit(0), some).count() == 0
    assert sorted(map(tuple, draw(some, none).collect()), key=str) == brute(docs, [])


def test_counters_keep_what_is_frequent():
    rng = random.Random(2)
    counters = importance.Counters(20)
    stream = ["hot"] * 3000 + [str(rng.randrange(5000)) for _ in range(12_000)]
    rng.shuffle(stream)
    for at in range(0, len(stream), 100):
        counters.add(stream[at : at + 100])
        assert len(counters.counts) <= 140
    counters.shrink()
    assert len(counters.counts) <= 20 and max(counters.counts, key=counters.counts.get) == "hot"


def test_head_states_give_the_crc_of_a_pair():
    head = importance.make_head([b"ab", b"c"], [b"ab c", b"c zz"], 1000)
    single, double, pairs = importance.feature_buckets([b"ab", b"c", b"new", b"c"], importance.np.array([3, 1]), head, 1000)
    assert single.tolist() == [zlib.crc32(w) % 1000 for w in (b"ab", b"c", b"new", b"c")]
    assert double.tolist() == [zlib.crc32(w) % 1000 for w in (b"ab c", b"c new")] and pairs.tolist() == [2, 0]
