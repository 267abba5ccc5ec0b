import random
import re

import pytest
from pyspark.sql import functions as F

from rowmender.llm.benchmark_leaks import LeakSettings, find_leaks

DOCS = "doc_id long, text string, words string, pos int, h long"
ITEMS = "item_id long, text string, len int, wid string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=10):
    """n_words, hit places and item ids of each document by looking everywhere."""
    out = []
    split = [(item, words_of(text)) for item, text, *_ in items]
    for _, text, *_ in docs:
        own, hit, found = words_of(text), set(), set()
        for item, w in split:
            for i in range(max(len(w) - window, 0) + 1 if w else 0):
                part = w[i : i + window]
                for at in range(len(own) - len(part) + 1):
                    if own[at : at + len(part)] == part:
                        hit.update(range(at, at + len(part)))
                        if item is not None:
                            found.add(str(item))
        out.append((len(own), hit, sorted(found)))
    return out


def tables():
    rng = random.Random(4)
    vocabulary = ["the", "of", "é", "日本", "Ab", "x1", "o'clock", "a-b", "ZÜRICH", "2024"]
    make = lambda n: [rng.choice(vocabulary) + ("" if rng.random() < 0.5 else str(rng.randrange(30))) for _ in range(n)]
    items = [(i, " ".join(make(n)), 1, "x") for i, n in enumerate([25, 14, 10, 9, 5, 4, 3, 12, 30])]
    shared = make(12)
    items += [(20 + i, " ".join(make(3) + shared + make(2)), 1, "x") for i in range(4)]  # items with a passage in common
    items += [(30, items[0][1], 1, "x"), (0, "another text for the same id of twelve words in all, just so", 1, "x")]
    items += [(None, "an item that has no id at all but ten or more words", 1, "x"), (40, None, 1, "x"), (41, "", 1, "x"), (42, "?!", 1, "x"), (43, "of", 1, "x")]
    docs = []
    for i in range(40):
        parts = make(rng.randrange(30))
        for _ in range(rng.randrange(3)):
            source = rng.choice(items)[1] or ""
            taken = words_of(source)
            at = rng.randrange(max(1, len(taken)))
            parts += taken[at : at + rng.randrange(4, 20)] + make(rng.randrange(4))
        text = " ".join(parts)
        docs.append((i, text.upper() if rng.random() < 0.3 else text.replace(" ", rng.choice([" ", "\n", ", ", "--"])), "w", 1, 2))
    docs += [(100, None, None, None, None), (101, "", "", 1, 1), (102, "--- \n", "", 1, 1), (None, items[0][1], "", 1, 1)]
    docs += [docs[0], docs[0], (3, "the same id with another text: " + items[1][1], "", 1, 1)]
    docs.append((103, (" ".join(make(3)) + " ") * 4000 + items[8][1], "", 1, 1))  # very long
    return docs, items


@pytest.mark.parametrize("settings", [LeakSettings(), LeakSettings(bits=64), LeakSettings(shingle=3), LeakSettings(window=6, shingle=6)])
def test_equals_brute_force(spark, settings):
    docs, items = tables()
    got = find_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), settings).collect()
    rows = sorted((str(r.doc_id), r.n_words, r.n_hit, tuple((s.start, s.end) for s in r.spans), tuple(r["items"])) for r in got)
    want = []
    for (doc, *_), (n, hit, found) in zip(docs, brute(docs, items, settings.window)):
        spans = []
        for p in sorted(hit):
            if spans and spans[-1][1] == p:
                spans[-1][1] += 1
            else:
                spans.append([p, p + 1])
        want.append((str(doc), n, len(hit), tuple(map(tuple, spans)), tuple(found)))
    assert rows == sorted(want)


def test_empty_tables(spark):
    docs, items = tables()
    some, none = spark.createDataFrame(docs, DOCS), spark.createDataFrame([], ITEMS)
    found = find_leaks(some, none)
    assert found.count() == len(docs) and found.agg(F.sum("n_hit")).first()[0] == 0
    assert find_leaks(some.limit(0), spark.createDataFrame(items, ITEMS)).count() == 0


def test_no_python_in_the_plan(spark):
    """The places that the pass over the documents keeps come from one scan without Python."""
    from rowmender.llm import benchmark_leaks as b

    docs, items = tables()
    table = b.bit_table(b.window_shingles(b.item_windows(spark.createDataFrame(items, ITEMS), LeakSettings()).withColumn("size", F.lit(3)).withColumn("wid", F.lit(1)), [3]), 1 << 20)
    plan = b.places(spark.createDataFrame(docs, DOCS), table, [3], LeakSettings())._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "BroadcastHashJoin" in plan
