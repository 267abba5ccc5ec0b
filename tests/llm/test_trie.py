import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from rowmender.llm import conversation_trie as trie
from rowmender.llm.conversation_trie import TrieSettings, conversation_trie, two_fattest

ROWS = "conv_id long, turn long, role string, text string, depth int, h1 string"


def brute(rows):
    """Nodes by comparing all rebuilt prefixes; turns are put in order by the caller."""
    own = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, (role or "", text or "")))
    turns = {c: [t for *_, t in sorted(v, key=lambda x: x[:2])] for c, v in own.items()}
    paths = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 4
        paths[c] = tuple(turns.get(c - c % 20, [])[:h] + turns[c][h:])
    members = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    words = lambda p: len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
    out = []
    for p, own in members.items():
        below = [q for q in members if q[: len(p)] == p]
        leaf = [q for q in below if not any(len(r) == len(q) + 1 and r[: len(q)] == q for r in below)]
        ends = sorted(c for c in own if paths[c] == p)
        out.append((
            min(own), len(p), min(members[p[:-1]]) if p else None, len(own), sum(len(q) == len(p) + 1 for q in below), len(leaf),
            sum((len(members[q]) - 1) * words(q) for q in below), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(seed=1, count=90):
    rng = random.Random(seed)
    texts = ["a b", "c", "", None, "d  e\tf", "é ü"]
    rows = []
    for c in rng.sample(range(300), count):
        for i in range(rng.choice([1, 1, 2, 3, 4, 7, 12])):
            rows.append((c, i if rng.random() < 0.9 or i else None, rng.choice(["user", None]), rng.choice(texts[: 2 + i % 5]), 1, "x"))
    copies = [(1000 + c, i, "user", f"common {i}", 1, "x") for c in range(30) for i in range(3 + (c % 3 == 0))]
    long = [(2000, i, "user", f"turn {i % 7}", 1, "x") for i in range(60)] + [(2001, i, "user", f"turn {i % 7}" if i < 50 else "other", 1, "x") for i in range(70)]
    rows += copies + long + [(None, 1, "user", "no id", 1, "x")]
    rng.shuffle(rows)
    return rows


def listed(df):
    return sorted((tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=str)


@pytest.mark.parametrize("settings,block", [(TrieSettings(), 1024), (TrieSettings(batches=1), 4), (TrieSettings(first=20, batches=2), 16)])
def test_equals_brute_force(spark, monkeypatch, settings, block):
    monkeypatch.setattr(trie, "BLOCK", block)
    rows = conversations()
    got = conversation_trie(spark.createDataFrame(rows, ROWS), settings)
    assert listed(got) == brute(rows)


def test_two_fattest(spark):
    pairs = [(a, b) for a in range(0, 40) for b in range(a + 1, 41)]
    df = spark.createDataFrame(pairs, "a long, b long").select("a", "b", two_fattest(F.col("a"), F.col("b")).alias("f"))
    for a, b, f in df.collect():
        assert f == max(range(a + 1, b + 1), key=lambda n: n & -n)


def test_odd_tables(spark):
    empty = spark.createDataFrame([], ROWS)
    assert conversation_trie(empty).count() == 0
    # rebuilt on an absent conversation, so that no turn is left
    alone = [c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 3][:2]
    rows = [(c, 0, "user", "x", 1, "y") for c in alone]
    assert listed(conversation_trie(spark.createDataFrame(rows, ROWS))) == brute(rows)
    # turns of one number, and repeated rows, are turns of their own, in an order given by their content
    same = [(40, 1, "user", "b", 1, "z"), (40, 1, "user", "a", 1, "z"), (60, 1, "user", "a", 1, "z"), (60, 1, "user", "b", 1, "z"), (80, 1, "user", "a", 1, "z"), (80, 1, "user", "a", 1, "z")]
    nodes = {(r.conv_id, r.depth): r for r in conversation_trie(spark.createDataFrame(same, ROWS)).collect()}
    assert nodes[(40, 2)].n_convs == 2 and nodes[(80, 2)].n_convs == 1 and nodes[(40, 0)].n_leaves == 2


def test_shared_turn_texts_with_separators(spark):
    """Role and text are told apart: ('ab', 'c') is not ('a', 'bc')."""
    rows = [(100, 0, "ab", "c", 1, "x"), (120, 0, "a", "bc", 1, "x")]
    assert listed(conversation_trie(spark.createDataFrame(rows, ROWS))) == brute(rows)
