import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rowmender.llm import set_sketch, subspace_join
from rowmender.llm.set_sketch import SketchSettings, components, likely_similarity, register_values
from rowmender.llm.subspace_join import SubspaceSettings, near_vectors
from rowmender.operators.components import connected

DOCS = "doc_id long, text string, low long, bucket string"


def smallest(ids, links):
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def brute_sets(text, words):
    own = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        own = own.replace(c, " ")
    found = [w for w in own.split(" ") if w]
    if len(found) < words:
        return {tuple(found)} if found else set()
    return {tuple(found[i : i + words]) for i in range(len(found) - words + 1)}


def test_components_equal_brute_force(spark):
    rng = random.Random(3)
    make = lambda n: [f"w{rng.randrange(300)}" for _ in range(n)]
    texts = []
    for _ in range(12):
        base = make(rng.randrange(3, 90))
        texts.append(" ".join(base))
        for _ in range(rng.randrange(6)):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(50)}"
            texts.append("  ".join(copy).upper() if rng.random() < 0.3 else " ".join(copy))
    chain = make(120)  # neighbours are near, the ends are not
    for i in range(12):
        texts.append(" ".join(chain[3 * i : 3 * i + 84]))
    texts += [None, "", " \t\n", "one", "ONE", "one two three", "One\ttwo\nthree", "é É", "É É"]
    order = list(range(len(texts)))
    rng.shuffle(order)
    rows = [(i, texts[j], 1, "b") for i, j in enumerate(order)]
    for words in (4, 5):
        sets = {r[0]: brute_sets(r[1], words) for r in rows}
        links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
        want = smallest(sets, links)
        got = components(spark.createDataFrame(rows, DOCS), SketchSettings(words=words)).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}
        assert len(got) == len(rows)


def test_classes_left_apart_are_compared(spark):
    rng = random.Random(6)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(60):  # copies with very different numbers of changes around a text with a middle id
        copy = list(base)
        for _ in range(0 if i == 30 else rng.choice((2, 4, 5, 12))):
            copy[rng.randrange(150)] = f"x{rng.randrange(9999)}"
        rows.append((i, " ".join(copy), 1, "b"))
    sets = {r[0]: brute_sets(r[1], 4) for r in rows}
    want = smallest(sets, [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])
    for settings in (SketchSettings(words=4), SketchSettings(words=4, chunk=5, task_rows=20)):
        got = components(spark.createDataFrame(rows, DOCS), settings).collect()
        assert {r.doc_id: r.component_id for r in got} == want


def test_tasks_of_a_hot_bucket_hold_two_chunks(spark, monkeypatch):
    n, settings = 600, SketchSettings(words=4, chunk=20, task_rows=20)
    members = spark.createDataFrame([(7, i, -1, n) for i in range(n)] + [(100 + i // 2, 1000 + i, -1, 9999) for i in range(200)], "bucket long, node long, low long, high long")
    sets = spark.createDataFrame([], "id long, set_id long")
    classes = members.select("node", F.lit(1).alias("n_shingles"), F.lit(b"").alias("registers"))
    bodies = members.select("node", F.lit(b"").alias("_z"))

    def sizes(settings, types):
        return lambda table: pa.Table.from_pydict({"a": [table.num_rows], "b": [len(set(table.column("bucket").to_pylist()))]}, schema=types)

    monkeypatch.setattr(set_sketch, "bucket_task", sizes)
    got = set_sketch.links_across(members, sets, classes, bodies, settings).collect()
    assert sum(r.a for r in got) == n * 30 + 200  # each class of the hot bucket meets all 30 chunks
    assert max(r.a for r in got) < 3 * 2 * settings.chunk  # chunks are dealt by hash


def test_rows_without_id_and_repeated_rows(spark):
    rows = [(None, "a b c d e f", 1, "x"), (None, "a b c d e f", 1, "x"), (4, "a b c d e f", 1, "x"), (4, "a b c d e f", 1, "x"), (2, "A b c d e f", 1, "x")]
    got = [(r.doc_id, r.component_id, r.kept) for r in components(spark.createDataFrame(rows, DOCS)).collect()]
    assert sorted(got, key=str) == sorted([(None, None, True), (None, None, True), (4, 2, False), (4, 2, False), (2, 2, True)], key=str)
    assert components(spark.createDataFrame([], DOCS)).count() == 0


def test_sketches_merge_and_estimate():
    settings = SketchSettings()
    rng = np.random.Generator(np.random.PCG64(1))
    factors = rng.integers(0, 1 << 31, settings.registers, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    shifts = rng.integers(0, 1 << 32, settings.registers, dtype=np.uint32)
    pool = rng.integers(0, 1 << 63, 1500, dtype=np.uint64)
    for lo, hi in ((0, 1000), (200, 1100), (700, 1500)):
        x, y = pool[:1000], pool[lo:hi]
        a, b, both = (register_values(s, settings, factors, shifts) for s in (x, y, np.union1d(x, y)))
        assert (np.maximum(a, b) == both).all()
        above, below = (a > b).sum(), (a < b).sum()
        true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
        found = likely_similarity(np.array([above]), np.array([below]), np.array([settings.registers - above - below]), np.array([len(x) / (len(x) + len(y))]), settings.base)[0]
        assert abs(found - true) < 0.12


@pytest.mark.parametrize("hot", [8, 100_000])
def test_connected(spark, hot, hot_from):
    hot_from(hot)
    rng = random.Random(4)
    links = [(1500, 1000 + i) for i in range(60)] + [(2000 + i, 2001 + i) for i in range(40)]
    links += [(rng.randrange(120), rng.randrange(120)) for _ in range(80)]
    want = smallest({x for a, b in links if a != b for x in (a, b)}, [p for p in links if p[0] != p[1]])
    got = connected(spark.createDataFrame(links, "id_1 long, id_2 long")).collect()
    assert {r.id: r.set_id for r in got} == want and len(got) == len(want)
    assert connected(spark.createDataFrame([], "id_1 long, id_2 long")).count() == 0


def vectors():
    rng = np.random.Generator(np.random.PCG64(2))
    base = rng.normal(size=(40, 20)).astype(np.float32)
    rows = [list(map(float, v)) for v in base]
    for v in base[:12]:
        for scale in (0.02, 0.1, 0.3, 0.4):
            rows.append(list(map(float, (v + scale * rng.normal(size=20)).astype(np.float32))))
    rows += [rows[0], rows[0], [2 * x for x in rows[0]], None, [], [0.0] * 20, [1.0, None] + [0.0] * 18, [float("nan")] + [1.0] * 19, [float("inf")] + [1.0] * 19, [1.0, 2.0], [1.0, 2.0], [2.0, 1.0]]
    return rows


@pytest.mark.parametrize("settings", [SubspaceSettings(), SubspaceSettings(block=5, chunk=7, tile=3)])
def test_vectors_equal_brute_force(spark, settings):
    rows = vectors()
    good = {}
    for i, v in enumerate(rows):
        if v and None not in v:
            x = np.array(v, np.float64)
            if np.isfinite(x).all() and x.any():
                good[i] = x / np.linalg.norm(x)
    links = [(a, b) for a in good for b in good if a < b and len(good[a]) == len(good[b]) and good[a] @ good[b] >= 0.95]
    want = smallest(range(len(rows)), links)
    table = spark.createDataFrame([(i, v, i % 3) for i, v in enumerate(rows)], "vec_id long, embedding array<float>, label int")
    got = near_vectors(table, settings).collect()
    count = {i: sum(i in p for p in links) for i in range(len(rows))}
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == {i: (count[i], want[i], want[i] == i) for i in range(len(rows))}
    assert near_vectors(table.limit(0), settings).count() == 0


def test_pairs_are_folded_a_batch_at_a_time():
    rng = np.random.Generator(np.random.PCG64(5))
    n = 3000
    x = (rng.normal(size=16) + 0.01 * rng.normal(size=(n, 16))).astype("<f4")
    settings, types = SubspaceSettings(), pa.schema([("node", pa.int64()), ("links", pa.int64()), ("label", pa.int64())])
    g = subspace_join.Geometry(16, settings)
    cell = " ".join(map(str, g.cells(g.turned(subspace_join.unit([x[0].tobytes()])), 0)[0]))
    both = [(f"16 0 {cell} 0 0", 0, home, i, 1, x[i].tobytes()) for home in (True, False) for i in range(n)]
    table = pa.table(dict(zip(("task", "b", "home", "node", "copies", "v"), map(list, zip(*both)))))
    tracemalloc.start()
    got = subspace_join.compare(settings, types)(table).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got and {r["label"] for r in got} == {0}
    assert peak < 150_000_000  # kept pairs took 292 MB
    # many batches, random links: the same sets as one by one
    pairs = rng.integers(0, 400, (500, 2))
    label = np.arange(400)
    for part in np.array_split(pairs, 50):
        subspace_join.fold(label, part[:, 0], part[:, 1])
    subspace_join.roots(label)
    want = smallest(range(400), [tuple(p) for p in pairs.tolist()])
    assert label.tolist() == [want[i] for i in range(400)]


def test_settings_find_near_pairs_almost_surely():
    s = SketchSettings()
    assert (1 - 0.8**s.rows) ** s.bands < 1e-5
    assert set_sketch.Shingles(4)(b"a b c d a b c d").size == 4 and subspace_join.rotation(6, 1).shape == (6, 6)
