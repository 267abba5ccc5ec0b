"""Series, stage history, stored tables changed in place, cursors, sets kept up to date, rules by name."""

import datetime
import itertools
import os
import random

import pytest
from pyspark.sql import functions as F

from rowmender.config import QualityRules
from rowmender.operators import duplicates, lists, pipeline, rules, search, series, sets, similar, skew, stages
from rowmender.plans import order
from rowmender.session import scratch_path
from rowmender.sources import kept

CONTACTS = "id string, email string, firstname string, lastname string, phone string, mobilephone string, company string, createdate timestamp"


def contacts(n, seed=1):
    rng = random.Random(seed)
    pick = lambda *xs: rng.choice(xs)
    start = datetime.datetime(2024, 1, 1)
    return [(f"{i:04d}", pick(None, "", "a@x.co", f"u{rng.randrange(15)}@y.co"), pick("Ann", "Bob", ""), pick("Lee", "Li"),
             pick(None, "5550000001", "5550000002"), None, pick("Acme", "Beta", None),
             pick(None, *[start + datetime.timedelta(days=d, hours=3) for d in range(0, 50, 3)])) for i in range(n)]


def exact_links(df):
    keys = duplicates.match_keys(df).collect()
    for a, b in itertools.combinations(sorted(keys, key=lambda r: r.id), 2):
        if any(a[c] is not None and a[c] == b[c] for c in ("email_key", "phone_company_key", "name_company_key")):
            yield a.id, b.id


def test_pairs_added_per_period(spark):
    df = spark.createDataFrame(contacts(120), CONTACTS)
    created = {r.id: r.createdate for r in df.collect()}
    want = {}
    for a, b in exact_links(df):
        dates = [d for d in (created[a], created[b]) if d is not None]
        if dates:
            week = max(dates).date() - datetime.timedelta(days=max(dates).weekday())
            want[week] = want.get(week, 0) + 1
    got = {r.period.date(): int(r.n) for r in series.pairs_added(df).collect()}
    assert got == want and sum(want.values()) > 100
    total = duplicates.pair_counts(df).agg(F.sum("pairs")).first()[0]
    undated = sum(1 for a, b in exact_links(df) if created[a] is None and created[b] is None)
    assert total == sum(want.values()) + undated
    assert series.pairs_added(df.limit(0)).count() == 0


def test_alerts_without_gaps(spark):
    day = lambda d: datetime.datetime(2024, 1, d)
    counts = spark.createDataFrame([("x", day(1), 10), ("x", day(8), 16), ("x", day(22), 5)], "kind string, period timestamp, n bigint")
    dense = series.without_gaps(counts)
    assert [r.n for r in dense.orderBy("period").collect()] == [10, 16, 0, 5]
    # a rise after nothing has no rate
    assert [(r.n, r.alert) for r in pipeline.spikes(dense, 50, 90).orderBy("period").collect()] == [(16, "spike"), (0, "drop")]
    moves = spark.createDataFrame([("l", day(1), 1)] * 10 + [("l", day(2), -1)] * 3 + [("l", day(4), 1)], "list_id string, at timestamp, step int")
    assert [(r.n, r.before, r.alert) for r in series.membership_alerts(moves).collect()] == [(7, 10, "drop")]


def test_stage_paths_of_a_deal_with_very_many_events(spark, hot_from):
    hot_from(10)
    names = ["a", "b", "c", "d"]
    rng = random.Random(3)
    start = datetime.datetime(2024, 1, 1)
    rows = [("hot", rng.choice(names + ["odd"]), start + datetime.timedelta(hours=h)) for h in range(300)]
    rows += [(f"d{i}", names[j], start + datetime.timedelta(days=j, hours=i)) for i in range(5) for j in range(i % 4 + 1)] + [(None, "a", start)]
    df = spark.createDataFrame(rows, "deal_id string, stage string, at timestamp").repartition(7)
    steps = stages.stage_steps(df)
    got = {(r.stage, r.next_stage): (r.kind, r.moves, r.deals) for r in stages.stage_paths(steps, names, "2025-01-01 00:00:00").collect()}
    want = {}
    by_deal = {}
    for deal, stage, at in sorted((r for r in rows if r[0]), key=lambda r: (r[0], r[2])):
        by_deal.setdefault(deal, []).append(stage)
    for deal, path in by_deal.items():
        for a, b in zip(path, [*path[1:], None]):
            moves, deals = want.get((a, b), (0, set()))
            want[(a, b)] = (moves + 1, deals | {deal})
    assert {k: v[1:] for k, v in got.items()} == {k: (m, len(d)) for k, (m, d) in want.items()}
    assert got[("a", "b")][0] == "forward" and got[("a", "c")][0] == "skipped" and got[("c", "a")][0] == "backward"
    assert got[("b", "b")][0] == "repeat" and got[("odd", "a")][0] == "unknown"
    reach = {r.stage: (r.deals, r.moved_on) for r in stages.stage_reach(steps, names).collect()}
    for i, s in enumerate(names):
        had = [p for p in by_deal.values() if s in p]
        assert reach[s] == (len(had), sum(any(x in names[i + 1:] for x in p[p.index(s):]) for p in had))


# ---- stored tables


def files(tables, name):
    """Every data file of a table with its time and size."""
    folder = tables.path(name).removeprefix("file:")
    return {os.path.join(d, f): (os.stat(os.path.join(d, f)).st_mtime_ns, os.stat(os.path.join(d, f)).st_size)
            for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


@pytest.fixture
def stored(spark):
    rows = kept.buckets_of(spark.range(200).select(F.col("id").cast("string").alias("id"), F.lit("old").alias("v")), "id", 16)
    tables = kept.KeptTables(spark, scratch_path(spark, "kept"), {"t": rows.schema}, {"t": "bucket"})
    tables.create("t", rows)
    return tables


CHANGES = "id string, property string, value string, seq string"


def test_only_touched_partitions_are_written(spark, stored):
    before = files(stored, "t")
    changes = spark.createDataFrame([("7", "v", "new", "1"), ("8", "v", None, "1"), ("unknown", "v", "x", "1")], CHANGES)
    touched = {r.bucket for r in kept.buckets_of(changes, "id", 16).collect()}
    assert kept.apply_in_place(stored, "t", changes, 16, "one")
    after = files(stored, "t")
    same = {f for f in before if after.get(f) == before[f]}
    changed = {int(f.split("bucket=")[1].split("/")[0]) for f in set(before) - same}
    assert changed <= touched and len(changed) < 16 and len(same) >= len(before) - 3
    got = {r.id: r.v for r in stored.read("t").collect()}
    assert got == {**{str(i): "old" for i in range(200)}, "7": "new", "8": ""}
    # the same change again does nothing
    assert not kept.apply_in_place(stored, "t", changes, 16, "one") and files(stored, "t") == after
    plan = stored.rows_of("t", changes.select(F.lit(3).alias("bucket")))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "(bucket#" in plan.split("PartitionFilters")[1]


def test_a_crash_leaves_the_old_or_the_new_table(spark, stored, monkeypatch):
    rows = stored.read("t").filter("bucket = 3").withColumn("v", F.lit("new"))
    touched = spark.createDataFrame([(3,)], "bucket int")
    # before the note: nothing has happened
    monkeypatch.setattr(kept.KeptTables, "_note", lambda *a: (_ for _ in ()).throw(RuntimeError("crash")))
    with pytest.raises(RuntimeError):
        stored.change("one", {"t": kept.Change(rows, touched)})
    monkeypatch.undo()
    assert stored.read("t").filter("v = 'new'").count() == 0
    # behind the note: the next reader carries it through
    stored.stage("two", {"t": kept.Change(rows, touched)})
    n = rows.count()
    assert not stored.done("two") and stored.read("t").filter("v = 'new'").count() == n > 0 and stored.done("two")
    # a partition that loses all its rows goes
    stored.change("three", {"t": kept.Change(rows.limit(0), touched)})
    assert stored.read("t").filter("bucket = 3").count() == 0 and stored.read("t").count() == 200 - n


def test_retention_leaves_later_periods_alone(spark):
    days = [datetime.datetime(2024, m, d, 12) for m in (1, 2, 3, 4) for d in (5, 15, 25)]
    rows = spark.createDataFrame([(i, d, datetime.date(d.year, d.month, 1)) for i, d in enumerate(days)], "id int, at timestamp, month date")
    tables = kept.KeptTables(spark, scratch_path(spark, "log"), {"log": rows.schema}, {"log": "month"})
    tables.create("log", rows)
    before = files(tables, "log")
    kept.clean_up_in_place(tables, "log", "2024-03-21 00:00:00", 30, "at", "month")
    after = files(tables, "log")
    assert sorted(r.at for r in tables.read("log").collect()) == [d for d in days if d >= datetime.datetime(2024, 2, 20)]
    assert all(after[f] == v for f, v in before.items() if "2024-03" in f or "2024-04" in f) and not any("2024-01" in f for f in after)


# ---- cursors


@pytest.mark.parametrize("sorts", [[], [("a", "ASC")], [("a", "DESCENDING"), ("b", "ASCENDING")], [("b", "DESC"), ("a", "DESC")]])
def test_pages_behind_a_cursor_give_the_whole_order(spark, sorts):
    rng = random.Random(5)
    rows = [(f"{i:03d}", rng.choice([None, 1, 2, 3]), rng.choice([None, "x", "y"])) for i in range(57)]
    df = spark.createDataFrame(rows, "id string, a int, b string")
    want = [r.id for r in df.orderBy(*search.keyset_order(sorts)).collect()]
    got, cursor = [], None
    for _ in range(20):
        page = search.page_behind(df, sorts, 10, cursor)
        got += [r.id for r in page.collect()]
        cursor = search.next_cursor(page, sorts, 10)
        if cursor is None:
            break
    assert got == want
    assert search.next_cursor(df.limit(0), sorts, 10) is None


@pytest.mark.parametrize("sorts", [[], [("a", "DESCENDING"), ("b", "ASCENDING")]])
def test_all_pages_at_once_are_those_of_the_cursors(spark, sorts):
    rng = random.Random(8)
    df = spark.createDataFrame([(f"{i:03d}", rng.choice([None, 1, 2, 3]), rng.choice([None, "x", "y"])) for i in range(57)], "id string, a int, b string")
    first = search.page_behind(df, sorts, 10)
    start = cursor = search.next_cursor(first, sorts, 10)
    want = []
    for number in range(5):
        page = search.page_behind(df, sorts, 10, cursor)
        want += [(r.id, number, row) for row, r in enumerate(page.collect(), 1)]
        cursor = search.next_cursor(page, sorts, 10)
    listed = lambda rows: sorted((r.page, r.row, r.id) for r in rows.collect())
    assert listed(search.pages_behind(df, sorts, 10, start)) == sorted((p, n, i) for i, p, n in want) and len(want) == 47
    # copies at the end of a page are not lost
    whole = search.pages_behind(df.unionByName(df), sorts, 9)
    assert [(r.page, r.row) for r in whole.orderBy("page", "row").collect()] == [(i // 9, i % 9 + 1) for i in range(114)]
    assert whole.groupBy("id").count().filter("count <> 2").isEmpty()


def test_the_work_of_a_search_does_not_grow_with_its_pages(spark, monkeypatch):
    from checks import history

    class Tables:
        contacts = spark.range(2000).select(
            F.col("id").cast("string").alias("id"), F.concat(F.lit("c"), F.col("id") % 7).alias("company"),
            F.lit("2024-01-01").cast("timestamp").alias("lastmodifieddate"), F.lit("lead").alias("lifecyclestage"))

    calls, one = [], search.page_behind
    monkeypatch.setattr(search, "page_behind", lambda *a: calls.append(a) or one(*a))
    rows = history.search_after(Tables()).collect()
    assert len(calls) <= 2
    want = sorted(range(2000), key=lambda i: (-(i % 7), str(i)))
    assert [int(r.id) for r in sorted(rows, key=lambda r: (r.page, r.row))] == want and max(r.page for r in rows) == 13


def test_a_cursor_reaches_the_scan(spark):
    path = scratch_path(spark, "pages")
    spark.range(100).select(F.col("id").cast("string").alias("id"), (F.col("id") % 10).alias("a")).write.parquet(path)
    plan = search.page_behind(spark.read.parquet(path), [("a", "ASC")], 10, (7, "57"))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(a,7)" in plan.split("PushedFilters")[1] and "Offset" not in plan and "TakeOrderedAndProject" in plan


# ---- sets


def test_sets_are_brought_up_to_date(spark):
    df = spark.createDataFrame(contacts(150, 2), CONTACTS)
    recent = F.pmod(F.xxhash64("id"), F.lit(3)) == 0
    old, new = df.filter(~recent), df.filter(recent)
    got = sets.update_sets(sets.duplicate_sets(old), sets.new_links(new, old))
    want = sets.duplicate_sets(df)
    listed = lambda d: sorted((r.id, r.set_id) for r in d.collect())
    assert listed(got) == listed(want) and got.count() > 50


def test_old_links_are_not_read_again(spark):
    labels, links = scratch_path(spark, "labels"), scratch_path(spark, "links")
    spark.createDataFrame([("1", "1"), ("2", "1"), ("5", "5"), ("6", "5"), ("8", "8"), ("9", "8")], "id string, set_id string").write.parquet(labels)
    spark.createDataFrame([("2", "6"), ("7", "7"), ("3", "4"), ("0", "4")], "id_1 string, id_2 string").write.parquet(links)
    out = sets.update_sets(spark.read.parquet(labels), spark.read.parquet(links))
    assert {r.id: r.set_id for r in out.collect()} == {"1": "1", "2": "1", "5": "1", "6": "1", "8": "8", "9": "8", "3": "0", "4": "0", "0": "0"}
    # what is read is the labels and what was made of the new links
    read = {line.split("Location:")[1].split(",")[0] for line in out._jdf.queryExecution().executedPlan().toString().splitlines() if "Location:" in line}
    assert not any("/links-" in line and links in line for line in read)


# ---- joins that stay linear


def names_with_a_common_word(n, seed=6):
    rng = random.Random(seed)
    return sorted({"acme holding " + "".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(9)) for _ in range(n)})


def test_a_common_word_does_not_bring_all_names_together(spark):
    names = names_with_a_common_word(20_000)
    near = [names[i][:-1] + "y" for i in range(0, 400, 2)] + [names[i] + "e" for i in range(1, 400, 2)]
    df = spark.createDataFrame([(x, i) for i, x in enumerate(names + near)], "name string, id int").repartition(8)
    found = similar.candidates(df, "name", [], ["id"], 2).select("text_1", "text_2").cache()
    # all names with all would be 200 million
    assert found.count() < 30 * len(names)
    pairs = {frozenset(r) for r in found.distinct().collect()}
    found.unpersist()
    assert all(frozenset(p) in pairs for p in zip(names[0:400:2] + names[1:400:2], near))


@pytest.mark.parametrize("sizes, limits", [((4_000, 8_000), (0, 0.85)), ((1_500, 3_000), (2, None))])
def test_short_texts_with_a_common_word_stay_linear(spark, sizes, limits):
    joined = []
    for n in sizes:
        df = spark.createDataFrame([(f"acme {i * 7 + 1000}", i) for i in range(n)], "name string, id int").repartition(8)
        found = similar.candidates(df, "name", [], ["id"], *limits).select("text_1", "text_2").cache()
        joined.append(found.count())
        pairs = {frozenset(r) for r in found.distinct().collect()}
        found.unpersist()
        # 70 numbers further on, one or two letters differ
        assert {frozenset((f"acme {x}", f"acme {x + 700}")) for x in range(1000, 1000 + 7 * (n - 100), 7) if str(x)[-3] in "012"} <= pairs
    # all with all would be four times as many
    assert joined[1] < 3 * joined[0]


@pytest.mark.parametrize("limits", [(2, None), (1, None), (0, 0.8), (3, 0.85)])
def test_finer_pieces_find_all_pairs(spark, monkeypatch, limits):
    monkeypatch.setattr(similar, "HOT_TEXTS", 3)
    distance, threshold = limits
    rng = random.Random(7)
    base = ["the acme group " + "".join(rng.choice("abc") for _ in range(rng.randrange(2, 9))) for _ in range(60)] + ["acme", "acne", "a", "", "xx"]
    texts = set(base)
    for t in base[:40]:
        for _ in range(3):
            at = rng.randrange(len(t) + 1)
            t = t[:at] + rng.choice(["", "z", "q"]) + t[at + rng.randrange(2):]
            texts.add(t)
    rows = [(x, b, i) for i, x in enumerate(sorted(texts)) for b in ("b1", "b2")]
    df = spark.createDataFrame(rows, "name string, block string, id int")
    got = [(r.block, r.text_1, r.text_2, r.distance) for r in similar.similar_texts(df, "name", ["block"], ["id"], distance, threshold).collect()]

    def far(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    want = []
    for a, b in itertools.combinations(sorted(texts, key=lambda x: (len(x), x)), 2):
        d = far(a, b)
        if d <= distance or (threshold is not None and 1 - d / len(b) >= threshold):
            want += [(k, a, b, d) for k in ("b1", "b2")]
    assert sorted(got) == sorted(want)


def test_grid_join_equals_plain_join(spark):
    left = spark.range(400).select(F.when(F.col("id") < 250, 1).otherwise(F.col("id") % 9).alias("k"), F.col("id").alias("a"))
    right = spark.range(300).select(F.when(F.col("id") < 200, 1).otherwise(F.col("id") % 9).alias("k"), F.col("id").alias("b"))
    rows = lambda df: sorted(tuple(r) for r in df.select("k", "a", "b").collect())
    assert rows(skew.grid_join(left, right, ["k"], ["a"], ["b"], 20)) == rows(left.join(right, "k"))
    assert rows(skew.grid_join(left, right.filter("k = 5"), ["k"], ["a"], ["b"], 20)) == rows(left.join(right.filter("k = 5"), "k"))


def test_one_contact_in_very_many_lists(spark):
    """Every list has the contact, and one other of its own; two lists have more in common."""
    n = 20_000
    members = spark.range(n).select(F.concat(F.lit("l"), F.col("id").cast("string")).alias("list_id"), F.explode(F.array(F.lit("all"), F.concat(F.lit("c"), F.col("id").cast("string")))).alias("contact_id"))
    twins = spark.createDataFrame([(lst, c) for lst in ("x", "y") for c in ("p", "q", "r", "all")], "list_id string, contact_id string")
    got = lists.list_overlap(members.unionByName(twins), 80.0).collect()
    assert [(r.list_1, r.list_2, r.shared) for r in got] == [("x", "y", 4)]


# ---- dependency levels


def test_ladders_take_few_rounds(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(order, "contracted", lambda *a, f=order.contracted: rounds.append(1) or f(*a))
    deps = {"r": []}
    last = "r"
    for i in range(40):  # paths that part and meet again, forty times
        deps |= {f"a{i}": [last], f"b{i}": [last], f"m{i}": [f"a{i}", f"b{i}"]}
        last = f"m{i}"
    deps |= {"x": [last, "y"], "y": ["x"], "z": ["y", "gone"], "w": ["z", "x"]}
    df = spark.createDataFrame(list(deps.items()), "action_id string, dependencies array<string>")
    got = {r.action_id: (r.level, r.status) for r in order.dependency_levels(df).collect()}
    assert got["m39"] == (80, "placed") and got["a7"] == (15, "placed")
    assert got["x"][1] == got["y"][1] == "cyclic" and got["z"][1] == got["w"][1] == "missing_dependency"
    assert len(rounds) <= 10


def test_levels_equal_brute_force(spark):
    rng = random.Random(9)
    deps = {}
    for i in range(60):
        own = {f"n{rng.randrange(i)}" for _ in range(rng.randrange(4))} if i else set()
        if rng.random() < 0.03:
            own.add("gone")
        if rng.random() < 0.04:
            own.add(f"n{rng.randrange(60)}")
        deps[f"n{i}"] = sorted(own)
    lost, grown = set(), True
    while grown:
        more = {a for a, d in deps.items() if a not in lost and any(x not in deps or x in lost for x in d)}
        lost, grown = lost | more, bool(more)
    level, grown = {}, True
    while grown:
        more = {a: max([level[x] + 1 for x in d], default=0) for a, d in deps.items() if a not in level and a not in lost and all(x in level for x in d)}
        level, grown = level | more, bool(more)
    want = {a: (level[a], "placed") if a in level else (None, "missing_dependency" if a in lost else "cyclic") for a in deps}
    df = spark.createDataFrame(list(deps.items()), "action_id string, dependencies array<string>")
    assert {r.action_id: (r.level, r.status) for r in order.dependency_levels(df).collect()} == want


# ---- rules by name


def test_rules_by_name(spark):
    @rules.register_rule("short_company", ["company", "badge"])
    def short_company(df, as_of, settings):
        return rules.Rule("short_company", "low", "high", "Company name is short", F.length("company") < 3, F.col("company"), field="company")

    try:
        df = spark.createDataFrame([("1", "u@x.co", "AB"), ("2", "u@x.co", "Acme")], "id string, email string, company string")
        found = rules.audit_contacts(df, "2024-02-01 00:00:00", QualityRules(required_contact_fields=(), custom_rules=("short_company",)))
        assert [(r.type, r.object_id, r.current_value) for r in found.collect()] == [("short_company", "1", "AB")]
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
        with pytest.raises(ValueError, match="registered already"):
            rules.register_rule("short_company")(lambda df, as_of, settings: [])
        with pytest.raises(ValueError, match="nosuch"):
            rules.audit_contacts(df, "2024-02-01 00:00:00", QualityRules(custom_rules=("nosuch",)))
    finally:
        rules.unregister_rule("short_company")
