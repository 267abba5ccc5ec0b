"""Exact and near duplicates against brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from rowmender.config import DuplicateSettings
from rowmender.operators import consistency, duplicates as d, fuzzy, sets
from rowmender.operators.components import connected
from rowmender.operators.similar import similar_texts

SCHEMA = "id string, email string, firstname string, lastname string, phone string, mobilephone string, company string"


def rows(n, seed=1):
    rng = random.Random(seed)
    pick = lambda *xs: rng.choice(xs)
    return [(f"{i:03d}", pick(None, "", "a@x.co", " A@X.co ", f"u{rng.randrange(12)}@y.co"), pick("Ann", "ann ", "Bob", "", None),
             pick("Lee", "Li", "  "), pick(None, "", "(555) 123-4567", "+1 555 123 4567", "none", f"55500000{rng.randrange(20):02d}"),
             pick(None, "5551234567"), pick("Acme", "ACME ", "Beta & Co", None)) for i in range(n)]


def brute(keys, tiers):
    names = {1: "email_key", 2: "phone_company_key", 3: "name_company_key"}
    out = {}
    for a, b in itertools.combinations(sorted(keys, key=lambda r: r.id), 2):
        for tier in tiers:
            k = names[tier]
            if a[k] is not None and a[k] == b[k]:
                out[a.id, b.id] = d.TIER_NAMES[tier]
                break
    return out


def brute_links(keys, tiers):
    names = {1: "email_key", 2: "phone_company_key", 3: "name_company_key"}
    out = {}
    for tier in tiers:
        groups = {}
        for r in keys:
            if r[names[tier]] is not None:
                groups.setdefault(r[names[tier]], []).append(r.id)
        for ids in groups.values():
            for i in sorted(ids)[1:]:
                out.setdefault((min(ids), i), d.TIER_NAMES[tier])
    return out


@pytest.mark.parametrize("switches", list(itertools.product([True, False], repeat=3))[:7])
def test_links_and_counts(spark, switches):
    df = spark.createDataFrame(rows(60), SCHEMA)
    settings = DuplicateSettings(*switches)
    keys = d.match_keys(df).collect()
    tiers = d.enabled_tiers(settings)
    got = d.exact_pairs(df, settings).collect()
    links = brute_links(keys, tiers)
    assert {(r.id_1, r.id_2): r.match_type for r in got} == links and len(got) == len(links)
    want = brute(keys, tiers)
    counts = {r.match_type: r.pairs for r in d.pair_counts(df, settings).collect()}
    assert counts == {t: list(want.values()).count(t) for t in set(want.values())}
    emails = d.email_match_count(df, settings).first()[0]
    by_id = {r.id: r.email_key for r in keys}
    assert emails == sum(by_id[a] is not None and by_id[a] == by_id[b] for a, b in want)


@pytest.mark.parametrize("size", [31, 32, 33, 500])
def test_groups_of_every_size_are_listed_alike(spark, hot_from, size):
    hot_from(100)
    df = spark.createDataFrame([(f"{i:03d}", "same@x.co", "A", "B", None, None, None) for i in range(size)], SCHEMA)
    got = d.exact_pairs(df).collect()
    assert sorted((r.id_1, r.id_2, r.group_size) for r in got) == [("000", f"{i:03d}", size) for i in range(1, size)]
    assert d.pair_counts(df).first().pairs == size * (size - 1) // 2


def test_no_link_between_key_types_is_lost(spark):
    mail = [(f"a{i:03d}", "a@x.co", "A", "B", None, None, None) for i in range(40)]
    phone = [(f"b{i:03d}", None, "A", "B", "5551234567", None, "Acme") for i in range(40)]
    phone[0], phone[1] = (phone[0][0], "a@x.co", *phone[0][2:]), (phone[1][0], "a@x.co", *phone[1][2:])
    df = spark.createDataFrame(mail + phone, SCHEMA)
    links = {(r.id_1, r.id_2) for r in d.exact_pairs(df).collect()}
    assert ("b000", "b001") in links and ("a000", "b001") in links
    assert {r.set_id for r in sets.duplicate_sets(df).collect()} == {"a000"}


def test_match_factors_and_texts(spark):
    df = spark.createDataFrame([
        ("1", "a@x.co", "Jon", "Smith", "none", None, "Acme"), ("2", "A@x.co ", "John", "Smith", "n/a", None, "acme"),
        ("3", None, None, None, "5551234567", None, "Beta"), ("4", None, "", "", "", "1-555-123-4567", "Beta")], SCHEMA)
    pairs = {r.id_1: r for r in d.exact_pairs(df).collect()}
    first, second = pairs["1"], pairs["3"]
    # two phones without digits count as the same phone
    assert (first.match_type, first.email_match, first.phone_match, first.company_match) == ("exact_email", True, True, True)
    assert first.name_similarity == pytest.approx(0.9)
    assert (second.match_type, second.name_similarity) == ("exact_phone_company", 0.0)
    found = {r.object_id: r for r in d.pairs_to_issues(d.exact_pairs(df)).collect()}
    assert found["1"].description == (
        'Potential duplicate: "Jon Smith" and "John Smith" have same email, same phone, same company, nearly identical names')
    assert found["3"].description == 'Potential duplicate: "Unknown" and "Unknown" have same phone, same company'
    assert (found["1"].severity, found["1"].suggested_value, found["1"].field) == ("high", "2", "")
    assert '"name_similarity":0.9' in found["1"].current_value


def test_summary_and_insights(spark):
    df = spark.createDataFrame([(str(i), "a@x.co", "A", "B", None, None, None) for i in range(6)], SCHEMA)
    counts = d.pair_counts(df)
    row = d.duplicate_summary(counts, df).first()
    assert (row.total_records, row.issues_found, row.high, row.by_type) == (6, 15, 15, {"duplicate": 15})
    texts = d.duplicate_insights(counts, d.email_match_count(df), df).first()
    assert texts.patterns_detected == ["Most common duplicate type: exact email (15 pairs)", "15 pairs share the same email address"]
    assert len(texts.recommendations) == 3
    none = df.filter("false")
    texts = d.duplicate_insights(d.pair_counts(none), d.email_match_count(none), none).first()
    assert (texts.summary, texts.patterns_detected, texts.recommendations) == (
        "No contacts found for duplicate detection", [], [])


def test_sets_are_a_partition(spark, hot_from):
    hot_from(5)
    rng = random.Random(3)
    links = [(f"{a:03d}", f"{b:03d}") for a, b in ((rng.randrange(80), rng.randrange(80)) for _ in range(60)) if a != b]
    links += [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(40)] + [("hub", f"h{i:02d}") for i in range(30)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        ra, rb = sorted((find(a), find(b)))
        parent[rb] = ra
    got = connected(spark.createDataFrame(links, "id_1 string, id_2 string")).collect()
    assert {r.id: r.set_id for r in got} == {x: find(x) for x in list(parent)} and len(got) == len(parent)


@pytest.mark.parametrize("distance, threshold", [(2, 0.85), (0, 0.85), (1, None), (2, None), (3, 0.7)])
def test_similar_texts_equals_brute_force(spark, distance, threshold):
    rng = random.Random(distance)
    words = {("b%d" % rng.randrange(2), "".join(rng.choice("abc") for _ in range(rng.randrange(0, 24)))) for _ in range(150)}
    words |= {(b, w[:k] + "x" + w[k + 1:]) for b, w in list(words) for k in [rng.randrange(len(w) + 1)]}
    df = spark.createDataFrame(sorted(words), "block string, word string")
    got = similar_texts(df, "word", ["block"], ["word"], distance, threshold)
    pairs = {(r.block, *sorted((r.text_1, r.text_2))) for r in got.collect()}
    a, b = df.toDF("block", "a"), df.toDF("block", "b")
    far = F.levenshtein("a", "b")
    close = far <= distance
    if threshold is not None:
        close = close | (F.lit(1.0) - far / F.greatest(F.length("a"), F.length("b")) >= threshold)
    want = {(r.block, r.a, r.b) for r in a.join(b, "block").filter((F.col("a") < F.col("b")) & close).collect()}
    assert pairs == want and got.count() == len(want)


def test_near_duplicates(spark):
    df = spark.createDataFrame([
        ("1", "a@x.co", "Robert", "Smith", None, None, "Acme"), ("2", "b@x.co", "Bob", "Smith", None, None, "acme"),
        ("3", "c@x.co", "Robrt", "Smith", None, None, "ACME"), ("4", "d@y.co", "Robert", "Smith", None, None, "Acme"),
        ("5", "A@x.co", "Robertt", "Smith", None, None, "Acme")], SCHEMA)
    close = {(r.id_1, r.id_2): (r.n_1, r.n_2, r.distance) for r in fuzzy.fuzzy_pairs(df).collect()}
    # 1 and 5 share an address, so an exact key has them already, but not 4 and 5
    assert close == {("1", "3"): (2, 1, 1), ("1", "5"): (2, 1, 1), ("3", "5"): (1, 1, 2)}
    half = spark.createDataFrame([
        ("1", "a@x.co", "Jon", "Smith", None, None, "Acme"), ("2", "a@x.co", "John", "Smith", None, None, "Acme"),
        ("3", "c@x.co", "Jon", "Smith", None, None, "Acme"), ("4", "d@x.co", "John", "Smith", None, None, "Acme"),
        ("5", None, "Ann", None, None, None, "Beta"), ("6", None, "Ann", "", None, None, "Beta")], SCHEMA)
    assert {(r.id_1, r.id_2, r.distance, int(r.pairs)) for r in fuzzy.fuzzy_pairs(half).collect()} == {("1", "2", 1, 3), ("5", "5", 0, 1)}
    assert [r.review_order for r in fuzzy.fuzzy_review(fuzzy.fuzzy_pairs(half)).orderBy("review_order").collect()] == [1, 2]
    nick = fuzzy.nickname_pairs(df).collect()
    assert [(r.id_1, r.id_2, r.n_1, r.nickname) for r in nick] == [("1", "2", 2, "bob")]
    twins = {r.domain: (r.n, r.head_id, r.domains, r.pairs) for r in fuzzy.name_domain_groups(df).collect()}
    assert twins == {"x.co": (1, "1", 2, 1), "y.co": (1, "1", 2, 1)}
    like = fuzzy.similar_contacts(df.filter("id = '3'"), df, limit=2).orderBy("rank").collect()
    assert [(r.rank, r.other_id, r.distance) for r in like] == [(1, "1", 1), (2, "4", 1)]


def test_companies_and_domains(spark):
    firms = spark.createDataFrame([("1", "Acme Inc.", "x.co"), ("2", "ACME llc", "X.co"), ("3", "Acme Industries", None),
                                   ("4", "Acme Industires", ""), ("5", None, "y.co")], "id string, name string, domain string")
    got = {(r.id_1, r.id_2, r.kind) for r in fuzzy.company_pairs(firms).collect()}
    assert got == {("1", "2", "same"), ("3", "4", "similar")}
    people = spark.createDataFrame([("p", "a@x.CO"), ("q", "b@z.co"), ("r", None)], "id string, email string")
    assert [(r.id, r.company_id) for r in consistency.associate_by_domain(people, firms).collect()] == [("p", "1")]


def test_incremental(spark):
    df = spark.createDataFrame(rows(50, 5), SCHEMA)
    recent = F.col("id") >= "030"
    got = {(r.id, r.match_type): (r.match_id, r.matches) for r in d.incremental_duplicates(df, recent).collect()}
    keys = d.match_keys(df).collect()
    names = {"exact_email": "email_key", "exact_phone_company": "phone_company_key", "exact_name_company": "name_company_key"}
    want = {}
    for r in keys:
        for kind, k in names.items():
            hits = [o.id for o in keys if o.id < "030" and o[k] is not None and o[k] == r[k]]
            if r.id >= "030" and hits:
                want[r.id, kind] = (min(hits), len(hits))
    assert got == want


def test_primary(spark):
    people = spark.createDataFrame(
        [("1", "a", None, "2024-01-01"), ("2", "a", "b", "2020-01-01"), ("3", "a", "b", "2021-01-01"), ("4", "a", "b", "2021-01-01")],
        "id string, x string, y string, lastmodifieddate string")
    groups = spark.createDataFrame([("1", "1"), ("2", "1"), ("4", "1"), ("3", "1")], "id string, set_id string")
    row = sets.primaries(groups, people).first()
    assert (row.primary_id, row.members, row.filled) == ("3", 4, 3)


def test_tasks_that_widen_contacts_hold_few_rows(spark, monkeypatch):
    from rowmender.operators import consistency, skew
    from rowmender.session import scratch_path

    path = scratch_path(spark, "one-file")
    spark.createDataFrame(rows(200, 4), SCHEMA).coalesce(1).write.parquet(path)
    df = spark.read.parquet(path)
    listed = lambda found: sorted(map(str, found.collect()))
    whole = listed(d.pair_counts(df)), listed(fuzzy.fuzzy_pairs(df))
    monkeypatch.setattr(skew, "ROWS_PER_TASK", 30)
    counted = d.pair_counts(df)
    assert "RoundRobinPartitioning(7)" in counted._jdf.queryExecution().executedPlan().toString()
    close = fuzzy.fuzzy_pairs(df)
    assert "RoundRobinPartitioning(7)" in close._jdf.queryExecution().executedPlan().toString()
    assert (listed(counted), listed(close)) == whole and whole[0]
    # the inputs of the profile are not read again when its rows are
    numbers = df.select("id", F.length("firstname").alias("filled"))
    profile = consistency.pair_profile(d.exact_pairs(df).select("id_1", "id_2", "match_type"), numbers)
    assert path not in profile._jdf.queryExecution().executedPlan().toString() and profile.count() > 0
