"""Lists, properties, masking, search, usage and streams on small tables."""

import random

from pyspark.sql import functions as F

from rowmender.config import AuditConfig, QualityRules
from rowmender.operators import lists, masking, modules, pipeline, properties, search
from rowmender.session import scratch_path
from rowmender.sources import scans
from rowmender.streaming import jobs


def test_list_overlap_equals_brute_force(spark, hot_from):
    hot_from(10)
    rng = random.Random(2)
    groups = {f"l{i}": set(rng.sample(range(30), rng.randrange(1, 20))) for i in range(14)}
    groups["copy"] = set(list(groups["l3"])[:-1]) or {1}
    groups["whole"] = set(range(30))
    df = spark.createDataFrame([(k, str(v)) for k, vs in groups.items() for v in vs], "list_id string, contact_id string")
    for limit in (50.0, 80.0):
        want = {(a, b): len(groups[a] & groups[b]) for a in groups for b in groups if a < b
                and 100 * len(groups[a] & groups[b]) > limit * min(len(groups[a]), len(groups[b]))}
        assert {(r.list_1, r.list_2): r.shared for r in lists.list_overlap(df, limit).collect()} == want


def test_masking(spark):
    df = spark.sql("SELECT 1 AS id, 'a' AS email, 'b' AS Company, null AS FirstName, named_struct('homeAddress', 'x', 'n', 2) AS s, "
                   "array(named_struct('phone', '1', 'k', 2)) AS items, map('workPhone', '1', 'size', '9') AS bag")
    row = masking.mask_personal(df).first()
    assert (row.id, row.email, row.Company, row.FirstName) == (1, "[REDACTED]", "b", "[REDACTED]")
    assert (row.s.homeAddress, row.s.n, row["items"][0].phone, row["items"][0].k) == ("[REDACTED]", 2, "[REDACTED]", 2)
    assert row.bag == {"workPhone": "[REDACTED]", "size": "9"}


def test_search_operators(spark):
    df = spark.createDataFrame([("1", "Acme test-lab", 5), ("2", "Contest", 9), ("3", None, None)], "id string, c string, n int")
    hit = lambda *f: sorted(r.id for r in search.search(df, [[f]]).collect())
    assert hit("c", "CONTAINS_TOKEN", "TEST") == ["1"] and hit("c", "NOT_CONTAINS_TOKEN", "test") == ["2", "3"]
    assert hit("c", "HAS_PROPERTY") == ["1", "2"] and hit("c", "NOT_HAS_PROPERTY") == ["3"]
    assert hit("n", "BETWEEN", 5, 6) == ["1"] and hit("n", "IN", [9]) == ["2"] and hit("n", "NOT_IN", [9]) == ["1", "3"]
    assert hit("n", "NEQ", 5) == ["2", "3"] and hit("n", "GTE", 9) == ["2"] and hit("n", "LT", 9) == ["1"]
    assert search.search(df, []).count() == 3
    assert [r.id for r in search.page(df, [("n", "DESC")], 1, 1).collect()] == ["1"]
    assert search.total(search.search(df, [[("n", "GT", 4), ("c", "EQ", "Contest")], [("id", "EQ", "3")]])).first()[0] == 2


def test_values_and_usage(spark):
    df = spark.createDataFrame([(v,) for v in ["Tech", "tech", "Tech", "Technology", "Technolgy", "IT", "", None]], "v string")
    got = {(r.kind, r.variant): (r.standard, r.records) for r in properties.value_variants(df, "v", {"IT": "Technology"}).collect()}
    assert got == {("casing", "tech"): ("Tech", 3), ("mapping", "it"): ("Technology", 1), ("typo", "technology"): ("Technolgy", 1)}
    for exact in (True, False):
        row = properties.property_usage(df, ["v"], exact=exact).first()
        assert (row.records, row.filled, row.distinct_values, row.fill_rate, row.verdict) == (8, 6, 5, 75.0, "keep")


def test_call_usage(spark):
    df = spark.createDataFrame(
        [("a", "reasoning", "claude-sonnet-4-20250514", 1_000_000, 1_000_000, 0, 1, False), ("a", "simple", "claude-3-haiku-20240307", 1_000_000, 0, 1_000_000, 0, False),
         ("b", "simple", "claude-3-haiku-20240307", 5, 5, 5, 5, True)],
        "operation string, mode string, model string, input_tokens long, output_tokens long, thinking_tokens long, tool_calls long, is_error boolean")
    got = {(r.scope, r.name): (r.requests, r.cost_usd, r.errors) for r in pipeline.usage_rollup(
        df, {"claude-sonnet-4-20250514": (3.0, 15.0, 3.0), "claude-3-haiku-20240307": (0.25, 1.25, 0.25)}).collect()}
    assert got == {("operation", "a"): (2, 18.5, 0), ("operation", "b"): (0, 0.0, 1), ("mode", "reasoning"): (1, 18.0, 0),
                   ("mode", "simple"): (1, 0.5, 1), ("total", "all"): (2, 18.5, 1)}


def test_formats_by_reader(spark):
    path = scratch_path(spark, "csv")
    spark.createDataFrame([("1", "a@b.co")], "id string, email string").write.option("header", True).csv(path)
    assert scans.read_objects(spark, path, ["email", "phone"], "csv").first().asDict() == {"id": "1", "email": "a@b.co", "phone": None}
    bags = scratch_path(spark, "bags")
    spark.sql("SELECT '1' AS id, map('email', 'a@b.co', 'x', 'y') AS properties, false AS archived").write.json(bags)
    assert scans.read_objects(spark, bags, ["email"], "json", bag=True).first().email == "a@b.co"


def test_streams_in_several_batches(spark):
    folder = scratch_path(spark, "arrivals")
    schema = "id string, email string, event_time timestamp"
    batches = [[("1", "a@x.co", "2024-01-01 00:00:00"), ("2", " A@x.co", "2024-01-01 00:01:00")],
               [("3", "a@x.co", "2024-01-01 00:02:00"), ("4", "old@x.co", "2024-01-01 00:03:00"), ("5", "b@x.co", "2024-01-01 00:04:00")]]
    for rows in batches:
        df = spark.createDataFrame(rows, "id string, email string, t string")
        df.select("id", "email", F.col("t").cast("timestamp").alias("event_time")).coalesce(1).write.mode("append").parquet(folder)
    existing = spark.createDataFrame([("0", "OLD@x.co")], "id string, email string")
    arrivals = jobs.read_files(spark, folder, schema, files_per_trigger=1)
    fresh = jobs.run_to_table(jobs.new_addresses(arrivals, existing, "event_time"), "fresh")
    assert sorted(r.email_key for r in fresh.collect()) == ["a@x.co", "b@x.co"]
    found = jobs.run_to_table(jobs.validate(jobs.read_files(spark, folder, schema), "2024-02-01 00:00:00"), "found")
    assert sorted({(r.object_id, r.type) for r in found.filter("type LIKE 'invalid%'").collect()}) == [("2", "invalid_email_format")]

    events = scratch_path(spark, "events")
    for n in (2, 1):
        spark.range(n).select(F.lit("c").alias("contact_id"), F.lit("BOUNCE").alias("event_type")).coalesce(1).write.mode("append").parquet(events)
    source = jobs.read_files(spark, events, "contact_id string, event_type string", files_per_trigger=1)
    updates = jobs.run_updates(jobs.bounce_counts(source), "bounces")
    members = spark.createDataFrame([("l", "c"), ("l", "d")], "list_id string, contact_id string")
    flagged, left = jobs.bounced_members(members, updates)
    assert [tuple(r) for r in flagged.collect()] == [("c", 0, 3, "review")] and left.count() == 2
    hard = spark.createDataFrame([("c", 0, 1), ("d", 1, 0)], "contact_id string, hard long, soft long")
    flagged, left = jobs.bounced_members(members, hard)
    assert [tuple(r) for r in flagged.collect()] == [("d", 1, 0, "remove")] and [r.contact_id for r in left.collect()] == ["c"]


def test_property_audit_finds_variants(spark):
    names = ["Tech", "tech", "Tech", "Technology", "Technolgy", "IT", "", None]
    df = spark.createDataFrame([(str(i), v, "x" if i == 9 else None) for i, v in enumerate(names * 5)], "id string, industry string, fax string")
    config = AuditConfig(rules=QualityRules(industry_mappings={"IT": "Technology"}))
    got = modules.run_audits(["properties"], {"contacts": df}, config, None).collect()
    assert {(r.type, r.field, r.current_value, r.suggested_value) for r in got} == {
        ("low_population", "fax", "2.5", None), ("value_variant", "industry=tech", "tech", "Tech"),
        ("value_variant", "industry=it", "it", "Technology"), ("value_variant", "industry=technology", "technology", "Technolgy")}
    assert len({r.issue_id for r in got}) == len(got) == 4
