"""Plans: building, views, dependencies, running, rolling back, storing."""

import pytest
from pyspark.sql import functions as F

from rowmender.plans import apply, build, execution, order, rollback
from rowmender.schemas import ACTION_SCHEMA
from rowmender.session import scratch_path
from rowmender.sources import store

ISSUES = ("issue_id string, module string, type string, severity string, object_type string, object_id string, description string, "
          "current_value string, suggested_value string, confidence string, detection_method string, reasoning string, field string, rule_no int")


def issue(n, kind, severity="low", confidence="medium", description="d", current=None, suggested=None, method="rule",
          reasoning=None, field="", object_type="contact"):
    return (f"i{n}", "m", kind, severity, object_type, str(n), description, current, suggested, confidence, method, reasoning, field, n)


@pytest.fixture(scope="module")
def plan(spark):
    rows = [
        issue(1, "missing_required_field", "high", "high", "Missing required field: email", field="email"),
        issue(2, "invalid_email_format", "high", "high", current="bad@x"),
        issue(3, "stale_contact", "medium"),
        issue(4, "duplicate", "high", "high", suggested="9", current='{"primaryId":"a@b"}'),
        issue(5, "obvious_typo", current=" Ann", suggested="Ann", field="firstname"),
        issue(6, "semantic_anomaly", "medium", "low", method="ai_exploratory", reasoning="odd"),
        issue(7, "something_else"),
        issue(8, "company_format", "low"),
        issue(9, "name_typo", "medium", "high", method="ai_reasoning", reasoning="short", object_type="company"),
    ]
    df = spark.createDataFrame(rows, ISSUES)
    return build.build_actions(df, "p")


def by_object(actions):
    return {r.target.object_id: r for r in actions.collect()}


def test_actions(plan):
    got = by_object(plan)
    assert set(got) == {"1", "2", "3", "4", "5", "6", "9"}
    assert [got[k].type for k in "1234"] == ["update_property", "update_property", "set_marketing_status", "merge_contacts"]
    assert [got[k].change.property for k in "125"] == ["email", "email", None]
    assert [got[k].target.display_name for k in "1249"] == ["Contact 1", "bad@x", "Contact 4", "Company 9"]
    assert [got[k].reversible for k in "1345"] == [True, True, False, True]
    assert [got[k].requires_confirmation for k in "13456"] == [True, False, True, False, True]
    assert got["1"].reasoning == "Fix data quality issue: Missing required field: email"
    assert got["1"].ai_reasoning is None and got["6"].ai_reasoning.primary_reason == "odd"
    assert got["6"].ai_reasoning.confidence_factors == [
        "Uncertain recommendation", "May need additional context", "Detected using AI data exploration"]
    assert got["9"].ai_reasoning.confidence_factors[-1] == "Detected using AI reasoning"
    assert len({r.action_id for r in got.values()}) == 7


def test_options(spark):
    df = spark.createDataFrame([issue(5, "obvious_typo", field="firstname"), issue(6, "name_typo", confidence="low",
                                method="ai_reasoning", reasoning="r")], ISSUES)
    got = build.build_actions(df, "p", include_low=False, infer_property=True).collect()
    assert [r.change.property for r in got] == ["firstname"]
    assert all(r.ai_reasoning is None for r in build.build_actions(df, "p", include_ai_reasoning=False).collect())


def test_filters_and_views(plan):
    ids = lambda df: sorted(by_object(df))
    assert ids(build.filter_actions(plan, ["high"], ["rule"])) == ["1", "2", "4"]
    assert ids(build.filter_actions(plan, types=["update_property"], reversible_only=True)) == ["1", "2", "5", "6", "9"]
    assert ids(build.filter_by_word(plan, "ai_reasoning")) == ["9"] and ids(build.filter_by_word(plan, "low")) == ["6"]
    assert ids(build.min_confidence(plan, "medium")) == ["1", "2", "3", "4", "5", "9"]
    assert ids(build.high_risk(plan)) == ["1", "2", "4", "6"]
    assert ids(build.non_reversible(plan)) == ["4"] and ids(build.ai_made(plan)) == ["6", "9"]
    row = build.summarize_actions(plan, 0.5).first()
    assert (row.total_actions, row.high, row.medium, row.low, row.rule_based, row.estimated_ai_cost_usd) == (7, 4, 2, 1, 5, 0.5)
    assert row.by_type == {"update_property": 5, "merge_contacts": 1, "set_marketing_status": 1}
    assert build.preview(plan, 2).groupBy("confidence").count().agg(F.max("count")).first()[0] == 2
    assert build.group_views(plan).count() == 14


def test_names(spark):
    df = spark.createDataFrame([("/x/data-quality-2025-01-15T10-30-00.json",), ("notes.json",)], "p string")
    got = [r[0] for r in df.select(build.parse_plan_name(F.col("p"))).collect()]
    assert got[0].source_audit == "data-quality" and str(got[0].created_at) == "2025-01-15 10:30:00" and got[1] is None


def dep_table(spark, deps):
    return spark.createDataFrame([(a, ds) for a, ds in deps.items()], "action_id string, dependencies array<string>")


def test_dependency_levels(spark, hot_from):
    hot_from(3)
    df = dep_table(spark, {
        "1": [], "3": ["1"], "2": ["3"], "self": ["self"], "x": ["y"], "y": ["x"], "after": ["x"], "lost": ["gone"],
        "behind": ["lost", "1"], "twice": ["1", "2"], "none": None, **{f"h{i}": ["1"] for i in range(6)}})
    got = {r.action_id: (r.level, r.status) for r in order.dependency_levels(df).collect()}
    assert {k: got[k] for k in ("1", "3", "2", "twice", "none", "h5")} == {
        "1": (0, "placed"), "3": (1, "placed"), "2": (2, "placed"), "twice": (3, "placed"), "none": (0, "placed"), "h5": (1, "placed")}
    assert {k: got[k][1] for k in ("self", "x", "y", "after", "lost", "behind")} == {
        "self": "cyclic", "x": "cyclic", "y": "cyclic", "after": "cyclic", "lost": "missing_dependency", "behind": "missing_dependency"}
    assert [(r.action_id, r.dependency) for r in order.missing_dependencies(df).collect()] == [("lost", "gone")]


def test_long_chains_between_actions_with_several_dependencies(spark):
    deps = {"c0": [], **{f"c{i}": [f"c{i - 1}"] for i in range(1, 40)}, "m": ["c39", "c3"], "n1": ["m"], "n2": ["n1"], "k": ["n2", "m", "c0"],
            "g1": ["gone"], "g2": ["g1"], "g3": ["g2", "c0"], "g4": ["g3"], "o1": ["o2", "c0"], "o2": ["o1"], "o3": ["o2"]}
    got = {r.action_id: (r.level, r.status) for r in order.dependency_levels(dep_table(spark, deps)).collect()}
    assert {k: v[0] for k, v in got.items() if v[1] == "placed"} == {**{f"c{i}": i for i in range(40)}, "m": 40, "n1": 41, "n2": 42, "k": 43}
    assert {k for k, v in got.items() if v[1] == "missing_dependency"} == {"g1", "g2", "g3", "g4"}
    assert {k for k, v in got.items() if v[1] == "cyclic"} == {"o1", "o2", "o3"}


def action(n, kind, object_id, prop=None, value=None, object_type="contact", reversible=True):
    return ("p", f"a{n}", f"{n:03d}", kind, "high", (object_type, object_id, "x"), ("d", prop, None, value), "r", "rule", None,
            reversible, False, [])


def actions(spark, *rows):
    return spark.createDataFrame(list(rows), ACTION_SCHEMA)


CONTACTS = "id string, email string, phone string, hs_marketable_status string"


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(
        [("1", "a", None, "true"), ("2", None, "22", "true"), ("3", "c", "33", "false"), ("4", "", "44", "true")], CONTACTS)


def content(df):
    return {r.id: tuple(r)[1:] for r in df.collect()}


def test_run_and_roll_back(spark, people):
    todo = actions(
        spark, action(1, "update_property", "1", "email", "b"), action(2, "update_property", "1", "email", "c"),
        action(3, "update_property", "2", "phone", None), action(4, "set_marketing_status", "1"),
        action(5, "update_property", "3"), action(6, "merge_contacts", "1", reversible=False),
        action(7, "update_property", "9", "phone", "1"), action(8, "update_property", "l", "name", "x", object_type="list"),
        action(9, "remove_from_list", "l"), action(10, "create_association", "1", value='{"type":"company"}'),
        action(11, "delete_contact", "4", reversible=False), action(12, "explode", "1"))
    images = rollback.before_images(todo, {"contact": people})
    log = execution.run_actions(todo, images, "run", "2024-01-01 00:00:00", continue_on_error=True)
    rows = {r.action_id: r for r in log.collect()}
    assert {k: v.error for k, v in rows.items() if v.status == "failed"} == {
        "a5": "Missing property name", "a6": "Missing secondary contact ID for merge",
        "a8": "Unsupported object type for update: list", "a9": "Missing contact ID for list removal",
        "a10": "Invalid association data", "a12": "Unknown action type: explode"}
    assert rows["a2"].rollback_data.original_value == "a" and rows["a7"].rollback_data is None
    result = execution.run_results(log).first()
    assert (result.successful, result.failed, result.non_reversible, result.status) == (6, 6, 1, "partially_completed")
    check = execution.can_roll_back(log).first()
    assert (check.can_rollback, check.reversible_count, check.non_reversible_count, check.reason) == (True, 4, 1, None)

    changes = apply.property_changes(todo).unionByName(apply.marketing_changes(todo))
    after = apply.apply_changes(people, changes)
    assert content(after) == {"1": ("c", None, "false"), "2": (None, "", "true"), "3": ("c", "33", "false"), "4": ("", "44", "true")}
    assert content(rollback.roll_back(after, log)) == content(people)
    undone = rollback.rollback_results(log).first()
    assert (undone.rolled_back, undone.failed, undone.non_reversible) == (4, 1, 1)
    assert [r.action_id for r in rollback.rollback_errors(log).collect()] == ["a7"]


def test_stop_dry_run_and_resume(spark):
    todo = actions(spark, action(1, "delete_contact", "1", reversible=False), action(2, "update_property", "1"),
                   action(3, "delete_contact", "2", reversible=False))
    log = execution.run_actions(todo, None, "run", "2024-01-01 00:00:00")
    assert sorted((r.action_id, r.status) for r in log.collect()) == [("a1", "success"), ("a2", "failed")]
    result = execution.run_results(log).first()
    assert (result.status, result.resume_from) == ("failed", "a2")
    only = execution.can_roll_back(log).first()
    assert (only.can_rollback, only.reason) == (False, "All actions are non-reversible")
    stops = spark.createDataFrame([("p", "a2")], "plan_id string, resume_from string")
    assert sorted(r.action_id for r in build.resume(todo, stops).collect()) == ["a2", "a3"]
    dry = execution.run_actions(todo, None, "run", "2024-01-01 00:00:00", dry_run=True)
    assert {r.status for r in dry.collect()} == {"skipped"} and execution.run_results(dry).first().status == "completed"


def test_merges(spark, people, hot_from):
    hot_from(2)
    todo = actions(
        spark, action(1, "merge_contacts", "1", value="2"), action(2, "merge_contacts", "2", value="3"),
        action(3, "merge_contacts", "4", value="3"), action(4, "merge_contacts", "x", value="y"),
        action(5, "merge_contacts", "y", value="x"), action(6, "merge_contacts", "ghost", value="4"))
    moves = apply.survivors(apply.merge_actions(todo))
    assert {r.id: r.survivor_id for r in moves.collect()} == {"2": "1", "3": "1", "4": "ghost"}
    merged = apply.apply_merges(people, moves)
    # 4 keeps its row: the contact it should go to does not exist
    assert content(merged) == {"1": ("a", "22", "true"), "4": ("", "44", "true")}
    dated = people.withColumn("lastmodifieddate", F.col("id"))
    recent = apply.apply_merges(dated, moves, ["email", "phone"], policy="recent").filter("id = '1'").first()
    assert (recent.email, recent.phone) == ("c", "33")
    edges = spark.createDataFrame([("2", "k"), ("3", "k"), ("4", "k")], "from_id string, to_id string")
    assert sorted(r.from_id for r in apply.repoint(edges, "from_id", moves.filter("survivor_id = '1'")).collect()) == ["1", "4"]
    long = actions(spark, *[action(i, "merge_contacts", f"{i:03d}", value=f"{i + 1:03d}") for i in range(40)])
    assert {r.survivor_id for r in apply.survivors(apply.merge_actions(long)).collect()} == {"000"}


def test_lists_edges_deletes(spark, people):
    members = spark.createDataFrame([("l", "1"), ("l", "2")], "list_id string, contact_id string")
    todo = actions(spark, action(1, "remove_from_list", "l", value="2", object_type="list"),
                   action(2, "create_association", "1", value='{"type":"company","id":"7"}'))
    got = apply.apply_list_changes(members, members.limit(1), apply.list_removals(todo))
    assert [tuple(r) for r in got.collect()] == [("l", "1")]
    edges = spark.createDataFrame([("contact", "1", "company", "6", None), ("contact", "1", "company", "5", "contact_to_company")],
                                  "from_type string, from_id string, to_type string, to_id string, assoc_type string")
    out = apply.apply_associations(edges, apply.association_actions(todo), edges.filter("to_id = '5'"))
    assert sorted((r.to_id, r.assoc_type) for r in out.collect()) == [("6", "company"), ("7", "contact_to_company")]
    archived = apply.apply_deletes(people, people.filter("id = '2'").select("id"))
    assert {r.id for r in archived.filter("archived").collect()} == {"2"}
    assert content(apply.bulk_update(people, F.col("id") == "3", {"phone": "0"}))["3"][1] == "0"
    sets = apply.bulk_changes(people, F.col("id") == "3", {"phone": "0"})
    table, outcome = apply.batch_update(people, sets.unionByName(sets.withColumn("id", F.lit("zz"))))
    assert content(table)["3"][1] == "0" and {r.id: r.status for r in outcome.collect()} == {"3": "success", "zz": "error"}


def test_edges_stay_spread(spark, monkeypatch):
    monkeypatch.setattr(apply, "EDGES_PER_TASK", 100, raising=False)
    columns = "from_type string, from_id string, to_type string, to_id string, assoc_type string"
    default = "contact_to_company"
    rows = [("contact", str(i), "company", str(i % 7), None if i % 5 == 0 else default) for i in range(2000)]
    odd = [("contact", None, "company", "1", default), ("contact", "x", "company", "1", "other"), ("contact", "x", "company", "1", "other")]
    edges = spark.createDataFrame(rows + odd, columns)
    remove = spark.createDataFrame([r for r in rows if int(r[1]) % 3 == 0] + odd, columns)
    create = spark.createDataFrame([("contact", "3", "company", "3", None), ("contact", "x", "company", "", None), ("contact", "n", "company", "9", "")], columns)
    out = apply.apply_associations(edges, create, remove)
    left = {(*r[:4], r[4] or "company") for r in rows if r[4] is None or int(r[1]) % 3}
    assert sorted(map(repr, (tuple(r) for r in out.collect()))) == sorted(
        map(repr, left | set(odd) | {("contact", "3", "company", "3", default), ("contact", "n", "company", "9", default)}))
    assert out.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 300


def test_derived_edges_are_those_of_their_sql(spark, monkeypatch):
    from checks import tables

    monkeypatch.setattr(tables, "LINES_PER_TASK", 50, raising=False)
    orders = spark.createDataFrame([(i if i % 50 else None, i % 40 if i % 9 else None) for i in range(300)] + [(1, 1)], "o_orderkey bigint, o_custkey bigint")
    lines = spark.createDataFrame(
        [(i % 310 if i % 20 else None, i % 11 if i % 13 else None, "ANR"[i % 3] if i % 7 else None) for i in range(1000)], "l_orderkey bigint, l_suppkey bigint, l_returnflag string")
    path = scratch_path(spark, "tables")
    orders.write.parquet(f"{path}/orders.parquet")
    lines.write.parquet(f"{path}/lineitem.parquet")
    got = tables.table(spark, path, "edges")
    orders.createOrReplaceTempView("orders")
    lines.createOrReplaceTempView("lineitem")
    want = spark.sql(tables.DERIVED["edges"])
    assert got.dtypes == want.dtypes
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert got.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 100


def test_conflicts_and_batches(spark):
    todo = actions(
        spark, action(1, "update_property", "1", "email", "x"), action(2, "update_property", "1", "email", "y"),
        action(3, "merge_contacts", "5", value="1"), action(4, "delete_contact", "6"), action(5, "update_property", "6", "phone", "1"))
    got = {(r.object_id, r.property, r.kind, r.actions) for r in build.conflicts(todo).collect()}
    assert got == {("1", "email", "same_property", 2), ("1", None, "target_removed", 2), ("6", None, "target_removed", 1)}
    mixed = todo.withColumn("source_audit", F.when(F.col("type") == "merge_contacts", "duplicates").otherwise("lists"))
    assert {(r.source_audit, r.batch) for r in build.audit_batches(mixed).collect()} == {("duplicates", 1), ("lists", 2)}
    many = actions(spark, *[action(i, "delete_contact", str(i)) for i in range(250)])
    sizes = build.batch_numbers(many).groupBy("batch").count().orderBy("batch").collect()
    assert [tuple(r) for r in sizes] == [(0, 100), (1, 100), (2, 50)]


def test_store(spark, plan):
    for fmt in ("parquet", "json"):
        path = scratch_path(spark, "plan")
        store.write_plan(plan, path, fmt)
        back = store.read_plan(spark, path, "p", fmt)
        assert sorted(map(repr, back.select(*plan.columns).collect())) == sorted(map(repr, plan.collect()))
    path, kept = scratch_path(spark, "runs"), scratch_path(spark, "kept")
    days = spark.createDataFrame([("a", "2024-01-01"), ("b", "2024-01-31"), ("c", "2024-02-01")], "execution_id string, d string")
    store.write_execution(days.withColumn("started_at", F.col("d").cast("timestamp")), path)
    store.clean_up(spark, path, kept, "2024-03-01 00:00:00", 30)
    assert sorted(r.execution_id for r in spark.read.parquet(kept).collect()) == ["b", "c"]
    runs = days.withColumn("executed_at", F.col("d").cast("timestamp"))
    assert [r.execution_id for r in store.list_executions(runs).collect()] == ["c", "b", "a"]
    assert store.get_execution(runs, "zz").count() == 0
