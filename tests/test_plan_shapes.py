"""What the physical plans must and must not contain."""

import pytest
from pyspark.sql import functions as F

from rowmender.operators import cases, duplicates, fuzzy, issues, rules, search
from rowmender.plans import apply, build
from rowmender.session import scratch_path
from rowmender.sources import scans

COLUMNS = "id string, email string, firstname string, lastname string, phone string, mobilephone string, company string, website string, notes string, createdate timestamp"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def contacts(spark):
    path = scratch_path(spark, "contacts")
    rows = [(str(i), f"u{i % 7}@x.co", "Ann", "Lee", None, None, "Acme", None, "long text", None) for i in range(20)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(path)
    return spark.read.parquet(path)


def test_rules_and_actions_do_not_shuffle(contacts):
    plan = plan_of(build.build_actions(rules.audit_contacts(contacts, "2024-02-01 00:00:00"), "p"))
    assert "Exchange" not in plan and "Python" not in plan
    # only the needed columns are read
    assert "notes:string" not in plan and "email:string" in plan


def test_filters_reach_the_scan(contacts):
    recent = plan_of(scans.created_after(contacts, "2024-01-01 00:00:00").select("id"))
    assert "GreaterThanOrEqual(createdate" in recent and "company" not in recent.split("ReadSchema")[1]
    found = plan_of(search.search(contacts, [[("company", "EQ", "Acme"), ("email", "HAS_PROPERTY")]]).select("id"))
    assert "EqualTo(company,Acme)" in found


def test_no_cross_joins(contacts):
    quality = rules.audit_contacts(contacts, "2024-02-01 00:00:00")
    frames = [
        duplicates.exact_pairs(contacts), duplicates.pair_counts(contacts), fuzzy.fuzzy_pairs(contacts),
        fuzzy.nickname_pairs(contacts), fuzzy.name_domain_groups(contacts), cases.review_cases(contacts, quality),
        issues.summarize(quality, contacts), issues.audit_overlap(quality),
        apply.apply_changes(contacts, apply.property_changes(build.build_actions(quality, "p"))),
    ]
    for df in frames:
        plan = plan_of(df)
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_top_rows_are_limited_before_the_shuffle(contacts):
    actions = build.build_actions(rules.audit_contacts(contacts, "2024-02-01 00:00:00"), "p")
    assert plan_of(build.preview(actions)).count("WindowGroupLimit") == 2
    assert "TakeOrderedAndProject" in plan_of(search.page(contacts, [("email", "DESC")], 10, 5))


def test_links_are_exchanged_as_often_as_needed(spark, contacts):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(duplicates.exact_pairs(contacts))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    # the rows, the heads of the groups, and the links, of which several key types may hold the same
    assert plan.count("Exchange hashpartitioning") == 3


def test_summary_counts_before_it_gathers(contacts):
    quality = rules.audit_contacts(contacts, "2024-02-01 00:00:00")
    per_type = issues.summarize(quality, contacts)
    assert plan_of(per_type).count("hashpartitioning(type") == 1
    assert per_type.select(F.size("by_type")).first()[0] >= 0
