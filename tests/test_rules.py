"""Rules on hand-written rows, including the awkward ones."""

from pyspark.sql import functions as F

from rowmender.config import CaseSettings, QualityRules
from rowmender.operators import cases, issues, rules
from rowmender.schemas import bag_to_columns, columns_to_bag

AS_OF = "2024-02-01 00:00:00"
SCHEMA = ("id string, email string, firstname string, lastname string, phone string, website string, company string, "
          "jobtitle string, industry string, notes_last_contacted string, hs_analytics_last_visit_timestamp string")


def contact(id, email="a@b.co", first="Ann", last="Lee", phone=None, website=None, company=None, title=None,
            industry=None, contacted=None, visited=None):
    return (id, email, first, last, phone, website, company, title, industry, contacted, visited)


def audit(spark, *rows, **kw):
    df = spark.createDataFrame(list(rows), SCHEMA)
    found = rules.audit_contacts(df, AS_OF, QualityRules(**kw))
    return sorted((r.object_id, r.type, r.severity, r.confidence, r.description, r.current_value, r.suggested_value)
                  for r in found.collect())


def kinds(found):
    return [(f[0], f[1]) for f in found]


def test_required_fields(spark):
    found = audit(spark, contact("1", first=None, last=""), contact("2", email="  "))
    assert [(f[0], f[1], f[2], f[3], f[4]) for f in found] == [
        ("1", "missing_required_field", "high", "high", "Missing required field: firstname"),
        ("1", "missing_required_field", "high", "high", "Missing required field: lastname"),
        ("2", "invalid_email_format", "high", "high", "Invalid email format"),
        ("2", "missing_required_field", "high", "high", "Missing required field: email")]
    assert kinds(audit(spark, contact("1"), required_contact_fields=("fax",))) == [("1", "missing_required_field")]


def test_email_and_phone(spark):
    found = audit(spark, contact("1", email="invalid-email"), contact("2", phone="123"), contact("3", email="a@b.co\n"),
                  contact("4", phone="(555) 123-4567"), contact("5", email="a@b@c.d"), contact("6", phone=""))
    assert kinds(found) == [("1", "invalid_email_format"), ("2", "invalid_phone_format"),
                            ("3", "invalid_email_format"), ("5", "invalid_email_format")]
    assert found[1][2:4] == ("medium", "medium")


def test_url(spark):
    found = audit(spark, contact("1", website="not a url"), contact("2", website="example.com"))
    assert [(f[0], f[1], f[2], f[3]) for f in found] == [("1", "invalid_url_format", "low", "low")]


def test_stale(spark):
    found = audit(
        spark, contact("exactly", contacted="2023-02-01T00:00:00Z"), contact("older", contacted="2023-01-31T23:59:59Z"),
        contact("visited", contacted="2020-01-01T00:00:00Z", visited="2024-01-01T00:00:00Z"),
        contact("unknown"), contact("garbage", contacted="soon"), contact("epoch", visited="1600000000000"))
    assert [(f[0], f[4], f[5]) for f in found] == [
        ("older", "No activity in 365 days (threshold: 365)", "2023-01-31T23:59:59.000Z")]


def test_typos(spark):
    found = audit(spark, contact("1", first="  John  ", last="Doe  Smith", company="Acme "))
    assert [(f[4], f[6]) for f in found] == [
        ("Company name has formatting issues", "Acme"), ("First name contains multiple consecutive spaces", "John"),
        ("First name has leading/trailing spaces", "John"), ("Last name has formatting issues", "Doe Smith")]
    assert {f[2:4] for f in found} == {("low", "medium")}


def test_same_issue_ids_in_every_run(spark):
    df = spark.createDataFrame([contact("1", email="x"), contact("2", first=None)], SCHEMA)
    first, second = (sorted(r.issue_id for r in rules.audit_contacts(df, AS_OF).collect()) for _ in range(2))
    assert first == second and len(set(first)) == 2


def test_companies(spark):
    df = spark.createDataFrame([("1", "Acme", None), ("2", "", "a.co")], "id string, name string, domain string")
    assert sorted((r.object_id, r.field, r.object_type) for r in rules.audit_companies(df).collect()) == [
        ("1", "domain", "company"), ("2", "name", "company")]


def test_cases(spark):
    df = spark.createDataFrame([
        contact("jon", first="Jon"), contact("odd", title="CTO", industry="Retail", company="Test Ltd"),
        contact("test", company="The Contest"), contact("fine"), contact("bob", first="Bob", email="bad")], SCHEMA)
    found = cases.review_cases(df, rules.audit_contacts(df, AS_OF))
    assert sorted((r.contact_id, r.type, r.needs_reasoning, r.needs_exploration) for r in found.collect()) == [
        ("jon", "name_typo", True, False), ("odd", "semantic_anomaly", True, True),
        ("test", "context_dependent", False, True)]
    batch = cases.case_batches(found, CaseSettings(batch_size=2)).collect()
    assert sorted((r.contact_id, r.route, r.position, r.batch) for r in batch) == [
        ("jon", "reasoning", 1, 0), ("odd", "exploratory", 2, 0), ("odd", "reasoning", 2, 0), ("test", "exploratory", 3, 1)]
    outside = spark.createDataFrame(
        [(c, "name_typo", "low", "medium", "d", "why", None) for c in ("jon", "ghost", "ghost")],
        "contact_id string, type string, severity string, confidence string, description string, reasoning string, "
        "suggested_value string")
    assert [r.object_id for r in issues.attach_findings(found, outside, "ai_reasoning").collect()] == ["jon"]
    assert issues.unknown_findings(found, outside).first()[0] == 2


def test_summary_and_insights(spark):
    df = spark.createDataFrame([contact(str(i), email="x") for i in range(6)] + [contact("ok")], SCHEMA)
    found = rules.audit_contacts(df, AS_OF)
    summary = issues.summarize(found, df, 0.5)
    row = summary.first()
    assert (row.total_records, row.issues_found, row.high, row.rule_based, row.ai_cost_usd) == (7, 6, 6, 6, 0.5)
    assert row.by_type == {"invalid_email_format": 6} and row.critical == 0
    insight = issues.quality_insights(summary).first()
    assert insight.patterns_detected == ["invalid_email_format is the most common issue (6 occurrences)"]
    assert insight.recommendations == ["Implement email validation at point of entry"]
    empty = issues.quality_insights(issues.summarize(found.filter("false"), df)).first()
    assert (empty.summary, empty.patterns_detected) == ("Found 0 data quality issues using rule-based analysis", [])


def test_bag_form(spark):
    df = spark.createDataFrame([contact("1", email="x")], SCHEMA).withColumns(
        {"created_at": F.current_timestamp(), "updated_at": F.current_timestamp(), "archived": F.lit(False)})
    bag = columns_to_bag(df, ["email", "firstname", "lastname"])
    back = bag_to_columns(bag, ["email", "firstname", "lastname"])
    assert [r.type for r in rules.audit_contacts(back, AS_OF).collect()] == ["invalid_email_format"]
