"""Rules, cases, summaries and insights of the data-quality audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query
from checks.tables import AS_OF, EXPECTED
from rowmender.config import AuditConfig, CaseSettings
from rowmender.functions import text as t
from rowmender.operators import cases, issues, rules

CONFIG = AuditConfig()
RULES = CONFIG.rules

# every derived text is ASCII, so the plain SQL trim over blanks suffices
EXPECTED["quality_issues"] = f"""
SELECT sha256(concat('data-quality|', type, '|', object_id, '|', detail)) AS issue_id, 'data-quality' AS module, type, severity,
  object_id, description, current_value, suggested_value, confidence, field, rule_no FROM (
  SELECT 'missing_required_field' AS type, 'high' AS severity, 'high' AS confidence, id AS object_id, concat('Missing required field: ', f) AS description,
    NULL AS current_value, NULL AS suggested_value, f AS field, f AS detail, n AS rule_no
  FROM (SELECT id, 'email' AS f, 0 AS n, email AS v FROM contacts UNION ALL SELECT id, 'firstname', 1, firstname FROM contacts
        UNION ALL SELECT id, 'lastname', 2, lastname FROM contacts) r WHERE v IS NULL OR trim(v) = ''
  UNION ALL SELECT 'invalid_email_format', 'high', 'high', id, 'Invalid email format', email, NULL, 'email', 'email', 3 FROM contacts
    WHERE email <> '' AND NOT regexp_full_match(email, '[^\\s@]+@[^\\s@]+\\.[^\\s@]+')
  UNION ALL SELECT 'invalid_phone_format', 'medium', 'medium', id, 'Phone number appears to be incomplete', phone, NULL, 'phone', 'phone', 4 FROM contacts
    WHERE phone <> '' AND length(regexp_replace(phone, '[^0-9]', '', 'g')) < 10
  UNION ALL SELECT 'invalid_url_format', 'low', 'low', id, 'Invalid website URL format', website, NULL, 'website', 'website', 5 FROM contacts
    WHERE website <> '' AND NOT regexp_full_match(website, '[a-z0-9.-]+')
  UNION ALL SELECT 'stale_contact', 'medium', 'medium', id, concat('No activity in ', CAST(CAST(floor(days) AS BIGINT) AS STRING), ' days (threshold: 365)'),
    strftime(latest, '%Y-%m-%dT%H:%M:%S.%gZ'), NULL, '', 'last_activity', 6
    FROM (SELECT id, latest, (epoch_ms(TIMESTAMP '{AS_OF}') - epoch_ms(latest)) / 86400000.0 AS days
          FROM (SELECT id, greatest(notes_last_contacted, hs_analytics_last_visit_timestamp) AS latest FROM contacts) g) h WHERE days > 365
  UNION ALL SELECT 'obvious_typo', 'low', 'medium', id, 'First name contains multiple consecutive spaces', firstname, trim(regexp_replace(firstname, ' +', ' ', 'g')), 'firstname', 'firstname-spaces', 7
    FROM contacts WHERE firstname LIKE '%  %'
  UNION ALL SELECT 'obvious_typo', 'low', 'medium', id, 'First name has leading/trailing spaces', firstname, trim(firstname), 'firstname', 'firstname-edges', 8
    FROM contacts WHERE firstname <> trim(firstname)
  UNION ALL SELECT 'obvious_typo', 'low', 'medium', id, 'Last name has formatting issues', lastname, trim(regexp_replace(lastname, ' +', ' ', 'g')), 'lastname', 'lastname-format', 9
    FROM contacts WHERE lastname LIKE '%  %' OR lastname <> trim(lastname)
  UNION ALL SELECT 'obvious_typo', 'low', 'medium', id, 'Company name has formatting issues', company, trim(regexp_replace(company, ' +', ' ', 'g')), 'company', 'company-format', 10
    FROM contacts WHERE company LIKE '%  %' OR company <> trim(company)
) i"""

ISSUE_FIELDS = "issue_id, type, severity, object_id, description, current_value, suggested_value, confidence"


def quality_issues(x, as_of: str = AS_OF):
    return rules.audit_contacts(x.contacts, as_of, RULES)


def one_rule(x, rule):
    found = rules.run_rules(x.contacts, rule, rules.MODULE)
    return found.select(*ISSUE_FIELDS.split(", "))


def rule_sql(kind: str) -> str:
    return f"SELECT {ISSUE_FIELDS} FROM quality_issues WHERE type = '{kind}'"


query("dq_missing_required", rule_sql("missing_required_field"))(
    lambda x: one_rule(x, [rules.missing_required(f) for f in RULES.required_contact_fields]))
query("dq_invalid_email", rule_sql("invalid_email_format"))(lambda x: one_rule(x, [rules.invalid_email()]))
query("dq_invalid_phone", rule_sql("invalid_phone_format"))(lambda x: one_rule(x, [rules.invalid_phone()]))
query("dq_invalid_url", rule_sql("invalid_url_format"))(lambda x: one_rule(x, [rules.invalid_url()]))
query("dq_typos", rule_sql("obvious_typo"))(lambda x: one_rule(x, rules.typos()))


@query("dq_stale", rule_sql("stale_contact"))
def dq_stale(x):
    return one_rule(x, [rules.stale_contact(x.contacts, t.as_timestamp(AS_OF), RULES.stale_contact_days)])


@query("dq_all_issues", f"SELECT {ISSUE_FIELDS}, module, field, rule_no FROM quality_issues")
def dq_all_issues(x):
    return quality_issues(x).select(*ISSUE_FIELDS.split(", "), "module", "field", "rule_no")


def summary_sql(source: str, records: str) -> str:
    return f"""
SELECT (SELECT count(*) FROM {records}) AS total_records, count(*) AS issues_found,
  count(*) FILTER (severity = 'low') AS low, count(*) FILTER (severity = 'medium') AS medium,
  count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'critical') AS critical,
  count(*) AS rule_based, 0::BIGINT AS ai_reasoning, 0::BIGINT AS ai_exploratory,
  (SELECT string_agg(concat(type, '=', CAST(n AS STRING)), ',' ORDER BY type) FROM (SELECT type, count(*) AS n FROM {source} GROUP BY type) p) AS by_type,
  0.0::DOUBLE AS ai_cost_usd
FROM {source}"""


def flat_counts(c: str):
    """A count map as sorted text."""
    entry = F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return F.array_join(entry, ",").alias(c)


def flat_summary(summary):
    return summary.withColumn("by_type", flat_counts("by_type"))


@query("dq_summary", summary_sql("quality_issues", "contacts"))
def dq_summary(x):
    return flat_summary(issues.summarize(quality_issues(x), x.contacts))


def flat_insights(df):
    return df.select("summary", F.array_join("patterns_detected", "; ").alias("patterns"),
                     F.array_join("recommendations", "; ").alias("recommendations"))


@query("dq_insights", """
SELECT concat('Found ', CAST((SELECT count(*) FROM quality_issues) AS STRING), ' data quality issues using rule-based analysis') AS summary,
  coalesce((SELECT CASE WHEN n > 5 THEN concat(type, ' is the most common issue (', CAST(n AS STRING), ' occurrences)') ELSE '' END
   FROM (SELECT type, count(*) AS n FROM quality_issues GROUP BY type ORDER BY n DESC, type LIMIT 1) top), '') AS patterns,
  (SELECT coalesce(string_agg(advice, '; ' ORDER BY no), '') FROM (VALUES
     (1, 'missing_required_field', 'Review data collection processes to ensure required fields are captured'),
     (2, 'invalid_email_format', 'Implement email validation at point of entry'),
     (3, 'stale_contact', 'Consider archiving or re-engaging contacts with no recent activity')) a(no, kind, advice)
   WHERE kind IN (SELECT type FROM quality_issues)) AS recommendations""")
def dq_insights(x):
    return flat_insights(issues.quality_insights(issues.summarize(quality_issues(x), x.contacts)))


EXPECTED["expected_cases"] = """
SELECT * FROM (
  SELECT id AS contact_id, 1 AS case_rank, 'name_typo' AS type, 'Potential nickname or abbreviation that may need standardization' AS description,
    true AS needs_reasoning, false AS needs_exploration
  FROM contacts WHERE firstname IN ('Jon', 'Mike', 'Bob', 'Bill', 'Inc', 'LLC') OR lastname IN ('Jon', 'Mike', 'Bob', 'Bill', 'Inc', 'LLC')
  UNION ALL
  SELECT id, 2, CASE WHEN odd THEN 'semantic_anomaly' ELSE 'context_dependent' END,
    CASE WHEN odd THEN concat('Tech job title "', jobtitle, '" in non-tech industry "', industry, '" - may be valid or data error')
         ELSE concat('Company name "', company, '" looks suspicious - may be test data') END, odd, true
  FROM (SELECT *, coalesce(regexp_matches(jobtitle, 'Engineer|Developer|Programmer|CTO|Tech Lead') AND regexp_matches(industry, 'Agriculture|Construction|Retail|Food Service'), false) AS odd FROM contacts) s
  WHERE odd OR regexp_matches(lower(company), 'test|example|sample|unknown|n/a|none')
) c WHERE contact_id NOT IN (SELECT object_id FROM quality_issues)"""


# a short threshold, so that some contacts are free of issues
def review_cases(x):
    return cases.review_cases(x.contacts, quality_issues(x))


query("dq_cases", "SELECT * FROM expected_cases")(review_cases)

EXPECTED["expected_batches"] = """
SELECT contact_id, case_rank, type, description, route, rn AS position, CAST((rn - 1) // 100 AS INTEGER) AS batch FROM (
  SELECT *, 'reasoning' AS route FROM first_cases WHERE needs_reasoning UNION ALL SELECT *, 'exploratory' FROM first_cases WHERE needs_exploration) b"""
EXPECTED["first_cases"] = """
SELECT *, row_number() OVER (ORDER BY contact_id, case_rank) AS rn FROM expected_cases"""


@query("dq_case_batches", "SELECT * FROM expected_batches")
def dq_case_batches(x):
    return cases.case_batches(review_cases(x), CaseSettings())


EXPECTED["outside_findings"] = """
SELECT contact_id, 'name_typo' AS type, 'low' AS severity, CASE WHEN event_type = 'BOUNCE' THEN 'low' ELSE 'medium' END AS confidence,
  concat('Looks odd at event ', CAST(id AS STRING)) AS description, concat('Seen in ', event_type) AS reasoning, NULL AS suggested_value
FROM contact_events"""


def outside_findings(x):
    return x.contact_events.select(
        "contact_id", F.lit("name_typo").alias("type"), F.lit("low").alias("severity"),
        F.when(F.col("event_type") == "BOUNCE", "low").otherwise("medium").alias("confidence"),
        F.concat(F.lit("Looks odd at event "), F.col("id").cast("string")).alias("description"),
        F.concat(F.lit("Seen in "), "event_type").alias("reasoning"),
        F.lit(None).cast("string").alias("suggested_value"))


@query("dq_attach_findings", """
SELECT 'name_typo' AS type, contact_id AS object_id, description, confidence, 'ai_reasoning' AS detection_method, reasoning
FROM outside_findings WHERE contact_id IN (SELECT contact_id FROM expected_cases)""")
def dq_attach_findings(x):
    found = issues.attach_findings(review_cases(x), outside_findings(x), "ai_reasoning")
    return found.select("type", "object_id", "description", "confidence", "detection_method", "reasoning")


@query("mode_routing", """
SELECT id, CASE WHEN is_obvious AND high_confidence THEN 'simple' WHEN requires_reasoning AND medium_complexity THEN 'reasoning'
  WHEN requires_context AND high_impact THEN 'exploratory' WHEN strategic AND multi_factored THEN 'iterative' ELSE 'simple' END AS mode FROM (
  SELECT id, (phone IS NULL) AS is_obvious, (email IS NULL) AS high_confidence, (firstname IN ('Jon', 'Bob', 'Mike')) AS requires_reasoning,
    (company LIKE '%Inc.') AS medium_complexity, (industry = 'Retail') AS requires_context, (hs_marketable_status = 'true') AS high_impact,
    (jobtitle = 'CTO') AS strategic, (website IS NOT NULL) AS multi_factored FROM contacts) f""")
def mode_routing(x):
    flags = x.contacts.selectExpr(
        "id", "phone IS NULL AS is_obvious", "email IS NULL AS high_confidence",
        "firstname IN ('Jon', 'Bob', 'Mike') AS requires_reasoning", "company LIKE '%Inc.' AS medium_complexity",
        "industry = 'Retail' AS requires_context", "hs_marketable_status = 'true' AS high_impact",
        "jobtitle = 'CTO' AS strategic", "website IS NOT NULL AS multi_factored")
    return flags.select("id", cases.analysis_mode().alias("mode"))
