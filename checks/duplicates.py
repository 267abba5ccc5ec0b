"""Exact and near duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.quality import flat_insights, flat_summary
from checks.registry import query
from checks.tables import EXPECTED
from rowmender.operators import duplicates as d

PAIR_FIELDS = "id_1, id_2, match_type, confidence, email_match, phone_match, company_match, name_similarity"

EXPECTED["dup_keys"] = """
SELECT id, ekey, phone_n, comp, full_name, nm,
  CASE WHEN phone_n <> '' AND comp <> '' THEN concat(phone_n, '|', comp) END AS pkey,
  CASE WHEN firstname <> '' AND lastname <> '' AND trim(both_n) <> '' AND comp <> '' THEN concat(both_n, '|', comp) END AS nkey
FROM (SELECT *, CASE WHEN length(digits) = 11 AND digits LIKE '1%' THEN substr(digits, 2) ELSE digits END AS phone_n,
   concat(fn, ' ', ln) AS both_n, regexp_replace(regexp_replace(lower(full_name), ' +', ' ', 'g'), '[^a-z0-9 ''-]', '', 'g') AS nm FROM (
  SELECT id, firstname, lastname, nullif(trim(lower(email)), '') AS ekey,
    regexp_replace(coalesce(nullif(phone, ''), nullif(mobilephone, '')), '[^0-9]', '', 'g') AS digits,
    coalesce(regexp_replace(regexp_replace(trim(lower(company)), ' +', ' ', 'g'), '[^a-z0-9 ''-]', '', 'g'), '') AS comp,
    coalesce(regexp_replace(regexp_replace(trim(lower(firstname)), ' +', ' ', 'g'), '[^a-z0-9 ''-]', '', 'g'), '') AS fn,
    coalesce(regexp_replace(regexp_replace(trim(lower(lastname)), ' +', ' ', 'g'), '[^a-z0-9 ''-]', '', 'g'), '') AS ln,
    trim(concat(coalesce(firstname, ''), ' ', coalesce(lastname, ''))) AS full_name
  FROM contacts) k) n"""

UNION_OF_PAIRS = """
      SELECT a.id AS i, b.id AS j, 1 AS tier FROM dup_keys a JOIN dup_keys b ON a.ekey = b.ekey AND a.id < b.id
      UNION ALL SELECT a.id, b.id, 2 FROM dup_keys a JOIN dup_keys b ON a.pkey = b.pkey AND a.id < b.id
      UNION ALL SELECT a.id, b.id, 3 FROM dup_keys a JOIN dup_keys b ON a.nkey = b.nkey AND a.id < b.id"""
EXPECTED["tier_heads"] = """
SELECT id, tier, min(id) OVER (PARTITION BY tier, key) AS head, count(*) OVER (PARTITION BY tier, key) AS group_size FROM tier_keys"""


def detailed(pairs: str) -> str:
    """The match factors of pairs (i, j, tier)."""
    return f"""
SELECT id_1, id_2, CASE tier WHEN 1 THEN 'exact_email' WHEN 2 THEN 'exact_phone_company' ELSE 'exact_name_company' END AS match_type,
  'high' AS confidence, email_match, phone_match, company_match,
  CASE WHEN tier = 3 THEN 1.0::DOUBLE WHEN full_1 = '' OR full_2 = '' THEN 0.0::DOUBLE WHEN greatest(length(nm_1), length(nm_2)) = 0 THEN 1.0::DOUBLE
       ELSE 1.0::DOUBLE - levenshtein(nm_1, nm_2)::DOUBLE / greatest(length(nm_1), length(nm_2)) END AS name_similarity,
  full_1, full_2
FROM (
  SELECT a.id AS id_1, b.id AS id_2, k.tier, a.full_name AS full_1, b.full_name AS full_2, a.nm AS nm_1, b.nm AS nm_2,
    coalesce(a.ekey = b.ekey, false) AS email_match, coalesce(a.phone_n = b.phone_n, false) AS phone_match,
    (a.comp <> '' AND a.comp = b.comp) AS company_match
  FROM (SELECT i, j, min(tier) AS tier FROM ({pairs}) u GROUP BY i, j) k
  JOIN dup_keys a ON a.id = k.i JOIN dup_keys b ON b.id = k.j) f"""


# every pair of every group, for the counts; and the listing, one link per member
EXPECTED["dup_pairs"] = detailed(UNION_OF_PAIRS)
EXPECTED["dup_links"] = detailed("SELECT head AS i, id AS j, tier FROM tier_heads WHERE id <> head")


def pairs(x, tiers=None):
    return d.exact_pairs(x.contacts, tiers=tiers)


def shown(df):
    return df.select(*PAIR_FIELDS.split(", "))


query("dup_exact_email", f"SELECT {PAIR_FIELDS} FROM ({detailed('SELECT head AS i, id AS j, tier FROM tier_heads WHERE id <> head AND tier = 1')}) p")(lambda x: shown(pairs(x, [1])))
query("dup_phone_company", f"SELECT {PAIR_FIELDS} FROM ({detailed('SELECT head AS i, id AS j, tier FROM tier_heads WHERE id <> head AND tier = 2')}) p")(lambda x: shown(pairs(x, [2])))
query("dup_name_company", f"SELECT {PAIR_FIELDS} FROM ({detailed('SELECT head AS i, id AS j, tier FROM tier_heads WHERE id <> head AND tier = 3')}) p")(lambda x: shown(pairs(x, [3])))
query("dup_tier1_pairs", f"SELECT {PAIR_FIELDS} FROM dup_links")(lambda x: shown(pairs(x)))


query("dup_groups", """
SELECT CASE tier WHEN 1 THEN 'exact_email' WHEN 2 THEN 'exact_phone_company' ELSE 'exact_name_company' END AS match_type, key, id, group_size
FROM (SELECT *, count(*) OVER (PARTITION BY tier, key) AS group_size FROM tier_keys) g WHERE group_size > 1""")(
    lambda x: d.shared_groups(x.contacts))


@query("dup_match_factors", """
SELECT match_type, email_match, phone_match, company_match, count(*) AS pairs, min(name_similarity) AS lowest, max(name_similarity) AS highest
FROM dup_links GROUP BY ALL""")
def dup_match_factors(x):
    return pairs(x).groupBy("match_type", "email_match", "phone_match", "company_match").agg(
        F.count(F.lit(1)).alias("pairs"), F.min("name_similarity").alias("lowest"),
        F.max("name_similarity").alias("highest"))


@query("dup_pair_counts", "SELECT match_type, count(*) AS pairs FROM dup_pairs GROUP BY match_type")
def dup_pair_counts(x):
    return d.pair_counts(x.contacts).withColumn("pairs", F.col("pairs").cast("bigint"))


EXPECTED["dup_issue_rows"] = """
SELECT sha256(concat('duplicates|duplicate|', id_1, '|', id_2)) AS issue_id, 'high' AS severity, id_1 AS object_id,
  concat('Potential duplicate: "', coalesce(nullif(full_1, ''), 'Unknown'), '" and "', coalesce(nullif(full_2, ''), 'Unknown'), '" have ',
    concat_ws(', ', CASE WHEN email_match THEN 'same email' END, CASE WHEN phone_match THEN 'same phone' END, CASE WHEN company_match THEN 'same company' END,
      CASE WHEN name_similarity >= 0.9 THEN 'nearly identical names' WHEN name_similarity >= 0.7 THEN 'similar names' END)) AS description,
  id_2 AS suggested_value, confidence, CASE match_type WHEN 'exact_email' THEN 'Contacts share the same email address (99% confidence duplicate)'
    WHEN 'exact_phone_company' THEN 'Contacts have the same phone number and company (95% confidence duplicate)'
    ELSE 'Contacts have the same name and company (95% confidence duplicate)' END AS reasoning, match_type, email_match, phone_match, company_match
FROM dup_links"""


@query("dup_issues", "SELECT * FROM dup_issue_rows")
def dup_issues(x):
    return d.pairs_to_issues(pairs(x)).select(
        "issue_id", "severity", "object_id", "description", "suggested_value", "confidence", "reasoning",
        *[F.get_json_object("current_value", f"$.{path}").cast(kind).alias(path.split(".")[-1]) for path, kind in (
            ("match_type", "string"), ("match_factors.email_match", "boolean"), ("match_factors.phone_match", "boolean"), ("match_factors.company_match", "boolean"))])


@query("dup_summary", """
SELECT (SELECT count(*) FROM contacts) AS total_records, count(*) AS issues_found, 0::BIGINT AS low, 0::BIGINT AS medium, count(*) AS high, 0::BIGINT AS critical,
  count(*) AS rule_based, 0::BIGINT AS ai_reasoning, 0::BIGINT AS ai_exploratory, concat('duplicate=', CAST(count(*) AS STRING)) AS by_type, 0.0::DOUBLE AS ai_cost_usd
FROM dup_pairs""")
def dup_summary(x):
    summary = flat_summary(d.duplicate_summary(d.pair_counts(x.contacts), x.contacts))
    return summary.withColumns({c: F.col(c).cast("bigint") for c in ("issues_found", "high", "rule_based")})


@query("dup_insights", """
SELECT concat('Found ', CAST(n AS STRING), ' duplicate pairs using rule-based exact matching') AS summary,
  concat('Most common duplicate type: ', (SELECT concat(replace(match_type, '_', ' '), ' (', CAST(count(*) AS STRING), ' pairs)') FROM dup_pairs GROUP BY match_type ORDER BY count(*) DESC, match_type LIMIT 1),
    CASE WHEN emails > 0 THEN concat('; ', CAST(emails AS STRING), ' pairs share the same email address') ELSE '' END) AS patterns,
  concat_ws('; ', CASE WHEN n > 10 THEN 'Consider reviewing data entry processes to prevent future duplicates' END,
    CASE WHEN emails > 5 THEN 'Implement email validation at point of entry to catch duplicates early' END,
    CASE WHEN n > 0 THEN 'Review merge recommendations carefully before executing - merges are NOT reversible' END) AS recommendations
FROM (SELECT count(*) AS n, count(*) FILTER (email_match) AS emails FROM dup_pairs) t""")
def dup_insights(x):
    counts = d.pair_counts(x.contacts)
    return flat_insights(d.duplicate_insights(counts, d.email_match_count(x.contacts, counts=counts), x.contacts))


@query("dup_incremental", """
SELECT r.id, CASE r.tier WHEN 1 THEN 'exact_email' WHEN 2 THEN 'exact_phone_company' ELSE 'exact_name_company' END AS match_type,
  min(o.id) AS match_id, count(*) AS matches
FROM tier_keys r JOIN tier_keys o ON r.tier = o.tier AND r.key = o.key
WHERE r.id IN (SELECT id FROM recent_ids) AND o.id NOT IN (SELECT id FROM recent_ids) GROUP BY r.id, r.tier""")
def dup_incremental(x):
    return d.incremental_duplicates(x.contacts, F.col("createdate") >= F.lit("1996-06-01").cast("timestamp"))


EXPECTED["recent_ids"] = "SELECT id FROM contacts WHERE createdate >= TIMESTAMP '1996-06-01 00:00:00'"
EXPECTED["tier_keys"] = """
SELECT * FROM (SELECT id, 1 AS tier, ekey AS key FROM dup_keys UNION ALL SELECT id, 2, pkey FROM dup_keys UNION ALL SELECT id, 3, nkey FROM dup_keys) k
WHERE key IS NOT NULL"""
