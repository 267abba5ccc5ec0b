"""Access paths, near duplicates, properties, lists, marketing, deals and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.duplicates import pairs
from checks.quality import CONFIG, ISSUE_FIELDS, quality_issues
from checks.registry import query
from checks.tables import AS_OF, EXPECTED
from rowmender.config import AuditConfig, CompanyProfile, MarketingSettings, QualityRules
from rowmender.functions import text as t
from rowmender.operators import (
    consistency, duplicates, fuzzy, issues, lists, marketing, masking, modules, pipeline, properties, search, sets,
)
from rowmender.sources import scans
from rowmender.streaming import jobs

ISO = "%Y-%m-%dT%H:%M:%S.%gZ"

# every property of a contact
PROPERTIES = (
    "email", "firstname", "lastname", "phone", "mobilephone", "company", "jobtitle", "industry", "company_size", "website", "country", "notes_last_contacted",
    "hs_analytics_last_visit_timestamp", "lastmodifieddate", "hs_marketable_status", "hs_marketable_reason_type", "lifecyclestage", "source", "hs_email_open",
    "hard_bounced", "unsubscribed_at", "createdate")

# ---- access paths


@query("scan_contacts", f"""
SELECT id, email, firstname, lastname, phone, mobilephone, company, jobtitle, lifecyclestage, hs_marketable_status,
  strftime(createdate, '{ISO}') AS createdate, strftime(lastmodifieddate, '{ISO}') AS lastmodifieddate FROM contacts""")
def scan_contacts(x):
    found = scans.scan(x.contacts, scans.CONTACT_PROPERTIES)
    return found.withColumns({c: t.iso_timestamp(F.col(c)) for c in ("createdate", "lastmodifieddate")})


@query("lookup", "SELECT id, email, lifecyclestage FROM contacts WHERE id = '7'")
def lookup(x):
    return scans.lookup(x.contacts, "7").select("id", "email", "lifecyclestage")


query("scan_companies", "SELECT id, name, domain FROM companies")(lambda x: scans.scan(x.companies, scans.COMPANY_PROPERTIES))


@query("scan_deals", f"SELECT id, contact_id, stage, amount, strftime(updated_at, '{ISO}') AS updated_at FROM deals")
def scan_deals(x):
    return scans.scan(x.deals, scans.DEAL_PROPERTIES).withColumn("updated_at", t.iso_timestamp(F.col("updated_at")))


KINDS = {
    "contact": {c: "string" for c in (
        "email", "firstname", "lastname", "phone", "mobilephone", "company", "jobtitle", "industry", "company_size", "website", "country",
        "hs_marketable_status", "hs_marketable_reason_type", "lifecyclestage", "source", "hs_email_open", "hard_bounced")}
    | {c: "timestamp" for c in ("notes_last_contacted", "hs_analytics_last_visit_timestamp", "lastmodifieddate", "unsubscribed_at", "createdate")},
    "company": {c: "string" for c in ("name", "domain", "country")},
    "deal": {"contact_id": "string", "stage": "string", "amount": "double", "updated_at": "timestamp"},
}


def crm(x):
    return {"contact": x.contacts, "company": x.companies, "deal": x.deals}


SOURCES = {"contact": "contacts", "company": "companies", "deal": "deals"}


@query("property_catalogue", "\nUNION ALL ".join(
    f"SELECT '{o}' AS object_type, '{c}' AS name, '{c.replace('_', ' ').capitalize()}' AS label, '{k}' AS type, count(*) AS records, "
    f"count(*) FILTER (CAST({c} AS STRING) <> '') AS filled, count(DISTINCT {c}) FILTER (CAST({c} AS STRING) <> '') AS distinct_values, "
    f"count(DISTINCT {c}) FILTER (CAST({c} AS STRING) <> '') BETWEEN 1 AND 10 AND '{k}' = 'string' AS is_choice FROM {SOURCES[o]}"
    for o, columns in KINDS.items() for c, k in columns.items()))
def property_catalogue(x):
    tables = {o: df.withColumns({c: F.col(c).cast("timestamp") for c, k in KINDS[o].items() if k == "timestamp"}) for o, df in crm(x).items()}
    return scans.property_catalogue(tables)


@query("property_values", "\nUNION ALL ".join(
    f"SELECT '{o}' AS object_type, '{c}' AS name, {c} AS value, count(*) AS n FROM {dict(contact='contacts', company='companies', deal='deals')[o]} WHERE {c} IS NOT NULL GROUP BY {c}"
    for o, c in (("contact", "industry"), ("contact", "lifecyclestage"), ("contact", "jobtitle"), ("contact", "website"), ("company", "country"), ("deal", "stage"))))
def property_values(x):
    return scans.property_values(crm(x), {"contact": ["industry", "lifecyclestage", "jobtitle", "website"], "company": ["country"], "deal": ["stage"]})


query("lists_scan", "SELECT list_id, name, coalesce(size, 0) AS size FROM lists")(
    lambda x: scans.lists_scan(x.lists).select("list_id", "name", "size"))
query("list_members", "SELECT list_id, contact_id, email FROM members JOIN contacts ON id = contact_id")(
    lambda x: scans.list_contacts(x.members, x.contacts.select("id", "email")).select("list_id", "contact_id", "email"))
query("associations", "SELECT from_id, to_id, coalesce(assoc_type, to_type) AS assoc_type FROM edges")(
    lambda x: scans.associations(x.edges, "contact", "company").select("from_id", "to_id", "assoc_type"))


@query("contact_events", f"SELECT id, contact_id, event_type, strftime(event_time, '{ISO}') AS event_time FROM contact_events WHERE event_type IN ('OPENED', 'CLICKED')")
def contact_events(x):
    return scans.contact_events(x.contact_events, ["OPENED", "CLICKED"]).select(
        "id", "contact_id", "event_type", t.iso_timestamp(F.col("event_time")).alias("event_time"))


@query("batch_read", "SELECT id, email FROM contacts WHERE id IN (SELECT CAST(o_custkey AS STRING) FROM orders WHERE o_orderpriority = '1-URGENT')")
def batch_read(x):
    ids = x.orders.filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").cast("string").alias("id"))
    return scans.batch_read(x.contacts.select("id", "email"), ids)


query("recent_contacts", "SELECT id, email FROM contacts WHERE createdate >= TIMESTAMP '1996-01-01 00:00:00'")(
    lambda x: scans.created_after(x.contacts, "1996-01-01 00:00:00").select("id", "email"))


@query("engagement_summary", f"""
SELECT id, strftime(coalesce(notes_last_contacted, lastmodifieddate), '{ISO}') AS last_activity, 0::BIGINT AS emails_sent,
  CASE WHEN coalesce(hs_email_open, '') = '' THEN 0 ELSE TRY_CAST(regexp_extract(hs_email_open, '^\\s*([+-]?[0-9]+)', 1) AS BIGINT) END AS emails_opened,
  0::BIGINT AS emails_clicked, 0::BIGINT AS form_submissions, 0::BIGINT AS page_views FROM contacts""")
def engagement_summary(x):
    return scans.engagement_summary(x.contacts).withColumn("last_activity", t.iso_timestamp(F.col("last_activity")))


@query("engagement_counters", f"""
SELECT id, strftime(coalesce(notes_last_contacted, lastmodifieddate), '{ISO}') AS last_activity, coalesce(sent, 0) AS emails_sent, coalesce(opened, 0) AS emails_opened,
  coalesce(clicked, 0) AS emails_clicked, coalesce(forms, 0) AS form_submissions, coalesce(views, 0) AS page_views FROM contacts c
LEFT JOIN (SELECT contact_id, count(*) FILTER (event_type IN ('DELIVERED', 'OPENED', 'CLICKED')) AS sent, count(*) FILTER (event_type = 'OPENED') AS opened, count(*) FILTER (event_type = 'CLICKED') AS clicked,
  count(*) FILTER (event_type = 'FORM_SUBMITTED') AS forms, count(*) FILTER (event_type IN ('OPENED', 'CLICKED', 'FORM_SUBMITTED')) AS views FROM contact_events GROUP BY contact_id) e ON e.contact_id = c.id""")
def engagement_counters(x):
    """The five counters from the events of the contacts."""
    return scans.engagement_summary(scans.with_counters(x.contacts, x.contact_events)).withColumn("last_activity", t.iso_timestamp(F.col("last_activity")))


query("marketing_status", "SELECT id, hs_marketable_status = 'true' AS is_marketing, coalesce(hs_marketable_reason_type, 'unknown') AS status FROM contacts")(
    lambda x: scans.marketing_status(x.contacts).select("id", "is_marketing", "status"))

GROUPS = [
    [("industry", "EQ", "Retail"), ("hs_marketable_status", "NEQ", "false"), ("phone", "HAS_PROPERTY")],
    [("company", "CONTAINS_TOKEN", "test"), ("jobtitle", "NOT_CONTAINS_TOKEN", "sales")],
    [("jobtitle", "IN", ["CTO", "Product Manager"]), ("source", "NOT_IN", ["BUILDING", "MACHINERY"]),
     ("website", "NOT_HAS_PROPERTY"), ("firstname", "GT", "J"), ("firstname", "LTE", "Mike")],
    [("company_size", "BETWEEN", "1-10", "11-50"), ("lastname", "GTE", "Smyth"), ("lastname", "LT", "T")],
]
SEARCH = """
FROM contacts WHERE (industry = 'Retail' AND hs_marketable_status <> 'false' AND phone <> '')
  OR (regexp_matches(lower(coalesce(company, '')), '(^|[^a-z0-9])test([^a-z0-9]|$)') AND NOT regexp_matches(lower(coalesce(jobtitle, '')), '(^|[^a-z0-9])sales([^a-z0-9]|$)'))
  OR (jobtitle IN ('CTO', 'Product Manager') AND source NOT IN ('BUILDING', 'MACHINERY') AND website IS NULL AND firstname > 'J' AND firstname <= 'Mike')
  OR (company_size BETWEEN '1-10' AND '11-50' AND lastname >= 'Smyth' AND lastname < 'T')"""

query("search_contacts", "SELECT id, company, jobtitle " + SEARCH)(
    lambda x: search.search(x.contacts, GROUPS).select("id", "company", "jobtitle"))


@query("search_page", f"SELECT id, lastname, (SELECT count(*) {SEARCH}) AS total {SEARCH} ORDER BY lastname DESC NULLS LAST, id LIMIT 100 OFFSET 50")
def search_page(x):
    found = search.search(x.contacts, GROUPS)
    return search.page(found, [("lastname", "DESC")], 100, 50).select("id", "lastname", search.total(found).scalar().alias("total"))


@query("pii_masked", """
SELECT id, '[REDACTED]' AS email, company, '[REDACTED]' AS mobilephone, company AS inner_company, '[REDACTED]' AS inner_firstname, jobtitle AS item_title,
  '[REDACTED]' AS item_phone, '[REDACTED]' AS map_email, industry AS map_industry FROM contacts""")
def pii_masked(x):
    nested = x.contacts.select(
        "id", "email", "company", "mobilephone", F.struct("company", "firstname").alias("info"),
        F.array(F.struct("jobtitle", "phone")).alias("items"),
        F.create_map(F.lit("work_email"), F.col("email"), F.lit("industry"), F.col("industry")).alias("bag"))
    return masking.mask_personal(nested).select(
        "id", "email", "company", "mobilephone", F.col("info.company").alias("inner_company"),
        F.col("info.firstname").alias("inner_firstname"), F.col("items")[0]["jobtitle"].alias("item_title"),
        F.col("items")[0]["phone"].alias("item_phone"), F.col("bag")["work_email"].alias("map_email"),
        F.col("bag")["industry"].alias("map_industry"))


# ---- scalar functions over the whole table

query("fn_levenshtein", "SELECT id, CAST(levenshtein(firstname, lastname) AS INTEGER) AS distance FROM contacts")(
    lambda x: x.contacts.select("id", t.levenshtein(F.col("firstname"), F.col("lastname")).alias("distance")))
query("fn_similarity", "SELECT id, CASE WHEN greatest(length(firstname), length(lastname)) = 0 THEN 1.0 ELSE 1.0::DOUBLE - levenshtein(firstname, lastname)::DOUBLE / greatest(length(firstname), length(lastname)) END AS score FROM contacts")(
    lambda x: x.contacts.select("id", t.similarity(F.col("firstname"), F.col("lastname")).alias("score")))
query("fn_normalize_name", "SELECT id, fn, ln, comp FROM (SELECT id, coalesce(regexp_replace(regexp_replace(trim(lower(firstname)), ' +', ' ', 'g'), '[^a-z0-9 ''-]', '', 'g'), '') AS fn, coalesce(regexp_replace(regexp_replace(trim(lower(lastname)), ' +', ' ', 'g'), '[^a-z0-9 ''-]', '', 'g'), '') AS ln, coalesce(regexp_replace(regexp_replace(trim(lower(company)), ' +', ' ', 'g'), '[^a-z0-9 ''-]', '', 'g'), '') AS comp FROM contacts) n")(
    lambda x: x.contacts.select("id", *[t.normalize_name(c).alias(n) for c, n in (("firstname", "fn"), ("lastname", "ln"), ("company", "comp"))]))
query("fn_normalize_phone", "SELECT id, coalesce(phone_n, '') AS phone_n FROM dup_keys")(
    lambda x: x.contacts.select("id", t.normalize_phone(t.first_present("phone", "mobilephone")).alias("phone_n")))
query("fn_email_domain", "SELECT id, CASE WHEN regexp_full_match(email, '[^@]+@[^@]+') THEN split_part(lower(email), '@', 2) ELSE '' END AS domain FROM contacts")(
    lambda x: x.contacts.select("id", t.email_domain("email").alias("domain")))

EXPECTED["nicknames"] = "SELECT * FROM (VALUES " + ", ".join(
    f"('{f}', '{n}')" for f, ns in t.NICKNAMES.items() for n in ns) + ") v(formal, nick)"
EXPECTED["neighbours"] = """
SELECT id, firstname, company, CASE CAST(CAST(id AS BIGINT) % 4 AS INT) WHEN 0 THEN 'Robert' WHEN 1 THEN 'John' WHEN 2 THEN 'Liz' ELSE 'Mike' END AS other FROM contacts"""


@query("fn_nickname", """
SELECT id, coalesce(firstname <> '' AND EXISTS (SELECT 1 FROM nicknames WHERE (formal = lower(trim(firstname)) AND nick = lower(other)) OR (nick = lower(trim(firstname)) AND formal = lower(other))), false) AS nickname FROM neighbours""")
def fn_nickname(x):
    key = F.col("id").cast("bigint") % 4
    other = F.when(key == 0, "Robert").when(key == 1, "John").when(key == 2, "Liz").otherwise("Mike")
    return x.contacts.select("id", t.is_likely_nickname(F.col("firstname"), other).alias("nickname"))


EXPECTED["cores"] = """
SELECT id, company, trim(regexp_replace(regexp_replace(trim(lower(company)), ' +', ' ', 'g'), '\\b(inc|llc|ltd|corp|corporation|company|co|incorporated|limited)\\b\\.?', '', 'g')) AS core FROM contacts"""


@query("fn_same_company", """
SELECT id, coalesce(company <> '' AND (core = 'acme 5 unit 0' OR 1.0::DOUBLE - levenshtein(core, 'acme 5 unit 0')::DOUBLE / greatest(length(core), 13) >= 0.85), false) AS same FROM cores""")
def fn_same_company(x):
    return x.contacts.select("id", F.coalesce(t.is_same_company(F.col("company"), F.lit("ACME 5  Unit 0 Corp.")), F.lit(False)).alias("same"))


# ---- near duplicates and sets

# from pairs of contacts, counted by their profiles only at the end
EXPECTED["fuzzy_members"] = """
SELECT *, min(id) OVER (PARTITION BY comp, nm) AS head, count(*) OVER (PARTITION BY comp, nm) AS n FROM dup_keys WHERE comp <> '' AND nm <> ''"""
FUZZY = """
SELECT least(h1, h2) AS id_1, greatest(h1, h2) AS id_2, CASE WHEN h1 < h2 THEN n1 ELSE n2 END AS n_1, CASE WHEN h1 < h2 THEN n2 ELSE n1 END AS n_2, company,
  distance, similarity, CASE WHEN distance <= 2 THEN 'medium' ELSE 'low' END AS confidence, count(*) AS pairs
FROM (SELECT CASE WHEN a.head <= b.head THEN a.head ELSE b.head END AS h1, CASE WHEN a.head <= b.head THEN b.head ELSE a.head END AS h2,
    CASE WHEN a.head <= b.head THEN a.n ELSE b.n END AS n1, CASE WHEN a.head <= b.head THEN b.n ELSE a.n END AS n2, a.comp AS company,
    CAST(levenshtein(a.nm, b.nm) AS INTEGER) AS distance, 1.0::DOUBLE - levenshtein(a.nm, b.nm)::DOUBLE / greatest(length(a.nm), length(b.nm)) AS similarity
  FROM fuzzy_members a JOIN fuzzy_members b ON a.comp = b.comp AND a.id < b.id
  WHERE NOT coalesce(a.ekey = b.ekey, false) AND NOT coalesce(a.pkey = b.pkey, false) AND NOT coalesce(a.nkey = b.nkey, false)) p
WHERE distance <= 2 OR similarity >= 0.85 GROUP BY ALL"""


def fuzzy_rows(x):
    return fuzzy.fuzzy_pairs(x.contacts).withColumn("pairs", F.col("pairs").cast("bigint"))


query("dup_fuzzy", FUZZY)(fuzzy_rows)
query("dup_fuzzy_review", f"SELECT *, row_number() OVER (ORDER BY similarity DESC, id_1, id_2) AS review_order FROM ({FUZZY}) f")(
    lambda x: fuzzy.fuzzy_review(fuzzy_rows(x)))

EXPECTED["first_names"] = """
SELECT comp AS company, ln AS last, fn AS first, count(*) AS n, min(id) AS id FROM (
  SELECT k.id, k.comp, coalesce(regexp_replace(regexp_replace(trim(lower(lastname)), ' +', ' ', 'g'), '[^a-z0-9 ''-]', '', 'g'), '') AS ln,
    coalesce(regexp_replace(regexp_replace(trim(lower(firstname)), ' +', ' ', 'g'), '[^a-z0-9 ''-]', '', 'g'), '') AS fn FROM dup_keys k JOIN contacts c ON c.id = k.id) p
WHERE comp <> '' AND trim(ln) <> '' AND fn <> '' GROUP BY ALL"""
query("dup_nickname", """
SELECT least(f.id, k.id) AS id_1, greatest(f.id, k.id) AS id_2, CASE WHEN f.id < k.id THEN f.n ELSE k.n END AS n_1, CASE WHEN f.id < k.id THEN k.n ELSE f.n END AS n_2,
  f.company, f.last, formal, nick AS nickname
FROM nicknames JOIN first_names f ON f.first = formal JOIN first_names k ON k.first = nick AND k.company = f.company AND k.last = f.last""")(
    lambda x: fuzzy.nickname_pairs(x.contacts))

EXPECTED["company_cores"] = """
SELECT core, count(*) AS n, min(id) AS head FROM (SELECT id, trim(regexp_replace(regexp_replace(trim(lower(name)), ' +', ' ', 'g'), '\\b(inc|llc|ltd|corp|corporation|company|co|incorporated|limited)\\b\\.?', '', 'g')) AS core FROM companies) c GROUP BY core"""
query("dup_companies", """
SELECT head AS id_1, id AS id_2, 1::BIGINT AS n_1, 1::BIGINT AS n_2, 'same' AS kind, 1.0::DOUBLE AS similarity
FROM (SELECT id, trim(regexp_replace(regexp_replace(trim(lower(name)), ' +', ' ', 'g'), '\\b(inc|llc|ltd|corp|corporation|company|co|incorporated|limited)\\b\\.?', '', 'g')) AS core FROM companies) m
JOIN company_cores g ON g.core = m.core WHERE id <> head
UNION ALL
SELECT least(a.head, b.head), greatest(a.head, b.head), CASE WHEN a.head < b.head THEN a.n ELSE b.n END, CASE WHEN a.head < b.head THEN b.n ELSE a.n END, 'similar',
  1.0::DOUBLE - levenshtein(a.core, b.core)::DOUBLE / greatest(length(a.core), length(b.core))
FROM company_cores a JOIN company_cores b ON a.core < b.core WHERE 1.0::DOUBLE - levenshtein(a.core, b.core)::DOUBLE / greatest(length(a.core), length(b.core)) >= 0.85""")(
    lambda x: fuzzy.company_pairs(x.companies))

EXPECTED["domain_groups"] = """
SELECT name, domain, count(*) AS n, min(id) AS id FROM (
  SELECT id, regexp_replace(regexp_replace(trim(lower(concat_ws(' ', nullif(firstname, ''), nullif(lastname, '')))), ' +', ' ', 'g'), '[^a-z0-9 ''-]', '', 'g') AS name,
    CASE WHEN regexp_full_match(email, '[^@]+@[^@]+') THEN split_part(lower(email), '@', 2) ELSE '' END AS domain FROM contacts) r
WHERE trim(name) <> '' AND domain <> '' GROUP BY name, domain"""
query("dup_name_domain", """
SELECT g.name, g.domain, g.n, g.id, min(h.id) AS head_id, count(*) AS domains,
  CAST((sum(h.n) * sum(h.n) - sum(h.n * h.n)) // 2 AS BIGINT) AS pairs
FROM domain_groups g JOIN domain_groups h ON h.name = g.name GROUP BY g.name, g.domain, g.n, g.id HAVING count(*) > 1""")(
    lambda x: fuzzy.name_domain_groups(x.contacts).withColumn("pairs", F.col("pairs").cast("bigint")))

query("dup_domain", """
SELECT least(a.id, b.id) AS id_1, greatest(a.id, b.id) AS id_2, CASE WHEN a.id < b.id THEN a.n ELSE b.n END AS n_1, CASE WHEN a.id < b.id THEN b.n ELSE a.n END AS n_2,
  CASE WHEN a.name = b.name THEN 'same_name' ELSE 'similar_name' END AS kind, a.domain, CAST(levenshtein(a.name, b.name) AS INTEGER) AS distance,
  1.0::DOUBLE - levenshtein(a.name, b.name)::DOUBLE / greatest(length(a.name), length(b.name)) AS similarity
FROM domain_groups a JOIN domain_groups b ON a.domain = b.domain AND (a.name < b.name OR (a.name = b.name AND a.n > 1))
WHERE levenshtein(a.name, b.name) <= 2 OR 1.0::DOUBLE - levenshtein(a.name, b.name)::DOUBLE / greatest(length(a.name), length(b.name)) >= 0.85""")(
    lambda x: fuzzy.domain_pairs(x.contacts))
query("dup_name_company_links", """
SELECT h.id AS id_1, p.id AS id_2, h.n AS n_1, p.n AS n_2, p.nm AS name, h.comp AS company_1, p.comp AS company_2, companies FROM name_companies p
JOIN (SELECT *, count(*) OVER (PARTITION BY nm) AS companies, row_number() OVER (PARTITION BY nm ORDER BY id) AS r FROM name_companies) h ON h.nm = p.nm AND h.r = 1 WHERE companies > 1 AND p.id <> h.id""")(
    lambda x: fuzzy.name_company_links(x.contacts))
EXPECTED["name_companies"] = "SELECT comp, nm, count(*) AS n, min(id) AS id FROM dup_keys WHERE comp <> '' AND trim(nm) <> '' GROUP BY comp, nm"

query("similar_contacts", """
SELECT id, CAST(rank AS INTEGER) AS rank, other_id, distance FROM (
  SELECT a.id, b.id AS other_id, CAST(levenshtein(a.nm, b.nm) AS INTEGER) AS distance, row_number() OVER (PARTITION BY a.id ORDER BY levenshtein(a.nm, b.nm), b.id) AS rank
  FROM (SELECT * FROM dup_keys WHERE id IN (SELECT contact_id FROM expected_cases) AND comp <> '') a JOIN dup_keys b ON a.comp = b.comp AND a.id <> b.id AND b.nm <> ''
  WHERE levenshtein(a.nm, b.nm) <= 2) r WHERE rank <= 10""")(
    lambda x: fuzzy.similar_contacts(_case_contacts(x), x.contacts))


def _case_contacts(x):
    from checks.quality import review_cases

    ids = review_cases(x).select(F.col("contact_id").alias("id")).distinct()
    return x.contacts.join(ids, "id", "left_semi")


EXPECTED["dup_set_rows"] = """
WITH RECURSIVE links AS MATERIALIZED (SELECT id_1 AS a, id_2 AS b FROM dup_pairs UNION SELECT id_2, id_1 FROM dup_pairs),
reach(id, other) AS (SELECT a, b FROM links UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT id, least(id, min(other)) AS set_id FROM reach GROUP BY id"""
query("dup_sets", "SELECT * FROM dup_set_rows")(lambda x: sets.duplicate_sets(x.contacts))

FILLED = " + ".join(f"CASE WHEN CAST({c} AS STRING) <> '' THEN 1 ELSE 0 END" for c in PROPERTIES)
query("dup_primary", f"""
SELECT set_id, id AS primary_id, CAST(filled AS INTEGER) AS filled, members FROM (
  SELECT s.set_id, s.id, {FILLED} AS filled, count(*) OVER (PARTITION BY set_id) AS members,
    row_number() OVER (PARTITION BY set_id ORDER BY {FILLED} DESC, coalesce(lastmodifieddate, TIMESTAMP '1970-01-01 00:00:00') DESC, s.id) AS r
  FROM dup_set_rows s JOIN contacts c ON c.id = s.id) p WHERE r = 1""")(
    lambda x: sets.primaries(sets.duplicate_sets(x.contacts), x.contacts))

# ---- issues across audits

EXPECTED["all_issues"] = """
SELECT issue_id, 'data-quality' AS module, type, object_id FROM quality_issues UNION ALL SELECT issue_id, 'duplicates', 'duplicate', object_id FROM dup_issue_rows"""


def all_issues(x):
    return modules.run_audits(["data-quality", "duplicates"], {"contacts": x.contacts}, CONFIG, AS_OF)


query("all_audits", "SELECT issue_id, module, type, object_id FROM all_issues")(
    lambda x: all_issues(x).select("issue_id", "module", "type", "object_id"))
query("cross_audit_overlap", """
SELECT a.module AS module_1, b.module AS module_2, t.n AS objects, count(*) AS shared, round(100.0::DOUBLE * count(*) / t.n, 4) AS pct
FROM (SELECT DISTINCT module, object_id FROM all_issues) a JOIN (SELECT DISTINCT module, object_id FROM all_issues) b ON a.object_id = b.object_id AND a.module <> b.module
JOIN (SELECT module, count(DISTINCT object_id) AS n FROM all_issues GROUP BY module) t ON t.module = a.module GROUP BY a.module, b.module, t.n""")(
    lambda x: issues.audit_overlap(all_issues(x)))

EARLIER = "1997-01-01 00:00:00"
EXPECTED["earlier_issues"] = f"""
SELECT issue_id, type, object_id FROM quality_issues WHERE type <> 'stale_contact'
UNION ALL SELECT issue_id, type, object_id FROM quality_issues i JOIN contacts c ON c.id = i.object_id WHERE type = 'stale_contact'
  AND (epoch_ms(TIMESTAMP '{EARLIER}') - epoch_ms(greatest(notes_last_contacted, hs_analytics_last_visit_timestamp))) / 86400000.0 > 365"""
query("audit_compare", """
SELECT type, coalesce(b.n, 0) AS before, coalesce(a.n, 0) AS after, coalesce(a.n, 0) - coalesce(b.n, 0) AS change,
  CASE WHEN coalesce(b.n, 0) > 0 THEN round(100.0::DOUBLE * (coalesce(a.n, 0) - coalesce(b.n, 0)) / b.n, 4) END AS change_pct
FROM (SELECT type, count(*) AS n FROM quality_issues GROUP BY type) a FULL JOIN (SELECT type, count(*) AS n FROM earlier_issues GROUP BY type) b USING (type)""")(
    lambda x: issues.compare_audits(quality_issues(x, EARLIER), quality_issues(x)))
query("issue_diff", """
SELECT issue_id, type, object_id, CASE WHEN issue_id IN (SELECT issue_id FROM earlier_issues) THEN 'remaining' ELSE 'new' END AS status FROM quality_issues""")(
    lambda x: issues.issue_diff(quality_issues(x, EARLIER), quality_issues(x)))
query("issue_source_share", """
SELECT type, source, count(*) AS issues, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY type), 4) AS pct
FROM quality_issues JOIN contacts ON id = object_id GROUP BY type, source""")(
    lambda x: issues.share_by_source(quality_issues(x), x.contacts, "source"))

# ---- properties

EXPECTED["usage"] = " UNION ALL ".join(f"""
SELECT '{c}' AS property, count(*) AS records, count(*) FILTER (CAST({c} AS STRING) <> '') AS filled, count(DISTINCT {c}) FILTER (CAST({c} AS STRING) <> '') AS distinct_values FROM contacts""" for c in PROPERTIES)
USAGE = """
SELECT *, round(100.0::DOUBLE * filled / records, 4) AS fill_rate,
  CASE WHEN 100.0 * filled / records > 50 THEN 'keep' WHEN 100.0 * filled / records < 10 AND property <> 'mobilephone' THEN 'deprecate' ELSE 'review' END AS verdict FROM usage"""


def usage(x):
    return properties.property_usage(x.contacts, PROPERTIES, required=["mobilephone"])


query("property_usage", USAGE)(usage)
query("low_population", f"SELECT * FROM ({USAGE}) u WHERE fill_rate < 5")(lambda x: properties.low_population(usage(x)))

MAPPINGS = {"it": "Technology", "tech": "Technology"}
EXPECTED["value_groups"] = """
SELECT lower(trim(v)) AS key, sum(n) AS records, count(*) AS spellings, arg_max(v, (n, -ascii(v))) AS standard FROM (SELECT industry AS v, count(*) AS n FROM contacts WHERE industry <> '' GROUP BY industry) c GROUP BY 1"""
VARIANTS = """
SELECT 'casing' AS kind, key AS variant, standard, CAST(records AS BIGINT) AS records FROM value_groups WHERE spellings > 1
UNION ALL SELECT 'mapping', key, 'Technology', CAST(records AS BIGINT) FROM value_groups WHERE key IN ('it', 'tech')
UNION ALL SELECT 'typo', b.key, a.standard, CAST(b.records AS BIGINT) FROM value_groups a JOIN value_groups b ON levenshtein(a.key, b.key) = 1 AND (a.records > b.records OR (a.records = b.records AND a.key < b.key))"""


def variants(x):
    return properties.value_variants(x.contacts, "industry", MAPPINGS)


query("value_variants", VARIANTS)(variants)


@query("format_mix", """
SELECT property, format, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY property), 4) AS pct FROM (
  SELECT 'phone' AS property, CASE WHEN regexp_full_match(phone, '\\+[1-9][0-9]{7,14}') THEN 'e164' WHEN regexp_full_match(phone, '\\([0-9]{3}\\) [0-9]{3}-[0-9]{4}') THEN 'national'
    WHEN phone LIKE '+%' THEN 'international' ELSE 'other' END AS format FROM contacts WHERE phone <> ''
  UNION ALL SELECT 'website', CASE WHEN website LIKE 'https://%' THEN 'https' WHEN website LIKE 'http://%' THEN 'http' WHEN website LIKE 'www.%' THEN 'www' ELSE 'bare' END FROM contacts WHERE website <> ''
  UNION ALL SELECT 'lastmodifieddate', 'iso' FROM contacts WHERE lastmodifieddate IS NOT NULL) f GROUP BY property, format""")
def format_mix(x):
    return properties.format_mix(x.contacts, {
        "phone": properties.phone_format(F.col("phone")), "website": properties.url_format(F.col("website")),
        "lastmodifieddate": properties.date_format_class(F.col("lastmodifieddate"))})


@query("standardise", f"""
SELECT c.id, CASE WHEN length(d) = 10 THEN concat('+1', d) ELSE phone END AS phone, CASE country WHEN 'NATION_0' THEN 'N0' WHEN 'NATION_7' THEN 'N7' ELSE country END AS country,
  array_to_string(list_transform(string_split(trim(regexp_replace(firstname, ' +', ' ', 'g')), ' '), lambda w: concat(upper(w[1]), lower(w[2:]))), ' ') AS firstname,
  strftime(createdate, '{ISO}') AS createdate
FROM contacts c JOIN (SELECT id, CASE WHEN length(q) = 11 AND q LIKE '1%' THEN substr(q, 2) ELSE q END AS d FROM (SELECT id, regexp_replace(coalesce(phone, ''), '[^0-9]', '', 'g') AS q FROM contacts) e) n ON n.id = c.id""")
def standardise(x):
    return properties.standardise(
        x.contacts.select("id", "phone", "country", "firstname", "createdate"), {"nation_0": "N0", "NATION_7": "N7"},
        ("phone", "country", "firstname"), ["createdate"])


# the reserved domains do not occur in the data, so the addresses are shortened to their last two labels
@query("placeholder_email", """
SELECT id, CASE WHEN regexp_full_match(short, '[^@]+@[^@]+') THEN split_part(lower(short), '@', 2) IN ('example.com', 'test.com') ELSE false END AS placeholder
FROM (SELECT id, CASE WHEN email IS NOT NULL THEN replace(lower(email), concat('mail', CAST(CAST(id AS BIGINT) % 5 AS STRING), '.'), '') END AS short FROM contacts) s""")
def placeholder_email(x):
    tail = F.concat(F.lit("mail"), (F.col("id").cast("bigint") % 5).cast("string"), F.lit("."))
    short = x.contacts.select("id", F.replace(F.lower("email"), tail, F.lit("")).alias("email"))
    return short.select("id", properties.placeholder_email().alias("placeholder"))


EXPECTED["scores"] = f"""
SELECT id, CAST(20 * ((CASE WHEN trim(email) <> '' THEN 1 ELSE 0 END) + (CASE WHEN trim(firstname) <> '' THEN 1 ELSE 0 END) + (CASE WHEN trim(lastname) <> '' THEN 1 ELSE 0 END))
  + CASE WHEN regexp_full_match(email, '[^\\s@]+@[^\\s@]+\\.[^\\s@]+') THEN 10 ELSE 0 END + CASE WHEN length(regexp_replace(phone, '[^0-9]', '', 'g')) >= 10 THEN 10 ELSE 0 END
  + CASE WHEN (epoch_ms(TIMESTAMP '{AS_OF}') - epoch_ms(greatest(notes_last_contacted, hs_analytics_last_visit_timestamp))) / 86400000.0 <= 365 THEN 5 ELSE 0 END
  + CASE WHEN trim(company) <> '' THEN 15 ELSE 0 END AS INTEGER) AS score FROM contacts"""
query("quality_score", "SELECT id, score, score < 50 AS is_low FROM scores")(
    lambda x: properties.quality_score(x.contacts, AS_OF, CONFIG.rules.required_contact_fields))


@query("health_score", f"""
SELECT count(*) AS contacts, count(*) FILTER (trim(email) <> '' AND trim(firstname) <> '' AND trim(lastname) <> '') AS complete,
  round(100.0::DOUBLE * count(*) FILTER (trim(email) <> '' AND trim(firstname) <> '' AND trim(lastname) <> '') / count(*), 4) AS complete_pct,
  (SELECT count(*) FROM dup_pairs) AS duplicate_pairs, (SELECT count(*) FROM ({VARIANTS}) v) AS inconsistent_values,
  (SELECT count(*) FROM lists WHERE last_used < TIMESTAMP '2023-08-01 00:00:00') AS unused_lists FROM contacts""")
def health_score(x):
    n = F.count(F.lit(1)).alias("n")
    hygiene = lists.list_hygiene(x.lists, x.members, x.contacts, AS_OF, F.col("hard_bounced") == "true")
    counted = duplicates.pair_counts(x.contacts).agg(F.coalesce(F.sum("pairs"), F.lit(0)).cast("bigint").alias("n"))
    return properties.health_score(
        x.contacts, CONFIG.rules.required_contact_fields, counted, variants(x).agg(n), hygiene.filter("is_unused").agg(n))


# ---- lists

query("list_overlap", """
SELECT list_1, list_2, shared, round(100.0::DOUBLE * shared / s1.n, 4) AS pct_1, round(100.0::DOUBLE * shared / s2.n, 4) AS pct_2 FROM (
  SELECT a.list_id AS list_1, b.list_id AS list_2, count(*) AS shared FROM members a JOIN members b ON a.contact_id = b.contact_id AND a.list_id < b.list_id GROUP BY 1, 2) p
JOIN (SELECT list_id, count(*) AS n FROM members GROUP BY 1) s1 ON s1.list_id = list_1 JOIN (SELECT list_id, count(*) AS n FROM members GROUP BY 1) s2 ON s2.list_id = list_2
WHERE 100.0::DOUBLE * shared / s1.n > 75 OR 100.0::DOUBLE * shared / s2.n > 75""")(
    lambda x: lists.list_overlap(x.members, 75.0))
query("list_hygiene", """
SELECT l.list_id, count(contact_id) AS members, count(*) FILTER (hard_bounced = 'true' OR unsubscribed_at IS NOT NULL) AS unfit, count(contact_id) FILTER (id IS NULL) AS deleted,
  count(contact_id) = 0 AS is_empty, max(last_used) < TIMESTAMP '2023-08-01 00:00:00' AS is_unused
FROM lists l LEFT JOIN members m ON m.list_id = l.list_id LEFT JOIN contacts ON id = contact_id GROUP BY l.list_id""")(
    lambda x: lists.list_hygiene(x.lists, x.members, x.contacts, AS_OF,
                                 (F.col("hard_bounced") == "true") | F.col("unsubscribed_at").isNotNull()))
query("list_validate", """
SELECT list_id, count(*) AS members, count(*) FILTER (fit) AS deliverable, count(*) FILTER (bad) AS bad_address, count(*) FILTER (out) AS opted_out, count(*) FILTER (bounced) AS bounced,
  count(address) - count(DISTINCT address) AS duplicates, count(DISTINCT address) FILTER (fit) AS clean_size, round(100.0::DOUBLE * count(*) FILTER (fit) / count(*), 4) AS deliverable_pct,
  round(100.0::DOUBLE * count(DISTINCT address) FILTER (fit) / nullif(count(DISTINCT address) FILTER (NOT (out OR bounced)) + count(*) FILTER (address IS NULL AND NOT (out OR bounced)), 0), 4) AS clean_deliverable_pct
FROM (SELECT *, NOT (bad OR out OR bounced) AS fit FROM (SELECT list_id, nullif(trim(lower(email)), '') AS address, NOT coalesce(regexp_full_match(email, '[^\\s@]+@[^\\s@]+\\.[^\\s@]+'), false) AS bad,
  unsubscribed_at IS NOT NULL AS out, hard_bounced = 'true' AS bounced FROM members JOIN contacts ON id = contact_id) j) f GROUP BY list_id""")(
    lambda x: lists.validate_lists(x.members, x.contacts))

# ---- marketing

PROFILE = CompanyProfile(("11-50", "51-200"), ("Technology", "tech"), ("Engineer", "CTO"))
SETTINGS = MarketingSettings(internal_domains=("mail3.example.com",), contact_limit=2000)
EXPECTED["obvious"] = """
SELECT id, hs_marketable_status = 'true' AS marketing, CASE WHEN hard_bounced = 'true' THEN 'hard_bounced' WHEN unsubscribed_at IS NOT NULL THEN 'unsubscribed'
  WHEN regexp_full_match(lower(email), '[^@]+@mail3\\.example\\.com') THEN 'internal' WHEN lower(email) LIKE '%test%' THEN 'test_contact' END AS reason FROM contacts"""
query("mkt_obvious", "SELECT id, reason, 'convert' AS action, 'high' AS confidence FROM obvious WHERE marketing AND reason IS NOT NULL")(
    lambda x: marketing.obvious_candidates(x.contacts, SETTINGS))

EXPECTED["metrics"] = f"""
SELECT id, CAST(floor((epoch_ms(TIMESTAMP '{AS_OF}') - epoch_ms(last_engaged)) / 86400000.0) AS BIGINT) AS days_since_engagement, coalesce(opens, 0) AS opens_12m, coalesce(clicks, 0) AS clicks_12m, coalesce(forms, 0) AS forms_12m,
  coalesce(deals, 0) AS deals, coalesce(open_deals, 0) AS open_deals, coalesce(won_deals, 0) AS won_deals, CAST(coalesce(won_value, 0) AS DOUBLE) AS won_value
FROM (SELECT id FROM contacts) c
LEFT JOIN (SELECT contact_id, max(event_time) FILTER (event_type IN ('OPENED', 'CLICKED', 'FORM_SUBMITTED')) AS last_engaged, count(*) FILTER (event_type = 'OPENED') AS opens,
  count(*) FILTER (event_type = 'CLICKED') AS clicks, count(*) FILTER (event_type = 'FORM_SUBMITTED') AS forms FROM contact_events GROUP BY contact_id) e ON e.contact_id = c.id
LEFT JOIN (SELECT contact_id, count(*) AS deals, count(*) FILTER (stage <> 'closedwon') AS open_deals, count(*) FILTER (stage = 'closedwon') AS won_deals,
  sum(CAST(amount AS DECIMAL(18,2))) FILTER (stage = 'closedwon') AS won_value FROM deals GROUP BY contact_id) d ON d.contact_id = c.id"""


def metrics(x):
    return marketing.engagement_metrics(x.contacts, x.contact_events, x.deals, AS_OF)


query("mkt_metrics", "SELECT * FROM metrics")(metrics)
EXPECTED["fits"] = """
SELECT *, CAST(round(100.0 * (size_match::INT + industry_match::INT + title_match::INT) / 3) AS INTEGER) AS fit FROM (
  SELECT id, coalesce(company_size IN ('11-50', '51-200'), false) AS size_match, coalesce(lower(industry) IN ('technology', 'tech'), false) AS industry_match,
    coalesce(lower(jobtitle) LIKE '%engineer%' OR lower(jobtitle) LIKE '%cto%', false) AS title_match FROM contacts) f"""
query("icp_fit", "SELECT * FROM fits")(lambda x: marketing.icp_fit(x.contacts, PROFILE))
EXPECTED["decisions"] = """
SELECT id, reason, fit, deals, won_value, CASE WHEN keep THEN 'keep' WHEN high OR medium THEN 'convert' ELSE 'monitor' END AS action,
  CASE WHEN keep OR high THEN 'high' WHEN medium THEN 'medium' ELSE 'low' END AS confidence FROM (
  SELECT id, reason, fit, deals, won_value, (won_deals > 0 OR open_deals > 0 OR (fit >= 67 AND idle <= 90)) AS keep,
    (reason IS NOT NULL OR (idle >= 730 AND deals = 0 AND fit <= 33)) AS high, (idle >= 540 AND deals = 0 AND fit <= 67) AS medium
  FROM (SELECT o.id, reason, fit, deals, won_value, won_deals, open_deals, coalesce(days_since_engagement, 100000) AS idle
    FROM obvious o JOIN metrics m ON m.id = o.id JOIN fits f ON f.id = o.id WHERE marketing) j) k"""


def decisions(x):
    return marketing.decide(x.contacts, metrics(x), marketing.icp_fit(x.contacts, PROFILE), SETTINGS)


query("mkt_decision", "SELECT * FROM decisions")(decisions)
query("mkt_savings", """
SELECT marketing_contacts, high, medium, low, with_deals, revenue_at_risk, round(marketing_contacts * 0.4::DOUBLE, 2) AS monthly_cost, round(100.0::DOUBLE * marketing_contacts / 2000, 4) AS utilization_pct,
  round(high * 0.4::DOUBLE, 2) AS immediate_monthly, round((high + medium) * 0.4::DOUBLE, 2) AS potential_monthly, round((high + medium) * 0.4::DOUBLE * 12, 2) AS annual,
  CASE WHEN high + medium > 0 THEN round(((high + medium) * 0.4::DOUBLE * 12 - revenue_at_risk) / ((high + medium) * 0.4::DOUBLE * 12), 4) END AS return_to_risk,
  CASE WHEN with_deals > 0 THEN 'Review high-value contacts first' ELSE 'Proceed' END AS recommendation
FROM (SELECT count(*) AS marketing_contacts, count(*) FILTER (action = 'convert' AND confidence = 'high') AS high, count(*) FILTER (action = 'convert' AND confidence = 'medium') AS medium,
  count(*) FILTER (confidence = 'low') AS low, count(*) FILTER (action = 'convert' AND deals > 0) AS with_deals, CAST(coalesce(sum(CAST(won_value AS DECIMAL(18,2))) FILTER (action = 'convert'), 0) AS DOUBLE) AS revenue_at_risk FROM decisions) t""")(
    lambda x: marketing.savings(decisions(x), SETTINGS))
query("retention_breaches", f"""
SELECT breach, count(*) AS contacts FROM (
  SELECT 'inactive' AS breach FROM contacts WHERE greatest(notes_last_contacted, hs_analytics_last_visit_timestamp) < TIMESTAMP '2021-02-01 00:00:00'
  UNION ALL SELECT 'opted_out' FROM contacts WHERE unsubscribed_at < TIMESTAMP '2022-02-01 00:00:00'
  UNION ALL SELECT 'bounced' FROM contacts WHERE hard_bounced = 'true') b GROUP BY breach""")(
    lambda x: marketing.retention_breaches(x.contacts, AS_OF))
query("mkt_deletion", """
SELECT count(*) FILTER (coalesce(lower(email) LIKE '%test%', false) OR coalesce(lower(company) LIKE '%test%', false)) AS test,
  count(*) FILTER (regexp_full_match(lower(email), '[^@]+@(example|test)\\.com')) AS spam, count(*) FILTER (hard_bounced = 'true' AND opens_12m + clicks_12m + forms_12m = 0) AS bounced_inactive,
  count(*) FILTER (greatest(notes_last_contacted, hs_analytics_last_visit_timestamp) < TIMESTAMP '2021-02-01 00:00:00') AS past_retention,
  count(*) FILTER (hs_marketable_status = 'true' AND opens_12m = 0) AS no_opens_12m, count(*) FILTER (hs_marketable_status = 'true' AND clicks_12m = 0) AS no_clicks_12m,
  count(*) FILTER (hs_marketable_status = 'true' AND forms_12m = 0) AS no_forms_12m
FROM contacts c JOIN metrics m ON m.id = c.id""")(
    lambda x: marketing.deletion_candidates(x.contacts, metrics(x), AS_OF))
query("mkt_limit_forecast", """
SELECT used, CAST(100000 AS INTEGER) AS contact_limit, round(fresh / months, 4) AS monthly_growth, round((100000 - used) / (fresh / months), 4) AS months_to_limit
FROM (SELECT (SELECT count(*) FROM contacts WHERE hs_marketable_status = 'true') AS used, sum(n)::DOUBLE AS fresh, count(*) AS months
  FROM (SELECT date_trunc('month', createdate) AS month, count(*) AS n FROM contacts WHERE hs_marketable_status = 'true' AND createdate IS NOT NULL GROUP BY 1) m) t""")(
    lambda x: marketing.limit_forecast(x.contacts, AS_OF, MarketingSettings(contact_limit=100_000)))

# ---- deals, forms, alerts, calls

query("stuck_deals", "SELECT stage, count(*) AS deals, CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS amount FROM deals WHERE stage <> 'closedwon' AND updated_at <= TIMESTAMP '2000-12-02 00:00:00' GROUP BY stage")(
    lambda x: pipeline.stuck_deals(x.deals, "2001-01-01 00:00:00"))
query("stage_conversion", """
SELECT stage, reached, reached_next, round(100.0::DOUBLE * reached_next / reached, 4) AS conversion_pct FROM (
  SELECT 'demo' AS stage, count(*) AS reached, count(*) FILTER (stage <> 'demo') AS reached_next FROM deals
  UNION ALL SELECT 'proposal', count(*) FILTER (stage <> 'demo'), count(*) FILTER (stage = 'closedwon') FROM deals
  UNION ALL SELECT 'closedwon', count(*) FILTER (stage = 'closedwon'), NULL FROM deals) s""")(
    lambda x: pipeline.stage_conversion(x.deals, ["demo", "proposal", "closedwon"]))
query("form_dropoff", """
SELECT form, field, starts, finished, round(100.0::DOUBLE * (starts - finished) / starts, 4) AS abandonment_pct FROM (
  SELECT event_type AS form, json_extract_string(props, '$.k') AS field, count(*) AS starts, count(*) FILTER (value >= 20) AS finished FROM contact_events GROUP BY 1, 2
  UNION ALL SELECT event_type, NULL, count(*), count(*) FILTER (value >= 20) FROM contact_events GROUP BY 1) f""")(
    lambda x: pipeline.form_dropoff(
        x.contact_events.withColumn("form", F.col("event_type")).withColumn("field", F.get_json_object("props", "$.k")),
        "form", "field", F.col("value") >= 20))


@query("alert_spikes", f"""
SELECT kind, strftime(period, '{ISO}') AS period, n, before, round(change, 4) AS change_pct, CASE WHEN round(change, 4) > 10 THEN 'spike' ELSE 'drop' END AS alert FROM (
  SELECT *, 100.0::DOUBLE * (n - before) / before AS change FROM (SELECT *, lag(n) OVER (PARTITION BY kind ORDER BY period) AS before FROM (
    SELECT event_type AS kind, date_trunc('week', event_time) AS period, count(*) AS n FROM contact_events GROUP BY 1, 2) c) l) d WHERE round(change, 4) > 10 OR round(change, 4) < -10""")
def alert_spikes(x):
    weekly = pipeline.period_counts(x.contact_events, "event_time", "event_type")
    return pipeline.spikes(weekly, 10, 10).withColumn("period", t.iso_timestamp(F.col("period")))


@query("alert_forms", f"""
SELECT kind, strftime(period, '{ISO}') AS period, n, before, round(change, 4) AS change_pct, 'drop' AS alert FROM (
  SELECT *, 100.0::DOUBLE * (n - before) / before AS change FROM (SELECT *, lag(n) OVER (PARTITION BY kind ORDER BY period) AS before FROM (
    SELECT event_type AS kind, date_trunc('day', event_time) AS period, count(*) AS n FROM contact_events WHERE event_type = 'FORM_SUBMITTED' GROUP BY 1, 2) c) l) d WHERE round(change, 4) < -30""")
def alert_forms(x):
    daily = pipeline.period_counts(x.contact_events.filter("event_type = 'FORM_SUBMITTED'"), "event_time", "event_type", "day")
    return pipeline.spikes(daily, float("inf"), 30).withColumn("period", t.iso_timestamp(F.col("period")))


@query("alert_membership", f"""
SELECT kind, strftime(period, '{ISO}') AS period, n, before, round(change, 4) AS change_pct, CASE WHEN change > 0 THEN 'spike' ELSE 'drop' END AS alert FROM (
  SELECT *, 100.0::DOUBLE * (n - before) / before AS change FROM (SELECT *, lag(n) OVER (PARTITION BY kind ORDER BY period) AS before FROM (
    SELECT event_type AS kind, date_trunc('day', event_time) AS period, count(DISTINCT contact_id) AS n FROM contact_events GROUP BY 1, 2) c) l) d WHERE abs(round(change, 4)) > 20""")
def alert_membership(x):
    """Members of a list per kind of event that change by more than a fifth within a day."""
    daily = x.contact_events.select(F.col("event_type").alias("kind"), F.date_trunc("day", F.col("event_time").cast("timestamp")).alias("period"), "contact_id").distinct()
    counts = daily.groupBy("kind", "period").agg(F.count(F.lit(1)).alias("n"))
    return pipeline.spikes(counts, 20, 20).withColumn("period", t.iso_timestamp(F.col("period")))


@query("alert_score", f"""
SELECT kind, strftime(period, '{ISO}') AS period, round(score, 4) AS score, round(before, 4) AS before FROM (SELECT *, lag(score) OVER (PARTITION BY kind ORDER BY period) AS before FROM (
  SELECT 'contacts' AS kind, date_trunc('month', createdate) AS period, 100.0::DOUBLE * count(*) FILTER (phone <> '') / count(*) AS score FROM contacts WHERE createdate IS NOT NULL GROUP BY 2) s) l WHERE before - score > 10""")
def alert_score(x):
    """Months whose new contacts have a phone number less often than those of the month before."""
    scores = x.contacts.filter("createdate IS NOT NULL").groupBy(F.lit("contacts").alias("kind"), F.date_trunc("month", F.col("createdate").cast("timestamp")).alias("period")).agg(
        (F.lit(100.0) * F.count_if(F.coalesce(F.col("phone") != "", F.lit(False))) / F.count(F.lit(1))).alias("score"))
    return pipeline.score_drops(scores).select("kind", t.iso_timestamp(F.col("period")).alias("period"), F.round("score", 4).alias("score"), F.round("before", 4).alias("before"))


MODEL_PRICES = {"claude-sonnet-4-20250514": (3.0, 15.0, 3.0), "claude-3-haiku-20240307": (0.25, 1.25, 0.25)}
PRICES = """
SELECT *, i + o + h AS cost FROM (SELECT *, input_tokens / 1000000 * CASE WHEN haiku THEN 0.25::DOUBLE ELSE 3.0::DOUBLE END AS i, output_tokens / 1000000 * CASE WHEN haiku THEN 1.25::DOUBLE ELSE 15.0::DOUBLE END AS o,
  thinking_tokens / 1000000 * CASE WHEN haiku THEN 0.25::DOUBLE ELSE 3.0::DOUBLE END AS h FROM (SELECT *, model LIKE '%haiku%' AS haiku FROM call_log) m) p"""
EXPECTED["priced"] = PRICES
query("llm_cost", "SELECT conv_id, turn, round(i, 9) AS input_cost, round(o, 9) AS output_cost, round(h, 9) AS thinking_cost, round(cost, 9) AS cost_usd FROM priced")(
    lambda x: x.call_log.select("conv_id", "turn", *pipeline.call_cost(MODEL_PRICES)).select(
        "conv_id", "turn", *[F.round(c, 9).alias(c) for c in ("input_cost", "output_cost", "thinking_cost", "cost_usd")]))
USAGE_SUMS = ("count(*) FILTER (NOT is_error) AS requests, " + ", ".join(
    f"CAST(coalesce(sum({c}) FILTER (NOT is_error), 0) AS BIGINT) AS {c}" for c in ("input_tokens", "output_tokens", "thinking_tokens", "tool_calls"))
    + ", coalesce(CAST(sum(CAST(round(cost * 1e9) AS BIGINT)) FILTER (NOT is_error) AS DOUBLE), 0) / 1e9 AS cost_usd, count(*) FILTER (is_error) AS errors")
query("llm_usage", f"""
SELECT 'operation' AS scope, operation AS name, {USAGE_SUMS} FROM priced GROUP BY operation
UNION ALL SELECT 'mode', mode, {USAGE_SUMS} FROM priced GROUP BY mode UNION ALL SELECT 'total', 'all', {USAGE_SUMS} FROM priced""")(
    lambda x: pipeline.usage_rollup(x.call_log, MODEL_PRICES))

# ---- across objects


def by_domain(x):
    return consistency.associate_by_domain(x.contacts, x.companies)


query("associate_by_domain", """
SELECT c.id, o.domain, o.id AS company_id FROM (SELECT id, split_part(lower(email), '@', 2) AS domain FROM contacts WHERE regexp_full_match(email, '[^@]+@[^@]+')) c
JOIN companies o ON o.domain = c.domain""")(by_domain)
query("associate_unlinked", """
SELECT c.id, o.domain, o.id AS company_id FROM (SELECT id, split_part(lower(email), '@', 2) AS domain FROM contacts WHERE regexp_full_match(email, '[^@]+@[^@]+')) c
JOIN companies o ON o.domain = c.domain WHERE c.id NOT IN (SELECT from_id FROM edges WHERE CAST(to_id AS BIGINT) % 7 = 0)""")(
    lambda x: consistency.associate_by_domain(x.contacts, x.companies, x.edges.filter(F.col("to_id").cast("bigint") % 7 == 0)))
query("cross_object_checks", """
SELECT id, 'customer_without_won_deal' AS "check" FROM contacts WHERE lifecyclestage = 'customer' AND id NOT IN (SELECT contact_id FROM deals WHERE stage = 'closedwon')
UNION ALL SELECT id, 'contact_without_company' FROM contacts WHERE id NOT IN (SELECT from_id FROM edges)""")(
    lambda x: consistency.cross_object_checks(x.contacts, x.deals, x.edges))

EXPECTED["pair_metrics"] = f"""
SELECT c.id, CAST({FILLED} AS INTEGER) AS filled, coalesce(e.n, 0) AS events, coalesce(d.n, 0) AS deals, coalesce(l.n, 0) AS lists FROM contacts c
LEFT JOIN (SELECT contact_id, count(*) AS n FROM contact_events GROUP BY 1) e ON e.contact_id = c.id LEFT JOIN (SELECT contact_id, count(*) AS n FROM deals GROUP BY 1) d ON d.contact_id = c.id
LEFT JOIN (SELECT contact_id, count(*) AS n FROM members GROUP BY 1) l ON l.contact_id = c.id"""


@query("pair_profile", """
SELECT id_1, id_2, match_type, a.filled AS filled_1, a.events AS events_1, a.deals AS deals_1, a.lists AS lists_1, b.filled AS filled_2, b.events AS events_2, b.deals AS deals_2, b.lists AS lists_2
FROM dup_links JOIN pair_metrics a ON a.id = id_1 JOIN pair_metrics b ON b.id = id_2""")
def pair_profile(x):
    numbers = consistency.contact_metrics(x.contacts, x.contact_events, x.deals, x.members)
    return consistency.pair_profile(pairs(x).select("id_1", "id_2", "match_type"), numbers)


# ---- streams

query("stream_validate", f"SELECT {ISSUE_FIELDS} FROM quality_issues")(
    lambda x: jobs.run_to_table(jobs.validate(x.stream("contacts", "customer"), AS_OF), "validate").select(*ISSUE_FIELDS.split(", ")))


@query("stream_dedupe", """
SELECT DISTINCT nullif(trim(lower(email)), '') AS email_key FROM contacts WHERE createdate >= TIMESTAMP '1995-06-01 00:00:00' AND trim(email) <> ''
  AND trim(lower(email)) NOT IN (SELECT trim(lower(email)) FROM contacts WHERE createdate < TIMESTAMP '1995-06-01 00:00:00' AND email IS NOT NULL)""")
def stream_dedupe(x):
    since = F.lit("1995-06-01").cast("timestamp")
    arrivals = x.stream("contacts", "customer").withColumn("createdate", F.col("createdate").cast("timestamp"))
    fresh = jobs.new_addresses(
        arrivals.filter(F.col("createdate") >= since).select("id", "email", "createdate"),
        x.contacts.filter(F.col("createdate") < since), "createdate")
    return jobs.run_to_table(fresh, "dedupe").select("email_key")


@query("stream_alerts", f"""
SELECT strftime(window_start, '{ISO}') AS window_start, event_type, n FROM (
  SELECT date_trunc('hour', event_time) AS window_start, event_type, count(*) AS n, (SELECT max(event_time) FROM contact_events) AS last FROM contact_events GROUP BY 1, 2) w
WHERE n >= 4 AND window_start + INTERVAL 1 HOUR <= last - INTERVAL 10 MINUTE""")
def stream_alerts(x):
    events = x.stream("contact_events", "events").withColumn("event_time", F.col("event_time").cast("timestamp"))
    alerts = jobs.run_to_table(jobs.rate_alerts(events, "event_time", "event_type", 4), "alerts")
    return alerts.withColumn("window_start", t.iso_timestamp(F.col("window_start")))


EXPECTED["bounce_actions"] = """
SELECT *, CASE WHEN hard > 0 THEN 'remove' WHEN soft >= 3 THEN 'review' END AS action FROM (
  SELECT contact_id, count(*) FILTER (id % 4 = 0) AS hard, count(*) FILTER (id % 4 <> 0) AS soft FROM contact_events WHERE event_type = 'BOUNCE' GROUP BY contact_id) b"""


@query("stream_bounces", """
SELECT 'contact' AS part, contact_id, action AS what, hard, soft FROM bounce_actions WHERE action IS NOT NULL
UNION ALL SELECT 'member', contact_id, list_id, NULL, NULL FROM members WHERE contact_id NOT IN (SELECT contact_id FROM bounce_actions WHERE action = 'remove')""")
def stream_bounces(x):
    updates = jobs.run_updates(jobs.bounce_counts(x.stream("contact_events", "events"), hard=F.col("id") % 4 == 0), "bounces")
    flagged, kept = jobs.bounced_members(x.members, updates)
    none = F.lit(None).cast("bigint")
    return flagged.select(F.lit("contact").alias("part"), "contact_id", F.col("action").alias("what"), "hard", "soft").unionByName(
        kept.select(F.lit("member").alias("part"), "contact_id", F.col("list_id").alias("what"), none.alias("hard"), none.alias("soft")))


# ---- the other audits by name

query("dq_companies", "SELECT 'missing_required_field' AS type, id AS object_id, 'domain' AS field FROM companies WHERE CAST(id AS BIGINT) % 7 = 0")(
    lambda x: modules.run_audits(["company-quality"], {"companies": x.companies.withColumn(
        "domain", F.when(F.col("id").cast("bigint") % 7 != 0, F.col("domain")))}, CONFIG, AS_OF).select("type", "object_id", "field"))


@query("other_audits", f"""
SELECT 'marketing' AS module, 'convert_to_non_marketing' AS type, id AS object_id, concat('Marketing contact can be converted: ', replace(reason, '_', ' ')) AS description FROM (
  SELECT id, CASE WHEN hard_bounced = 'true' THEN 'hard_bounced' WHEN unsubscribed_at IS NOT NULL THEN 'unsubscribed' WHEN lower(email) LIKE '%test%' THEN 'test_contact' END AS reason
  FROM contacts WHERE hs_marketable_status = 'true') m WHERE reason IS NOT NULL
UNION ALL SELECT 'lists', kind, list_id, CASE kind WHEN 'empty_list' THEN 'List has no members' WHEN 'unused_list' THEN 'List was not used in six months'
    ELSE concat('List has ', CAST(invalid AS STRING), ' members who cannot be mailed') END FROM (
  SELECT list_id, invalid, unnest([CASE WHEN members = 0 THEN 'empty_list' END, CASE WHEN last_used IS NULL OR last_used < TIMESTAMP '2023-08-01 00:00:00' THEN 'unused_list' END, CASE WHEN invalid > 0 THEN 'invalid_members' END]) AS kind
  FROM (SELECT l.list_id, l.last_used, count(m.contact_id) AS members, count(m.contact_id) FILTER (c.id IS NULL OR c.hard_bounced = 'true' OR c.unsubscribed_at IS NOT NULL) AS invalid
    FROM lists l LEFT JOIN members m ON m.list_id = l.list_id LEFT JOIN contacts c ON c.id = m.contact_id GROUP BY l.list_id, l.last_used) g) u WHERE kind IS NOT NULL""")
def other_audits(x):
    tables = {"contacts": x.contacts, "lists": x.lists, "members": x.members}
    return modules.run_audits(["marketing", "lists"], tables, CONFIG, AS_OF).select("module", "type", "object_id", "description")


@query("property_findings", """
SELECT 'low_population' AS type, property AS object_id, CAST(round(100.0::DOUBLE * filled / records, 4) AS DOUBLE) AS fill_rate FROM all_usage WHERE 100.0 * filled / records < 5""")
def property_findings(x):
    found = modules.run_audits(["properties"], {"contacts": x.contacts}, CONFIG, AS_OF).filter("type = 'low_population'")
    return found.select("type", "object_id", F.col("current_value").cast("double").alias("fill_rate"))

# every property, and the spellings of industry with the configured mappings
EXPECTED["all_usage"] = " UNION ALL ".join(f"""
SELECT '{c}' AS property, count(*) AS records, count(*) FILTER (CAST({c} AS STRING) <> '') AS filled FROM contacts""" for c in PROPERTIES)


@query("property_audit", f"""
SELECT 'low_population' AS type, property AS object_id, property AS field, CAST(round(100.0::DOUBLE * filled / records, 4) AS DOUBLE) AS fill_rate, NULL AS current_value, NULL AS suggested_value,
  count(*) OVER () AS ids FROM all_usage WHERE 100.0 * filled / records < 5
UNION ALL SELECT 'value_variant', 'industry', concat('industry=', variant), NULL, variant, standard, count(*) OVER () AS ids FROM ({VARIANTS}) v""")
def property_audit(x):
    config = AuditConfig(rules=QualityRules(industry_mappings=MAPPINGS))
    found = modules.run_audits(["properties"], {"contacts": x.contacts}, config, AS_OF)
    ids = found.groupBy("type").agg(F.countDistinct("issue_id").alias("ids"))
    low = F.col("type") == "low_population"
    return found.join(ids, "type").select(
        "type", "object_id", "field", F.when(low, F.col("current_value").cast("double")).alias("fill_rate"),
        F.when(~low, F.col("current_value")).alias("current_value"), "suggested_value", "ids")
