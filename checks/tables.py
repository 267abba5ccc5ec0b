"""CRM tables derived from the test tables, by one SQL text for both engines."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from rowmender.operators.skew import spread_keys
from rowmender.session import tune
from rowmender.streaming.jobs import read_files

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
        "embeddings", "pages", "benchmark", "labels", "conversations")

AS_OF = "2024-02-01 00:00:00"

DERIVED = {
    "contacts": """
SELECT
  CAST(c_custkey AS STRING) AS id,
  CASE WHEN c_custkey % 31 = 0 THEN NULL
       WHEN c_custkey % 13 = 0 THEN concat('bad-email-', CAST(c_custkey AS STRING))
       WHEN c_custkey % 11 = 0 THEN concat('  USER', CAST(c_custkey - 1 AS STRING), '@MAIL', CAST((c_custkey - 1) % 5 AS STRING), '.EXAMPLE.COM')
       ELSE concat('user', CAST(c_custkey AS STRING), '@mail', CAST(c_custkey % 5 AS STRING), '.example.com') END AS email,
  CASE WHEN c_custkey % 17 = 0 THEN NULL WHEN c_custkey % 19 = 0 THEN '  Mary ' WHEN c_custkey % 23 = 0 THEN 'Mary  Ann'
       ELSE CASE CAST(c_custkey % 8 AS INT) WHEN 0 THEN 'John' WHEN 1 THEN 'Jon' WHEN 2 THEN 'Robert' WHEN 3 THEN 'Bob'
            WHEN 4 THEN 'Michael' WHEN 5 THEN 'Mike' WHEN 6 THEN 'Elizabeth' ELSE 'Liz' END END AS firstname,
  CASE WHEN c_custkey % 29 = 0 THEN '   ' WHEN c_custkey % 41 = 0 THEN 'Stone '
       ELSE CASE CAST(c_custkey % 7 AS INT) WHEN 0 THEN 'Smith' WHEN 1 THEN 'Smyth' WHEN 2 THEN 'O''Connor' WHEN 3 THEN 'Stone'
            WHEN 4 THEN 'Jones' WHEN 5 THEN 'Johnson' ELSE 'Brown-Lee' END END AS lastname,
  CASE WHEN c_custkey % 37 = 0 THEN '123' WHEN c_custkey % 5 = 0 THEN NULL
       WHEN c_custkey % 9 = 0 THEN concat('+1-', CAST(200 + c_custkey % 600 AS STRING), '-555-', lpad(CAST(CAST(floor(c_custkey / 1200.0) AS BIGINT) AS STRING), 4, '0'))
       ELSE concat('(', CAST(200 + c_custkey % 600 AS STRING), ') 555-', lpad(CAST(CAST(floor(c_custkey / 1200.0) AS BIGINT) AS STRING), 4, '0')) END AS phone,
  CASE WHEN c_custkey % 10 = 0 THEN concat(CAST(200 + c_custkey % 600 AS STRING), '.555.', lpad(CAST(CAST(floor(c_custkey / 1200.0) AS BIGINT) AS STRING), 4, '0')) ELSE NULL END AS mobilephone,
  CASE WHEN c_custkey % 43 = 0 THEN NULL WHEN c_custkey % 47 = 0 THEN 'Test Company'
       ELSE concat('Acme ', CAST(c_custkey % 20 AS STRING), ' Unit ', CAST(CAST(floor(c_custkey / 840.0) AS BIGINT) AS STRING),
            CASE CAST(c_custkey % 3 AS INT) WHEN 0 THEN ' Inc.' WHEN 1 THEN '  LLC' ELSE ' Inc.' END) END AS company,
  CASE CAST(c_custkey % 6 AS INT) WHEN 0 THEN 'Software Engineer' WHEN 1 THEN 'CTO' WHEN 2 THEN 'Sales Manager' WHEN 3 THEN NULL WHEN 4 THEN 'Product Manager' ELSE 'VP of Engineering' END AS jobtitle,
  CASE CAST(c_custkey % 9 AS INT) WHEN 0 THEN 'Technology' WHEN 1 THEN 'tech' WHEN 2 THEN 'Tech' WHEN 3 THEN 'IT' WHEN 4 THEN 'Agriculture' WHEN 5 THEN 'Retail' WHEN 6 THEN 'Technolgy' WHEN 7 THEN NULL ELSE 'Healthcare' END AS industry,
  CASE CAST(c_custkey % 4 AS INT) WHEN 0 THEN '1-10' WHEN 1 THEN '11-50' WHEN 2 THEN '51-200' ELSE NULL END AS company_size,
  CASE WHEN c_custkey % 53 = 0 THEN 'not a url' WHEN c_custkey % 4 = 0 THEN NULL ELSE concat('acme', CAST(c_custkey % 20 AS STRING), '.example.com') END AS website,
  n_name AS country,
  CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE lo.last_order END AS notes_last_contacted,
  ev.last_visit AS hs_analytics_last_visit_timestamp,
  lo.last_order AS lastmodifieddate,
  CASE WHEN c_mktsegment = 'BUILDING' THEN 'false' ELSE 'true' END AS hs_marketable_status,
  CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS hs_marketable_reason_type,
  CASE CAST(c_custkey % 5 AS INT) WHEN 0 THEN 'customer' WHEN 1 THEN 'lead' WHEN 2 THEN 'subscriber' WHEN 3 THEN '' ELSE NULL END AS lifecyclestage,
  c_mktsegment AS source,
  CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 10 = 0 THEN ' 12 opens' WHEN c_custkey % 11 = 0 THEN 'many' ELSE CAST(c_custkey % 50 AS STRING) END AS hs_email_open,
  CASE WHEN c_custkey % 21 = 0 THEN 'true' ELSE 'false' END AS hard_bounced,
  CASE WHEN c_custkey % 25 = 0 THEN lo.last_order ELSE NULL END AS unsubscribed_at,
  lo.first_order AS createdate
FROM customer
JOIN nation ON n_nationkey = c_nationkey
LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last_order, min(o_orderdate) AS first_order FROM orders GROUP BY o_custkey) lo ON lo.o_custkey = c_custkey
LEFT JOIN (SELECT user_id, max(ts) AS last_visit FROM events GROUP BY user_id) ev ON ev.user_id = c_custkey""",
    "companies": """
SELECT CAST(s_suppkey AS STRING) AS id,
  CASE WHEN s_suppkey % 10 = 1 THEN concat('Acme ', CAST(s_suppkey - 1 AS STRING), ' LLC')
       ELSE concat('Acme ', CAST(s_suppkey AS STRING), ' Inc.') END AS name,
  concat('mail', CAST(s_suppkey AS STRING), '.example.com') AS domain,
  n_name AS country
FROM supplier JOIN nation ON n_nationkey = s_nationkey""",
    # two contacts in three have no deals
    "deals": """
SELECT CAST(o_orderkey AS STRING) AS id, CAST(o_custkey - o_custkey % 3 AS STRING) AS contact_id,
  CASE o_orderstatus WHEN 'F' THEN 'closedwon' WHEN 'O' THEN 'proposal' ELSE 'demo' END AS stage,
  o_totalprice AS amount, o_orderdate AS updated_at
FROM orders""",
    "contact_events": """
SELECT event_id AS id, CAST(user_id AS STRING) AS contact_id,
  CASE event_type WHEN 'click' THEN 'CLICKED' WHEN 'view' THEN 'OPENED' WHEN 'signup' THEN 'FORM_SUBMITTED'
       WHEN 'error' THEN 'BOUNCE' ELSE 'DELIVERED' END AS event_type,
  ts AS event_time, value, props
FROM events""",
    # a list per event type and block of three days
    "members": """
SELECT DISTINCT concat(event_type, '-', CAST(CAST(floor((extract(day FROM ts) - 1) / 3.0) AS INT) AS STRING)) AS list_id,
  CAST(user_id AS STRING) AS contact_id
FROM events""",
    "lists": """
SELECT list_id, concat('List ', list_id) AS name, last_used, CASE WHEN size > 90 THEN NULL ELSE size END AS size FROM (
  SELECT concat(event_type, '-', CAST(CAST(floor((extract(day FROM ts) - 1) / 3.0) AS INT) AS STRING)) AS list_id,
    max(ts) AS last_used, count(DISTINCT user_id) AS size
  FROM events GROUP BY 1) x
UNION ALL SELECT concat('empty-', CAST(n_nationkey AS STRING)), concat('Empty ', n_name), TIMESTAMP '2023-01-01 00:00:00', NULL FROM nation""",
    "edges": """
SELECT 'contact' AS from_type, CAST(o_custkey AS STRING) AS from_id, 'company' AS to_type, CAST(l_suppkey AS STRING) AS to_id,
  CASE WHEN max(l_returnflag) = 'R' THEN NULL ELSE 'contact_to_company' END AS assoc_type
FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey, l_suppkey""",
    "plan_seed": """
SELECT concat('a', CAST(o_orderkey AS STRING)) AS action_id, o_orderkey AS seq,
  CASE WHEN o_orderkey % 997 = 996 THEN 'a-missing' WHEN o_orderkey % 5 <> 0 THEN concat('a', CAST(o_orderkey - 1 AS STRING)) ELSE NULL END AS depends_on,
  CASE WHEN o_orderkey % 50 = 49 THEN 'failed' ELSE 'success' END AS status,
  (o_orderkey % 7 <> 0) AS is_reversible,
  concat('plan-', o_orderpriority) AS plan_id, CAST(o_custkey AS STRING) AS object_id, o_orderdate AS executed_at
FROM orders""",
    # stages of a deal by the lines of its order: now and then one is skipped or taken back
    "deal_history": """
SELECT CAST(l_orderkey AS STRING) AS deal_id, l_linenumber AS seq, l_shipdate AS entered_at,
  CASE CAST(CASE WHEN l_partkey % 5 = 0 THEN l_linenumber WHEN l_partkey % 7 = 0 THEN l_linenumber - 2 ELSE l_linenumber - 1 END AS INT)
    WHEN -1 THEN 'lead' WHEN 0 THEN 'qualified' WHEN 1 THEN 'demo' WHEN 2 THEN 'proposal' ELSE 'closedwon' END AS stage
FROM lineitem""",
    # a contact joins a list at its first event there; one in three leaves at its last
    "member_moves": """
SELECT list_id, contact_id, first_at AS moved_at, 1 AS step FROM (
  SELECT concat(event_type, '-', CAST(CAST(floor((extract(day FROM ts) - 1) / 6.0) AS INT) AS STRING)) AS list_id, CAST(user_id AS STRING) AS contact_id,
    min(ts) AS first_at FROM events GROUP BY 1, 2) a
UNION ALL SELECT list_id, contact_id, last_at, -1 FROM (
  SELECT concat(event_type, '-', CAST(CAST(floor((extract(day FROM ts) - 1) / 6.0) AS INT) AS STRING)) AS list_id, CAST(user_id AS STRING) AS contact_id,
    min(ts) AS first_at, max(ts) AS last_at FROM events WHERE user_id % 3 = 0 GROUP BY 1, 2) b WHERE last_at > first_at""",
    # events in the order in which they arrive: most at once, some one or two deliveries late
    "deliveries": """
SELECT *, least(5, CAST(floor((extract(day FROM event_time) - 1) / 5.0) AS INT) + CASE WHEN id % 10 = 0 THEN 2 WHEN id % 15 = 0 THEN 1 ELSE 0 END) AS delivery
FROM (SELECT event_id AS id, event_type, ts AS event_time FROM events) e""",
    "call_log": """
SELECT conv_id, turn, CASE CAST(conv_id % 3 AS INT) WHEN 0 THEN 'data-quality-reasoning' WHEN 1 THEN 'data-quality-exploration' ELSE 'duplicates' END AS operation,
  CASE WHEN conv_id % 2 = 0 THEN 'reasoning' ELSE 'exploratory' END AS mode,
  CASE WHEN conv_id % 4 = 0 THEN 'claude-3-haiku-20240307' ELSE 'claude-sonnet-4-20250514' END AS model,
  CAST(length(text) AS BIGINT) AS input_tokens, CAST(turn AS BIGINT) * 10 AS output_tokens, CAST(turn AS BIGINT) * 3 AS thinking_tokens,
  CAST(turn % 3 AS BIGINT) AS tool_calls, (conv_id % 20 = 19) AS is_error
FROM conversations""",
}

# A task of a join or grouping of order lines holds about this many.
LINES_PER_TASK = 250_000


def edges(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """The rows of ``DERIVED["edges"]``, joined and grouped in tasks of a bounded number of lines."""
    n = lineitem.count()
    bought = orders.select("o_orderkey", "o_custkey").filter("o_orderkey is not null")
    lines = lineitem.select("l_orderkey", "l_suppkey", "l_returnflag").filter("l_orderkey is not null")
    both = spread_keys(bought, ["o_orderkey"], n, LINES_PER_TASK).join(
        spread_keys(lines, ["l_orderkey"], n, LINES_PER_TASK), F.col("l_orderkey") == F.col("o_orderkey"))
    pair = ["o_custkey", "l_suppkey"]
    found = spread_keys(both, pair, n, LINES_PER_TASK).groupBy(*pair).agg(F.max("l_returnflag").alias("flag"))
    return found.select(
        F.lit("contact").alias("from_type"), F.col("o_custkey").cast("string").alias("from_id"), F.lit("company").alias("to_type"),
        F.col("l_suppkey").cast("string").alias("to_id"),
        F.when(F.col("flag") == "R", F.lit(None).cast("string")).otherwise("contact_to_company").alias("assoc_type"))


# Tables that Spark derives in bounded tasks, with the rows of their SQL.
SPREAD = {"edges": edges}

_SCHEMAS: dict = {}

# Results of the same rules in plain SQL, for the comparison only.
EXPECTED: dict[str, str] = {}


def _uses(sql: str, names) -> list[str]:
    words = set(re.findall(r"[a-z_][a-z0-9_]*", sql))
    return [n for n in names if n in words]


def table(spark: SparkSession, sf_dir: str, name: str, stream: str | None = None) -> DataFrame:
    """A base or derived table as a DataFrame; the base table ``stream`` is read as a stream."""
    tune(spark)

    def base(n: str) -> DataFrame:
        path = f"{sf_dir}/{n}.parquet"
        try:
            key = (path, os.path.getmtime(path))
        except OSError:  # a path that only Spark reads may change unseen
            key = None
        schema = _SCHEMAS.get(key) or spark.read.parquet(path).schema
        if key is not None:
            _SCHEMAS[key] = schema
        df = spark.read.schema(schema).parquet(path)
        return read_files(spark, sf_dir, df.schema, f"{n}.parquet") if n == stream else df

    if name in BASE:
        return base(name)
    sql = DERIVED[name]
    sources = {n: base(n) for n in _uses(sql, BASE)}
    if name in SPREAD:
        return SPREAD[name](**sources)
    named = re.sub(r"(?<!')\b[a-z_][a-z0-9_]*\b(?!')", lambda m: "{%s}" % m[0] if m[0] in sources else m[0], sql)
    return spark.sql(named, **sources)


def with_views(sql: str) -> str:
    """The SQL with every derived or expected table it names as a common table."""
    library = {**DERIVED, **EXPECTED}
    ordered: list[str] = []

    def add(text: str) -> None:
        for n in _uses(text, library):
            if n not in ordered:
                add(library[n])
                ordered.append(n)

    add(sql)
    if not ordered:
        return sql
    views = ",\n".join(f"{n} AS ({library[n]})" for n in ordered)
    return f"WITH {views}\nSELECT * FROM (\n{sql}\n) result"
