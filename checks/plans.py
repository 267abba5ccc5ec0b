"""Plans: building, filtering, ordering, running and rolling back."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.duplicates import pairs
from checks.quality import flat_counts, quality_issues
from checks.registry import query
from checks.tables import AS_OF, EXPECTED
from rowmender.functions import text as t
from rowmender.operators import duplicates, issues
from rowmender.plans import apply, build, execution, order, rollback
from rowmender.session import scratch_path, written
from rowmender.sources import store

FLAT = ("action_id", "type", "confidence", "object_type", "object_id", "display_name", "description", "property",
        "current_value", "new_value", "reasoning", "detection_method", "reversible", "requires_confirmation")

EXPECTED["actions"] = """
SELECT *, concat(object_id, '/', lpad(CAST(rule_no AS STRING), 4, '0'), '/', action_id) AS seq FROM (
  SELECT plan_id, sha256(concat('action|', plan_id, '|', issue_id)) AS action_id, rule_no,
    CASE type WHEN 'stale_contact' THEN 'set_marketing_status' WHEN 'duplicate' THEN 'merge_contacts' ELSE 'update_property' END AS type,
    confidence, 'contact' AS object_type, object_id,
    CASE WHEN type <> 'duplicate' AND current_value LIKE '%@%' THEN current_value ELSE concat('Contact ', object_id) END AS display_name,
    description, CASE type WHEN 'missing_required_field' THEN field WHEN 'invalid_email_format' THEN 'email' WHEN 'invalid_phone_format' THEN 'phone'
      WHEN 'invalid_url_format' THEN 'website' END AS property,
    CASE WHEN type <> 'duplicate' THEN current_value END AS current_value, suggested_value AS new_value,
    coalesce(reasoning, concat('Fix data quality issue: ', description)) AS reasoning, 'rule' AS detection_method,
    type <> 'duplicate' AS reversible, (type = 'duplicate' OR severity = 'high' OR confidence = 'low') AS requires_confirmation
  FROM (SELECT 'plan-quality' AS plan_id, issue_id, type, severity, object_id, description, current_value, suggested_value, confidence, field, rule_no, NULL AS reasoning FROM quality_issues
        UNION ALL SELECT 'plan-duplicates', issue_id, 'duplicate', severity, object_id, description, NULL, suggested_value, confidence, '', 0, reasoning FROM dup_issue_rows) i) a"""
QUALITY_PLAN = "SELECT {} FROM actions WHERE plan_id = 'plan-quality'"


def quality_plan(x):
    return build.build_actions(quality_issues(x), "plan-quality")


def merge_plan(x):
    return build.build_actions(duplicates.pairs_to_issues(pairs(x)), "plan-duplicates")


def both_plans(x):
    return quality_plan(x).unionByName(merge_plan(x))


def flat(actions):
    return build.flatten(actions).withColumn(
        "current_value", F.when(F.col("type") != "merge_contacts", F.col("current_value"))).select(*FLAT)


query("plan_actions", f"SELECT {', '.join(FLAT)} FROM actions")(lambda x: flat(both_plans(x)))


@query("plan_ai_reasoning", """
SELECT object_id, reasoning AS primary_reason, CASE WHEN confidence = 'medium' THEN 'Requires human review;Some ambiguity in data;Detected using AI reasoning'
  ELSE 'Uncertain recommendation;May need additional context;Detected using AI reasoning' END AS factors, confidence = 'low' AS requires_confirmation
FROM (SELECT contact_id AS object_id, reasoning, confidence FROM outside_findings WHERE contact_id IN (SELECT contact_id FROM expected_cases)) f""")
def plan_ai_reasoning(x):
    from checks.quality import outside_findings, review_cases

    found = issues.attach_findings(review_cases(x), outside_findings(x), "ai_reasoning")
    return build.build_actions(found, "plan-findings").select(
        "target.object_id", "ai_reasoning.primary_reason",
        F.array_join("ai_reasoning.confidence_factors", ";").alias("factors"), "requires_confirmation")


@query("plan_filter", f"SELECT {', '.join(FLAT)} FROM actions WHERE confidence IN ('high') AND type IN ('update_property', 'merge_contacts') AND reversible")
def plan_filter(x):
    return flat(build.filter_actions(both_plans(x), ["high"], ["rule"], ["update_property", "merge_contacts"], True))


query("plan_min_confidence", f"SELECT {', '.join(FLAT)} FROM actions WHERE confidence <> 'low'")(
    lambda x: flat(build.min_confidence(both_plans(x), "medium")))
query("plan_high_risk", f"SELECT {', '.join(FLAT)} FROM actions WHERE requires_confirmation OR NOT reversible")(
    lambda x: flat(build.high_risk(both_plans(x))))

SUMMARY = """
SELECT plan_id, count(*) AS total_actions, count(*) FILTER (confidence = 'high') AS high, count(*) FILTER (confidence = 'medium') AS medium,
  count(*) FILTER (confidence = 'low') AS low, count(*) AS rule_based, 0::BIGINT AS ai_reasoning, 0::BIGINT AS ai_exploratory, count(*) AS estimated_api_calls,
  concat_ws(',', CASE WHEN count(*) FILTER (type = 'merge_contacts') > 0 THEN concat('merge_contacts=', CAST(count(*) FILTER (type = 'merge_contacts') AS STRING)) END,
    CASE WHEN count(*) FILTER (type = 'set_marketing_status') > 0 THEN concat('set_marketing_status=', CAST(count(*) FILTER (type = 'set_marketing_status') AS STRING)) END,
    CASE WHEN count(*) FILTER (type = 'update_property') > 0 THEN concat('update_property=', CAST(count(*) FILTER (type = 'update_property') AS STRING)) END) AS by_type,
  {cost}::DOUBLE AS estimated_ai_cost_usd
FROM actions WHERE {where} GROUP BY plan_id"""


@query("plan_summary", f"""
SELECT s.*, concat('data-quality-', '2024-02-01T00-00-00.json') AS file_name,
  (SELECT concat(type, ' is the most common issue (', CAST(n AS STRING), ' occurrences)') FROM (SELECT type, count(*) AS n FROM quality_issues GROUP BY type ORDER BY n DESC, type LIMIT 1) p) AS patterns
FROM ({SUMMARY.format(cost='0.25', where="plan_id = 'plan-quality'")}) s""")
def plan_summary(x):
    found = quality_issues(x)
    insights = issues.quality_insights(issues.summarize(found, x.contacts))
    row = build.plan_row(build.build_actions(found, "plan-quality"), insights, "data-quality", AS_OF, 0.25)
    return row.select(
        "plan_id", "total_actions", "high", "medium", "low", "rule_based", "ai_reasoning", "ai_exploratory",
        "estimated_api_calls", flat_counts("by_type"), "estimated_ai_cost_usd",
        build.plan_file_name(F.col("source_audit"), F.col("created_at")).alias("file_name"),
        F.array_join("ai_context.patterns_identified", ";").alias("patterns"))


@query("plan_filtered_summary", SUMMARY.format(cost="0.25", where="confidence = 'medium'"))
def plan_filtered_summary(x):
    kept = build.filter_actions(both_plans(x), confidence=["medium"])
    return build.summarize_actions(kept, 0.25).withColumn("by_type", flat_counts("by_type"))


@query("plan_preview", """
SELECT plan_id, confidence, action_id, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY plan_id, confidence ORDER BY seq) AS rank FROM actions) r WHERE rank <= 5""")
def plan_preview(x):
    return build.preview(both_plans(x)).select("plan_id", "confidence", "action_id", "rank")


@query("plan_groups", """
SELECT plan_id, 'confidence' AS "view", confidence AS "group", action_id FROM actions
UNION ALL SELECT plan_id, 'detection_method', detection_method, action_id FROM actions""")
def plan_groups(x):
    return build.group_views(both_plans(x))


@query("plan_export_flat", f"SELECT {', '.join(FLAT)} FROM actions WHERE plan_id = 'plan-quality'")
def plan_export_flat(x):
    actions, path = quality_plan(x), scratch_path(x.spark, "export")
    store.export_plan(actions, path, "csv")
    back = store.read_export(x.spark, path, build.flatten(actions).schema)
    return back.select(*FLAT)


@query("plan_roundtrip", f"SELECT {', '.join(FLAT)} FROM actions")
def plan_roundtrip(x):
    path = scratch_path(x.spark, "plans")
    store.write_plan(both_plans(x), path, "json")
    return flat(store.read_plan(x.spark, path, fmt="json"))


@query("plan_name_parse", """
SELECT plan_id AS source_audit, strftime(executed_at, '%Y-%m-%dT%H:%M:%S.%gZ') AS created_at, count(*) AS plans FROM plan_seed GROUP BY ALL""")
def plan_name_parse(x):
    name = build.plan_file_name(F.col("plan_id"), F.col("executed_at"))
    parsed = x.plan_seed.select(build.parse_plan_name(F.concat(F.lit("/reports/plans/"), name)).alias("p"))
    return parsed.groupBy("p.source_audit", t.iso_timestamp(F.col("p.created_at")).alias("created_at")).agg(
        F.count(F.lit(1)).alias("plans"))


@query("batch_number", """
SELECT action_id, plan_id, position, (position - 1) // 100 AS batch FROM (
  SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY seq, action_id) AS position FROM plan_seed) p""")
def batch_number(x):
    return build.batch_numbers(x.plan_seed).select("action_id", "plan_id", "position", "batch")


def seed_actions(x):
    """The seed plan with dependencies as arrays."""
    one = F.array_compact(F.array("depends_on"))
    return x.plan_seed.withColumn("dependencies", one)


query("plan_missing_deps", """
SELECT action_id, depends_on AS dependency FROM plan_seed WHERE depends_on IS NOT NULL AND depends_on NOT IN (SELECT action_id FROM plan_seed)""")(
    lambda x: order.missing_dependencies(seed_actions(x)))


@query("plan_levels", """
WITH RECURSIVE placed(action_id, level) AS (
  SELECT action_id, 0 FROM plan_seed WHERE depends_on IS NULL
  UNION ALL SELECT p.action_id, l.level + 1 FROM plan_seed p JOIN placed l ON p.depends_on = l.action_id)
SELECT s.action_id, level, CASE WHEN level IS NULL THEN 'missing_dependency' ELSE 'placed' END AS status
FROM plan_seed s LEFT JOIN placed l ON l.action_id = s.action_id""")
def plan_levels(x):
    return order.dependency_levels(seed_actions(x))


EXPECTED["graph_links"] = """
SELECT concat('g', CAST(o_orderkey AS STRING)) AS action_id, dependency FROM (
  SELECT o_orderkey, unnest(list_distinct(list_filter([
    CASE WHEN o_orderkey % 4 <> 0 THEN concat('g', CAST(o_orderkey - 1 AS STRING)) END,
    CASE WHEN o_orderkey % 4 = 2 AND o_orderkey % 60 <> 2 THEN concat('g', CAST(o_orderkey - 2 AS STRING)) END,
    CASE WHEN o_orderkey % 4 = 0 AND o_orderkey % 40 <> 0 THEN concat('g', CAST(o_orderkey - 1 AS STRING)) END,
    CASE WHEN o_orderkey % 4 = 0 AND o_orderkey % 40 <> 0 THEN concat('g', CAST(o_orderkey - 2 AS STRING)) END,
    CASE WHEN o_orderkey % 331 = 330 THEN 'g-missing' END,
    CASE WHEN o_orderkey % 499 = 0 AND o_orderkey % 4 <> 3 THEN concat('g', CAST(o_orderkey + 1 AS STRING)) END], lambda d: d IS NOT NULL))) AS dependency
  FROM orders) o"""


def graph_actions(x):
    """Actions of the orders with up to three dependencies: ladders of forty, with gaps and circles."""
    k = F.col("o_orderkey")

    def on(test, step):
        return F.when(test, F.concat(F.lit("g"), (k + step).cast("string")))

    fork = (k % 4 == 0) & (k % 40 != 0)
    links = [on(k % 4 != 0, -1), on((k % 4 == 2) & (k % 60 != 2), -2), on(fork, -1), on(fork, -2),
             F.when(k % 331 == 330, F.lit("g-missing")), on((k % 499 == 0) & (k % 4 != 3), 1)]
    return x.orders.select(F.concat(F.lit("g"), k.cast("string")).alias("action_id"), F.array_distinct(F.array_compact(F.array(*links))).alias("dependencies"))


@query("plan_levels_graph", """
WITH RECURSIVE node AS (SELECT concat('g', CAST(o_orderkey AS STRING)) AS action_id FROM orders),
lost(action_id) AS (
  SELECT action_id FROM graph_links WHERE dependency NOT IN (SELECT action_id FROM node)
  UNION SELECT g.action_id FROM graph_links g JOIN lost l ON g.dependency = l.action_id),
way(action_id, dependency) AS (
  SELECT action_id, dependency FROM graph_links WHERE dependency IN (SELECT action_id FROM node)
  UNION SELECT w.action_id, g.dependency FROM way w JOIN graph_links g ON g.action_id = w.dependency WHERE g.dependency IN (SELECT action_id FROM node)),
ring AS (SELECT DISTINCT action_id FROM way WHERE action_id = dependency),
bad AS (SELECT action_id FROM lost UNION SELECT action_id FROM ring UNION SELECT w.action_id FROM way w JOIN ring r ON r.action_id = w.dependency),
deep(action_id, level) AS (
  SELECT action_id, 0 FROM node WHERE action_id NOT IN (SELECT action_id FROM graph_links)
  UNION SELECT g.action_id, d.level + 1 FROM graph_links g JOIN deep d ON g.dependency = d.action_id WHERE g.action_id NOT IN (SELECT action_id FROM bad))
SELECT n.action_id, CAST(max(level) AS INTEGER) AS level, CASE WHEN n.action_id IN (SELECT action_id FROM lost) THEN 'missing_dependency'
  WHEN n.action_id IN (SELECT action_id FROM bad) THEN 'cyclic' ELSE 'placed' END AS status
FROM node n LEFT JOIN deep d ON d.action_id = n.action_id GROUP BY n.action_id""")
def plan_levels_graph(x):
    return order.dependency_levels(graph_actions(x))


@query("plan_conflicts", """
SELECT plan_id, 'contact' AS object_type, object_id, property, count(*) AS actions, 'same_property' AS kind FROM actions WHERE property IS NOT NULL GROUP BY plan_id, object_id, property HAVING count(*) > 1
UNION ALL
SELECT plan_id, 'contact', object_id, NULL, count(*), 'target_removed' FROM actions a WHERE EXISTS (SELECT 1 FROM actions m WHERE m.plan_id = a.plan_id AND m.type = 'merge_contacts' AND m.new_value = a.object_id)
GROUP BY plan_id, object_id""")
def plan_conflicts(x):
    return build.conflicts(both_plans(x))


@query("plan_batches", """
SELECT action_id, CASE WHEN plan_id = 'plan-quality' THEN 1 ELSE 2 END AS batch FROM actions""")
def plan_batches(x):
    module = F.when(F.col("plan_id") == "plan-quality", "data-quality").otherwise("duplicates")
    return build.audit_batches(both_plans(x).withColumn("source_audit", module)).select("action_id", "batch")


@query("plan_three_batches", """
SELECT action_id, CASE WHEN type = 'set_marketing_status' THEN 3 WHEN plan_id = 'plan-quality' THEN 1 ELSE 2 END AS batch FROM actions""")
def plan_three_batches(x):
    """The actions of three audits run together: corrections, then merges, then marketing changes."""
    module = F.when(F.col("type") == "set_marketing_status", "marketing").when(F.col("plan_id") == "plan-quality", "data-quality").otherwise("duplicates")
    return build.audit_batches(both_plans(x).withColumn("source_audit", module)).select("action_id", "batch")


@query("plan_methods", """
SELECT 'kept' AS part, object_id, detection_method, confidence, reasoning FROM actions WHERE plan_id = 'plan-quality' AND confidence = 'medium'
UNION ALL SELECT 'kept', contact_id, 'ai_reasoning', confidence, reasoning FROM outside_findings WHERE confidence = 'medium' AND contact_id IN (SELECT contact_id FROM expected_cases WHERE needs_reasoning)
UNION ALL SELECT 'ai', contact_id, m, confidence, reasoning FROM outside_findings, (SELECT unnest(['ai_reasoning', 'ai_exploratory']) AS m) k
  WHERE contact_id IN (SELECT contact_id FROM expected_cases WHERE CASE m WHEN 'ai_reasoning' THEN needs_reasoning ELSE needs_exploration END)""")
def plan_methods(x):
    """A plan of all three detection methods: what rules and reasoning found at medium confidence, and all of the models."""
    from checks.quality import outside_findings, review_cases

    cases = review_cases(x)
    found = [issues.attach_findings(cases.filter(need), outside_findings(x), method) for need, method in (
        ("needs_reasoning", "ai_reasoning"), ("needs_exploration", "ai_exploratory"))]
    plan = quality_plan(x)
    for part in found:
        plan = plan.unionByName(build.build_actions(part, "plan-findings"))
    shown = ["target.object_id", "detection_method", "confidence", "reasoning"]
    kept = build.filter_actions(plan, ["medium"], ["rule", "ai_reasoning"])
    return kept.select(F.lit("kept").alias("part"), *shown).unionByName(build.ai_made(plan).select(F.lit("ai").alias("part"), *shown))


EXPECTED["seed_stops"] = """
SELECT p.*, f.first_seq, CASE WHEN f.first_seq IS NOT NULL THEN concat('a', CAST(f.first_seq AS STRING)) END AS resume_from
FROM plan_seed p LEFT JOIN (SELECT plan_id, min(seq) AS first_seq FROM plan_seed WHERE status = 'failed' GROUP BY plan_id) f ON f.plan_id = p.plan_id"""


@query("exec_stop_on_error", "SELECT plan_id, action_id, seq, status, resume_from FROM seed_stops WHERE first_seq IS NULL OR seq <= first_seq")
def exec_stop_on_error(x):
    kept = execution.stop_on_error(x.plan_seed)
    return kept.select("plan_id", "action_id", "seq", "status", "resume_from")


@query("exec_resume", "SELECT plan_id, action_id, seq FROM seed_stops WHERE seq >= first_seq")
def exec_resume(x):
    stopped = execution.stop_on_error(x.plan_seed)
    stops = stopped.groupBy("plan_id").agg(F.max("resume_from").alias("resume_from")).dropna()
    return build.resume(x.plan_seed, stops).select("plan_id", "action_id", "seq")


# one run per customer segment of actions: the seed rows by plan
RUN_SQL = """
SELECT execution_id, count(*) FILTER (status = 'success') AS successful, count(*) FILTER (status = 'failed') AS failed, 0::BIGINT AS skipped,
  count(*) FILTER (status = 'success' AND NOT is_reversible) AS non_reversible, max(resume_from) AS resume_from,
  CASE WHEN max(resume_from) IS NOT NULL THEN 'failed' WHEN count(*) FILTER (status = 'failed') = 0 THEN 'completed' WHEN count(*) FILTER (status = 'success') > 0 THEN 'partially_completed' ELSE 'failed' END AS status
FROM seed_log GROUP BY execution_id"""
# every second run stops at its first failure
EXPECTED["seed_log"] = """
SELECT p.*, concat('run-', p.object_id) AS execution_id, CASE WHEN stops AND first_seq IS NOT NULL THEN concat('a', CAST(first_seq AS STRING)) END AS resume_from
FROM (SELECT *, CAST(object_id AS BIGINT) % 2 = 0 AS stops FROM plan_seed) p
LEFT JOIN (SELECT object_id, min(seq) AS first_seq FROM plan_seed WHERE status = 'failed' GROUP BY object_id) f ON f.object_id = p.object_id
WHERE NOT stops OR first_seq IS NULL OR p.seq <= first_seq"""


def seed_log(x):
    image = F.struct(F.lit("contact").alias("object_type"), "object_id", F.lit("phone").alias("property"),
                     F.lit("0").alias("original_value"))
    rows = x.plan_seed.withColumn("execution_id", F.concat(F.lit("run-"), "object_id"))
    stops = F.col("object_id").cast("bigint") % 2 == 0
    stopped = execution.stop_on_error(rows.filter(stops), plan="execution_id")
    rows = stopped.unionByName(rows.filter(~stops).withColumn("resume_from", F.lit(None).cast("string")))
    return rows.select(
        "*", F.when(F.col("is_reversible") & (F.col("seq") % 3 != 0), image).alias("rollback_data"))


query("exec_results", RUN_SQL)(lambda x: execution.run_results(seed_log(x)))


@query("can_rollback", """
SELECT execution_id, back > 0 AS can_rollback, back AS reversible_count, gone AS non_reversible_count,
  CASE WHEN back = 0 AND gone > 0 THEN 'All actions are non-reversible' END AS reason
FROM (SELECT execution_id, count(*) FILTER (status = 'success' AND is_reversible AND seq % 3 <> 0) AS back,
  count(*) FILTER (status = 'success' AND NOT is_reversible) AS gone FROM seed_log GROUP BY execution_id) c""")
def can_rollback(x):
    return execution.can_roll_back(seed_log(x))


RUNS = """
SELECT execution_id, strftime(max(executed_at), '%Y-%m-%dT%H:%M:%S.%gZ') AS executed_at, count(*) AS actions FROM seed_log GROUP BY execution_id"""


def runs(x):
    return seed_log(x).groupBy("execution_id").agg(
        F.max("executed_at").alias("executed_at"), F.count(F.lit(1)).alias("actions"))


def iso_runs(df):
    return df.withColumn("executed_at", t.iso_timestamp(F.col("executed_at")))


query("list_executions", RUNS)(lambda x: iso_runs(store.list_executions(runs(x))))
query("retention_cleanup", RUNS + " HAVING max(executed_at) >= TIMESTAMP '1999-12-02 00:00:00'")(
    lambda x: iso_runs(store.retained(runs(x), "2000-01-01 00:00:00", 30)))

# updates of the whole table: the quality plan, with the field of a spacing finding inferred
EXPECTED["inferred"] = """
SELECT *, coalesce(property, CASE WHEN description LIKE 'First name%' THEN 'firstname' WHEN description LIKE 'Last name%' THEN 'lastname'
  WHEN description LIKE 'Company%' THEN 'company' END) AS prop FROM actions WHERE plan_id = 'plan-quality'"""
CHANGED = ("email", "phone", "website", "firstname", "lastname", "company")
CHANGEABLE = {"contact": ("hs_marketable_status", *CHANGED)}


def _changed(p: str) -> str:
    return (f"CASE WHEN EXISTS (SELECT 1 FROM inferred i WHERE i.object_id = c.id AND i.prop = '{p}' AND type = 'update_property') THEN "
            f"(SELECT coalesce(max_by(coalesce(new_value, ''), seq), '') FROM inferred i WHERE i.object_id = c.id AND i.prop = '{p}' AND type = 'update_property') ELSE {p} END AS {p}")


def stored(x, actions):
    """The plan as a run reads it: from where it was saved."""
    path = scratch_path(x.spark, "plan")
    store.write_plan(actions, path)
    return store.read_plan(x.spark, path)


def inferred_plan(x):
    return build.build_actions(quality_issues(x), "plan-quality", infer_property=True)


@query("apply_updates", f"SELECT id, {', '.join(_changed(p) for p in CHANGED)} FROM contacts c")
def apply_updates(x):
    changes = apply.property_changes(inferred_plan(x))
    return apply.apply_changes(x.contacts.select("id", *CHANGED), changes, CHANGED)


@query("apply_marketing", """
SELECT id, CASE WHEN id IN (SELECT object_id FROM actions WHERE type = 'set_marketing_status') THEN 'false' ELSE hs_marketable_status END AS hs_marketable_status FROM contacts""")
def apply_marketing(x):
    changes = apply.marketing_changes(quality_plan(x))
    return apply.apply_changes(x.contacts.select("id", "hs_marketable_status"), changes)


@query("apply_deletes", "SELECT id, hard_bounced = 'true' AS archived FROM contacts")
def apply_deletes(x):
    gone = x.contacts.filter("hard_bounced = 'true'").select("id")
    return apply.apply_deletes(x.contacts.select("id"), gone)


EXPECTED["merge_first"] = """
SELECT new_value AS id, min_by(object_id, seq) AS survivor, min(seq) AS seq FROM actions WHERE type = 'merge_contacts' GROUP BY new_value"""
EXPECTED["merge_moves"] = """
WITH RECURSIVE hop(id, survivor, seq) AS (
  SELECT id, survivor, seq FROM merge_first
  UNION ALL SELECT h.id, m.survivor, h.seq FROM hop h JOIN merge_first m ON m.id = h.survivor)
SELECT id, survivor, seq FROM hop WHERE survivor NOT IN (SELECT id FROM merge_first)"""
MERGED = ("email", "phone", "jobtitle", "website")


def _filled(p: str) -> str:
    return (f"CASE WHEN {p} <> '' THEN {p} ELSE coalesce((SELECT min_by(s.{p}, m.seq) FROM merge_moves m JOIN contacts s ON s.id = m.id "
            f"WHERE m.survivor = c.id AND s.{p} <> ''), {p}) END AS {p}")


@query("apply_merges", f"SELECT id, {', '.join(_filled(p) for p in MERGED)} FROM contacts c WHERE id NOT IN (SELECT id FROM merge_moves)")
def apply_merges(x):
    moves = apply.survivors(apply.merge_actions(merge_plan(x)))
    return apply.apply_merges(x.contacts.select("id", *MERGED), moves, MERGED)


RECENT = ("email", "phone", "jobtitle", "website")


def _latest(p: str) -> str:
    return f"coalesce(arg_max(s.{p}, (s.lastmodifieddate, s.id)) FILTER (s.{p} <> '' AND s.lastmodifieddate IS NOT NULL), arg_max(s.{p}, s.id) FILTER (s.{p} <> '')) AS {p}"


@query("merge_recent", f"""
SELECT c.id, {', '.join(f"coalesce(v.{p}, c.{p}) AS {p}" for p in RECENT)} FROM contacts c
LEFT JOIN (SELECT survivor, {', '.join(map(_latest, RECENT))} FROM (
    SELECT survivor, id AS member FROM merge_moves UNION SELECT survivor, survivor FROM merge_moves) m JOIN contacts s ON s.id = m.member GROUP BY survivor) v ON v.survivor = c.id
WHERE c.id NOT IN (SELECT id FROM merge_moves)""")
def merge_recent(x):
    """Merges that keep the value of the contact that was modified last."""
    moves = apply.survivors(apply.merge_actions(merge_plan(x)))
    return apply.apply_merges(x.contacts.select("id", *RECENT, "lastmodifieddate"), moves, RECENT, policy="recent").drop("lastmodifieddate")


@query("merge_side_tables", """
SELECT DISTINCT 'edge' AS kind, coalesce(survivor, from_id) AS contact_id, to_id AS other_id FROM edges LEFT JOIN merge_moves m ON m.id = from_id
UNION ALL SELECT DISTINCT 'list', coalesce(survivor, contact_id), list_id FROM members LEFT JOIN merge_moves m ON m.id = contact_id""")
def merge_side_tables(x):
    moves = apply.survivors(apply.merge_actions(merge_plan(x)))
    edges = apply.repoint(x.edges.select("from_id", "to_id"), "from_id", moves)
    members = apply.repoint(x.members, "contact_id", moves)
    return edges.select(F.lit("edge").alias("kind"), F.col("from_id").alias("contact_id"), F.col("to_id").alias("other_id")).unionByName(
        members.select(F.lit("list").alias("kind"), "contact_id", F.col("list_id").alias("other_id")))


@query("apply_list_changes", """
SELECT list_id, contact_id FROM members WHERE contact_id NOT IN (SELECT id FROM contacts WHERE hard_bounced = 'true')
UNION SELECT 'marketable', id FROM contacts WHERE hs_marketable_status = 'true'""")
def apply_list_changes(x):
    bounced = x.contacts.filter("hard_bounced = 'true'").select(F.col("id").alias("contact_id"))
    remove = x.members.join(bounced, "contact_id", "left_semi")
    add = x.contacts.filter("hs_marketable_status = 'true'").select(
        F.lit("marketable").alias("list_id"), F.col("id").alias("contact_id"))
    return apply.apply_list_changes(x.members, add, remove)


@query("apply_associations", """
SELECT DISTINCT from_type, from_id, to_type, to_id, assoc_type FROM (
  SELECT from_type, from_id, to_type, to_id, coalesce(assoc_type, to_type) AS assoc_type FROM edges
  WHERE NOT (from_id IN (SELECT id FROM contacts WHERE hard_bounced = 'true') AND coalesce(assoc_type, to_type) = 'contact_to_company')
  UNION ALL SELECT 'contact', c.id, 'company', o.id, 'contact_to_company' FROM contacts c JOIN companies o ON o.domain = lower(split_part(email, '@', 2)) WHERE email LIKE '%@%') e""")
def apply_associations(x):
    from checks.audits import by_domain

    # joined and grouped once, then read wherever it is needed
    edges, _ = written(x.edges, "edges")
    bounced = x.contacts.filter("hard_bounced = 'true'").select(F.col("id").alias("from_id"))
    remove = edges.join(bounced, "from_id", "left_semi")
    create = by_domain(x).select(
        F.lit("contact").alias("from_type"), F.col("id").alias("from_id"), F.lit("company").alias("to_type"),
        F.col("company_id").alias("to_id"))
    return apply.apply_associations(edges, create, remove)


@query("rollback_capture", f"""
SELECT i.action_id, CASE WHEN type = 'set_marketing_status' THEN 'hs_marketable_status' ELSE prop END AS property,
  CASE WHEN type = 'set_marketing_status' THEN hs_marketable_status {' '.join(f"WHEN prop = '{p}' THEN {p}" for p in CHANGED)} END AS original_value
FROM inferred i JOIN contacts c ON c.id = i.object_id WHERE type = 'set_marketing_status' OR prop IS NOT NULL""")
def rollback_capture(x):
    images = rollback.before_images(stored(x, inferred_plan(x)), {"contact": x.contacts}, CHANGEABLE)
    return images.select("action_id", "rollback_data.property", "rollback_data.original_value")


def quality_run(x):
    plan = stored(x, quality_plan(x))
    images = rollback.before_images(plan, {"contact": x.contacts}, CHANGEABLE)
    return execution.run_actions(plan, images, "run-1", AS_OF, continue_on_error=True, tables={"contact": x.contacts.filter("hard_bounced = 'false'")})


@query("execution_log", """
SELECT action_id, CASE WHEN error IS NULL THEN 'success' ELSE 'failed' END AS status, error, is_reversible FROM (
  SELECT action_id, CASE WHEN type = 'update_property' AND property IS NULL THEN 'Missing property name'
    WHEN object_id IN (SELECT id FROM contacts WHERE hard_bounced = 'true') THEN 'Target not found' END AS error, reversible AS is_reversible
  FROM actions WHERE plan_id = 'plan-quality') r""")
def execution_log(x):
    """A run after the hard-bounced contacts have been deleted."""
    path = scratch_path(x.spark, "executions")
    store.write_execution(quality_run(x).withColumn("started_at", F.lit(AS_OF).cast("timestamp")), path)
    return store.read_execution(x.spark, path).select("action_id", "status", "error", "is_reversible")


UNDONE = ("hs_marketable_status", *CHANGED)


def _undone(p: str) -> str:
    touched = (f"type = 'update_property' AND prop = '{p}'" if p != "hs_marketable_status" else "type = 'set_marketing_status'")
    return f"CASE WHEN {p} IS NULL AND id IN (SELECT object_id FROM inferred WHERE {touched}) THEN '' ELSE {p} END AS {p}"


@query("rollback_apply", f"SELECT id, {', '.join(_undone(p) for p in UNDONE)} FROM contacts")
def rollback_apply(x):
    """Apply a plan and undo it: only nulls come back as empty text."""
    plan = stored(x, inferred_plan(x))
    before = x.contacts.select("id", *UNDONE)
    images = rollback.before_images(plan, {"contact": before}, CHANGEABLE)
    log = execution.run_actions(plan, images, "run-1", AS_OF, continue_on_error=True)
    changes = apply.property_changes(plan).unionByName(apply.marketing_changes(plan))
    return rollback.roll_back(apply.apply_changes(before, changes), log)


@query("rollback_counts", """
SELECT execution_id, count(*) FILTER (status = 'success' AND is_reversible AND seq % 3 <> 0) AS rolled_back,
  count(*) FILTER (status = 'success' AND is_reversible AND seq % 3 = 0) AS failed, count(*) FILTER (status = 'success' AND NOT is_reversible) AS non_reversible
FROM seed_log GROUP BY execution_id""")
def rollback_counts(x):
    return rollback.rollback_results(seed_log(x))


@query("rollback_errors", "SELECT action_id, 'No rollback data available' AS error FROM seed_log WHERE status = 'success' AND is_reversible AND seq % 3 = 0")
def rollback_errors(x):
    return rollback.rollback_errors(seed_log(x))


@query("audit_sink", "SELECT issue_id, module, type, object_id, description, current_value, suggested_value FROM quality_issues")
def audit_sink(x):
    path = scratch_path(x.spark, "audit")
    found = quality_issues(x)
    store.write_audit(found, path)
    back = x.spark.read.schema(found.schema).json(path)
    return back.select("issue_id", "module", "type", "object_id", "description", "current_value", "suggested_value")


@query("pair_key", "SELECT id_1, id_2, concat(least(id_1, id_2), '-', greatest(id_1, id_2)) AS key FROM dup_links")
def pair_key(x):
    found = pairs(x)
    return found.select("id_1", "id_2", t.pair_key(F.col("id_2"), F.col("id_1")).alias("key"))


EXPECTED["asked_updates"] = "SELECT CASE WHEN CAST(id AS BIGINT) % 10 = 0 THEN concat('new-', contact_id) ELSE contact_id END AS id, id AS value FROM deals"


@query("batch_update", """
SELECT 'table' AS part, c.id, coalesce(u.value, phone) AS value, NULL AS changes, NULL AS status FROM contacts c LEFT JOIN (SELECT id, max(value) AS value FROM asked_updates GROUP BY id) u ON u.id = c.id
UNION ALL SELECT 'outcome', id, NULL, count(*), CASE WHEN id IN (SELECT id FROM contacts) THEN 'success' ELSE 'error' END FROM asked_updates GROUP BY id""")
def batch_update(x):
    unknown = F.col("id").cast("bigint") % 10 == 0
    changes = x.deals.select(
        F.when(unknown, F.concat(F.lit("new-"), "contact_id")).otherwise(F.col("contact_id")).alias("id"), F.lit("phone").alias("property"),
        F.col("id").alias("value"), F.col("id").alias("seq"))
    table, outcome = apply.batch_update(x.contacts.select("id", "phone"), changes)
    none = F.lit(None)
    return table.select(F.lit("table").alias("part"), "id", F.col("phone").alias("value"), none.cast("bigint").alias("changes"), none.cast("string").alias("status")).unionByName(
        outcome.select(F.lit("outcome").alias("part"), "id", none.cast("string").alias("value"), "changes", "status"))


@query("bulk_update", """
SELECT id, CASE WHEN lifecyclestage = 'lead' AND lastmodifieddate < TIMESTAMP '2001-01-01 00:00:00' THEN 'subscriber' ELSE lifecyclestage END AS lifecyclestage FROM contacts""")
def bulk_update(x):
    cold = (F.col("lifecyclestage") == "lead") & (F.col("lastmodifieddate") < F.lit("2001-01-01").cast("timestamp"))
    return apply.bulk_update(x.contacts, cold, {"lifecyclestage": "subscriber"}).select("id", "lifecyclestage")


@query("bulk_preview", "SELECT count(*) AS matching, count(*) AS changing FROM contacts WHERE lifecyclestage = 'lead' AND lastmodifieddate < TIMESTAMP '2001-01-01 00:00:00'")
def bulk_preview(x):
    cold = (F.col("lifecyclestage") == "lead") & (F.col("lastmodifieddate") < F.lit("2001-01-01").cast("timestamp"))
    return apply.preview_update(x.contacts, cold, {"lifecyclestage": "subscriber"})
