"""Exact duplicate detection on blocking keys.

A contact belongs to at most one group per key type, and two contacts are a
pair when they share a group. A group of n members stands for n(n-1)/2 pairs; it
is listed in one way whatever its size:

* one link per member, to the member with the smallest id, which connects the
  group, with the size of the group beside it;
* ``pair_counts`` counts every pair of every group exactly, from group sizes.

A link found by several key types belongs to the first one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rowmender.config import DuplicateSettings
from rowmender.functions import text as t
from rowmender.operators.issues import issue_id, row_total
from rowmender.operators.skew import hot_counted, salted_join, spread_rows
from rowmender.schemas import ISSUE_COLUMNS, require_columns
from rowmender.session import cut_lineage

MODULE = "duplicates"

KEY_PROPERTIES = ("email", "firstname", "lastname", "phone", "mobilephone", "company")
TIER_NAMES = {1: "exact_email", 2: "exact_phone_company", 3: "exact_name_company"}

# fixed values: explanation per match type
REASONS = {
    "exact_email": "Contacts share the same email address (99% confidence duplicate)",
    "exact_phone_company": "Contacts have the same phone number and company (95% confidence duplicate)",
    "exact_name_company": "Contacts have the same name and company (95% confidence duplicate)",
}


def enabled_tiers(settings: DuplicateSettings) -> list[int]:
    switches = (settings.exact_email_match, settings.exact_phone_and_company_match,
                settings.exact_name_and_company_match)
    return [n for n, on in enumerate(switches, 1) if on]


def match_keys(contacts: DataFrame, country: str = "US") -> DataFrame:
    """Per contact: the three blocking keys and what the match factors need."""
    df = require_columns(contacts, KEY_PROPERTIES)
    raw_phone = t.first_present("phone", "mobilephone")
    full = t.trim_spaces(F.concat(
        F.coalesce("firstname", F.lit("")), F.lit(" "), F.coalesce("lastname", F.lit(""))))
    df = df.select(
        "id",
        t.email_key("email").alias("email_key"),
        F.when(raw_phone.isNotNull(), t.normalize_phone(raw_phone, country)).alias("phone"),
        t.nonempty(t.normalize_name("company")).alias("company"),
        F.concat(t.normalize_name("firstname"), F.lit(" "), t.normalize_name("lastname")).alias("_both"),
        (t.present("firstname") & t.present("lastname")).alias("_named"),
        full.alias("full_name"),
    )
    named = F.col("_named") & (t.trim_spaces("_both") != "")
    return df.select(
        "id", "email_key", "phone", "company", "full_name",
        t.normalize_name("full_name").alias("name"),
        F.when(t.present("phone"), F.concat("phone", F.lit("|"), "company")).alias("phone_company_key"),
        F.when(named, F.concat("_both", F.lit("|"), "company")).alias("name_company_key"),
    )


def group_members(keys: DataFrame, tiers: list[int]) -> DataFrame:
    """One row per contact and key: (tier, key, id, member)."""
    columns = {1: "email_key", 2: "phone_company_key", 3: "name_company_key"}
    entries = [
        F.when(F.col(columns[n]).isNotNull(), F.struct(F.lit(n).alias("tier"), F.col(columns[n]).alias("key")))
        for n in tiers
    ]
    profile = F.struct("id", "email_key", "phone", "company", "full_name", "name", "phone_company_key")
    return keys.select("id", profile.alias("member"), F.inline(F.array_compact(F.array(*entries))))


def shared_groups(contacts: DataFrame, settings: DuplicateSettings = DuplicateSettings()) -> DataFrame:
    """Every contact of every group of two or more, one row per key: the whole of the pairs, in linear size."""
    rows = group_members(match_keys(contacts, settings.default_country_code), enabled_tiers(settings)).select(
        "tier", "key", "id")
    counts = cut_lineage(rows.groupBy("tier", "key").agg(F.count(F.lit(1)).alias("group_size")).filter("group_size > 1"))
    hot = hot_counted(counts, ["tier", "key"], "group_size")
    names = F.create_map(*[F.lit(x) for item in TIER_NAMES.items() for x in item])
    return salted_join(rows, counts, ["tier", "key"], "inner", ["id"], hot).select(
        names[F.col("tier")].alias("match_type"), "key", "id", "group_size")


def _factors(a: Column, b: Column, tier: Column) -> dict[str, Column]:
    def same(field: str) -> Column:
        return F.coalesce(a[field] == b[field], F.lit(False))

    named = (a["full_name"] != "") & (b["full_name"] != "")
    score = F.when(tier == 3, 1.0).when(named, t.similarity(a["name"], b["name"])).otherwise(0.0)
    return {
        "email_match": same("email_key"),
        "phone_match": same("phone"),
        "company_match": same("company"),
        "name_similarity": score,
    }


def exact_pairs(contacts: DataFrame, settings: DuplicateSettings = DuplicateSettings(),
                tiers: list[int] | None = None) -> DataFrame:
    """A link from the smallest id of each group to every other member; each link once, ``id_1 < id_2``."""
    tiers = enabled_tiers(settings) if tiers is None else tiers
    return links_to_heads(group_members(match_keys(contacts, settings.default_country_code), tiers))


def links_to_heads(members: DataFrame) -> DataFrame:
    """One aggregation finds the head and the size of every group, joined back to its members."""
    keys = ["tier", "key"]
    heads = cut_lineage(members.groupBy(*keys).agg(
        F.min("member").alias("a"), F.count(F.lit(1)).alias("group_size")).filter(F.col("group_size") > 1))
    hot = hot_counted(heads, keys, "group_size")
    found = salted_join(members, heads, keys, "inner", ["id"], hot).filter(F.col("id") != F.col("a.id"))
    # the same two contacts may be linked by up to three key types
    rest = [c for c in found.columns if c not in ("id", "key", "tier")]
    links = found.groupBy(F.col("a.id").alias("id_1"), F.col("id").alias("id_2")).agg(
        F.min(F.struct("tier", *[F.col("member").alias("b") if c == "member" else F.col(c) for c in rest])).alias("x"))
    tier, a, b = F.col("x.tier"), F.col("x.a"), F.col("x.b")
    names = F.create_map(*[F.lit(x) for item in TIER_NAMES.items() for x in item])
    return links.select(
        "id_1", "id_2", names[tier].alias("match_type"), F.lit("high").alias("confidence"),
        *[c.alias(n) for n, c in _factors(a, b, tier).items()],
        a["full_name"].alias("name_1"), b["full_name"].alias("name_2"), F.col("x.group_size").alias("group_size"),
    )


def pairs_in(n: Column) -> Column:
    """n(n-1)/2 as a decimal: a group of a few billion has more pairs than a bigint holds."""
    half = F.shiftright(n, 1)
    return half.cast("decimal(19,0)") * (n - 1 + n.bitwiseAND(F.lit(1))).cast("decimal(19,0)")


def combined_keys(keys: DataFrame, settings: DuplicateSettings, keep: list[str] | None = None) -> DataFrame:
    """Each contact's single and combined keys with the sign of inclusion-exclusion.

    Rows of (part, match_type, sign, k0, k1, k2); pairs of a type are the signed pairs of its parts.
    """
    tiers = enabled_tiers(settings)
    e, p, n = F.col("email_key"), F.col("phone_company_key"), F.col("name_company_key")

    parts: list[tuple[str, int, list[Column]]] = []
    if 1 in tiers:
        parts.append((TIER_NAMES[1], 1, [e]))
    if 2 in tiers:
        parts.append((TIER_NAMES[2], 1, [p]))
        if 1 in tiers:
            parts.append((TIER_NAMES[2], -1, [p, e]))
    if 3 in tiers:
        parts.append((TIER_NAMES[3], 1, [n]))
        if 1 in tiers:
            parts.append((TIER_NAMES[3], -1, [n, e]))
        if 2 in tiers:
            parts.append((TIER_NAMES[3], -1, [n, p]))
        if 1 in tiers and 2 in tiers:
            parts.append((TIER_NAMES[3], 1, [n, p, e]))

    def entry(part: int, name: str, sign: int, used: list[Column]) -> Column:
        whole = F.lit(True)
        for k in used:
            whole = whole & k.isNotNull()
        padded = [*used, *[F.lit(None).cast("string")] * (3 - len(used))]
        return F.when(whole, F.struct(
            F.lit(part).alias("part"), F.lit(name).alias("match_type"), F.lit(sign).alias("sign"),
            *[k.alias(f"k{i}") for i, k in enumerate(padded)]))

    entries = [entry(i, *p) for i, p in enumerate(parts)]
    return keys.select(*(keep or []), F.inline(F.array_compact(F.array(*entries))))


def pair_counts(contacts: DataFrame, settings: DuplicateSettings = DuplicateSettings()) -> DataFrame:
    """Exact number of pairs per match type, without listing any pair.

    A group of n holds n(n-1)/2 pairs. Pairs that an earlier key type already
    has are the pairs of the combined key, so they are subtracted.
    """
    # up to seven keys of each contact are counted
    keys = match_keys(spread_rows(contacts), settings.default_country_code)
    sizes = (
        combined_keys(keys, settings)
        .groupBy("part", "match_type", "sign", "k0", "k1", "k2").agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > 1)
    )
    return (
        sizes.groupBy("match_type")
        .agg(F.sum(F.col("sign") * pairs_in(F.col("n"))).cast("decimal(38,0)").alias("pairs"))
        .filter(F.col("pairs") > 0)
    )


def pair_severity() -> Column:
    """Exact matches are high, then by confidence."""
    return (
        F.when(F.col("match_type").startswith("exact"), "high")
        .when(F.col("confidence") == "medium", "medium")
        .otherwise("low")
    )


def pair_description() -> Column:
    score = F.col("name_similarity")
    reasons = F.array_compact(F.array(
        F.when(F.col("email_match"), F.lit("same email")),
        F.when(F.col("phone_match"), F.lit("same phone")),
        F.when(F.col("company_match"), F.lit("same company")),
        F.when(score >= 0.9, F.lit("nearly identical names")).when(score >= 0.7, F.lit("similar names")),
    ))

    def shown(c: str) -> Column:
        return F.coalesce(t.nonempty(c), F.lit("Unknown"))

    return F.concat(
        F.lit('Potential duplicate: "'), shown("name_1"), F.lit('" and "'), shown("name_2"), F.lit('" have '),
        F.array_join(reasons, ", "))


def pairs_to_issues(pairs: DataFrame) -> DataFrame:
    """One issue per pair: merge the second contact into the first."""
    reasons = F.create_map(*[F.lit(x) for item in REASONS.items() for x in item])
    current = F.to_json(F.struct(
        F.col("id_1").alias("primaryId"), F.col("id_2").alias("secondaryId"), "match_type",
        F.struct("email_match", "phone_match", "company_match", "name_similarity").alias("match_factors")))
    return pairs.select(
        issue_id(F.lit(MODULE), F.lit("duplicate"), F.col("id_1"), F.col("id_2")).alias("issue_id"),
        F.lit(MODULE).alias("module"), F.lit("duplicate").alias("type"), pair_severity().alias("severity"),
        F.lit("contact").alias("object_type"), F.col("id_1").alias("object_id"),
        pair_description().alias("description"), current.alias("current_value"),
        F.col("id_2").alias("suggested_value"), "confidence", F.lit("rule").alias("detection_method"),
        F.coalesce(F.try_element_at(reasons, F.col("match_type")),
                   F.lit("Duplicate detected based on matching criteria")).alias("reasoning"),
        F.lit("").alias("field"), F.lit(0).alias("rule_no"),
    ).select(*ISSUE_COLUMNS)


def duplicate_summary(counts: DataFrame, contacts: DataFrame, ai_cost: float = 0.0) -> DataFrame:
    """Audit summary from the exact pair counts; every exact pair is a high-severity rule finding."""
    zero = F.lit(0).cast("bigint")
    total = counts.agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("issues_found"))
    n = F.col("issues_found")
    by_type = F.map_filter(F.create_map(F.lit("duplicate"), n), lambda _, v: v > 0)
    return total.select(
        row_total(contacts).alias("total_records"), "issues_found",
        zero.alias("low"), zero.alias("medium"), n.alias("high"), zero.alias("critical"),
        n.alias("rule_based"), zero.alias("ai_reasoning"), zero.alias("ai_exploratory"),
        by_type.alias("by_type"), F.lit(float(ai_cost)).alias("ai_cost_usd"),
    )


def email_match_count(contacts: DataFrame, settings: DuplicateSettings = DuplicateSettings(),
                      counts: DataFrame | None = None) -> DataFrame:
    """Pairs with equal addresses, from the counts of the keys that include the address.

    ``counts`` is the outcome of :func:`pair_counts` for the same contacts, if there is one.
    """
    if settings.exact_email_match:
        counts = pair_counts(contacts, settings) if counts is None else counts
        counts = counts.filter(F.col("match_type") == TIER_NAMES[1])
        return counts.agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("email_matches"))
    # pairs of the other key types that also share the address: those of (key, address)
    keys = match_keys(spread_rows(contacts), settings.default_country_code).filter(F.col("email_key").isNotNull())
    tiers = enabled_tiers(settings)
    p, n = F.col("phone_company_key"), F.col("name_company_key")
    parts = [(1, p, F.lit(""))] if 2 in tiers else []
    parts += [(1, n, F.lit(""))] if 3 in tiers else []
    parts += [(-1, n, p)] if tiers == [2, 3] else []
    if not parts:
        return keys.limit(0).agg(F.count(F.lit(1)).alias("email_matches"))
    rows = F.array_compact(F.array(*[
        F.when(k.isNotNull() & k2.isNotNull(), F.struct(
            F.lit(i).alias("part"), F.lit(s).alias("sign"), k.alias("key"), k2.alias("key2")))
        for i, (s, k, k2) in enumerate(parts)]))
    sizes = keys.select("email_key", F.inline(rows)).groupBy("part", "sign", "key", "key2", "email_key").count()
    total = F.sum(F.col("sign") * pairs_in(F.col("count"))).cast("decimal(38,0)")
    return sizes.agg(F.coalesce(total, F.lit(0)).alias("email_matches"))


def duplicate_insights(counts: DataFrame, email_matches: DataFrame, contacts: DataFrame,
                       used_ai: bool = False) -> DataFrame:
    """Sentences derived from the exact pair counts."""
    total = counts.agg(
        F.coalesce(F.sum("pairs"), F.lit(0)).alias("n"),
        F.min(F.struct((-F.col("pairs")).alias("neg"), "match_type")).alias("top"),
    ).select("n", "top", email_matches.scalar().alias("emails"), row_total(contacts).alias("records"))
    n, emails = F.col("n"), F.col("emails")
    how = "three-tier analysis (rule-based + AI)" if used_ai else "rule-based exact matching"
    text = F.concat(F.lit("Found "), n.cast("string"), F.lit(f" duplicate pairs using {how}"))
    return total.select(
        F.when(F.col("records") == 0, "No contacts found for duplicate detection").otherwise(text).alias("summary"),
        F.array_compact(F.array(
            F.when(F.col("top").isNotNull(), F.concat(
                F.lit("Most common duplicate type: "), F.replace("top.match_type", F.lit("_"), F.lit(" ")),
                F.lit(" ("), (-F.col("top.neg")).cast("string"), F.lit(" pairs)"))),
            F.when(emails > 0, F.concat(emails.cast("string"), F.lit(" pairs share the same email address"))),
        )).alias("patterns_detected"),
        F.array_compact(F.array(
            F.when(n > 10, F.lit("Consider reviewing data entry processes to prevent future duplicates")),
            F.when(emails > 5,
                   F.lit("Implement email validation at point of entry to catch duplicates early")),
            F.when(n > 0, F.lit(
                "Review merge recommendations carefully before executing - merges are NOT reversible")),
        )).alias("recommendations"),
    )


def incremental_duplicates(contacts: DataFrame, is_recent: Column,
                           settings: DuplicateSettings = DuplicateSettings()) -> DataFrame:
    """For each recent contact and match type, what it duplicates among the others.

    Existing rows are reduced to one row per key before the join, so one key
    shared by very many rows stays cheap: the recent row gets the smallest
    existing id and the number of existing rows it matches.
    """
    tiers = enabled_tiers(settings)
    # only the ids are needed here, so the profile is left behind
    flagged = contacts.withColumn("_recent", F.coalesce(is_recent, F.lit(False)))
    keys = match_keys(flagged.select("id", "_recent", *KEY_PROPERTIES), settings.default_country_code)
    rows = group_members(keys, tiers).select("id", "tier", "key")
    recent_ids = flagged.filter("_recent").select("id")
    recent = rows.join(recent_ids, "id", "left_semi")
    existing = (
        rows.join(recent_ids, "id", "left_anti").groupBy("tier", "key")
        .agg(F.min("id").alias("match_id"), F.count(F.lit(1)).alias("matches"))
    )
    names = F.create_map(*[F.lit(x) for item in TIER_NAMES.items() for x in item])
    hot = hot_counted(recent.groupBy("tier", "key").agg(F.count(F.lit(1)).alias("n")), ["tier", "key"], "n")
    return salted_join(recent, existing, ["tier", "key"], "inner", ["id"], hot).select(
        "id", names[F.col("tier")].alias("match_type"), "match_id", "matches")
