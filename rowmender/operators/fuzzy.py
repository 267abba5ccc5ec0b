"""Near duplicates: similar names, nicknames, companies, and name twins.

Contacts with the same name and company are reduced to one profile first. The
results link profiles, named by the smallest contact id, and say how many
contacts stand behind each side; they never list the product of two groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rowmender.config import DuplicateSettings
from rowmender.functions import text as t
from rowmender.operators.duplicates import match_keys, pairs_in
from rowmender.operators.similar import similar_texts
from rowmender.operators.skew import hot_counted, ordered_position, salted_join, spread_rows


def _ordered(pairs: DataFrame, *rest) -> DataFrame:
    """Orient the linked rows by id, carrying the group sizes along."""
    swap = F.col("row_1.id") > F.col("row_2.id")
    first = F.when(swap, F.col("row_2")).otherwise(F.col("row_1"))
    second = F.when(swap, F.col("row_1")).otherwise(F.col("row_2"))
    return pairs.select(
        first["id"].alias("id_1"), second["id"].alias("id_2"), first["n"].alias("n_1"), second["n"].alias("n_2"), *rest)


EXACT_KEYS = ("email_key", "phone_company_key", "name_company_key")


def name_profiles(members: DataFrame) -> DataFrame:
    return members.groupBy("company", "name").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"))


def exact_parts(members: DataFrame) -> DataFrame:
    """Members per profile and value of each combination of exact keys, with the sign of inclusion and exclusion.

    (company, name, part, sign, k0, k1, k2, n): for two profiles, the sum of sign * n * n over
    equal combinations is the number of their member pairs that some exact key links.
    """
    entries = []
    for part in range(1, 1 << len(EXACT_KEYS)):
        used = [F.col(k) for i, k in enumerate(EXACT_KEYS) if part >> i & 1]
        whole = F.lit(True)
        for k in used:
            whole = whole & k.isNotNull()
        values = [*used, *[F.lit(None).cast("string")] * (len(EXACT_KEYS) - len(used))]
        entries.append(F.when(whole, F.struct(
            F.lit(part).alias("part"), F.lit(1 if len(used) % 2 else -1).alias("sign"),
            *[F.coalesce(v, F.lit("")).alias(f"k{i}") for i, v in enumerate(values)])))
    rows = members.select("company", "name", F.inline(F.array_compact(F.array(*entries))))
    return rows.groupBy("company", "name", "part", "sign", "k0", "k1", "k2").agg(F.count(F.lit(1)).alias("n"))


def fuzzy_pairs(contacts: DataFrame, settings: DuplicateSettings = DuplicateSettings()) -> DataFrame:
    """Profiles of one company with similar names, and how many of their member pairs no exact key links.

    A profile whose own members are not all linked by exact keys is reported against itself.
    """
    # seven keys of each contact are counted
    keys = match_keys(spread_rows(contacts), settings.default_country_code)
    members = keys.filter(F.col("company").isNotNull() & (F.col("name") != ""))
    profiles = name_profiles(members)
    close = similar_texts(profiles, "name", ["company"], ["id", "n"], settings.max_fuzzy_distance, settings.fuzzy_match_threshold)
    parts = exact_parts(members)
    value = ["company", "part", "k0", "k1", "k2"]
    # only values that several profiles have can link two of them
    shared = parts.groupBy(*value).agg(F.count(F.lit(1)).alias("_profiles")).filter("_profiles > 1").drop("_profiles")
    common = parts.join(shared, value)
    one = common.select(*value, "sign", F.col("name").alias("text_1"), F.col("n").alias("_n1"))
    other = common.select(*value, F.col("name").alias("text_2"), F.col("n").alias("_n2"))
    wide = "decimal(38,0)"
    linked = (
        close.select("company", "text_1", "text_2").join(one, ["company", "text_1"]).join(other, [*value, "text_2"])
        .groupBy("company", "text_1", "text_2").agg(
            F.sum((F.col("sign") * F.col("_n1")).cast("decimal(19,0)") * F.col("_n2").cast("decimal(19,0)")).cast(wide).alias("_linked")))
    zero = F.lit(0).cast(wide)
    product = (F.col("row_1.n").cast("decimal(19,0)") * F.col("row_2.n").cast("decimal(19,0)")).cast(wide)
    apart = close.join(linked, ["company", "text_1", "text_2"], "left").withColumn("pairs", product - F.coalesce("_linked", zero))
    own_links = parts.groupBy("company", "name").agg(F.sum(F.col("sign") * pairs_in(F.col("n"))).cast(wide).alias("_linked"))
    row = F.struct("id", "n")
    own = profiles.filter("n > 1").join(own_links, ["company", "name"], "left").select(
        "company", row.alias("row_1"), row.alias("row_2"), F.lit(0).alias("distance"), F.lit(1.0).alias("similarity"),
        (pairs_in(F.col("n")).cast(wide) - F.coalesce("_linked", zero)).alias("pairs"))
    found = apart.select(*own.columns).unionByName(own).filter("pairs > 0")
    confidence = F.when(F.col("distance") <= settings.max_fuzzy_distance, "medium").otherwise("low")
    return _ordered(found, "company", "distance", "similarity", confidence.alias("confidence"), "pairs")


def fuzzy_review(pairs: DataFrame) -> DataFrame:
    """All pairs, numbered in the order of review: the most similar first."""
    ranked = ordered_position(pairs.withColumn("_order", -F.col("similarity")), ["_order", "id_1", "id_2"], "review_order")
    return ranked.drop("_order")


def nickname_pairs(contacts: DataFrame) -> DataFrame:
    """Profiles with one last name and company whose first names are formal and nickname.

    A formal name has few nicknames, so each row meets at most a handful.
    """
    parts = contacts.select(
        "id", t.normalize_name("firstname").alias("first"), t.normalize_name("lastname").alias("last"),
        t.normalize_name("company").alias("company")).filter("first <> '' AND trim(last) <> '' AND company <> ''")
    profiles = parts.groupBy("company", "last", "first").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"))
    nick = profiles.withColumn("formal", t.formal_name(F.col("first"))).dropna(subset=["formal"]).select(
        "company", "last", "formal", F.col("first").alias("nickname"), F.struct("id", "n").alias("row_2"))
    formal = profiles.select("company", "last", F.col("first").alias("formal"), F.struct("id", "n").alias("row_1"))
    linked = formal.join(nick, ["company", "last", "formal"])
    return _ordered(linked, "company", "last", "formal", "nickname")


def company_pairs(companies: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Companies with the same name but for its legal form, or a similar one.

    Equal names are linked to the smallest id of their group.
    """
    named = companies.filter(t.present("name")).select("id", t.company_core("name").alias("core"))
    groups = named.groupBy("core").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("head"))
    hot = hot_counted(groups, ["core"], "n")
    members = salted_join(named, groups.filter("n > 1"), ["core"], "inner", ["id"], hot).filter("id <> head")
    one = F.lit(1).cast("bigint")
    same = members.select(
        F.col("head").alias("id_1"), F.col("id").alias("id_2"), one.alias("n_1"), one.alias("n_2"),
        F.lit("same").alias("kind"), F.lit(1.0).alias("similarity"))
    close = similar_texts(groups.withColumnRenamed("head", "id"), "core", [], ["id", "n"], 0, threshold)
    return same.unionByName(_ordered(close, F.lit("similar").alias("kind"), "similarity"))


def name_domain_groups(contacts: DataFrame) -> DataFrame:
    """Names that occur with several e-mail domains: one row per name and domain.

    All domains of a name are linked through the first one, whose id is
    ``head_id``; ``pairs`` counts all contact pairs of the name across domains.
    """
    rows = contacts.select(
        "id", t.normalize_name(F.concat_ws(" ", t.nonempty("firstname"), t.nonempty("lastname"))).alias("name"),
        t.email_domain("email").alias("domain")).filter("trim(name) <> '' AND domain <> ''")
    groups = rows.groupBy("name", "domain").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"))
    n = F.col("n").cast("decimal(19,0)")
    names = groups.groupBy("name").agg(
        F.count(F.lit(1)).alias("domains"), F.min("id").alias("head_id"),
        ((F.sum(n).cast("decimal(19,0)") * F.sum(n).cast("decimal(19,0)") - F.sum(n * n)) / 2).cast("decimal(38,0)").alias("pairs")
    ).filter("domains > 1")
    hot = hot_counted(names, ["name"], "domains")
    return salted_join(groups, names, ["name"], "inner", ["domain"], hot).select(
        "name", "domain", "n", "id", "head_id", "domains", "pairs")


def domain_pairs(contacts: DataFrame, settings: DuplicateSettings = DuplicateSettings()) -> DataFrame:
    """Near duplicates by e-mail domain: one name twice in a domain, similar names in a domain.

    Contacts of one name and domain are one profile of ``n`` contacts under the smallest id. A
    profile of several is reported against itself (``same_name``); two profiles of a domain whose
    names are close against each other (``similar_name``).
    """
    rows = contacts.select(
        "id", t.normalize_name(F.concat_ws(" ", t.nonempty("firstname"), t.nonempty("lastname"))).alias("name"),
        t.email_domain("email").alias("domain")).filter("trim(name) <> '' AND domain <> ''")
    profiles = rows.groupBy("domain", "name").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"))
    row = F.struct("id", "n")
    same = profiles.filter("n > 1").select(
        F.lit("same_name").alias("kind"), "domain", row.alias("row_1"), row.alias("row_2"), F.lit(0).alias("distance"), F.lit(1.0).alias("similarity"))
    close = similar_texts(profiles, "name", ["domain"], ["id", "n"], settings.max_fuzzy_distance, settings.fuzzy_match_threshold)
    near = close.select(F.lit("similar_name").alias("kind"), "domain", "row_1", "row_2", "distance", "similarity")
    return _ordered(same.unionByName(near), "kind", "domain", "distance", "similarity")


def name_company_links(contacts: DataFrame) -> DataFrame:
    """Names that occur in several companies: each (name, company) linked to the first one.

    Contacts of one name and company are one profile; ``companies`` is the number of profiles
    of the name.
    """
    keys = match_keys(contacts).filter(F.col("company").isNotNull() & (F.trim("name") != ""))
    profiles = name_profiles(keys)
    heads = profiles.groupBy("name").agg(
        F.count(F.lit(1)).alias("companies"), F.min(F.struct("id", "company", "n")).alias("head")).filter("companies > 1")
    hot = hot_counted(heads, ["name"], "companies")
    joined = salted_join(profiles, heads, ["name"], "inner", ["company"], hot).filter("id <> head.id")
    return joined.select(
        F.col("head.id").alias("id_1"), F.col("id").alias("id_2"), F.col("head.n").alias("n_1"), F.col("n").alias("n_2"),
        "name", F.col("head.company").alias("company_1"), F.col("company").alias("company_2"), "companies")


def similar_contacts(targets: DataFrame, contacts: DataFrame, limit: int = 10,
                     max_distance: int = 2) -> DataFrame:
    """For each target contact, up to ``limit`` contacts of its company with a like name.

    Per profile the candidates are the first ids of it and of each similar
    profile, so no array exceeds limit + 1 ids per profile.
    """
    from pyspark.sql import Window

    keys = match_keys(contacts).filter(F.col("company").isNotNull() & (F.col("name") != "")).select("id", "company", "name")
    # Spark applies the limit per task before the shuffle
    w = Window.partitionBy("company", "name").orderBy("id")
    first = keys.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= limit + 1)
    profiles = first.groupBy("company", "name").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    close = similar_texts(profiles, "name", ["company"], ["ids"], max_distance)
    links = (
        profiles.select("company", "name", F.lit(0).alias("distance"), "ids")
        .unionByName(close.select("company", F.col("text_1").alias("name"), "distance", F.col("row_2.ids").alias("ids")))
        .unionByName(close.select("company", F.col("text_2").alias("name"), "distance", F.col("row_1.ids").alias("ids")))
    )
    ranked = links.select("company", "name", "distance", F.explode("ids").alias("other_id"))
    best = Window.partitionBy("company", "name").orderBy("distance", "other_id")
    top = ranked.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= limit + 1)
    lists = top.groupBy("company", "name").agg(
        F.array_sort(F.collect_list(F.struct("distance", "other_id"))).alias("found"))
    mine = match_keys(targets).select("id", "company", "name").dropna(subset=["company"])
    joined = salted_join(mine, lists, ["company", "name"], "inner", spread=["id"])
    others = F.slice(F.filter("found", lambda f: f["other_id"] != F.col("id")), 1, limit)
    return joined.select("id", F.posexplode(others).alias("pos", "f")).select(
        "id", (F.col("pos") + 1).alias("rank"), "f.other_id", "f.distance")
