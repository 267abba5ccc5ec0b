"""How properties are filled and how uniform their values are."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from rowmender.functions import text as t
from rowmender.operators.similar import similar_texts


def _filled(c: Column) -> Column:
    return c.isNotNull() & (c.cast("string") != "")


def property_usage(df: DataFrame, properties: Sequence[str], required: Sequence[str] = (),
                   exact: bool = True) -> DataFrame:
    """Fill rate, distinct values and a verdict per property, in one pass.

    Exact distinct values are counted per (property, value) first, a two-step
    aggregation that no hot value can stall; ``exact=False`` uses a sketch.
    """
    entries = F.array(*[F.struct(F.lit(p).alias("property"), F.when(_filled(F.col(p)), F.col(p).cast("string")).alias("value"))
                        for p in properties])
    long = df.select(F.inline(entries))
    if exact:
        counts = long.groupBy("property", "value").agg(F.count(F.lit(1)).alias("n"))
        stats = counts.groupBy("property").agg(
            F.sum("n").alias("records"), F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0)).alias("filled"),
            F.count("value").alias("distinct_values"))
    else:
        stats = long.groupBy("property").agg(
            F.count(F.lit(1)).alias("records"), F.count("value").alias("filled"),
            F.approx_count_distinct("value").alias("distinct_values"))
    rate = F.lit(100.0) * F.col("filled") / F.col("records")
    need = F.col("property").isin(*required) if required else F.lit(False)
    verdict = F.when(rate > 50, "keep").when((rate < 10) & ~need, "deprecate").otherwise("review")
    return stats.select("property", "records", "filled", "distinct_values", F.round(rate, 4).alias("fill_rate"),
                        verdict.alias("verdict"))


def low_population(usage: DataFrame, percent: float = 5.0) -> DataFrame:
    return usage.filter(F.col("fill_rate") < percent)


def value_variants(df: DataFrame, column: str, mappings: dict[str, str] | None = None) -> DataFrame:
    """Clusters of values that mean the same: casing, configured mapping, near-typo.

    Values are counted once; everything after that works on distinct values.
    Per cluster the most frequent spelling is the standard (ties: smaller text).
    """
    counts = df.filter(_filled(F.col(column))).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    keyed = counts.withColumn("key", F.lower(t.trim_spaces("value")))
    # struct order: highest count first, then the smaller text
    clusters = keyed.groupBy("key").agg(
        F.sum("n").alias("records"), F.count(F.lit(1)).alias("spellings"),
        F.min(F.struct((-F.col("n")).alias("m"), "value")).alias("top")).select(
        "key", "records", "spellings", F.col("top.value").alias("standard"))
    casing = clusters.filter("spellings > 1").select(
        F.lit("casing").alias("kind"), F.col("key").alias("variant"), "standard", "records")
    parts = [casing]
    if mappings:
        table = F.create_map(*[F.lit(x) for k, v in mappings.items() for x in (k.lower(), v)])
        mapped = clusters.withColumn("to", F.try_element_at(table, F.col("key")))
        parts.append(mapped.filter(F.col("to").isNotNull()).select(
            F.lit("mapping").alias("kind"), F.col("key").alias("variant"), F.col("to").alias("standard"), "records"))
    close = similar_texts(clusters, "key", [], ["key", "records", "standard"], max_distance=1)
    first_wins = (F.col("row_1.records") > F.col("row_2.records")) | (
        (F.col("row_1.records") == F.col("row_2.records")) & (F.col("row_1.key") < F.col("row_2.key")))
    good = F.when(first_wins, F.col("row_1")).otherwise(F.col("row_2"))
    bad = F.when(first_wins, F.col("row_2")).otherwise(F.col("row_1"))
    parts.append(close.select(
        F.lit("typo").alias("kind"), bad["key"].alias("variant"), good["standard"].alias("standard"),
        bad["records"].alias("records")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def phone_format(c: Column) -> Column:
    return (
        F.when(c.rlike(r"^\+[1-9][0-9]{7,14}\z"), "e164")
        .when(c.rlike(r"^\([0-9]{3}\) [0-9]{3}-[0-9]{4}\z"), "national")
        .when(c.rlike(r"^\+"), "international")
        .otherwise("other")
    )


def url_format(c: Column) -> Column:
    return F.when(c.rlike("^https://"), "https").when(c.rlike("^http://"), "http").when(
        c.rlike(r"^www\."), "www").otherwise("bare")


def date_format_class(c: Column) -> Column:
    text = c.cast("string")
    return (
        F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}([T ]|\z)"), "iso")
        .when(text.rlike(r"^\d{1,2}/\d{1,2}/\d{4}"), "slash")
        .when(text.rlike(r"^\d{13}\z"), "epoch_ms")
        .otherwise("other")
    )


def format_mix(df: DataFrame, classes: dict[str, Column]) -> DataFrame:
    """Share of the filled values of each property per format."""
    entries = F.array(*[F.struct(F.lit(p).alias("property"), F.when(_filled(F.col(p)), c).alias("format"))
                        for p, c in classes.items()])
    counts = df.select(F.inline(entries)).dropna().groupBy("property", "format").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("property").agg(F.sum("n").alias("_all"))
    return counts.join(totals, "property").select(
        "property", "format", "n", F.round(F.lit(100.0) * F.col("n") / F.col("_all"), 4).alias("pct"))


def standardise(df: DataFrame, country_codes: dict[str, str] | None = None, columns: Sequence[str] = ("phone", "country", "firstname", "lastname"),
                dates: Sequence[str] = ()) -> DataFrame:
    """Phones to E.164, dates to ISO 8601, countries to codes, names to title case.

    A value that cannot be converted stays as it is.
    """
    changes: dict[str, Column] = {}
    for c in columns:
        if c == "phone":
            digits = t.normalize_phone("phone")
            changes[c] = F.when(F.length(digits) == 10, F.concat(F.lit("+1"), digits)).otherwise(F.col(c))
        elif c == "country":
            table = F.create_map(*[F.lit(x) for k, v in (country_codes or {}).items() for x in (k.lower(), v)]) \
                if country_codes else None
            if table is not None:
                changes[c] = F.coalesce(F.try_element_at(table, F.lower(t.trim_spaces(c))), F.col(c))
        else:
            changes[c] = t.title_case(c)
    for c in dates:
        changes[c] = F.coalesce(t.iso_timestamp(t.instant(df, c)), F.col(c).cast("string"))
    return df.withColumns(changes)


def placeholder_email(c: str = "email") -> Column:
    """Addresses of domains that are reserved for examples."""
    return t.email_domain(c).isin("example.com", "test.com")


def quality_score(contacts: DataFrame, as_of, required: Sequence[str], recent_days: int = 365) -> DataFrame:
    """Points for filled, valid and recent data; below 50 is low."""
    from rowmender.operators.rules import EMAIL_PATTERN, last_activity

    def points(test: Column, n: int) -> Column:
        return F.when(F.coalesce(test, F.lit(False)), n).otherwise(0)

    score = F.lit(0)
    for f in required:
        score = score + points(t.present(t.trim_spaces(F.col(f).cast("string"))), 20)
    digits = F.length(F.regexp_replace("phone", "[^0-9]", ""))
    score = (
        score + points(F.col("email").rlike(EMAIL_PATTERN), 10) + points(digits >= 10, 10)
        + points(t.days_between(t.as_timestamp(as_of), last_activity(contacts)) <= recent_days, 5)
        + points(t.present(t.trim_spaces("company")), 15)
    )
    return contacts.select("id", score.alias("score")).withColumn("is_low", F.col("score") < 50)


def health_score(contacts: DataFrame, critical: Sequence[str], duplicate_pairs: DataFrame,
                 variants: DataFrame, unused_lists: DataFrame) -> DataFrame:
    """One row: share of complete contacts, and what is left of the other findings.

    The three other inputs are one-row counts.
    """
    complete = F.lit(True)
    for c in critical:
        complete = complete & F.coalesce(t.present(t.trim_spaces(F.col(c).cast("string"))), F.lit(False))
    base = contacts.agg(F.count(F.lit(1)).alias("contacts"), F.count_if(complete).alias("complete"))
    return base.select(
        "contacts", "complete", F.round(F.lit(100.0) * F.col("complete") / F.col("contacts"), 4).alias("complete_pct"),
        duplicate_pairs.scalar().alias("duplicate_pairs"), variants.scalar().alias("inconsistent_values"),
        unused_lists.scalar().alias("unused_lists"))
