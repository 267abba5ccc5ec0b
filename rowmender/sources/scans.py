"""Reading CRM tables and looking rows up."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rowmender.functions import text as t
from rowmender.operators.skew import salted_join
from rowmender.schemas import BAG_SCHEMA, bag_to_columns, require_columns

# fixed values: default properties read per object type
CONTACT_PROPERTIES = (
    "email", "firstname", "lastname", "phone", "mobilephone", "company", "jobtitle", "lifecyclestage",
    "hs_marketable_status", "lastmodifieddate", "createdate",
)
COMPANY_PROPERTIES = ("name", "domain")
DEAL_PROPERTIES = ("contact_id", "stage", "amount", "updated_at")


def scan(df: DataFrame, properties: Iterable[str]) -> DataFrame:
    """The wanted properties only, each once; absent ones are null."""
    wanted = list(dict.fromkeys(["id", *properties]))
    return require_columns(df, wanted).select(*wanted)


def read_objects(spark: SparkSession, path: str, properties: Iterable[str], fmt: str = "parquet",
                 bag: bool = False, **options) -> DataFrame:
    """Read contacts, companies or deals, as columns or as property bags."""
    reader = spark.read.format(fmt).options(**options)
    if bag:
        return bag_to_columns(reader.schema(BAG_SCHEMA).load(path), properties)
    if fmt in ("csv", "json") and "header" not in options and fmt == "csv":
        reader = reader.option("header", True)
    return scan(reader.load(path), properties)


def lookup(df: DataFrame, object_id: str) -> DataFrame:
    return df.filter(F.col("id") == object_id)


def batch_read(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """The rows whose id is in ``ids``; the ids may repeat."""
    return df.join(ids.select(F.col(key).alias("id")).distinct(), "id", "left_semi")


def created_after(df: DataFrame, instant, column: str = "createdate") -> DataFrame:
    return df.filter(F.col(column) >= t.as_timestamp(instant))


def property_catalogue(tables: dict[str, DataFrame], choices: int = 10) -> DataFrame:
    """Definitions of the properties of each object type, with what their rows hold.

    Name, label and type come from the schema; the numbers of rows, of filled ones and of
    distinct values from one pass over each table, counted per value first. A text property
    with at most ``choices`` values is a choice.
    """
    out = None
    for object_type, df in tables.items():
        kinds = {c: kind for c, kind in df.dtypes if c != "id"}
        entries = F.array(*[F.struct(F.lit(c).alias("name"), t.nonempty(F.col(c).cast("string")).alias("value")) for c in kinds])
        counts = df.select(F.inline(entries)).groupBy("name", "value").agg(F.count(F.lit(1)).alias("n"))
        stats = counts.groupBy("name").agg(
            F.sum("n").alias("records"), F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0)).alias("filled"),
            F.count("value").alias("distinct_values"))
        labels = F.create_map(*[F.lit(x) for c in kinds for x in (c, c.replace("_", " ").capitalize())])
        types = F.create_map(*[F.lit(x) for item in kinds.items() for x in item])
        is_choice = (types[F.col("name")] == "string") & F.col("distinct_values").between(1, choices)
        rows = stats.select(
            F.lit(object_type).alias("object_type"), "name", labels[F.col("name")].alias("label"), types[F.col("name")].alias("type"),
            "records", "filled", "distinct_values", is_choice.alias("is_choice"))
        out = rows if out is None else out.unionByName(rows)
    return out


def property_values(tables: dict[str, DataFrame], options: dict[str, Sequence[str]]) -> DataFrame:
    """The values in use of the named properties, a row with its number of rows each."""
    out = None
    for object_type, names in options.items():
        entries = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in names])
        values = tables[object_type].select(F.inline(entries)).dropna().groupBy("name", "value").agg(F.count(F.lit(1)).alias("n"))
        values = values.select(F.lit(object_type).alias("object_type"), "name", "value", "n")
        out = values if out is None else out.unionByName(values)
    return out


def lists_scan(lists: DataFrame) -> DataFrame:
    return lists.withColumn("size", F.coalesce("size", F.lit(0)))


def list_contacts(members: DataFrame, contacts: DataFrame, list_ids: Column | None = None) -> DataFrame:
    """All members of the lists, with their contact columns.

    A contact can be in very many lists, so the membership side is salted.
    """
    wanted = members if list_ids is None else members.filter(list_ids)
    people = contacts.withColumnRenamed("id", "contact_id")
    return salted_join(wanted, people, ["contact_id"], "inner", spread=["list_id"])


def associations(edges: DataFrame, from_type: str, to_type: str) -> DataFrame:
    """Edges between two object types; an untyped edge gets the target type."""
    kept = edges.filter((F.col("from_type") == from_type) & (F.col("to_type") == to_type))
    return kept.withColumn("assoc_type", F.coalesce(t.nonempty("assoc_type"), F.col("to_type")))


def contact_events(events: DataFrame, kinds: Sequence[str] = ()) -> DataFrame:
    """Timeline or e-mail events, of some kinds or of all."""
    return events.filter(F.col("event_type").isin(*kinds)) if kinds else events


def engagement_summary(contacts: DataFrame) -> DataFrame:
    """Last activity and the engagement counters, from text properties."""
    counters = {
        "emails_sent": "hs_email_delivered", "emails_opened": "hs_email_open", "emails_clicked": "hs_email_click",
        "form_submissions": "form_submissions", "page_views": "hs_analytics_num_page_views",
    }
    df = require_columns(contacts, ["notes_last_contacted", "lastmodifieddate", *counters.values()])
    last = F.coalesce(t.instant(df, "notes_last_contacted"), t.instant(df, "lastmodifieddate"))
    return df.select("id", last.alias("last_activity"), *[
        t.parse_int_prefix(F.col(p).cast("string")).alias(n) for n, p in counters.items()])


#: Which events make up each engagement counter.
COUNTED = {
    "hs_email_delivered": ("DELIVERED", "OPENED", "CLICKED"), "hs_email_open": ("OPENED",), "hs_email_click": ("CLICKED",),
    "form_submissions": ("FORM_SUBMITTED",), "hs_analytics_num_page_views": ("OPENED", "CLICKED", "FORM_SUBMITTED"),
}


def with_counters(contacts: DataFrame, events: DataFrame, counted: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """``contacts`` with their engagement counters taken from the events instead of stored texts.

    Events are counted per contact before the join, so it has one row on either side.
    """
    counted = COUNTED if counted is None else counted
    numbers = events.groupBy(F.col("contact_id").alias("id")).agg(
        *[F.count_if(F.col("event_type").isin(*kinds)).alias(f"_{name}") for name, kinds in counted.items()])
    joined = contacts.drop(*counted).join(numbers, "id", "left")
    return joined.withColumns({name: F.coalesce(f"_{name}", F.lit(0)).cast("string") for name in counted}).drop(*[f"_{name}" for name in counted])


def marketing_status(contacts: DataFrame) -> DataFrame:
    """Marketing flag as a boolean; both spellings of it are understood."""
    df = require_columns(contacts, ["hs_marketable_status", "hs_marketable_reason_type", "hs_marketable_until_renewal"])
    return df.select(
        "id", F.coalesce(F.col("hs_marketable_status").isin("true", "MARKETABLE"), F.lit(False)).alias("is_marketing"),
        F.coalesce(t.nonempty("hs_marketable_reason_type"), F.lit("unknown")).alias("status"),
        t.nonempty("hs_marketable_until_renewal").alias("status_updated_at"))
