"""Streams that go on over many micro-batches and restarts, and that keep tables.

A query is started on a folder of arriving files with a checkpoint of its own; started again
later it goes on where it stopped, with its state and its watermark. What a batch writes
depends on the batch and the tables before it alone, and is written under its number, so a batch
that runs twice leaves the same tables.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F, Window
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from rowmender.config import DuplicateSettings, QualityRules
from rowmender.functions import text as t
from rowmender.operators.duplicates import KEY_PROPERTIES, match_keys
from rowmender.operators.properties import standardise
from rowmender.operators.rules import audit_contacts
from rowmender.session import drop_path, written
from rowmender.sources.kept import Change, KeptTables, buckets_of


def continue_table(df: DataFrame, path: str, state: str, output_mode: str = "append") -> None:
    """Process what has arrived since the checkpoint ``state``, appending to the table at ``path``."""
    query = (
        df.writeStream.format("parquet").outputMode(output_mode).option("path", path)
        .option("checkpointLocation", state).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def continue_batches(df: DataFrame, state: str, store: Callable[[DataFrame, int], None]) -> None:
    """Hand what has arrived since the checkpoint to ``store``, batch by batch."""
    query = df.writeStream.foreachBatch(store).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()


# ---- findings and clean rows from one stream

def phone_status(raw: Column, clean: Column) -> Column:
    """Whether a phone number is usable: as it was, after reformatting, or only after a look at it."""
    good = F.coalesce(clean.rlike(r"^\+[1-9][0-9]{7,14}\z"), F.lit(False))
    return (
        F.when(~F.coalesce(t.present(raw), F.lit(False)), "missing")
        .when(good & (raw == clean), "valid").when(good, "reformatted").otherwise("manual_review")
    )


def standardised(arrivals: DataFrame, country_codes: dict[str, str] | None = None, columns: Sequence[str] = ("phone", "country", "firstname", "lastname"),
                 dates: Sequence[str] = ()) -> DataFrame:
    """The rows with phones, countries, names and dates in one form, and what became of the phone."""
    raw = arrivals.withColumn("_raw", F.col("phone"))
    clean = standardise(raw, country_codes, columns, dates)
    return clean.withColumn("phone_validation_status", phone_status(F.col("_raw"), F.col("phone"))).drop("_raw")


def two_sinks(root: str, as_of, rules: QualityRules = QualityRules(), **options) -> Callable[[DataFrame, int], None]:
    """A batch function that writes the rule findings and the standardised rows of the arrivals.

    Each goes to a folder with the number of the batch, which is overwritten if the batch
    runs again; the rows come last, so a batch whose rows are there is complete.
    """
    def store(batch: DataFrame, number: int) -> None:
        audit_contacts(batch, as_of, rules).write.mode("overwrite").parquet(f"{root}/findings/batch_id={number}")
        standardised(batch, **options).write.mode("overwrite").parquet(f"{root}/rows/batch_id={number}")

    return store


# ---- arrivals against a kept table

CONTACTS, NAMES, LOG = "contacts", "names", "merges"


def kept_contacts(spark, root: str, schema: StructType) -> KeptTables:
    """A contact table by address, the first contact of each name and company, and the log of merges."""
    string = lambda n: StructField(n, StringType())
    contact = StructType([*schema.fields, string("email_key"), string("potential_duplicate"), StructField("bucket", IntegerType())])
    names = StructType([string("name_key"), string("id"), StructField("bucket", IntegerType())])
    log = StructType([string("id"), string("arrival_id"), StructField("batch_id", LongType())])
    return KeptTables(spark, root, {CONTACTS: contact, NAMES: names, LOG: log}, {CONTACTS: "bucket", NAMES: "bucket", LOG: "batch_id"})


def keyed(rows: DataFrame, settings: DuplicateSettings) -> DataFrame:
    """``rows`` with the key of the address and the key of name and company."""
    whole = F.struct(*[F.col(c) for c in rows.columns])
    keys = match_keys(rows.select(whole.alias("id"), *[c for c in rows.columns if c in KEY_PROPERTIES]), settings.default_country_code)
    return keys.select("id.*", "email_key", F.col("name_company_key").alias("name_key"))


def create_contacts(tables: KeptTables, rows: DataFrame, order: str, buckets: int, settings: DuplicateSettings = DuplicateSettings()) -> None:
    """Start the kept tables from a contact table; of several contacts with one address the first in ``order`` stays."""
    wanted = tables.schemas[CONTACTS].names
    known = keyed(rows, settings)
    first = folded(known, order, [c for c in rows.columns if c not in ("id", order)])
    people = first.filter("name_key is not null").groupBy("name_key").agg(F.min_by("id", F.struct(order, "id")).alias("id"))
    contacts = first.withColumn("potential_duplicate", F.lit(None).cast("string"))
    tables.create(CONTACTS, buckets_of(contacts, "email_key", buckets).select(*wanted))
    tables.create(NAMES, buckets_of(people, "name_key", buckets))


def folded(rows: DataFrame, order: str, columns: Sequence[str]) -> DataFrame:
    """One row per address: the first in ``order``, each column with its last value that is not empty.

    Rows without an address stay as they are. The key names are those of the first row.
    Per address and column the aggregation keeps one value, so a hot address costs no memory.
    """
    at = F.struct(order, "id")
    some = rows.filter("email_key is not null")
    last = [F.max(F.when(filled(F.col(c)), F.struct(F.col(order).alias("o"), F.col("id").alias("i"), F.col(c).alias("v"))))["v"].alias(c) for c in columns]
    own = some.groupBy("email_key").agg(F.min_by("id", at).alias("id"), F.min(order).alias(order), F.min_by("name_key", at).alias("name_key"), *last)
    return own.unionByName(rows.filter("email_key is null").select(*own.columns))


def filled(c: Column) -> Column:
    return c.isNotNull() & (c.cast("string") != "")


def upsert(tables: KeptTables, order: str, buckets: int, settings: DuplicateSettings = DuplicateSettings()) -> Callable[[DataFrame, int], None]:
    """A batch function that brings arriving contacts into the kept table.

    An arrival whose address is known updates that contact with its filled values and is logged
    as a merge; of several arrivals with one address the first in ``order`` counts as the contact.
    A new contact with the name and company of an earlier one is marked as its potential
    duplicate. Only the partitions of the addresses and names that arrive are read and written, and
    a batch is staged as a whole before it is applied, once.

    The arrivals and what they meet in the table are written once per batch and read from there. The
    joins are sort-merge joins, so that neither the table nor the batch passes through the driver.
    """
    inner = [n for n in tables.schemas[CONTACTS].names if n not in ("id", order, "email_key", "potential_duplicate", "bucket")]

    def store(batch: DataFrame, number: int) -> None:
        tag = f"batch-{number}"
        tables.recover()
        if tables.done(tag):
            return
        paths: list[str] = []

        def once(df: DataFrame, name: str) -> DataFrame:
            table, path = written(df, name)
            paths.append(path)
            return table

        try:
            tables.change(tag, changes(keyed(batch.select("id", order, *inner), settings), number, once))
        finally:
            for path in paths:
                drop_path(tables.spark, path)

    def changes(arrived: DataFrame, number: int, once: Callable[[DataFrame, str], DataFrame]) -> dict[str, Change]:
        fresh = once(buckets_of(folded(arrived, order, inner), "email_key", buckets), "arrived")
        touched = fresh.select("bucket").distinct()
        known = tables.rows_of(CONTACTS, touched)
        mine = known.select(*[F.col(c).alias(f"_{c}") for c in known.columns])
        # rows without an address are never joined
        met = once(fresh.join(mine, (fresh["email_key"] == mine["_email_key"]) & (fresh["bucket"] == mine["_bucket"]), "full"), "met")
        is_new, is_old = F.col("_id").isNull(), F.col("id").isNull()

        new = met.filter(is_new).select(*fresh.columns)
        names = buckets_of(new.filter("name_key is not null").select("name_key", "id", order), "name_key", buckets)
        first = names.groupBy("name_key", "bucket").agg(F.min_by("id", F.struct(order, "id")).alias("id"))
        known_names = tables.rows_of(NAMES, first.select("bucket").distinct())
        heads = first.alias("n").join(known_names.alias("k"), ["name_key", "bucket"], "full").select(
            "name_key", F.coalesce("k.id", "n.id").alias("id"), "bucket")
        marks = new.select("id", "name_key").join(heads.select("name_key", F.col("id").alias("head")).hint("merge"), "name_key").filter("id <> head").select(
            F.col("id").alias("new_id"), "head")

        merged = [F.when(is_old, F.col(f"_{c}")).when(is_new, F.col(c)).otherwise(F.when(filled(F.col(c)), F.col(c)).otherwise(F.col(f"_{c}"))).alias(c) for c in inner]
        rows = met.select(
            F.coalesce("_id", "id").alias("id"), F.coalesce(f"_{order}", order).alias(order), *merged, F.coalesce("_email_key", "email_key").alias("email_key"),
            F.col("_potential_duplicate"), F.coalesce("_bucket", "bucket").alias("bucket"), F.when(is_new, F.col("id")).alias("_new"))
        # contacts that were there have no part in the join, where all of them would be in one task
        names_met = rows.filter("_new is not null").join(marks.hint("merge"), F.col("_new") == F.col("new_id"), "left").drop("new_id")
        marked = names_met.unionByName(rows.filter("_new is null").withColumn("head", F.lit(None).cast("string"))).withColumn(
            "potential_duplicate", F.coalesce("head", "_potential_duplicate"))
        # each arrival that is not the contact itself
        target = met.filter("id is not null").select("email_key", F.coalesce("_id", "id").alias("target")).filter("email_key is not null")
        log = arrived.select("email_key", F.col("id").alias("arrival_id")).join(target.hint("merge"), "email_key").filter("arrival_id <> target").select(
            F.col("target").alias("id"), "arrival_id", F.lit(number).cast("long").alias("batch_id"))
        return {
            CONTACTS: Change(marked, touched), NAMES: Change(heads, first.select("bucket").distinct()),
            LOG: Change(log, log.select("batch_id").distinct())}

    return store
