"""Streams over several deliveries, with restarts, repeated batches and crashes."""

import datetime

import pytest
import pyspark.sql.types as T
from pyspark.sql import functions as F

from rowmender.session import scratch_path
from rowmender.sources import kept
from rowmender.streaming import arrivals, jobs

EVENTS = "event_time timestamp, event_type string"


def at(hour, minute=0):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=hour, minutes=minute)


def test_restarts_keep_state_and_drop_late_rows(spark):
    root = scratch_path(spark, "late")
    deliveries = [
        [(at(1), "a"), (at(1, 10), "a"), (at(3), "a")],
        [(at(2, 59), "a"), (at(1, 30), "a"), (at(9), "a")],  # 1:30 is in a window that may still be open: its end is not behind 3:00 - 2 h
        [(at(1, 40), "a"), (at(9, 5), "a"), (at(2), "a"), (at(20), "a")],  # 1:40 and 2:00 are late now
        [(at(9, 30), "a"), (at(30), "b")],
    ]
    schema = spark.createDataFrame([], EVENTS).schema
    for rows in deliveries:
        spark.createDataFrame(rows, EVENTS).repartition(2).write.mode("append").parquet(f"{root}/in")
        for _ in range(2):  # the second start finds nothing new
            events = jobs.read_files(spark, f"{root}/in", schema)
            arrivals.continue_table(jobs.rate_alerts(events, "event_time", "event_type", 1, delay="2 hours"), f"{root}/out", f"{root}/state")
    got = sorted((r.window_start.hour, r.event_type, r.n) for r in spark.read.parquet(f"{root}/out").collect())
    # 9:30 comes when 18:00 has been reached; 20:00 is closed by 30:00, which stays open itself
    assert got == [(1, "a", 3), (2, "a", 1), (3, "a", 1), (9, "a", 2), (20, "a", 1)]


def test_a_repeated_batch_changes_nothing(spark):
    root = scratch_path(spark, "sinks")
    df = spark.createDataFrame([("1", "555-123-4567", "FRANCE", "ann"), ("2", "12", None, "Bob"), ("3", None, "x", None), ("4", "+15551234567", "x", "y")], "id string, phone string, country string, firstname string")
    store = arrivals.two_sinks(root, "2024-02-01 00:00:00", country_codes={"FRANCE": "FR"}, columns=("phone", "country", "firstname"))
    read = lambda: (sorted(map(repr, spark.read.parquet(f"{root}/rows").collect())), sorted(map(repr, spark.read.parquet(f"{root}/findings").drop("issue_id").collect())))
    store(df.filter("id < 3"), 0)
    store(df.filter("id >= 3"), 1)
    before = read()
    store(df.filter("id >= 3"), 1)
    assert read() == before
    rows = {r.id: r for r in spark.read.parquet(f"{root}/rows").collect()}
    assert [rows[i].phone_validation_status for i in "1234"] == ["reformatted", "manual_review", "missing", "valid"]
    assert rows["1"].phone == "+15551234567" and rows["1"].country == "FR" and rows["1"].firstname == "Ann"


COLUMNS = "id string, seq bigint, email string, firstname string, lastname string, phone string, company string"


def people(spark, *rows):
    return spark.createDataFrame([(i, s, e, f, "Lee", p, c) for i, s, e, f, p, c in rows], COLUMNS)


@pytest.fixture
def tables(spark):
    start = people(spark, ("1", 1, "a@x.co", "Ann", None, "Acme"), ("2", 2, " A@X.co", None, "1", None), ("3", 3, "b@x.co", "Bob", "2", "Beta"), ("4", 4, None, "Cy", "3", "Acme"))
    made = arrivals.kept_contacts(spark, scratch_path(spark, "upsert"), T.StructType(start.schema.fields))
    arrivals.create_contacts(made, start, "seq", 4)
    return made


def state(tables):
    contacts = {r.id: (r.email, r.firstname, r.phone, r.potential_duplicate) for r in tables.read(arrivals.CONTACTS).collect()}
    return contacts, sorted((r.id, r.arrival_id) for r in tables.read(arrivals.LOG).collect())


def batches(spark):
    return [
        people(spark, ("10", 10, "a@x.co", "Anna", None, None), ("11", 11, "c@x.co", "Ann", "9", "Acme"), ("12", 12, "C@X.co ", None, "8", None), ("13", 13, None, "Bob", None, "Beta")),
        people(spark, ("14", 14, "c@x.co", None, "7", None), ("15", 15, "d@x.co", "Dee", None, "Acme"), ("16", 16, "e@x.co", "Dee", None, "Acme"), ("3", 17, "b@x.co", "Rob", None, None)),
    ]


WANT = ({
    "1": ("a@x.co", "Anna", "1", None), "3": ("b@x.co", "Rob", "2", None), "4": (None, "Cy", "3", None), "11": ("c@x.co", "Ann", "7", "1"),
    "13": (None, "Bob", None, "3"), "15": ("d@x.co", "Dee", None, None), "16": ("e@x.co", "Dee", None, "15")}, [("1", "10"), ("11", "12"), ("11", "14")])


def test_arrivals_update_the_table(spark, tables):
    store = arrivals.upsert(tables, "seq", 4)
    for number, batch in enumerate(batches(spark)):
        store(batch, number)
        store(batch, number)  # a batch that runs twice
    assert state(tables) == WANT


def test_a_crash_between_staging_and_applying(spark, tables, monkeypatch):
    store = arrivals.upsert(tables, "seq", 4)
    first, second = batches(spark)
    monkeypatch.setattr(kept.KeptTables, "apply", lambda *a: (_ for _ in ()).throw(RuntimeError("crash")))
    with pytest.raises(RuntimeError):
        store(first, 0)
    monkeypatch.undo()
    store(first, 0)  # Spark repeats the batch after a restart
    store(second, 1)
    assert state(tables) == WANT


def test_empty_batch(spark, tables):
    before = state(tables)
    arrivals.upsert(tables, "seq", 4)(batches(spark)[0].limit(0), 0)
    assert state(tables) == before


def test_a_batch_sends_no_table_through_the_driver(spark, tables, monkeypatch):
    plans = []
    stage = kept.KeptTables.stage

    def seen(self, tag, changes):
        plans.extend(df._jdf.queryExecution().executedPlan().toString() for c in changes.values() for df in (c.rows, c.touched))
        return stage(self, tag, changes)

    monkeypatch.setattr(kept.KeptTables, "stage", seen)
    arrivals.upsert(tables, "seq", 4)(batches(spark)[0], 0)
    assert len(plans) == 6 and not any("Broadcast" in p for p in plans)
