"""Exact values of the string, date and similarity expressions."""

import pytest
from pyspark.sql import functions as F

from rowmender.functions import text as t
from rowmender.functions.urls import is_valid_url


def values(spark, rows, schema, column):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"n int, {schema}")
    return [r[0] for r in df.orderBy("n").select(column).collect()]


def test_levenshtein_and_similarity(spark):
    rows = [("kitten", "sitting"), ("saturday", "sunday"), ("", "hello"), ("HELLO", "hello"), ("", "")]
    a, b = F.col("a"), F.col("b")
    assert values(spark, rows, "a string, b string", t.levenshtein(a, b)) == [3, 3, 5, 5, 0]
    got = values(spark, [("hello", "hallo"), ("abc", "xyz"), ("", "")], "a string, b string", t.similarity(a, b))
    assert got == pytest.approx([0.8, 0.0, 1.0])
    assert values(spark, [("hello", "hallo")], "a string, b string", t.normalized_levenshtein(a, b)) == [0.2]


@pytest.mark.parametrize("raw, want", [
    ("John  \t  Smith", "john smith"), ("John@Smith#123", "johnsmith123"), ("Mary (Jones)", "mary jones"), (None, ""),
    ("Mary-Jane O'Connor", "mary-jane o'connor"), ("A & B", "a  b"), ("Acme !", "acme "),
    (" Ann　 Lee﻿", "ann lee"), ("José", "jos"), ("  ", ""), ("a  & b", "a  b"),
])
def test_normalize_name(spark, raw, want):
    assert values(spark, [(raw,)], "a string", t.normalize_name("a")) == [want]


def test_normalize_phone(spark):
    rows = [("(555) 123-4567",), ("+1-555-123-4567",), ("555·123·4567",), ("+44 20 1234 5678",), (None,), ("no",)]
    assert values(spark, rows, "a string", t.normalize_phone("a")) == [
        "5551234567", "5551234567", "5551234567", "442012345678", "", ""]
    assert values(spark, [("1 555 123 4567",)], "a string", t.normalize_phone("a", "UK")) == ["15551234567"]


def test_email_domain(spark):
    rows = [("JOHN@EXAMPLE.COM",), ("no@at@sign",), ("@example.com",), ("user@",), (None,), ("plain",)]
    assert values(spark, rows, "a string", F.coalesce(t.email_domain("a"), F.lit(""))) == ["example.com", "", "", "", "", ""]


def test_nicknames(spark):
    rows = [("Bob", "Robert"), ("Kate", "Catherine"), ("Bob", "Bobby"), ("John", "John"), (None, "Robert"),
            ("ROBERT", " bob "), ("John", "Jane"), ("", "Bob")]
    got = values(spark, rows, "a string, b string", t.is_likely_nickname("a", "b"))
    assert got == [True, True, False, False, False, True, False, False]
    nicks = [n for ns in t.NICKNAMES.values() for n in ns]
    assert (len(t.NICKNAMES), len(nicks), len(set(nicks))) == (21, 55, 55)


def test_same_company(spark):
    rows = [("Acme Inc.", "Acme Corporation"), ("Company Corp.", "Company Inc."), ("Acme Industries", "Acme Industires"),
            ("Acme Corp", "Beta Corp"), ("", "Acme Corp"), ("Inc.", "LLC")]
    got = values(spark, rows, "a string, b string", t.is_same_company("a", "b"))
    assert got == [True, True, True, False, False, True]


def test_trim_and_prefix_numbers(spark):
    rows = [("  x\t",), ("\n",), ("a   b",)]
    assert values(spark, rows, "a string", t.trim_spaces("a")) == ["x", "", "a   b"]
    assert values(spark, rows, "a string", t.tidy("a")) == ["x", "", "a b"]
    numbers = [("12",), (" +7 opens",), ("many",), ("",), (None,), ("3.9",)]
    assert values(spark, numbers, "a string", t.parse_int_prefix("a")) == [12, 7, None, 0, 0, 3]


def test_pair_key_and_dates(spark):
    assert values(spark, [("9", "10")], "a string, b string", t.pair_key(F.col("a"), F.col("b"))) == ["10-9"]
    days = t.days_between(t.as_timestamp("2024-02-01 00:00:00"), F.col("a").cast("timestamp"))
    assert values(spark, [("2024-01-30 12:00:00",)], "a string", days) == [1.5]
    iso = t.iso_timestamp(F.col("a").cast("timestamp"))
    assert values(spark, [("2024-01-30 12:00:00.5",)], "a string", iso) == ["2024-01-30T12:00:00.500Z"]


GOOD_URLS = ["example.com", "https://example.com/a?b=c#d", "http:example.com", "a_b.com", "user:pw@host:8080", "[::1]:80",
             "1.2.3.4", "localhost", "host:", "müller.de", "ftp.example.com", "httpbin:x", "example.com:65535", "a%C3%A9.com",
             "  trailing.com "[2:], "256.com", "4294967295", "01.2.3.4", "0x7f.1", "1.2.65535", "0x", "1.2.3.4."]
BAD_URLS = ["not a url", "https://", "http", "httpfoo", "exa mple.com", "host:99999", "1.2.3.456", "a<b.com", "[::1", "host:abc",
            "a%20b.com", "foo.123", ":80", "a|b", "1.2.70000", "4294967296", "1.2.3.08", "1.2.3.4.5", "0x1ffffffff", "99999999999999999999999"]


def test_urls(spark):
    ok = F.coalesce(is_valid_url(F.col("a")), F.lit(False))
    assert dict(zip(GOOD_URLS, values(spark, [(u,) for u in GOOD_URLS], "a string", ok))) == dict.fromkeys(GOOD_URLS, True)
    assert dict(zip(BAD_URLS, values(spark, [(u,) for u in BAD_URLS], "a string", ok))) == dict.fromkeys(BAD_URLS, False)
