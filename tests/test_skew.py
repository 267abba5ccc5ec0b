import pytest
from pyspark.sql import functions as F

from rowmender.operators import skew


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(spark, hot_from, how):
    hot_from(20)
    keys = F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 7 == 0, F.lit(None)).otherwise(
        (F.col("id") % 11).cast("string"))
    big = spark.range(300).withColumn("k", keys)
    single = spark.createDataFrame([("hot", 1), ("3", 2), ("99", 3)], "k string, v int")
    hot = skew.hot_keys(big, ["k"])
    assert {r.k for r in hot} >= {"hot", None}
    got = skew.salted_join(big, single, ["k"], how)
    want = big.join(single, ["k"], how)
    order = sorted(want.columns)
    plain = lambda df: sorted(map(repr, df.select(*order).collect()))
    assert plain(got) == plain(want)
    assert "_salt" in skew.salted_join(big, single, ["k"], "inner", hot=hot, keep_salt=True).columns


def test_hot_keys_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(skew, "MAX_HOT_KEYS", 3)
    df = spark.range(100).withColumn("k", F.col("id") % 10)
    assert len(skew.hot_keys(df, ["k"], min_rows=1)) == 3


def test_positions(spark, hot_from):
    hot_from(10)
    df = spark.range(200).select(
        F.when(F.col("id") % 2 == 0, "a").otherwise((F.col("id") % 5).cast("string")).alias("g"),
        F.pmod(F.xxhash64("id"), F.lit(1000)).alias("v"), "id")
    rows = skew.ordered_position(df, ["v", "id"]).collect()
    want = {r.id: n for n, r in enumerate(sorted(df.collect(), key=lambda r: (r.v, r.id)), 1)}
    assert {r.id: r.position for r in rows} == want
    inside = {r.id: r.position for r in skew.position_within(df, ["g"], ["v", "id"]).collect()}
    seen, expected = {}, {}
    for r in sorted(df.collect(), key=lambda r: (r.g, r.v, r.id)):
        seen[r.g] = seen.get(r.g, 0) + 1
        expected[r.id] = seen[r.g]
    assert inside == expected
