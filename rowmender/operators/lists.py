"""List hygiene: overlap, unused lists, unfit members."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rowmender.functions import text as t
from rowmender.operators.skew import grid_join, hot_counted, position_within, salted_join


def list_overlap(members: DataFrame, threshold: float = 80.0) -> DataFrame:
    """List pairs that share more than ``threshold`` percent of either list.

    A list can only overlap that much with another one if they meet in its
    rarest members: with n members and k needed, in the first n - k + 1 of them.
    So only that prefix looks for partners, and the frequent contacts at the end
    of the order do not pair up all of their lists. Then the pairs are counted.
    """
    members = members.select("list_id", "contact_id").distinct()
    sizes = members.groupBy("list_id").agg(F.count(F.lit(1)).alias("size"))
    degrees = members.groupBy("contact_id").agg(F.count(F.lit(1)).alias("degree"))
    hot_people = hot_counted(degrees, ["contact_id"], "degree")
    hot_lists = hot_counted(sizes, ["list_id"], "size")
    ranked = salted_join(members, degrees, ["contact_id"], "inner", ["list_id"], hot_people)
    placed = position_within(ranked, ["list_id"], ["degree", "contact_id"])
    placed = salted_join(placed, sizes, ["list_id"], "inner", ["contact_id"], hot_lists)
    needed = (F.floor(F.col("size") * F.lit(threshold / 100.0) + F.lit(1e-9)) + 1).alias("needed")
    prefix = placed.select("*", needed).filter(F.col("position") <= F.col("size") - F.col("needed") + 1).select(
        F.col("list_id").alias("list_1"), "contact_id", F.col("size").alias("size_1"), "needed")
    others = placed.select(F.col("list_id").alias("list_2"), "contact_id", F.col("size").alias("size_2"))
    # a contact of very many lists on both sides is split both ways; a list that is too small cannot hold enough
    met = grid_join(prefix, others, ["contact_id"], ["list_1"], ["list_2"]).filter("list_1 <> list_2 and size_2 >= needed")
    first = F.col("list_1") < F.col("list_2")

    def ordered(a: str, b: str) -> Column:
        return F.when(first, F.col(a)).otherwise(F.col(b))

    sized = met.select(
        *[ordered(f"{c}_1", f"{c}_2").alias(f"{c}_1") for c in ("list", "size")],
        *[ordered(f"{c}_2", f"{c}_1").alias(f"{c}_2") for c in ("list", "size")]).distinct()
    # count from the members of the smaller list
    small_first = F.col("size_1") <= F.col("size_2")
    driven = sized.select(
        "*", F.when(small_first, F.col("list_1")).otherwise(F.col("list_2")).alias("_small"),
        F.when(small_first, F.col("list_2")).otherwise(F.col("list_1")).alias("_large"))
    walked = grid_join(driven, members.withColumnRenamed("list_id", "_small"), ["_small"], ["_large"], ["contact_id"])
    shared = walked.join(members.withColumnRenamed("list_id", "_large"), ["_large", "contact_id"], "left_semi")
    counted = shared.groupBy("list_1", "list_2", "size_1", "size_2").agg(F.count(F.lit(1)).alias("shared"))
    part_1, part_2 = (F.lit(100.0) * F.col("shared") / F.col(s) for s in ("size_1", "size_2"))
    return counted.filter((part_1 > threshold) | (part_2 > threshold)).select(
        "list_1", "list_2", "shared", F.round(part_1, 4).alias("pct_1"), F.round(part_2, 4).alias("pct_2"))


def list_hygiene(lists: DataFrame, members: DataFrame, contacts: DataFrame, as_of, unfit: Column,
                 unused_months: int = 6) -> DataFrame:
    """Flags per list: empty, unused, and how many members are unfit or gone.

    Members are counted per list before the lists are joined.
    """
    people = contacts.select(F.col("id").alias("contact_id"), F.coalesce(unfit, F.lit(False)).alias("_unfit"))
    checked = salted_join(members, people, ["contact_id"], "left", spread=["list_id"])
    counts = checked.groupBy("list_id").agg(
        F.count(F.lit(1)).alias("members"), F.count_if("_unfit").alias("unfit"),
        F.count_if(F.col("_unfit").isNull()).alias("deleted"))
    cut = F.add_months(t.as_timestamp(as_of).cast("date"), -unused_months)
    joined = lists.join(counts, "list_id", "left").fillna(0, ["members", "unfit", "deleted"])
    return joined.select(
        "list_id", "members", "unfit", "deleted", (F.col("members") == 0).alias("is_empty"),
        F.coalesce(F.col("last_used") < cut, F.lit(True)).alias("is_unused"))


def validate_lists(members: DataFrame, contacts: DataFrame) -> DataFrame:
    """Per list, what would go wrong in a campaign, and the deliverable share before and after.

    Cleaning drops opted-out and bounced members and merges duplicates; bad addresses wait for
    a review, so they still count against ``clean_deliverable_pct``. Duplicates are further members with an address that the list already has.
    """
    from rowmender.operators.rules import EMAIL_PATTERN

    people = contacts.select(
        F.col("id").alias("contact_id"), t.email_key("email").alias("address"),
        (~F.coalesce(F.col("email").rlike(EMAIL_PATTERN), F.lit(False))).alias("bad_address"),
        F.col("unsubscribed_at").isNotNull().alias("opted_out"),
        F.coalesce(F.col("hard_bounced") == "true", F.lit(False)).alias("bounced"))
    joined = salted_join(members, people, ["contact_id"], "inner", spread=["list_id"])
    flags = ("bad_address", "opted_out", "bounced")
    fit = ~(F.col("bad_address") | F.col("opted_out") | F.col("bounced"))
    # per address first: it takes the hot lists apart and finds the duplicates
    per_address = joined.groupBy("list_id", "address").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(fit).alias("fit"), F.count_if(~(F.col("opted_out") | F.col("bounced"))).alias("stay"), *[F.count_if(f).alias(f) for f in flags])
    counts = per_address.groupBy("list_id").agg(
        F.sum("n").alias("members"), F.sum("fit").alias("deliverable"), *[F.sum(f).alias(f) for f in flags],
        F.sum(F.when(F.col("address").isNotNull(), F.col("n") - 1).otherwise(0)).alias("duplicates"),
        F.sum(F.when(F.col("address").isNotNull() & (F.col("fit") > 0), 1).otherwise(0)).alias("clean_size"),
        F.sum(F.when(F.col("address").isNull(), F.col("stay")).when(F.col("stay") > 0, 1).otherwise(0)).alias("_stay"))
    after = F.when(F.col("_stay") > 0, F.round(F.lit(100.0) * F.col("clean_size") / F.col("_stay"), 4))
    return counts.withColumn("clean_deliverable_pct", after).drop("_stay").withColumn("deliverable_pct", F.round(F.lit(100.0) * F.col("deliverable") / F.col("members"), 4))
