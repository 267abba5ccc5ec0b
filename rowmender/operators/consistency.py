"""Checks and lookups across contacts, companies, deals and pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rowmender.functions import text as t
from rowmender.operators.skew import hot_keys, salted_join
from rowmender.session import cut_lineage


def associate_by_domain(contacts: DataFrame, companies: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """The company whose domain a contact's address has, where none is associated yet.

    A large company's domain is a hot key, hence the salted join. Of companies
    with one domain the smallest id is taken.
    """
    domains = companies.filter(t.present("domain")).groupBy(F.lower("domain").alias("domain")).agg(
        F.min("id").alias("company_id"))
    people = contacts.select("id", t.email_domain("email").alias("domain")).filter("domain <> ''")
    if edges is not None:
        linked = edges.filter("from_type = 'contact' AND to_type = 'company'").select(F.col("from_id").alias("id")).distinct()
        people = people.join(linked, "id", "left_anti")
    return salted_join(people, domains, ["domain"], "inner", spread=["id"]).select("id", "domain", "company_id")


def cross_object_checks(contacts: DataFrame, deals: DataFrame, edges: DataFrame) -> DataFrame:
    """Customers without a won deal, and contacts without a company."""
    won = deals.filter("stage = 'closedwon'").select(F.col("contact_id").alias("id")).distinct()
    linked = edges.filter("from_type = 'contact' AND to_type = 'company'").select(F.col("from_id").alias("id")).distinct()
    customers = contacts.filter("lifecyclestage = 'customer'").select("id").join(won, "id", "left_anti")
    alone = contacts.select("id").join(linked, "id", "left_anti")
    return customers.withColumn("check", F.lit("customer_without_won_deal")).unionByName(
        alone.withColumn("check", F.lit("contact_without_company")))


def contact_metrics(contacts: DataFrame, events: DataFrame, deals: DataFrame, members: DataFrame) -> DataFrame:
    """Per contact what helps to choose between two records."""
    from rowmender.operators.sets import completeness

    n = F.count(F.lit(1))
    key = F.col("contact_id").alias("id")
    out = contacts.select("id", completeness(contacts).alias("filled"))
    for df, name in ((events, "events"), (deals, "deals"), (members, "lists")):
        out = out.join(df.groupBy(key).agg(n.alias(name)), "id", "left")
    return out.fillna(0, ["events", "deals", "lists"])


def pair_profile(pairs: DataFrame, metrics: DataFrame) -> DataFrame:
    """Pairs with the metrics of both contacts side by side."""
    names = [c for c in metrics.columns if c != "id"]
    # both are read several times
    out = pairs = cut_lineage(pairs)
    metrics = cut_lineage(metrics)
    for side in ("1", "2"):
        mine = metrics.select(F.col("id").alias(f"id_{side}"), *[F.col(c).alias(f"{c}_{side}") for c in names])
        out = salted_join(out, mine, [f"id_{side}"], "inner", spread=["id_1", "id_2"], hot=hot_keys(pairs, [f"id_{side}"]))
    return out
