"""Marketing contacts: candidates, value, decisions and cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rowmender.config import CompanyProfile, MarketingSettings
from rowmender.functions import text as t


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def obvious_reason(settings: MarketingSettings = MarketingSettings()) -> Column:
    """Why a contact should not be a marketing contact, when that is obvious."""
    internal = t.email_domain("email").isin(*settings.internal_domains) if settings.internal_domains else F.lit(False)
    return (
        F.when(_flag(F.col("hard_bounced") == "true"), "hard_bounced")
        .when(F.col("unsubscribed_at").isNotNull(), "unsubscribed")
        .when(_flag(internal), "internal")
        .when(_flag(F.contains(F.lower("email"), F.lit("test"))), "test_contact")
    )


def obvious_candidates(contacts: DataFrame, settings: MarketingSettings = MarketingSettings()) -> DataFrame:
    marketing = contacts.filter(F.col("hs_marketable_status").isin("true", "MARKETABLE"))
    return marketing.select("id", obvious_reason(settings).alias("reason")).dropna().select(
        "id", "reason", F.lit("convert").alias("action"), F.lit("high").alias("confidence"))


ENGAGED = ("OPENED", "CLICKED", "FORM_SUBMITTED")


def engagement_metrics(contacts: DataFrame, events: DataFrame, deals: DataFrame, as_of) -> DataFrame:
    """Per contact: time since the last engagement, 12-month counts, deals.

    Events and deals are reduced to one row per contact before the joins.
    """
    now = t.as_timestamp(as_of)
    recent = F.col("event_time") >= F.add_months(now.cast("date"), -12)

    def count(kind: str) -> Column:
        return F.count_if(recent & (F.col("event_type") == kind))

    per_event = events.groupBy(F.col("contact_id").alias("id")).agg(
        F.max(F.when(F.col("event_type").isin(*ENGAGED), F.col("event_time"))).alias("last_engaged"),
        count("OPENED").alias("opens_12m"), count("CLICKED").alias("clicks_12m"), count("FORM_SUBMITTED").alias("forms_12m"))
    won = F.col("stage") == "closedwon"
    per_deal = deals.groupBy(F.col("contact_id").alias("id")).agg(
        F.count(F.lit(1)).alias("deals"), F.count_if(~won & (F.col("stage") != "closedlost")).alias("open_deals"),
        F.count_if(won).alias("won_deals"),
        F.sum(F.when(won, F.col("amount").cast("decimal(18,2)"))).alias("won_value"))
    counts = ["opens_12m", "clicks_12m", "forms_12m", "deals", "open_deals", "won_deals"]
    joined = contacts.select("id").join(per_event, "id", "left").join(per_deal, "id", "left").fillna(0, counts)
    return joined.select(
        "id", F.floor(t.days_between(now, F.col("last_engaged"))).alias("days_since_engagement"), *counts,
        F.coalesce(F.col("won_value"), F.lit(0)).cast("double").alias("won_value"))


def icp_fit(contacts: DataFrame, profile: CompanyProfile) -> DataFrame:
    """Matches with the ideal customer profile and a score from 0 to 100."""
    def within(c: str, allowed: tuple[str, ...]) -> Column:
        return _flag(F.lower(c).isin(*[a.lower() for a in allowed])) if allowed else F.lit(False)

    title = F.lit(False)
    for word in profile.job_titles:
        title = title | _flag(F.contains(F.lower("jobtitle"), F.lit(word.lower())))
    flags = contacts.select(
        "id", within("company_size", profile.company_sizes).alias("size_match"),
        within("industry", profile.industries).alias("industry_match"), title.alias("title_match"))
    hits = sum((F.col(c).cast("int") for c in ("size_match", "industry_match", "title_match")), F.lit(0))
    return flags.withColumn("fit", F.round(F.lit(100) * hits / 3).cast("int"))


def decide(contacts: DataFrame, metrics: DataFrame, fit: DataFrame,
           settings: MarketingSettings = MarketingSettings()) -> DataFrame:
    """Convert, keep or monitor each marketing contact; what must be kept is tested first."""
    idle = F.coalesce(F.col("days_since_engagement"), F.lit(100_000))
    no_deal = F.col("deals") == 0
    rule = (
        F.when((F.col("won_deals") > 0) | (F.col("open_deals") > 0) | ((F.col("fit") >= 67) & (idle <= 90)),
               F.struct(F.lit("keep").alias("action"), F.lit("high").alias("confidence")))
        .when(F.col("reason").isNotNull() | ((idle >= 730) & no_deal & (F.col("fit") <= 33)),
              F.struct(F.lit("convert").alias("action"), F.lit("high").alias("confidence")))
        .when((idle >= 540) & no_deal & (F.col("fit") <= 67),
              F.struct(F.lit("convert").alias("action"), F.lit("medium").alias("confidence")))
        .otherwise(F.struct(F.lit("monitor").alias("action"), F.lit("low").alias("confidence")))
    )
    marketing = contacts.filter(F.col("hs_marketable_status").isin("true", "MARKETABLE"))
    base = marketing.select("id", obvious_reason(settings).alias("reason"))
    joined = base.join(metrics, "id").join(fit.select("id", "fit"), "id")
    return joined.select("id", "reason", "fit", "deals", "won_value", rule.alias("d")).select(
        "id", "reason", "fit", "deals", "won_value", "d.*")


def savings(decisions: DataFrame, settings: MarketingSettings = MarketingSettings()) -> DataFrame:
    """One row: conversions by confidence, what they save, and the revenue at risk."""
    convert = F.col("action") == "convert"

    def n(level: str) -> Column:
        return F.count_if(convert & (F.col("confidence") == level))

    total = decisions.agg(
        F.count(F.lit(1)).alias("marketing_contacts"), n("high").alias("high"), n("medium").alias("medium"),
        F.count_if(F.col("confidence") == "low").alias("low"),
        F.count_if(convert & (F.col("deals") > 0)).alias("with_deals"),
        F.coalesce(F.sum(F.when(convert, F.col("won_value").cast("decimal(18,2)"))), F.lit(0)).cast("double").alias("revenue_at_risk"))
    unit = F.lit(settings.unit_cost)
    both = F.col("high") + F.col("medium")
    return total.select(
        "marketing_contacts", "high", "medium", "low", "with_deals", "revenue_at_risk",
        F.round(F.col("marketing_contacts") * unit, 2).alias("monthly_cost"),
        F.round(F.lit(100.0) * F.col("marketing_contacts") / settings.contact_limit, 4).alias("utilization_pct"),
        F.round(F.col("high") * unit, 2).alias("immediate_monthly"), F.round(both * unit, 2).alias("potential_monthly"),
        F.round(both * unit * 12, 2).alias("annual"),
        F.when(both > 0, F.round((both * unit * 12 - F.col("revenue_at_risk")) / (both * unit * 12), 4)).alias("return_to_risk"),
        F.when(F.col("with_deals") > 0, "Review high-value contacts first").otherwise("Proceed").alias("recommendation"))


def retention_breaches(contacts: DataFrame, as_of, idle_years: int = 3, opt_out_years: int = 2) -> DataFrame:
    """Counts of contacts kept longer than their data should be; one contact may breach several rules."""
    from rowmender.operators.rules import last_activity

    today = t.as_timestamp(as_of).cast("date")
    breaches = F.array_compact(F.array(
        F.when(last_activity(contacts) < F.add_months(today, -12 * idle_years), F.lit("inactive")),
        F.when(t.instant(contacts, "unsubscribed_at") < F.add_months(today, -12 * opt_out_years), F.lit("opted_out")),
        F.when(F.col("hard_bounced") == "true", F.lit("bounced"))))
    return contacts.select(F.explode(breaches).alias("breach")).groupBy("breach").agg(F.count(F.lit(1)).alias("contacts"))


def deletion_candidates(contacts: DataFrame, metrics: DataFrame, as_of, retention_years: int = 3) -> DataFrame:
    """One row: contacts that could be deleted, by reason, and marketing contacts without each kind of engagement."""
    from rowmender.operators.rules import last_activity

    today = t.as_timestamp(as_of).cast("date")
    base = contacts.select(
        "id", _flag(F.contains(F.lower("email"), F.lit("test")) | F.contains(F.lower("company"), F.lit("test"))).alias("test"),
        _flag(t.email_domain("email").isin("example.com", "test.com")).alias("spam"),
        _flag(F.col("hard_bounced") == "true").alias("bounced"),
        _flag(last_activity(contacts) < F.add_months(today, -12 * retention_years)).alias("expired"),
        _flag(F.col("hs_marketable_status").isin("true", "MARKETABLE")).alias("marketing"))
    joined = base.join(metrics, "id")
    idle = (F.col("opens_12m") + F.col("clicks_12m") + F.col("forms_12m")) == 0
    return joined.agg(
        F.count_if("test").alias("test"), F.count_if("spam").alias("spam"),
        F.count_if(F.col("bounced") & idle).alias("bounced_inactive"), F.count_if("expired").alias("past_retention"),
        *[F.count_if(F.col("marketing") & (F.col(c) == 0)).alias(f"no_{c}") for c in ("opens_12m", "clicks_12m", "forms_12m")])


def limit_forecast(contacts: DataFrame, as_of, settings: MarketingSettings = MarketingSettings(),
                   created: str = "createdate") -> DataFrame:
    """One row: marketing contacts used, the limit, monthly growth and months to the limit.

    Growth is the mean of the months with a new contact.
    """
    marketing = contacts.filter(F.col("hs_marketable_status").isin("true", "MARKETABLE"))
    monthly = marketing.groupBy(F.date_trunc("month", F.col(created).cast("timestamp")).alias("month")).agg(
        F.count(F.lit(1)).alias("n"))
    known = F.col("month").isNotNull() & (F.col("month") <= t.as_timestamp(as_of))
    total = monthly.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("used"), F.sum(F.when(known, F.col("n"))).alias("_new"),
        F.count_if(known).alias("_months"))
    growth = F.col("_new") / F.col("_months")
    room = F.lit(settings.contact_limit) - F.col("used")
    return total.select(
        "used", F.lit(settings.contact_limit).alias("contact_limit"), F.round(growth, 4).alias("monthly_growth"),
        F.when(room <= 0, 0.0).otherwise(F.round(room / growth, 4)).alias("months_to_limit"))
