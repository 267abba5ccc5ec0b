"""Contacts without a rule finding that still deserve a look."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rowmender.config import CaseSettings
from rowmender.operators.skew import ordered_position
from rowmender.schemas import require_columns

# fixed values: names and words that mark a review case
SHORT_NAMES = ("Jon", "Mike", "Bob", "Bill", "Inc", "LLC")
TECH_TITLES = ("Engineer", "Developer", "Programmer", "CTO", "Tech Lead")
OTHER_INDUSTRIES = ("Agriculture", "Construction", "Retail", "Food Service")
SUSPICIOUS_COMPANIES = ("test", "example", "sample", "unknown", "n/a", "none")


def _has_any(c: Column, words: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(c, F.lit(w))
    return F.coalesce(hit, F.lit(False))


def _case(kind: str, description: Column | str, reasoning: bool, exploration: bool, rank: int) -> Column:
    return F.struct(
        F.lit(rank).alias("case_rank"),
        F.lit(kind).alias("type"),
        (F.lit(description) if isinstance(description, str) else description).alias("description"),
        F.lit(reasoning).alias("needs_reasoning"),
        F.lit(exploration).alias("needs_exploration"),
    )


def case_columns(settings: CaseSettings) -> list[Column]:
    cases = []
    if settings.analyze_name_typos:
        short = F.coalesce(F.col("firstname").isin(*SHORT_NAMES), F.lit(False)) | F.coalesce(
            F.col("lastname").isin(*SHORT_NAMES), F.lit(False))
        cases.append(F.when(short, _case(
            "name_typo", "Potential nickname or abbreviation that may need standardization", True, False, 1)))
    if settings.analyze_semantic_anomalies:
        title, industry, company = F.col("jobtitle"), F.col("industry"), F.col("company")
        mismatch = _has_any(title, TECH_TITLES) & _has_any(industry, OTHER_INDUSTRIES)
        odd_title = F.concat(
            F.lit('Tech job title "'), title, F.lit('" in non-tech industry "'), industry,
            F.lit('" - may be valid or data error'))
        odd_company = F.concat(
            F.lit('Company name "'), company, F.lit('" looks suspicious - may be test data'))
        cases.append(
            F.when(mismatch, _case("semantic_anomaly", odd_title, True, True, 2))
            .when(_has_any(F.lower(company), SUSPICIOUS_COMPANIES),
                  _case("context_dependent", odd_company, False, True, 2)))
    return cases


def review_cases(contacts: DataFrame, issues: DataFrame, settings: CaseSettings = CaseSettings()) -> DataFrame:
    """Cases of the contacts that have no issue at all."""
    df = require_columns(contacts, ["firstname", "lastname", "jobtitle", "industry", "company"])
    cases = case_columns(settings)
    # find the few contacts with a case first, so that only they are shuffled
    found = df.select("id", F.array_compact(F.array(*cases)).alias("found")).filter(F.size("found") > 0)
    flagged = issues.select(F.col("object_id").alias("id")).distinct()
    flat = found.join(flagged, "id", "left_anti").select("id", F.explode("found").alias("c"))
    return flat.select(F.col("id").alias("contact_id"), "c.*")


def case_batches(cases: DataFrame, settings: CaseSettings = CaseSettings()) -> DataFrame:
    """Every case, once for each kind of review it needs, with its position and batch."""
    placed = ordered_position(cases, ["contact_id", "case_rank"])
    routes = F.array_compact(F.array(
        F.when(F.col("needs_reasoning"), F.lit("reasoning")),
        F.when(F.col("needs_exploration"), F.lit("exploratory"))))
    batch = F.floor((F.col("position") - 1) / settings.batch_size).cast("int").alias("batch")
    return placed.select("*", F.explode(routes).alias("route")).select(
        "contact_id", "case_rank", "type", "description", "route", "position", batch)


FLAGS = ("is_obvious", "high_confidence", "requires_reasoning", "medium_complexity",
         "requires_context", "high_impact", "strategic", "multi_factored")


def analysis_mode() -> Column:
    """Kind of analysis a set of flags asks for; the cheapest one by default."""
    def both(a: str, b: str) -> Column:
        return F.col(a) & F.col(b)

    return (
        F.when(both("is_obvious", "high_confidence"), "simple")
        .when(both("requires_reasoning", "medium_complexity"), "reasoning")
        .when(both("requires_context", "high_impact"), "exploratory")
        .when(both("strategic", "multi_factored"), "iterative")
        .otherwise("simple")
    )
