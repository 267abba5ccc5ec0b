"""Row rules for contacts, and the pass that applies them.

All rules are evaluated in one pass over the table; no rule shuffles.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from rowmender.config import QualityRules
from rowmender.functions import text as t
from rowmender.functions.urls import is_valid_url
from rowmender.operators.issues import issue_id
from rowmender.schemas import require_columns

MODULE = "data-quality"

# fixed value: shape of an acceptable address
EMAIL_PATTERN = rf"^[^{t.SPACE}@]+@[^{t.SPACE}@]+\.[^{t.SPACE}@]+\z"

RULE_PROPERTIES = (
    "email", "phone", "website", "jobtitle", "company", "industry", "firstname", "lastname",
    "lastmodifieddate", "notes_last_contacted", "hs_analytics_last_visit_timestamp",
)


@dataclass(frozen=True)
class Rule:
    """One row rule: what it reports, and when.

    ``description`` may be a Column when it depends on the row.
    """

    kind: str
    severity: str
    confidence: str
    description: str | Column
    fires: Column
    current: Column | None = None
    suggested: Column | None = None
    field: str = ""
    detail: str = ""


def missing_required(field: str) -> Rule:
    gone = ~F.coalesce(t.present(t.trim_spaces(F.col(field).cast("string"))), F.lit(False))
    return Rule("missing_required_field", "high", "high", f"Missing required field: {field}", gone, field=field)


def invalid_email(field: str = "email") -> Rule:
    c = F.col(field)
    return Rule("invalid_email_format", "high", "high", "Invalid email format",
                t.present(c) & ~c.rlike(EMAIL_PATTERN), c, field=field)


def invalid_phone(field: str = "phone") -> Rule:
    c = F.col(field)
    return Rule("invalid_phone_format", "medium", "medium", "Phone number appears to be incomplete",
                t.present(c) & (t.digit_count(c) < 10), c, field=field)


def invalid_url(field: str = "website") -> Rule:
    c = F.col(field)
    return Rule("invalid_url_format", "low", "low", "Invalid website URL format",
                t.present(c) & ~is_valid_url(c), c, field=field)


def last_activity(df: DataFrame) -> Column:
    return F.greatest(t.instant(df, "notes_last_contacted"), t.instant(df, "hs_analytics_last_visit_timestamp"))


def stale_contact(df: DataFrame, as_of: Column, threshold: int) -> Rule:
    latest = last_activity(df)
    days = t.days_between(as_of, latest)
    text = F.concat(
        F.lit("No activity in "), F.floor(days).cast("string"), F.lit(f" days (threshold: {threshold})"))
    return Rule("stale_contact", "medium", "medium", text, days > threshold, t.iso_timestamp(latest),
                detail="last_activity")


def typos() -> list[Rule]:
    doubled = t.has_double_space

    def padded(f: str) -> Column:
        return F.col(f) != t.trim_spaces(f)

    def typo(f: str, fires: Column, description: str, suggested: Column, detail: str) -> Rule:
        return Rule("obvious_typo", "low", "medium", description, t.present(f) & fires, F.col(f), suggested, f, detail)

    return [
        typo("firstname", doubled("firstname"), "First name contains multiple consecutive spaces",
             t.tidy("firstname"), "firstname-spaces"),
        typo("firstname", padded("firstname"), "First name has leading/trailing spaces",
             t.trim_spaces("firstname"), "firstname-edges"),
        typo("lastname", doubled("lastname") | padded("lastname"), "Last name has formatting issues",
             t.tidy("lastname"), "lastname-format"),
        typo("company", doubled("company") | padded("company"), "Company name has formatting issues",
             t.tidy("company"), "company-format"),
    ]


#: Makes the rules of one name from the table, the date of the audit and the settings.
RuleMaker = Callable[[DataFrame, Column, QualityRules], "Rule | list[Rule]"]
_REGISTERED: dict[str, tuple[tuple[str, ...], RuleMaker]] = {}


def register_rule(name: str, properties: Sequence[str] = ()) -> Callable[[RuleMaker], RuleMaker]:
    """Make a rule of one's own known by name; ``properties`` are the columns that it reads.

    An audit runs it if ``QualityRules.custom_rules`` names it. A name can be taken once.
    """
    def keep(make: RuleMaker) -> RuleMaker:
        if name in _REGISTERED and _REGISTERED[name][1] is not make:
            raise ValueError(f"a rule named {name!r} is registered already")
        _REGISTERED[name] = (tuple(properties), make)
        return make

    return keep


def unregister_rule(name: str) -> None:
    _REGISTERED.pop(name, None)


def named_properties(names: Sequence[str]) -> list[str]:
    """The columns that the named rules read."""
    unknown = [n for n in names if n not in _REGISTERED]
    if unknown:
        raise ValueError(f"unknown rules: {', '.join(unknown)}; known are: {', '.join(sorted(_REGISTERED)) or 'none'}")
    return [p for n in names for p in _REGISTERED[n][0]]


def named_rules(names: Sequence[str], df: DataFrame, as_of: Column, rules: QualityRules) -> list[Rule]:
    made = [_REGISTERED[n][1](df, as_of, rules) for n in names]
    return [r for one in made for r in (one if isinstance(one, list) else [one])]


def contact_rules(df: DataFrame, as_of: Column, rules: QualityRules) -> list[Rule]:
    return [
        *[missing_required(f) for f in rules.required_contact_fields],
        invalid_email(),
        invalid_phone(),
        invalid_url(),
        stale_contact(df, as_of, rules.stale_contact_days),
        *typos(),
        *named_rules(rules.custom_rules, df, as_of, rules),
    ]


def run_rules(df: DataFrame, rules: list[Rule], module: str, object_type: str = "contact") -> DataFrame:
    """Evaluate the rules in one pass and give one row per finding.

    Only what depends on the row goes through the array; the fixed texts of a
    rule are looked up afterwards in a constant.
    """
    none = F.lit(None).cast("string")

    def found(n: int, r: Rule) -> Column:
        text = r.description if isinstance(r.description, Column) else none
        return F.when(r.fires, F.struct(
            F.lit(n).alias("rule_no"), (none if r.current is None else r.current).alias("current_value"),
            (none if r.suggested is None else r.suggested).alias("suggested_value"), text.alias("text")))

    fixed = F.array(*[
        F.struct(
            F.lit(r.kind).alias("type"), F.lit(r.severity).alias("severity"), F.lit(r.confidence).alias("confidence"),
            F.lit(r.description if isinstance(r.description, str) else "").alias("description"),
            F.lit(r.field).alias("field"), F.lit(r.detail or r.field).alias("detail"))
        for r in rules])
    hits = df.select("id", F.array_compact(F.array(*[found(n, r) for n, r in enumerate(rules)])).alias("hits"))
    flat = hits.filter(F.size("hits") > 0).select("id", F.inline("hits"))
    rows = flat.withColumn("r", fixed[F.col("rule_no")])
    return rows.select(
        issue_id(F.lit(module), F.col("r.type"), F.col("id"), F.col("r.detail")).alias("issue_id"),
        F.lit(module).alias("module"),
        "r.type",
        "r.severity",
        F.lit(object_type).alias("object_type"),
        F.col("id").alias("object_id"),
        F.coalesce("text", "r.description").alias("description"),
        "current_value",
        "suggested_value",
        "r.confidence",
        F.lit("rule").alias("detection_method"),
        none.alias("reasoning"),
        "r.field",
        "rule_no",
    )


def audit_contacts(contacts: DataFrame, as_of, rules: QualityRules = QualityRules()) -> DataFrame:
    """All rule findings of a contact table, one row each."""
    df = require_columns(contacts, [*rules.required_contact_fields, *RULE_PROPERTIES, *named_properties(rules.custom_rules)])
    return run_rules(df, contact_rules(df, t.as_timestamp(as_of), rules), MODULE)


def audit_companies(companies: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    df = require_columns(companies, rules.required_company_fields)
    return run_rules(df, [missing_required(f) for f in rules.required_company_fields], "company-quality", "company")

