"""Audits by name: functions from tables to an issue table."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from rowmender.config import AuditConfig
from rowmender.operators import duplicates, lists, marketing, properties, rules
from rowmender.operators.issues import issue_id
from rowmender.schemas import ISSUE_COLUMNS

Audit = Callable[[dict[str, DataFrame], AuditConfig, object], DataFrame]

AUDITS: dict[str, Audit] = {}


def audit(name: str) -> Callable[[Audit], Audit]:
    """Register an audit under a name."""
    def add(function: Audit) -> Audit:
        AUDITS[name] = function
        return function
    return add


@audit("data-quality")
def data_quality(tables: dict[str, DataFrame], config: AuditConfig, as_of) -> DataFrame:
    return rules.audit_contacts(tables["contacts"], as_of, config.rules)


@audit("company-quality")
def company_quality(tables: dict[str, DataFrame], config: AuditConfig, as_of) -> DataFrame:
    return rules.audit_companies(tables["companies"], config.rules)


@audit("duplicates")
def duplicate_contacts(tables: dict[str, DataFrame], config: AuditConfig, as_of) -> DataFrame:
    return duplicates.pairs_to_issues(duplicates.exact_pairs(tables["contacts"], config.duplicates))


def as_issues(found: DataFrame, module: str, object_type: str, object_id: Column, kind: Column, severity: Column,
              description: Column, current: Column, suggested: Column, confidence: Column, field: Column, key: Column | None = None) -> DataFrame:
    """Findings of an analysis in the columns of an issue table; ``key`` tells findings of one field apart."""
    return found.select(
        issue_id(F.lit(module), kind, object_id, field if key is None else key).alias("issue_id"), F.lit(module).alias("module"), kind.alias("type"),
        severity.alias("severity"), F.lit(object_type).alias("object_type"), object_id.alias("object_id"), description.alias("description"),
        current.cast("string").alias("current_value"), suggested.cast("string").alias("suggested_value"), confidence.alias("confidence"),
        F.lit("rule").alias("detection_method"), F.lit(None).cast("string").alias("reasoning"), field.alias("field"), F.lit(0).alias("rule_no"),
    ).select(*ISSUE_COLUMNS)


@audit("properties")
def property_findings(tables: dict[str, DataFrame], config: AuditConfig, as_of) -> DataFrame:
    """Columns that are hardly filled, and spellings that differ from the usual one."""
    contacts, none = tables["contacts"], F.lit(None).cast("string")
    names = [c for c in contacts.columns if c != "id"]
    rare = properties.low_population(properties.property_usage(contacts, names))
    out = as_issues(
        rare, "properties", "property", F.col("property"), F.lit("low_population"), F.lit("low"),
        F.concat(F.lit("Property is filled in "), F.col("fill_rate").cast("string"), F.lit("% of the records")), F.col("fill_rate"), none,
        F.lit("high"), F.col("property"))
    if "industry" in names:
        variants = properties.value_variants(contacts, "industry", dict(config.rules.industry_mappings))
        out = out.unionByName(as_issues(
            variants, "properties", "property", F.lit("industry"), F.lit("value_variant"), F.lit("low"),
            F.concat(F.lit('Value "'), F.col("variant"), F.lit('" is a variant of "'), F.col("standard"), F.lit('"')), F.col("variant"), F.col("standard"),
            F.lit("high"), F.concat(F.lit("industry="), F.col("variant")), F.concat_ws("=", "kind", "variant", "standard")))
    return out


@audit("lists")
def list_findings(tables: dict[str, DataFrame], config: AuditConfig, as_of) -> DataFrame:
    """Lists that are empty, unused, or hold members who cannot be mailed."""
    unfit = (F.col("hard_bounced") == "true") | F.col("unsubscribed_at").isNotNull()
    flags = lists.list_hygiene(tables["lists"], tables["members"], tables["contacts"], as_of, unfit)
    invalid, none = F.col("unfit") + F.col("deleted"), F.lit(None).cast("string")
    kinds = F.array_compact(F.array(
        F.when(F.col("is_empty"), F.struct(F.lit("empty_list").alias("kind"), F.lit("List has no members").alias("text"))),
        F.when(F.col("is_unused"), F.struct(F.lit("unused_list").alias("kind"), F.lit("List was not used in six months").alias("text"))),
        F.when(invalid > 0, F.struct(F.lit("invalid_members").alias("kind"), F.concat(
            F.lit("List has "), invalid.cast("string"), F.lit(" members who cannot be mailed")).alias("text")))))
    rows = flags.select("list_id", invalid.alias("invalid"), F.inline(kinds))
    return as_issues(
        rows, "lists", "list", F.col("list_id"), F.col("kind"), F.when(F.col("kind") == "invalid_members", "medium").otherwise("low"),
        F.col("text"), F.when(F.col("kind") == "invalid_members", F.col("invalid")), none, F.lit("high"), F.lit(""))


@audit("marketing")
def marketing_findings(tables: dict[str, DataFrame], config: AuditConfig, as_of) -> DataFrame:
    """Marketing contacts that need not be paid for."""
    found = marketing.obvious_candidates(tables["contacts"])
    return as_issues(
        found, "marketing", "contact", F.col("id"), F.lit("convert_to_non_marketing"), F.lit("medium"),
        F.concat(F.lit("Marketing contact can be converted: "), F.replace("reason", F.lit("_"), F.lit(" "))), F.lit("true"), F.lit("false"),
        F.col("confidence"), F.lit("hs_marketable_status"))


def run_audits(names: Iterable[str], tables: dict[str, DataFrame], config: AuditConfig, as_of) -> DataFrame:
    """The issues of several audits, told apart by their ``module``."""
    return reduce(DataFrame.unionByName, [AUDITS[n](tables, config, as_of) for n in names])
