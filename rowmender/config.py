"""Audit settings, as plain dataclasses handed to the operators."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class CompanyProfile:
    """Ideal customer profile used by the fit score."""

    company_sizes: tuple[str, ...] = ()
    industries: tuple[str, ...] = ()
    job_titles: tuple[str, ...] = ()


@dataclass(frozen=True)
class QualityRules:
    required_contact_fields: tuple[str, ...] = ("email", "firstname", "lastname")
    required_company_fields: tuple[str, ...] = ("name", "domain")
    stale_contact_days: int = 365
    min_engagement_months: int = 12
    industry_mappings: dict[str, str] = field(default_factory=dict)
    # names of registered rules to run beside the built-in ones
    custom_rules: tuple[str, ...] = ()


@dataclass(frozen=True)
class CaseSettings:
    """Which contacts go to review although no rule fired."""

    enable_ambiguous_analysis: bool = True
    batch_size: int = 100
    analyze_name_typos: bool = True
    analyze_semantic_anomalies: bool = True


@dataclass(frozen=True)
class DuplicateSettings:
    exact_email_match: bool = True
    exact_phone_and_company_match: bool = True
    exact_name_and_company_match: bool = True
    default_country_code: str = "US"
    fuzzy_match_threshold: float = 0.85
    max_fuzzy_distance: int = 2


@dataclass(frozen=True)
class MarketingSettings:
    internal_domains: tuple[str, ...] = ()
    unit_cost: float = 0.40
    contact_limit: int = 10_000


@dataclass(frozen=True)
class AuditConfig:
    profile: CompanyProfile = CompanyProfile()
    rules: QualityRules = QualityRules()
    cases: CaseSettings = CaseSettings()
    duplicates: DuplicateSettings = DuplicateSettings()
    marketing: MarketingSettings = MarketingSettings()
