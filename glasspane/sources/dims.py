"""Rule and lookup tables as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..rules import dark_patterns, data_types, pages, recipients, retention, rights, trackers, trust, wording

# Largest dimension that is sent to every executor; a bigger one is joined by shuffle.
BROADCAST_ROWS = 200_000


def small(dim: DataFrame, rows: int) -> DataFrame:
    """Broadcast hint, only for a dimension of a known and bounded size."""
    return F.broadcast(dim) if rows <= BROADCAST_ROWS else dim


def tracker_rows() -> list[tuple]:
    """One row per host without "www."; a later duplicate wins."""
    by_host = {}
    for domain, *rest in trackers.TRACKERS:
        domain = domain.removeprefix("www.")
        by_host[domain] = (domain, *rest)
    return list(by_host.values())


def tracker_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        tracker_rows(), "domain string, name string, category string, risk string, fingerprinting boolean, "
                        "session_recording boolean, opt_out string")


def party_key(name: str) -> str:
    return name.lower().rstrip(".")


def trust_rows() -> list[tuple]:
    """One row per lower-cased name without dots at the end."""
    by_name = {}
    for name, *rest in trust.PARTIES:
        by_name[party_key(name)] = (party_key(name), *(list(x) if isinstance(x, tuple) else x for x in rest))
    return list(by_name.values())


def trust_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        trust_rows(), "name_lc string, category string, trust_score int, gdpr_compliant boolean, us_based boolean, "
                      "is_data_broker boolean, typical_data array<string>, purposes array<string>, "
                      "opt_out_url string, privacy_url string")


def company_page_rows() -> list[tuple]:
    return [(company, label, url) for company, found in trust.COMPANY_PAGES.items() for label, url in found.items()]


def company_page_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(company_page_rows(), "company_lc string, label string, url string")


def rule_rows() -> list[tuple]:
    """All rules as (family, rule_id, pattern_id, kind, pattern, label)."""
    out = []

    def add(family, rule, kind, patterns, label=None):
        out.extend((family, rule, i, kind, p, label) for i, p in enumerate(patterns))

    for cid, label, *_ in data_types.CATEGORIES:
        add("data_keyword", cid, "literal", data_types.KEYWORDS[cid], label)
        add("data_phrase", cid, "regex", data_types.PHRASES[cid], label)
    add("data_sharing", "shared", "regex", data_types.SHARING)
    add("retention_period", "kept_for", "regex", (retention.KEPT_FOR + "(" + retention.PERIOD + ")",))
    add("retention_period", "lasts_for", "regex", (retention.LASTS_FOR + "(" + retention.PERIOD + ")",))
    for i, (p, label) in enumerate(retention.EVENTS):
        add("retention_event", f"event_{i}", "regex", (p,), label)
    add("retention_vague", "vague", "regex", retention.VAGUE, retention.VAGUE_TEXT)
    add("retention_flag", "deletion_on_request", "regex", (retention.DELETION_ON_REQUEST,))
    add("retention_flag", "storage_limitation", "regex", (retention.STORAGE_LIMITATION,))
    add("retention_flag", "indefinite", "regex", (retention.INDEFINITE,))
    add("vague_term", "vague", "literal", wording.VAGUE_TERMS)
    add("hedge", "hedge", "literal", wording.HEDGES)
    add("vague_purpose", "purpose", "literal", wording.VAGUE_PURPOSES)
    add("specific_purpose", "purpose", "regex", wording.SPECIFIC_PURPOSES)
    add("known_name", "name", "literal", wording.KNOWN_NAMES)
    add("legal_entity", "entity", "regex", (wording.LEGAL_ENTITY,))
    add("passive", "passive", "regex", wording.PASSIVE)
    add("active", "active", "regex", wording.ACTIVE)
    for group, patterns in wording.ACCOUNTABILITY.items():
        add("accountability", group, "regex", patterns)
    for kind, label, *_ in dark_patterns.TYPES:
        add("dark_pattern", kind, "regex", dark_patterns.PATTERNS[kind], label)
    add("consent_quality", "explicit", "regex", (dark_patterns.EXPLICIT,))
    add("consent_quality", "granular", "regex", (dark_patterns.GRANULAR,))
    add("consent_quality", "withdrawal", "regex", (dark_patterns.WITHDRAWAL,))
    for family, table in (("gdpr_right", rights.GDPR), ("ccpa_right", rights.CCPA)):
        for rid, label, _ in table:
            add(family, rid, "regex", rights.PATTERNS[rid], label)
    for label, patterns in rights.FRAMEWORKS:
        add("framework", label, "regex", patterns, label)
    for topic, patterns in rights.COOKIE_TOPICS.items():
        add("cookie_topic", topic, "regex", patterns)
    add("browser_signal", "dnt_mentioned", "regex", (rights.DNT_MENTIONED,))
    add("browser_signal", "dnt_honoured", "regex", (rights.DNT_HONOURED,))
    add("browser_signal", "gpc", "regex", (rights.GPC,))
    add("unnamed_recipient", "reference", "regex", recipients.UNNAMED)
    for purpose, patterns in recipients.PURPOSES.items():
        add("sharing_purpose", purpose, "regex", patterns)
    add("data_sale", "sale", "regex", (recipients.SALE,))
    add("transfer", "transfer", "regex", recipients.TRANSFERS)
    for name, p in recipients.SAFEGUARDS:
        add("safeguard", name, "regex", (p,), name)
    add("fingerprinting", "script", "regex", pages.FINGERPRINTING)
    add("recording", "script", "regex", pages.RECORDING)
    for name, patterns in pages.CONSENT_PLATFORMS:
        add("consent_platform", name, "regex", patterns, name)
    return out
