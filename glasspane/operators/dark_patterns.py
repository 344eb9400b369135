"""Manipulative consent wording per document."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions import text as T
from ..rules import dark_patterns as R


def _snippets(text: str, low: str, kind: str, evidence: bool = True) -> str:
    """Up to two snippets (without evidence, matches): patterns in order, matches of a pattern in order."""
    if not evidence:
        found = ", ".join(f"if({T.matches(low, p)}, slice({T.all_matches(low, p)}, 1, {R.MAX_SNIPPETS}), {T.no_strings()})" for p in R.PATTERNS[kind])
        return f"slice(concat({found}), 1, {R.MAX_SNIPPETS})"
    found = ", ".join(f"if({T.matches(low, p)}, {T.all_spans(low, p, R.MAX_SNIPPETS)}, "
                      f"cast(array() as array<struct<start:int,stop:int>>))" for p in R.PATTERNS[kind])
    return T.each(f"slice(concat({found}), 1, {R.MAX_SNIPPETS})", lambda s: T.snippet(text, s, *R.WINDOW))


def _detect(text: str, low: str, evidence: bool = True) -> str:
    def row(i: int, found: str) -> str:
        kind, name, severity, reference = map(T.quote, R.TYPES[i])
        return (f"if(size({found}) > 0, " + T.struct(
            ord=str(i), pattern_type=kind, name=name, severity=severity, gdpr_reference=reference,
            evidence=found if evidence else "cast(NULL as array<string>)",
            confidence=f"round(least(1D, 0.6D + size({found}) * 0.1D), 2)") + ", NULL)")

    def gated(kind: str, found: str) -> str:
        first = T.gate(low, R.PATTERNS[kind])
        return f"if({first}, {found}, NULL)" if first else found
    return "array_compact(" + T.array(
        gated(t[0], T.let(_snippets(text, low, t[0], evidence), lambda e, i=i: row(i, e))) for i, t in enumerate(R.TYPES)) + ")"


def count_severity(found: str, severity: str) -> str:
    return f"size({T.keep(found, lambda d: f'{d}.severity = ' + T.quote(severity))})"


def overall_risk(high: str, medium: str, low: str) -> str:
    return (f"CASE WHEN {high} >= 2 THEN 'critical' WHEN {high} >= 1 THEN 'high' WHEN {medium} >= 2 THEN 'medium' "
            f"WHEN {medium} + {low} >= 1 THEN 'low' ELSE 'none' END")


def consent_quality(explicit: str, granular: str, withdrawal: str, found: str, high: str) -> str:
    return (f"CASE WHEN {explicit} AND {granular} AND {withdrawal} AND {found} = 0 THEN 'good' "
            f"WHEN {explicit} AND {withdrawal} THEN 'adequate' WHEN {high} >= 1 THEN 'poor' ELSE 'unclear' END")


def _analyse(text: str, low: str, evidence: bool = True) -> str:
    def counted(d: str) -> str:
        return T.struct(detected=d, count=f"size({d})", high=count_severity(d, "high"),
                        medium=count_severity(d, "medium"), low=count_severity(d, "low"),
                        explicit=T.matches(low, R.EXPLICIT), granular=T.matches(low, R.GRANULAR),
                        withdrawal=T.matches(low, R.WITHDRAWAL))

    def finish(c: str) -> str:
        return T.struct(
            detected=f"{c}.detected", count=f"{c}.count", high_severity_count=f"{c}.high",
            medium_severity_count=f"{c}.medium", low_severity_count=f"{c}.low",
            overall_risk=overall_risk(f"{c}.high", f"{c}.medium", f"{c}.low"),
            explicit_consent=f"{c}.explicit", granular_consent=f"{c}.granular", withdrawal=f"{c}.withdrawal",
            consent_mechanism_quality=consent_quality(f"{c}.explicit", f"{c}.granular", f"{c}.withdrawal",
                                                      f"{c}.count", f"{c}.high"))

    return T.let(_detect(text, low, evidence), lambda d: T.let(counted(d), finish))


def detect(docs: DataFrame) -> DataFrame:
    """Adds `dark_patterns`."""
    return docs.withColumn("dark_patterns", T.over_text(_analyse))


def rows(docs: DataFrame) -> DataFrame:
    """One row per document and kind of manipulative wording."""
    found = docs.select("doc_id", "domain", T.over_text(_detect).alias("ds"))
    return T.explode_rows(found, "ds", "d").select("doc_id", "domain", "d.*")
