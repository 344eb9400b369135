"""Data-subject rights per document, other frameworks, cookie topics and browser signals."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions import text as T
from ..rules import rights as R


def _coverage(text: str, low: str, table, evidence: bool = True) -> str:
    def row(right, where: str) -> str:
        rid, name, article = map(T.quote, right)
        return T.struct(right_id=rid, name=name, article=article, covered=f"{where} IS NOT NULL",
                        evidence=f"if({where} IS NULL, NULL, {T.snippet(text, where, *R.WINDOW)})")

    def bare(right) -> str:
        rid, name, article = map(T.quote, right)
        return T.struct(right_id=rid, name=name, article=article, covered=f"coalesce({T.any_match(low, R.PATTERNS[right[0]])}, false)",
                        evidence="cast(NULL as string)")
    if not evidence:
        return T.array(map(bare, table))
    return T.array(T.let(T.first_of(low, R.PATTERNS[r[0]]), lambda w, r=r: row(r, w)) for r in table)


def covered_share(rights: str, n: int) -> str:
    return f"cast(size(filter({rights}, r -> r.covered)) / {float(n)}D * 100 as int)"


def grade(score: str) -> str:
    return T.scale(score, R.GRADE_CUTS, "F")


def frameworks(low: str) -> str:
    return T.strings(f"if({T.any_match(low, patterns)}, {T.quote(name)}, NULL)" for name, patterns in R.FRAMEWORKS)


def cookie_topics(low: str) -> str:
    return "map(" + ", ".join(f"{T.quote(t)}, {T.any_match(low, p)}" for t, p in R.COOKIE_TOPICS.items()) + ")"


def _analyse(text: str, low: str, evidence: bool = True) -> str:
    def finish(c: str) -> str:
        return T.struct(
            gdpr=f"{c}.gdpr", gdpr_score=f"{c}.g", gdpr_grade=grade(f"{c}.g"), ccpa=f"{c}.ccpa", ccpa_score=f"{c}.c",
            ccpa_grade=grade(f"{c}.c"), frameworks_mentioned=frameworks(low), cookie_compliance=cookie_topics(low),
            dnt_mentioned=T.matches(low, R.DNT_MENTIONED), dnt_honored=T.matches(low, R.DNT_HONOURED),
            global_privacy_control=T.matches(low, R.GPC),
            overall_rights_score=f"cast(({c}.g + {c}.c) / 2D as int)")

    return T.let(T.struct(gdpr=_coverage(text, low, R.GDPR, evidence), ccpa=_coverage(text, low, R.CCPA, evidence)), lambda b: T.let(
        T.struct(gdpr=f"{b}.gdpr", ccpa=f"{b}.ccpa", g=covered_share(f"{b}.gdpr", len(R.GDPR)),
                 c=covered_share(f"{b}.ccpa", len(R.CCPA))), finish))


def detect(docs: DataFrame) -> DataFrame:
    """Adds `rights`."""
    return docs.withColumn("rights", T.over_text(_analyse))


def rows(docs: DataFrame, table) -> DataFrame:
    """One row per document and right of one framework, covered or not."""
    found = docs.select("doc_id", "domain", T.over_text(lambda text, low: _coverage(text, low, table)).alias("rs"))
    return T.explode_rows(found, "rs", "r").select("doc_id", "domain", "r.*")
