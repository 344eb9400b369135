"""Documents against a table of rules."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions import text as T


def rule_hits(docs: DataFrame, rules: list[tuple]) -> DataFrame:
    """One row per document and pattern that occurs: family, rule_id, pattern_id, n, first_pos.

    rules: rows (family, rule_id, pattern_id, kind, pattern, label). The rules become one expression over the text of
    a row, so a document is read once for all of them and nothing is joined or shuffled.
    """
    def one(low: str, family: str, rule_id: str, pattern_id: int, pattern: str) -> str:
        return (f"if({T.matches(low, pattern)}, " + T.struct(
            family=T.quote(family), rule_id=T.quote(rule_id), pattern_id=str(pattern_id),
            n=T.count_matches(low, pattern), first_pos=f"{T.first_span(low, pattern)}.start") + ", NULL)")

    def every(_, low: str) -> str:
        return "array_compact(" + T.array(one(low, f, r, i, p) for f, r, i, _, p, _ in rules) + ")"

    found = docs.select("doc_id", "domain", T.over_text(every).alias("hs"))
    return T.explode_rows(found, "hs", "h").select("doc_id", "domain", "h.*")
