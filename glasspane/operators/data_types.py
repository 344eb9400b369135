"""Personal-data categories per document, with evidence and a sharing flag."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..rules import data_types as R

FIELDS = ("ord", "category_id", "name", "sensitivity", "gdpr_special_category", "gdpr_article", "ccpa_category")


def _window(at: str, before: int, after) -> str:
    return T.let(at, lambda x: T.span(f"{x} - {before}", f"{x} + {after}"))


def _keywords(low: str, cid: str, match: str) -> str:
    return (T.words_in if match == "word" else T.literals_in)(low, R.KEYWORDS[cid])


def _windows(low: str, cid: str, match: str, found: str) -> str:
    """Evidence windows: the first keywords found, then the first hit of each collection phrase."""
    before, after = R.KEYWORD_WINDOW
    start = (lambda k: T.word_start(low, k)) if match == "word" else (lambda k: f"instr({low}, {k}) - 1")
    words = T.each(f"slice({found}, 1, {R.MAX_KEYWORDS})",
                   lambda k: _window(start(k), before, f"length({k}) + {after}"))
    before, after = R.PHRASE_WINDOW
    phrases = T.array(f"if({T.matches(low, p)}, {_window(T.first_span(low, p) + '.start', before, after)}, NULL)"
                      for p in R.PHRASES[cid])
    return f"slice(concat({words}, array_compact({phrases})), 1, {R.MAX_EVIDENCE})"


def _detect(text: str, low: str, match: str, evidence: bool = True) -> str:
    """Categories of a text. Without evidence, windows are only cut out where the text shares data at all."""
    none = "cast(NULL as array<string>)"

    def near(window: str) -> str:
        return T.let(f"greatest({window}.start, 0)", lambda at: T.let(
            T.cut(low, f"{at} - {R.SHARING_RADIUS}", f"{at} + {R.SHARING_RADIUS}"),
            lambda around: T.any_match(around, R.SHARING)))

    def category(i: int, shares: str, windows: str) -> str:
        fixed = dict(zip(FIELDS, map(T.quote, (i, *R.CATEGORIES[i]))))
        cuts = T.each(windows, lambda w: f"concat('…', {T.squeeze(T.cut(text, f'{w}.start', f'{w}.stop'))}, '…')")
        return f"if(size({windows}) > 0, " + T.struct(
            **fixed, evidence=cuts if evidence else none, shared=f"{shares} AND {T.some(windows, near)}") + ", NULL)"

    def bare(i: int, shares: str, found: str) -> str:
        cid = R.CATEGORIES[i][0]
        fixed = dict(zip(FIELDS, map(T.quote, (i, *R.CATEGORIES[i]))))
        alone = T.struct(**fixed, evidence=none, shared="false")
        near_by = T.let(_windows(low, cid, match, found), lambda w: category(i, shares, w))
        return f"if({shares}, {near_by}, if(size({found}) > 0 OR {T.either(T.matches(low, p) for p in R.PHRASES[cid])}, {alone}, NULL))"

    def row(i: int, shares: str) -> str:
        cid = R.CATEGORIES[i][0]
        words = _keywords(low, cid, match)
        if not evidence:
            return T.let(words, lambda found: bare(i, shares, found))
        return T.let(_windows(low, cid, match, words), lambda w: category(i, shares, w))

    def gated(cid: str, found: str) -> str:
        first = T.gate(low, R.PHRASES[cid], R.KEYWORDS[cid])
        return f"if({first}, {found}, NULL)" if first else found

    return T.let(T.any_match(low, R.SHARING), lambda shares: "array_compact(" + T.array(
        gated(c[0], row(i, shares))
        for i, c in enumerate(R.CATEGORIES)) + ")")


def detect(docs: DataFrame, match: str = "word") -> DataFrame:
    """Adds `data_types`: detected categories in taxonomy order.

    Keywords count as whole words, so that "ein" is not found in "being"; match="substring" finds them anywhere.
    """
    return docs.withColumn("data_types", T.over_text(lambda text, low: _detect(text, low, match)))


def rows(docs: DataFrame, match: str = "word") -> DataFrame:
    """One row per document and detected category."""
    found = detect(docs, match).select("doc_id", "domain", "data_types")
    return T.explode_rows(found, "data_types", "d").select("doc_id", "domain", "d.*")


def by_sensitivity(categories: str) -> str:
    """Categories with the most sensitive first, else in taxonomy order."""
    def rank(c: str) -> str:
        return f"({T.lookup(R.SENSITIVITY_RANK, c + '.sensitivity', 99)} * 100 + {c}.ord)"
    return f"array_sort({categories}, (a, b) -> {rank('a')} - {rank('b')})"


def counts(categories: str) -> dict[str, str]:
    """Numbers that a label shows."""
    out = {f"{s}_count": T.keep(categories, lambda c, s=s: f"{c}.sensitivity = '{s}'") for s in R.SENSITIVITY_RANK}
    out["special_count"] = T.keep(categories, lambda c: f"{c}.gdpr_special_category")
    out["shared_count"] = T.keep(categories, lambda c: f"{c}.shared")
    return {k: f"size({v})" for k, v in out.items()}
