"""Wording of a policy: vagueness, purposes, named parties, voice, accountability, readability, transparency."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions import text as T
from ..rules import wording as R


# The Java engine recurses once per word where a repeated group may give words back, and a list of some thousand names
# would exhaust the stack of a task. So a whole run of capitalised words is taken without giving back, and the name is
# the part of the run up to its last legal form.
WORDS = r"\b(?:[A-Z][a-z]+\s+)++"
NAME_IN_RUN = rf"^[A-Z][A-Za-z\s]*\s{R.ENTITY_FORMS}(?=\s|$)"


def entity_in(run: str) -> str:
    """Legal entity in a run of capitalised words, "" without one."""
    return f"regexp_extract({run}, {T.rule(NAME_IN_RUN)}, 0)"


def entities(text: str) -> str:
    """Legal entities of a text, in order."""
    runs = f"regexp_extract_all({text}, {T.quote(rf'(?=[A-Z]){WORDS}(?:{R.ENTITY_FORMS}\b)?')}, 0)"
    some = T.either(f"contains({text}, {T.quote(f)})" for f in R.ENTITY_LITERALS)
    return f"if(NOT {some}, {T.no_strings()}, filter({T.each(runs, entity_in)}, e -> e <> ''))"


def named_parties(text: str, low: str) -> str:
    """Well-known names in list order, then legal entities in text order; first 30 distinct."""
    known = T.each(T.literals_in(low, R.KNOWN_NAMES), lambda n: f"initcap({n})")
    return f"slice(array_distinct(concat({known}, {entities(text)})), 1, {R.MAX_NAMES})"


def accountability(low: str) -> str:
    """map<group, any marker found>."""
    return "map(" + ", ".join(f"{T.quote(g)}, {T.any_match(low, p)}" for g, p in R.ACCOUNTABILITY.items()) + ")"


def sentence_length(text: str) -> str:
    """Mean number of words per sentence; 0 without sentences."""
    return f"coalesce(try_divide(cast({T.plain_words(text)} as double), cast({T.sentences(text)} as double)), 0D)"


def readability(mean: str) -> str:
    cases = " ".join(f"WHEN {mean} < {below} THEN {T.quote(name)}" for below, name in R.SENTENCE_CUTS)
    return f"CASE {cases} ELSE 'very_complex' END"


def transparency(specificity: str, account: str, passive: str, named: str, vagueness: str) -> str:
    total = (f"({specificity} * 0.3D) + ({account} * 0.3D) + ((1D - {passive}) * 100D * 0.2D) + "
             f"(least({named}, 10) * 3) - ({vagueness} * 0.2D)")
    return f"greatest(0, least(100, cast({total} as int)))"


def _examples(hits: str) -> str:
    return T.each(f"slice({hits}, 1, {R.MAX_EXAMPLES})", lambda h: f"concat('\"', {h}.term, '\" (×', {h}.n, ')')")


def _counts(text: str, low: str) -> str:
    groups = len(R.ACCOUNTABILITY)
    return T.struct(
        vague=T.counted_literals(low, R.VAGUE_TERMS), hedges=T.counted_literals(low, R.HEDGES),
        vague_purposes=f"size({T.literals_in(low, R.VAGUE_PURPOSES)})",
        specific_purpose_count="(" + " + ".join(
            f"cast({T.matches(low, p)} as int)" for p in R.SPECIFIC_PURPOSES) + ")",
        named=named_parties(text, low), passive=T.count_all(low, R.PASSIVE), active=T.count_all(low, R.ACTIVE),
        accountability=accountability(low), mean_sentence=sentence_length(text),
        words=T.words(text), groups=str(groups))


def _analyse(text: str, low: str) -> str:
    def first(c: str) -> str:
        return T.struct(
            c=c, vagueness=f"least(100, {R.VAGUE_WEIGHT} * (size({c}.vague) + size({c}.hedges) + "
                           f"{c}.vague_purposes))",
            specificity=f"least(100, {R.SPECIFIC_WEIGHT} * {c}.specific_purpose_count)",
            passive_ratio=f"coalesce(try_divide(cast({c}.passive as double), "
                          f"cast({c}.passive + {c}.active as double)), 0D)",
            account=f"cast(size(filter(map_values({c}.accountability), v -> v)) / cast({c}.groups as double) * 100 "
                    f"as int)")

    def second(m: str) -> str:
        score = transparency(f"{m}.specificity", f"{m}.account", f"{m}.passive_ratio", f"size({m}.c.named)",
                             f"{m}.vagueness")
        return T.let(score, lambda s: T.struct(
            vagueness_score=f"{m}.vagueness", specificity_score=f"{m}.specificity",
            passive_voice_ratio=f"round({m}.passive_ratio, 3)", active_voice_count=f"{m}.c.active",
            passive_voice_count=f"{m}.c.passive", named_third_parties=f"{m}.c.named",
            named_third_party_count=f"size({m}.c.named)", vague_term_examples=_examples(f"{m}.c.vague"),
            hedging_examples=_examples(f"{m}.c.hedges"), specific_purpose_count=f"{m}.c.specific_purpose_count",
            accountability=f"{m}.c.accountability", accountability_score=f"{m}.account",
            overall_transparency=T.scale(s, R.TRANSPARENCY_CUTS, "very_low"), transparency_score=s,
            avg_sentence_length=f"round({m}.c.mean_sentence, 1)", readability_rating=readability(f"{m}.c.mean_sentence"),
            word_count=f"{m}.c.words"))

    return T.let(_counts(text, low), lambda c: T.let(first(c), second))


def detect(docs: DataFrame) -> DataFrame:
    """Adds `wording`."""
    return docs.withColumn("wording", T.over_text(_analyse))


def term_rows(docs: DataFrame, terms) -> DataFrame:
    """One row per document and term that occurs, with its number of occurrences."""
    found = docs.select("doc_id", "domain", T.over_text(lambda _, low: T.counted_literals(low, terms)).alias("ts"))
    return T.explode_rows(found, "ts", "t").select("doc_id", "domain", "t.*")


def radar(wording: str) -> dict[str, str]:
    """Six measures from 0 to 100."""
    return {"specificity": f"{wording}.specificity_score", "accountability": f"{wording}.accountability_score",
            "transparency": f"{wording}.transparency_score",
            "active_voice": f"cast(round((1D - {wording}.passive_voice_ratio) * 100) as int)",
            "named_parties": f"least(100, {wording}.named_third_party_count * 10)",
            "non_vague": f"greatest(0, 100 - {wording}.vagueness_score)"}
