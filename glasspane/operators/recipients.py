"""Named and unnamed recipients, purposes of sharing, sale, and transfers abroad."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..rules import recipients as R
from ..rules.wording import ENTITY_FORMS, ENTITY_LITERALS, LEGAL_ENTITY
from ..sources import dims
from .wording import WORDS, entity_in

NAMED = rf"(?:{LEGAL_ENTITY}|\b(?:{'|'.join(R.BRANDS)})\b)"


_BRAND = rf"\b(?:{'|'.join(R.BRANDS)})\b"
_PIECE = rf"(?=[A-Zc])(?:{WORDS}(?:{ENTITY_FORMS}\b|[A-Z][a-z]+\b)?|{_BRAND})"


def names(text: str) -> str:
    """Distinct names in alphabetical order: legal entities, and brands outside of them.

    Every name begins with a capital letter or the "c" of one brand, so most positions fail on their first character.
    A run of capitalised words gives at most one entity, which starts it; brands are looked for behind that.
    """
    pieces = f"regexp_extract_all({text}, {T.quote(_PIECE)}, 0)"

    def inside(piece: str) -> str:
        brands = T.quote("(?=[A-Zc])" + _BRAND)
        return T.let(entity_in(piece), lambda e: (
            f"concat(filter(array({e}), n -> n <> ''), "
            f"regexp_extract_all(substring({piece}, length({e}) + 1), {brands}, 0))"))

    some = T.either(f"contains({text}, {T.quote(x)})" for x in (*ENTITY_LITERALS, *(b.split(chr(92))[0] for b in R.BRANDS)))
    return f"if(NOT {some}, {T.no_strings()}, array_sort(array_distinct(flatten({T.each(pieces, inside)}))))"


def key(name: str) -> str:
    """Key of a name in the trust table."""
    return f"rtrim('.', lower({name}))"


def mentions(text: str, low: str, name: str) -> str:
    """Snippets around the first two mentions of a name, in any case."""
    def second(at: str, n: str) -> str:
        return T.let(f"locate({n}, {low}, {at} + length({n}))", lambda b: T.each(
            f"filter(array({at}, {b}), p -> p > 0)",
            lambda p: T.snippet(text, f"named_struct('start', {p} - 1, 'stop', {p} - 1 + length({n}))",
                                *R.MENTION_WINDOW)))
    return T.let(f"lower({name})", lambda n: T.let(f"locate({n}, {low})", lambda at: second(at, n)))


def purposes_in(low: str) -> str:
    """Purposes of sharing that a lower-cased text names, in list order."""
    return T.strings(f"if({T.any_match(low, p)}, {T.quote(name)}, NULL)" for name, p in R.PURPOSES.items())


def purposes_near(low: str, name: str) -> str:
    """Purposes within 200 characters of the start of the first mention."""
    radius = R.PURPOSE_RADIUS
    return T.let(f"instr({low}, lower({name})) - 1", lambda at: T.let(
        T.cut(low, f"{at} - {radius}", f"{at} + {radius}"), purposes_in))


def trust_label(score: str) -> str:
    return T.scale(score, R.TRUST_CUTS, "unknown")


def _known(rows) -> str:
    """Trust facts as a literal map, for look-ups inside a row."""
    cells = ", ".join(f"{T.quote(n)}, " + T.struct(category=T.quote(c), trust=T.quote(t), broker=T.quote(b),
                                                   purposes=T.literals(p))
                      for n, c, t, _, _, b, _, p, *_ in rows)
    return f"map({cells})"


def _mentioned(text: str, low: str) -> str:
    return T.let(names(text), lambda ns: T.each(ns, lambda n: T.struct(
        name=n, name_lc=key(n), evidence=mentions(text, low, n), near=purposes_near(low, n))))


def mentioned(docs: DataFrame) -> DataFrame:
    """One row per document and named recipient: evidence and the purposes named near it."""
    found = docs.select("doc_id", "domain", T.over_text(_mentioned).alias("ms"))
    return T.explode_rows(found, "ms", "m").select("doc_id", "domain", "m.*")


def parties(docs: DataFrame, trust: DataFrame, trust_rows: int) -> DataFrame:
    """Named recipients with what is known about them; unknown ones get the defaults."""
    known = dims.small(trust, trust_rows)
    score = F.coalesce("trust_score", F.lit(R.DEFAULT_TRUST))
    return mentioned(docs).join(known, "name_lc", "left").select(
        "doc_id", "domain", "name", F.coalesce("category", F.lit(R.DEFAULT_CATEGORY)).alias("category"),
        score.alias("trust_score"), F.expr(trust_label(f"coalesce(trust_score, {R.DEFAULT_TRUST})"))
        .alias("trust_label"), F.coalesce("typical_data", F.array().cast("array<string>")).alias("data_types_shared"),
        F.when(F.size("near") > 0, F.col("near")).otherwise(
            F.coalesce("purposes", F.array().cast("array<string>"))).alias("purposes"),
        "opt_out_url", "privacy_url", "gdpr_compliant",
        F.coalesce("us_based", F.lit(False)).alias("cross_border_transfer"),
        F.coalesce("is_data_broker", F.lit(False)).alias("is_data_broker"), "evidence")


def risk(sold: str, brokers: str, total: str, advertising: str) -> str:
    return (f"CASE WHEN {sold} OR {brokers} > 0 THEN 'critical' WHEN {total} >= 20 OR {advertising} >= 5 THEN 'high' "
            f"WHEN {total} >= 8 OR {advertising} >= 2 THEN 'medium' ELSE 'low' END")


def _summary(text: str, low: str, rows) -> str:
    def party(n: str, known: str) -> str:
        return T.let(f"try_element_at({known}, {key(n)})", lambda k: T.let(purposes_near(low, n), lambda near: T.struct(
            name=n, category=f"lower(coalesce({k}.category, 'unknown'))",
            broker=f"coalesce({k}.broker, false)", trust=f"coalesce({k}.trust, {R.DEFAULT_TRUST})",
            purposes=f"if(size({near}) > 0, {near}, coalesce({k}.purposes, {T.no_strings()}))")))

    def about(word: str, ps: str) -> str:
        return f"size(filter({ps}, p -> contains(p.category, '{word}') OR array_contains(p.purposes, '{word}')))"

    def counted(ps: str) -> str:
        unnamed = T.count_all(low, R.UNNAMED)
        safeguards = T.strings(f"if({T.matches(low, p)}, {T.quote(name)}, NULL)" for name, p in R.SAFEGUARDS)
        return T.struct(named=f"size({ps})", unnamed=f"greatest(0, {unnamed} - size({ps}))",
                        advertising=about("advertising", ps), analytics=about("analytics", ps),
                        brokers=f"size(filter({ps}, p -> p.broker))", sold=T.matches(low, R.SALE),
                        abroad=T.any_match(low, R.TRANSFERS), safeguards=safeguards, parties=(
                            f"array_sort(transform({ps}, p -> named_struct('trust_score', p.trust, 'name', p.name, 'category', p.category, "
                            f"'purposes', p.purposes, 'is_data_broker', p.broker)))"),
                        purposes="map(" + ", ".join(f"{T.quote(n)}, {T.any_match(low, p)}"
                                                    for n, p in R.PURPOSES.items()) + ")")

    def finish(c: str) -> str:
        return T.struct(
            parties=f"{c}.parties", count=f"{c}.named + {c}.unnamed", named_count=f"{c}.named", unnamed_count=f"{c}.unnamed",
            sharing_purposes=f"{c}.purposes", data_sold=f"{c}.sold", cross_border_transfers=f"{c}.abroad",
            transfer_safeguards=f"{c}.safeguards", advertising_partners=f"{c}.advertising",
            analytics_partners=f"{c}.analytics", data_brokers=f"{c}.brokers",
            risk_level=risk(f"{c}.sold", f"{c}.brokers", f"({c}.named + {c}.unnamed div 2)", f"{c}.advertising"),
            sharing_score=f"least(100, {c}.named * 3 + {c}.unnamed + {c}.advertising * 5 + if({c}.sold, 20, 0) + "
                          f"if({c}.abroad AND size({c}.safeguards) = 0, 10, 0))")

    return T.let(_known(rows), lambda known: T.let(T.each(names(text), lambda n: party(n, known)),
                                                   lambda ps: T.let(counted(ps), finish)))


def detect(docs: DataFrame, rows=None) -> DataFrame:
    """Adds `sharing`: the roll-up over all recipients of a document, within its row."""
    rows = dims.trust_rows() if rows is None else rows
    return docs.withColumn("sharing", T.over_text(lambda text, low: _summary(text, low, rows)))
