"""Storage periods per document: items, rating and flags."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions import text as T
from ..rules import retention as R

ITEM = ("struct<context:string,period_text:string,period_days:bigint,period_type:string,rating:string,"
        "rating_label:string,is_vague:boolean>")


def days(period: str) -> str:
    """Days of a written period, truncated; null when it names no known number or unit."""
    unit = T.lookup(R.UNIT_DAYS, f"regexp_extract({period}, '(day|week|month|year|yr)', 1)")
    number = f"try_cast(regexp_extract({period}, '^([0-9]+(?:[.][0-9]+)?)', 1) as double)"
    word = T.lookup(R.NUMBER_WORDS, f"regexp_extract({period}, '^([a-z]+)', 1)")
    return f"try_cast(coalesce({number}, cast({word} as double)) * {unit} as bigint)"


def rating(n: str) -> str:
    cases = " ".join(f"WHEN {n} <= {upto} THEN {T.quote(name)}" for upto, name, _ in R.BANDS)
    return f"CASE WHEN {n} IS NULL THEN 'unknown' {cases} ELSE 'very_poor' END"


def rating_label(n: str) -> str:
    cases = " ".join(f"WHEN {n} <= {upto} THEN {T.quote(label)}" for upto, _, label in R.BANDS)
    return f"CASE WHEN {n} IS NULL THEN 'Unknown' {cases} ELSE concat('>', {n} div 365, ' years') END"


def _item(context: str, text: str, n: str, kind: str, rate: str, label: str) -> str:
    return T.struct(context=context, period_text=text, period_days=n, period_type=T.quote(kind), rating=rate,
                    rating_label=label, is_vague=T.quote(kind == "vague"))


_NO_CONTEXT = "cast(NULL as string)"


def _periods(text: str, low: str, pattern: str, evidence: bool = True) -> str:
    """All periods that a pattern finds, with their ranges."""
    texts = T.all_matches(low, pattern, 1)
    if not evidence:
        return f"transform({texts}, t -> named_struct('t', t))"
    return T.let(texts, lambda ts: f"if(size({ts}) = 0, cast(array() as array<struct<t:string,s:struct<start:int,stop:int>>>), "
                                   f"zip_with({ts}, {T.all_spans(low, pattern)}, (t, s) -> named_struct('t', t, 's', s)))")


def _dated(text: str, found: str, evidence: bool) -> str:
    return T.each(found, lambda f: T.let(days(f"{f}.t"), lambda n: _item(
        T.snippet(text, f"{f}.s", *R.WINDOW) if evidence else _NO_CONTEXT, f"{f}.t", n, "specific", rating(n), rating_label(n))))


def _items(text: str, low: str, evidence: bool = True) -> str:
    """Dated periods first, then periods from "for ..." not listed yet, then events, then one vague item."""
    def fresh(found: str, known: str) -> str:
        x, i = "c", "i"
        return (f"filter({found}, ({x}, {i}) -> NOT array_contains({known}, {x}.t) AND "
                f"array_position(transform({found}, q -> q.t), {x}.t) = {i} + 1 AND coalesce({days(x + '.t')}, 0) > 0)")

    period = f"({R.PERIOD})"
    kept = _periods(text, low, R.KEPT_FOR + period, evidence)
    lasts = _periods(text, low, R.LASTS_FOR + period, evidence)
    dated = T.let(kept, lambda k: T.let(lasts, lambda c: _dated(
        text, f"concat({k}, {fresh(c, f'transform({k}, q -> q.t)')})", evidence)))
    null = "cast(NULL as bigint)"

    def event(context: str, label: str) -> str:
        return _item(context, T.quote(label), null, "event_based", "'good'", T.quote(R.EVENT_LABEL))

    def vaguely(context: str) -> str:
        return _item(context, T.quote(R.VAGUE_TEXT), null, "vague", "'very_poor'", T.quote(R.VAGUE_LABEL))

    events = T.strings(f"if({T.matches(low, p)}, " + (T.let(T.first_span(low, p), lambda s, label=label: event(
        T.snippet(text, s, *R.WINDOW), label)) if evidence else event(_NO_CONTEXT, label)) + ", NULL)" for p, label in R.EVENTS)
    if evidence:
        vague = T.let(T.first_of(low, R.VAGUE), lambda s: f"if({s} IS NULL, cast(array() as array<{ITEM}>), array("
                      + vaguely(T.snippet(text, s, *R.WINDOW)) + "))")
    else:
        vague = f"if({T.any_match(low, R.VAGUE)}, array({vaguely(_NO_CONTEXT)}), cast(array() as array<{ITEM}>))"
    return f"concat(cast({dated} as array<{ITEM}>), cast({events} as array<{ITEM}>), cast({vague} as array<{ITEM}>))"


def overall(items: str) -> str:
    points = T.each(items, lambda i: T.lookup(R.RATING_POINTS, f"{i}.rating", 0))
    mean = f"(aggregate({points}, 0, (a, p) -> a + p) / cast(size({items}) as double))"
    specific = T.some(items, lambda i: f"{i}.period_type = 'specific'")
    vague = T.some(items, lambda i: f"{i}.is_vague")
    return (f"CASE WHEN size({items}) = 0 OR ({vague} AND NOT {specific}) THEN 'very_poor' ELSE "
            f"{T.scale(mean, R.MEAN_CUTS, 'very_poor')} END")


def _analyse(text: str, low: str, evidence: bool = True) -> str:
    def roll_up(items: str) -> str:
        dated = T.each(T.keep(items, lambda i: f"{i}.period_type = 'specific' AND {i}.period_days > 0"),
                       lambda i: f"{i}.period_days")
        on_request = T.matches(low, R.DELETION_ON_REQUEST)
        event = T.some(items, lambda i: f"{i}.period_type = 'event_based'")
        return T.let(dated, lambda d: T.struct(
            items=f"slice({items}, 1, {R.MAX_ITEMS})", n_items=f"size({items})", overall_rating=overall(items),
            has_vague_retention=T.some(items, lambda i: f"{i}.is_vague"),
            has_indefinite_retention=T.matches(low, R.INDEFINITE),
            has_event_based_deletion=event,
            has_specific_periods=T.some(items, lambda i: f"{i}.period_type = 'specific'"),
            has_deletion_policy=f"{on_request} OR {event}", deletion_on_request=on_request,
            shortest_days=f"array_min({d})", longest_days=f"array_max({d})",
            storage_limitation_mentioned=T.matches(low, R.STORAGE_LIMITATION)))
    return T.let(_items(text, low, evidence), roll_up)


def detect(docs: DataFrame) -> DataFrame:
    """Adds `retention`."""
    return docs.withColumn("retention", T.over_text(_analyse))


def items(docs: DataFrame) -> DataFrame:
    """One row per storage period of a document, in order of discovery."""
    found = docs.select("doc_id", "domain", T.over_text(_items).alias("items"))
    found = found.selectExpr("doc_id", "domain", "transform(items, (x, i) -> named_struct('ord', i, 'item', x)) AS xs")
    return T.explode_rows(found, "xs", "x").select("doc_id", "domain", "x.ord", "x.item.*")
