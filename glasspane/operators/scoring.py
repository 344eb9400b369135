"""Seven dimension scores, the overall score and the ledger of penalties and bonuses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..rules import discovery as D
from ..rules import scoring as R
from . import dark_patterns, data_types, recipients, retention, rights, wording


def analyse(docs: DataFrame, evidence: bool = True) -> DataFrame:
    """All policy facts of a document, one struct column per family; texts are dealt out by doc_id before it and dropped behind it.

    Without evidence the same facts are found, but places are not looked up and nothing is cut out of a text: `evidence` and `context` are null.
    """
    out = T.over_texts(T.dealt(docs), {
        "data_types": lambda t, w: data_types._detect(t, w, "word", evidence), "retention": lambda t, w: retention._analyse(t, w, evidence),
        "wording": wording._analyse, "dark_patterns": lambda t, w: dark_patterns._analyse(t, w, evidence),
        "rights": lambda t, w: rights._analyse(t, w, evidence),
        "sharing": lambda t, w: recipients._summary(t, w, recipients.dims.trust_rows())})
    return out.withColumn("chars", F.length("text")).drop("text", "low")


def state(found: str, chars: str) -> str:
    return (f"CASE WHEN NOT {found} THEN 'no_policy' WHEN {chars} < {D.READABLE_CHARS} THEN 'unreadable' "
            f"ELSE 'full' END")


def grade(score: str) -> str:
    return T.scale(score, R.GRADE_CUTS, "F")


def risk_level(score: str) -> str:
    return T.scale(score, R.RISK_CUTS, "critical")


def data_score(types: str, sold: str) -> str:
    p = R.SENSITIVITY_POINTS
    points = (f"CASE WHEN c.sensitivity = 'critical' THEN if(c.gdpr_special_category, {p['critical_special']}, "
              f"{p['critical']}) WHEN c.sensitivity = 'high' THEN {p['high']} WHEN c.sensitivity = 'medium' THEN "
              f"{p['medium']} ELSE {p['low']} END")
    shared = f"size(filter({types}, c -> c.shared))"
    return (f"greatest(0, 100 - aggregate(transform({types}, c -> {points}), 0, (a, x) -> a + x) - "
            f"greatest(0, {shared} - 5) * 3 - if({sold}, 20, 0))")


def count_penalty(n: str) -> str:
    return (f"CASE WHEN {n} <= 5 THEN {n} * 3 WHEN {n} <= 15 THEN 15 + ({n} - 5) * 4 ELSE 55 + ({n} - 15) * 2 END")


def sharing_score(n: str, advertising: str, sold: str, unsafe: str, unnamed: str) -> str:
    return (f"greatest(0, 100 - ({count_penalty(n)}) - if({advertising} > 3, {advertising} * 4, 0) - "
            f"if({sold}, 25, 0) - if({unsafe}, 15, 0) - if({unnamed} > 10, 10, 0))")


def retention_score(rating: str, indefinite: str) -> str:
    return f"greatest(0, {T.lookup(R.RETENTION_SCORE, rating, 0)} - if({indefinite}, 30, 0))"


def dark_score(high: str, medium: str, low: str) -> str:
    p = R.DARK_PENALTY
    return f"greatest(0, 100 - {high} * {p['high']} - {medium} * {p['medium']} - {low} * {p['low']})"


def technical_score(t: str) -> str:
    """From the tracking facts of a page, full marks without any."""
    n = f"coalesce({t}.total_tracker_count, 0)"
    cookies = f"coalesce({t}.n_cookies, 0) > 0"
    return (f"greatest(0, 100 - CASE WHEN {n} > 20 THEN 30 WHEN {n} > 10 THEN 18 WHEN {n} > 5 THEN 10 ELSE 0 END - "
            f"if(coalesce({t}.fingerprinting_detected, false), 25, 0) - "
            f"if(coalesce({t}.session_recording_detected, false), 15, 0) - "
            f"if({cookies} AND {t}.secure_pct < 50, 10, 0) - if({cookies} AND {t}.httponly_pct < 50, 8, 0) - "
            f"if({cookies} AND {t}.samesite_pct < 30, 5, 0))")


def unreadable_technical(t: str) -> str:
    cases = " ".join(f"WHEN {t}.total_tracker_count <= {upto} THEN {s}" for upto, s in R.UNREADABLE_TECHNICAL)
    return f"CASE WHEN {t} IS NULL THEN {R.UNREADABLE_NO_DATA} {cases} ELSE {R.UNREADABLE_MANY} END"


def overall(dims: dict[str, str]) -> str:
    total = " + ".join(f"{dims[d]} * {w}D" for d, w in R.WEIGHTS)
    return f"greatest(0, least(100, cast({total} as int)))"


def _dims(state_col: str, t: str) -> dict[str, str]:
    s = "sharing"
    full = {
        "data_collection": data_score("data_types", f"{s}.data_sold"),
        "sharing": sharing_score(f"{s}.count", f"{s}.advertising_partners", f"{s}.data_sold",
                                 f"{s}.cross_border_transfers AND size({s}.transfer_safeguards) = 0",
                                 f"{s}.unnamed_count"),
        "transparency": "wording.transparency_score", "rights": "rights.overall_rights_score",
        "retention": retention_score("retention.overall_rating", "retention.has_indefinite_retention"),
        "dark_patterns": dark_score("dark_patterns.high_severity_count", "dark_patterns.medium_severity_count",
                                    "dark_patterns.low_severity_count"),
        "technical": technical_score(t)}
    neutral = {**{k: str(v) for k, v in R.UNREADABLE_DIMS.items()}, "technical": unreadable_technical(t)}
    return {d: f"CASE {state_col} WHEN 'no_policy' THEN 0 WHEN 'unreadable' THEN {neutral[d]} ELSE {full[d]} END"
            for d, _ in R.WEIGHTS}


def _entry(test: str, dimension: str, reason: str, points) -> str:
    return f"if({test}, " + T.struct(dimension=T.quote(dimension), reason=reason, points=f"cast({points} as int)") + ", NULL)"


def penalties(t: str) -> str:
    """All reasons against a site, in order of the dimensions."""
    q, s = T.quote, "sharing"
    none = "cast(array() as array<struct<dimension:string,reason:string,points:int>>)"
    special = "transform(filter(data_types, c -> c.sensitivity = 'critical'), c -> " + T.struct(
        dimension=q("data_collection"),
        reason="concat(if(c.gdpr_special_category, 'GDPR special category data: ', 'Highly sensitive data: '), c.name)",
        points=f"if(c.gdpr_special_category, {R.SENSITIVITY_POINTS['critical_special']}, "
               f"{R.SENSITIVITY_POINTS['critical']})") + ")"
    shared = "size(filter(data_types, c -> c.shared))"
    dark = ("transform(dark_patterns.detected, d -> " + T.struct(
        dimension=q("dark_patterns"), reason="concat('Dark pattern: ', d.name, ' (', d.gdpr_reference, ')')",
        points=T.lookup(R.DARK_PENALTY, "d.severity", 5)) + ")")

    def list_of(*entries: str) -> str:
        return f"array_compact(array({', '.join(entries)}))"

    n = f"{s}.count"
    before = list_of(
        _entry(f"{shared} > 5", "data_collection", f"concat({shared}, ' data types shared with third parties')",
               f"({shared} - 5) * 3"),
        _entry(f"{s}.data_sold", "data_collection", q("Personal data is sold to third parties"), 20),
        _entry(f"{n} > 5 AND {n} <= 15", "sharing", f"concat({n}, ' third-party data recipients')", count_penalty(n)),
        _entry(f"{n} > 15", "sharing", f"concat('Excessive third-party sharing (', {n}, ' parties)')",
               count_penalty(n)),
        _entry(f"{s}.advertising_partners > 3", "sharing",
               f"concat({s}.advertising_partners, ' advertising partners')", f"{s}.advertising_partners * 4"),
        _entry(f"{s}.data_sold", "sharing", q("Data sold to third parties (CCPA opt-out required)"), 25),
        _entry(f"{s}.cross_border_transfers AND size({s}.transfer_safeguards) = 0", "sharing",
               q("International data transfers without documented safeguards"), 15),
        _entry(f"{s}.unnamed_count > 10", "sharing",
               f"concat('≥', {s}.unnamed_count, ' unnamed third parties referenced')", 10),
        _entry("NOT wording.accountability['dpo_named']", "transparency",
               q("No DPO identified (recommended under GDPR Art. 37)"), 5),
        _entry("NOT wording.accountability['legitimate_basis']", "transparency",
               q("Lawful basis for processing not clearly stated (GDPR Art. 6)"), 8),
        _entry("retention.has_indefinite_retention", "retention", q("Data retained indefinitely"), 30),
        _entry("NOT retention.has_specific_periods AND NOT retention.has_event_based_deletion", "retention",
               q("No specific retention periods stated (violates GDPR Art. 5(1)(e))"), 20))
    cookies = f"coalesce({t}.n_cookies, 0) > 0"

    def cookie(flag: str, name: str, below: int, points: int) -> str:
        return _entry(f"{cookies} AND {t}.{flag} < {below}", "technical",
                      f"concat('Only ', cast(bround({t}.{flag}) as int), '% of cookies have {name}')", points)

    after = list_of(
        _entry(f"coalesce({t}.total_tracker_count, 0) > 20", "technical",
               f"concat({t}.total_tracker_count, ' trackers detected on website')", 30),
        _entry(f"coalesce({t}.fingerprinting_detected, false)", "technical",
               q("Browser fingerprinting detected (high risk, often unconsented)"), 25),
        _entry(f"coalesce({t}.session_recording_detected, false)", "technical",
               q("Session recording active (captures all user interactions)"), 15),
        cookie("secure_pct", "Secure flag", 50, 10), cookie("httponly_pct", "HttpOnly flag", 50, 8),
        cookie("samesite_pct", "SameSite attribute", 30, 5))
    full = f"concat({special}, {before}, {dark}, {after})"
    missing = list_of(_entry("true", "general", q("No privacy policy found"), 95))
    unread = list_of(
        _entry(f"coalesce({t}.total_tracker_count, 0) BETWEEN 4 AND 8", "technical",
               f"concat({t}.total_tracker_count, ' trackers detected')", 15),
        _entry(f"coalesce({t}.total_tracker_count, 0) > 8", "technical",
               f"concat({t}.total_tracker_count, ' trackers detected')", 30),
        _entry("true", "transparency", q("Policy page is JavaScript-rendered — full text analysis unavailable"), 20))
    return f"coalesce(CASE state WHEN 'no_policy' THEN {missing} WHEN 'unreadable' THEN {unread} ELSE {full} END, {none})"


def bonuses(t: str) -> str:
    """Reasons for a site. They explain, but do not change, a score."""
    q, s = T.quote, "sharing"
    none = "cast(array() as array<struct<dimension:string,reason:string,points:int>>)"
    guards, frames = f"{s}.transfer_safeguards", "rights.frameworks_mentioned"
    full = "array_compact(array(" + ", ".join((
        _entry(f"{s}.count = 0", "sharing", q("No third-party sharing detected"), 5),
        _entry(f"size({guards}) > 0", "sharing",
               f"concat('Transfer safeguards documented: ', array_join(slice({guards}, 1, 2), ', '))", 5),
        _entry("wording.accountability['dpo_named']", "transparency", q("Data Protection Officer (DPO) named"), 5),
        _entry("wording.accountability['legitimate_basis']", "transparency",
               q("Lawful basis for processing explicitly stated"), 5),
        _entry("wording.accountability['privacy_by_design']", "transparency",
               q("Privacy by Design/Default principles mentioned"), 5),
        _entry("wording.named_third_party_count > 5", "transparency",
               "concat(wording.named_third_party_count, ' third parties specifically named')", 5),
        _entry("rights.dnt_honored", "rights", q("Do Not Track (DNT) / GPC honored"), 5),
        _entry("rights.dnt_mentioned AND NOT rights.dnt_honored", "rights", q("DNT mentioned"), 2),
        _entry("rights.global_privacy_control", "rights", q("Global Privacy Control (GPC) supported"), 5),
        _entry(f"size({frames}) > 0", "rights",
               f"concat('Frameworks referenced: ', array_join(slice({frames}, 1, 3), ', '))", 3),
        _entry("retention.has_event_based_deletion", "retention",
               q("Event-based deletion policy (e.g., upon account closure)"), 10),
        _entry("retention.deletion_on_request", "retention", q("Data deletion on user request confirmed"), 10),
        _entry("retention.storage_limitation_mentioned", "retention",
               q("Storage limitation principle explicitly acknowledged"), 5),
        _entry("dark_patterns.consent_mechanism_quality = 'good'", "dark_patterns",
               q("Good consent mechanism: explicit, granular, withdrawable"), 10),
        _entry("dark_patterns.consent_mechanism_quality = 'adequate'", "dark_patterns",
               q("Adequate consent mechanism"), 5),
        _entry(f"{t}.cmp_detected IS NOT NULL", "technical",
               f"concat('Consent Management Platform detected: ', {t}.cmp_detected)", 8),
        _entry(f"{t}.total_tracker_count = 0", "technical", q("No trackers detected on website"), 15))) + "))"
    unread = "array_compact(array(" + ", ".join((
        _entry("true", "general", q("Privacy policy page exists and is accessible"), 10),
        _entry(f"{t}.total_tracker_count = 0", "technical", q("No trackers detected"), 10))) + "))"
    return (f"CASE state WHEN 'no_policy' THEN {none} WHEN 'unreadable' THEN {unread} "
            f"ELSE {full} END")


def summary(score_grade: str) -> str:
    return (f"CASE state WHEN 'no_policy' THEN {T.quote(R.NO_POLICY_SUMMARY)} WHEN 'unreadable' THEN "
            f"{T.quote(R.UNREADABLE_SUMMARY)} ELSE {T.lookup(R.SUMMARIES, score_grade)} END")


def site_facts(docs: DataFrame, pages: DataFrame, evidence: bool = True) -> DataFrame:
    """Policy facts and homepage facts of a site side by side, with evidence (see analyse) or without.

    Texts and markup are dealt out by their ids, so that all cores analyse them however few row groups hold them; only facts are joined.
    """
    from .trackers import detect
    tracking = detect(pages.repartition("page_id")).select(F.col("page_id").alias("doc_id"), F.col("domain").alias("page_domain"), "tracking")
    return analyse(docs, evidence).join(tracking, "doc_id", "left").withColumn("state", F.expr(state("policy_found", "chars")))


def score(facts: DataFrame) -> DataFrame:
    """Adds the dimension scores, `overall`, `grade`, `risk_level`, `summary`, `penalties` and `bonuses`."""
    out = facts.withColumns({f"{d}_score": F.expr(e) for d, e in _dims("state", "tracking").items()})
    total = overall({d: f"{d}_score" for d, _ in R.WEIGHTS})
    out = out.withColumn("overall", F.expr(f"if(state = 'no_policy', {R.NO_POLICY_OVERALL}, {total})"))
    out = out.withColumns({"grade": F.expr(grade("overall")), "risk_level": F.expr(risk_level("overall"))})
    return out.withColumns({"summary": F.expr(summary("grade")), "penalties": F.expr(penalties("tracking")),
                            "bonuses": F.expr(bonuses("tracking"))})
