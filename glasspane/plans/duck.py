"""Building blocks of the check queries in DuckDB's dialect.

The check queries state each result a second time, in another engine and in relational form: documents meet a table of
rules in a join, and findings are ranked and grouped by SQL.
"""

from __future__ import annotations

import re

from ..functions import html as H
from ..operators import discovery as disc
from ..operators.recipients import NAMED
from ..rules import dark_patterns, data_types, discovery, pages, recipients, retention, rights, scoring, trackers, trust
from ..rules import wording
from ..sources import dims, seeds
from ..sources.tables import D_TEXT

NL = "chr(10)"


def q(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, (int, float)):
        return str(value)
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(q(v) for v in value) + "]"
    return "'" + value.replace("'", "''") + "'"


def values(rows, *columns: str) -> str:
    body = ", ".join("(" + ", ".join(q(v) for v in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS v({', '.join(columns)})"


def pick(items, key: str) -> str:
    return f"({q(list(items))})[CAST({key} % {len(items)} AS INTEGER) + 1]"


def start(low: str, pattern: str) -> str:
    return f"length(regexp_extract({low}, '^([\\s\\S]*?)(?:' || {pattern} || ')', 1))"


def stop(low: str, pattern: str) -> str:
    return f"length(regexp_extract({low}, '^[\\s\\S]*?(?:' || {pattern} || ')', 0))"


def squeeze(text: str) -> str:
    return f"trim(regexp_replace({text}, '\\s+', ' ', 'g'))"


def cut(text: str, a: str, b: str) -> str:
    return f"substring({text}, greatest({a}, 0) + 1, greatest({b} - greatest({a}, 0), 0))"


def snippet(text: str, a: str, b: str) -> str:
    return f"'…' || {squeeze(cut(text, a, b))} || '…'"


def case_scale(value: str, cuts, rest: str) -> str:
    return "CASE " + " ".join(f"WHEN {value} >= {c} THEN {q(l)}" for c, l in cuts) + f" ELSE {q(rest)} END"


def case_of(value: str, table: dict, rest=None) -> str:
    return f"CASE {value} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in table.items()) + f" ELSE {q(rest)} END"


def any_of(low: str, patterns) -> str:
    return "(" + " OR ".join(f"regexp_matches({low}, {q(p)})" for p in patterns) + ")"


def count_of(low: str, patterns) -> str:
    return "(" + " + ".join(f"len(regexp_extract_all({low}, {q(p)}))" for p in patterns) + ")"


def attribute(el: str, name: str) -> str:
    tag = f"regexp_extract({el}, '^<[^>]*>')"
    rule = q(rf"""(?i)[\s"'/]{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""")
    got = " || ".join(f"regexp_extract({tag}, {rule}, {i})" for i in (1, 2, 3))
    return f"CASE WHEN regexp_matches({tag}, {rule}) THEN replace(trim({got}), '&amp;', '&') END"


def host(url: str) -> str:
    rule = q(r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)")
    return f"nullif(regexp_replace(lower(regexp_extract({url}, {rule}, 1)), '^www\\.', ''), '')"


def norm(url: str) -> str:
    return (f"regexp_replace(CASE WHEN regexp_matches({url}, '^https?://') THEN {url} "
            f"ELSE 'https://' || regexp_replace({url}, '^/+', '') END, '/+$', '')")


def unescape(text: str) -> str:
    names, chars = q(list(H.NAMED)), q(list(H.NAMED.values()))
    name, decimal, hexa = (f"regexp_extract(amp, {q(r)}, 1)" for r in (H.NAME_RULE, H.DECIMAL_RULE, H.HEX_RULE))
    rest = "amp[strpos(amp, ';') + 1:]"

    def number(digits: str) -> str:
        code = f"TRY_CAST({digits} AS INTEGER)"
        return (f"CASE WHEN {code} = 0 OR {code} > 1114111 OR {code} BETWEEN 55296 AND 57343 THEN {q(H.REPLACEMENT)} WHEN {code} = 160 THEN ' ' "
                f"ELSE chr({code}) END || {rest}")

    written = number("'0x' || " + hexa)
    return (f"array_to_string(list_transform(string_split({text}, '&'), lambda amp, nth: CASE WHEN nth = 1 THEN amp WHEN {decimal} <> '' THEN "
            f"{number(decimal)} WHEN {hexa} <> '' THEN {written} WHEN {name} <> '' AND list_contains({names}, {name}) "
            f"THEN ({chars})[list_position({names}, {name})] || {rest} ELSE '&' || amp END), '')")


def gone(html: str, tags) -> str:
    out = f"regexp_replace({html}, {q(rf'(?i){H.COMMENT}|{H.SCRIPT}')}, '', 'g')"
    for t in tags:
        if t != "script":
            out = f"regexp_replace({out}, {q(rf'(?i)<{t}\b[^>]*>[\s\S]*?</{t}\s*>')}, '', 'g')"
    return out


def lines(html: str, tags, least: int) -> str:
    clean = unescape(f"regexp_replace({gone(html, tags)}, '<[^>]*>', {NL}, 'g')")
    return (f"array_to_string(list_filter(list_transform(string_split({clean}, {NL}), lambda n: regexp_replace(n, "
            f"'^\\s+|\\s+$', '', 'g')), lambda n: length(n) > {least}), {NL})")


def likely(text: str) -> str:
    hits = " + ".join(f"CAST(contains(lower({text}), {q(w)}) AS INTEGER)" for w in discovery.POLICY_WORDS)
    return f"(length({text}) >= {discovery.MIN_POLICY_CHARS} AND {hits} >= {discovery.MIN_POLICY_WORDS})"


def url_signal(url: str) -> str:
    return "(" + " OR ".join(f"contains(lower({url}), {q(s)})" for s in discovery.URL_SIGNALS) + ")"


def rule_values(*families: str) -> str:
    rows = [(f, r, i, p, lb) for f, r, i, _, p, lb in dims.rule_rows() if f in families]
    return values(rows, "family", "rule_id", "pattern_id", "pattern", "label")


def days(p: str) -> str:
    unit = case_of(f"regexp_extract({p}, '(day|week|month|year|yr)', 1)", retention.UNIT_DAYS)
    word = case_of(f"regexp_extract({p}, '^([a-z]+)', 1)", retention.NUMBER_WORDS)
    number = f"TRY_CAST(regexp_extract({p}, '^([0-9]+(?:[.][0-9]+)?)', 1) AS DOUBLE)"
    return f"CAST(trunc(coalesce({number}, CAST({word} AS DOUBLE)) * {unit}) AS BIGINT)"


def band(n: str, label: bool) -> str:
    cases = " ".join(f"WHEN {n} <= {u} THEN {q(lb if label else r)}" for u, r, lb in retention.BANDS)
    rest = f"'>' || ({n} // 365) || ' years'" if label else "'very_poor'"
    return f"CASE WHEN {n} IS NULL THEN {q('Unknown' if label else 'unknown')} {cases} ELSE {rest} END"


def hits(rows, *columns: str) -> str:
    """Documents against rules, one branch per pattern so that each is compiled once; rows end with the pattern."""
    return " UNION ALL ".join(
        f"SELECT doc_id, {', '.join(f'{q(v)} AS {c}' for v, c in zip(r[:-1], columns))}, {start('low', q(r[-1]))} AS a, "
        f"{stop('low', q(r[-1]))} AS b FROM §docs WHERE regexp_matches(low, {q(r[-1])})" for r in rows)


def _category_values() -> str:
    return values([(i, *c) for i, c in enumerate(data_types.CATEGORIES)], "ord", "category_id", "name", "sensitivity",
                  "gdpr_special_category", "gdpr_article", "ccpa_category")


_EDGE = r"[^\p{L}\p{N}_]"
_ANY = r"[\s\S]"

CTES = {
    "docs": f"""SELECT *, lower(replace(text, chr(304), 'i')) AS low FROM (SELECT doc_id, source AS domain, lang, source <> 'src7' AS policy_found,
        text || {NL} || {pick(seeds.CLAUSES, 'doc_id')} || {NL} || {pick(seeds.EXTRAS, 'doc_id')} AS text FROM documents)""",
    "pages": f"""SELECT page_id, url, {host(norm('url'))} AS domain,
        regexp_extract({norm('url')}, '^(https?://[^/?#]*)', 1) AS base,
        html || {pick(seeds.FRAGMENTS, 'page_id')} AS html, {pick(seeds.COOKIES, 'page_id')} AS raw_cookies FROM pages""",
    "phhit": hits([(i, k, p) for i, c in enumerate(data_types.CATEGORIES)
                   for k, p in enumerate(data_types.PHRASES[c[0]])], "ord", "k"),
    "cat": _category_values(),
    "kwhit": " UNION ALL ".join(
        f"SELECT doc_id, {i} AS ord, {k} AS k, {len(w)} AS n, length(regexp_extract(low, "
        f"{q(f'^((?:|[^^]*?{_EDGE})){w}(?:e?s)?(?:$|{_EDGE})'.replace('[^^]', _ANY))}, 1)) AS a FROM §docs "
        f"WHERE contains(low, {q(w)}) AND regexp_matches(low, {q(f'(?:^|{_EDGE}){w}(?:e?s)?(?:$|{_EDGE})')})"
        for i, c in enumerate(data_types.CATEGORIES) for k, w in enumerate(data_types.KEYWORDS[c[0]])),
    "win": """SELECT doc_id, ord, 0 AS kind, k, a - 80 AS s, a + n + 80 AS e FROM (SELECT *, row_number() OVER (
            PARTITION BY doc_id, ord ORDER BY k) AS nth FROM §kwhit) WHERE nth <= 2
        UNION ALL SELECT doc_id, ord, 1, k, a - 60, a + 120 FROM §phhit""",
    "dt": """SELECT r.doc_id, d.domain, r.ord, c.category_id, c.name, c.sensitivity, c.gdpr_special_category, c.gdpr_article,
            c.ccpa_category, string_agg(""" + snippet("d.text", "r.s", "r.e") + """, '|' ORDER BY r.kind, r.k) AS evidence,
            bool_or(""" + any_of(cut("d.low", "greatest(r.s, 0) - 300", "greatest(r.s, 0) + 300"), data_types.SHARING) + """) AS shared
        FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, ord ORDER BY kind, k) AS nth FROM §win) r
        JOIN §docs d USING (doc_id) JOIN §cat c USING (ord) WHERE nth <= 3 GROUP BY ALL""",
    "ret_found": " UNION ALL ".join(f"""SELECT doc_id, {k} AS src, unnest(range(len(found))) AS i, unnest(found) AS m,
            unnest(texts) AS t, pieces FROM (SELECT doc_id, regexp_extract_all(low, {q(p)}) AS found,
            regexp_extract_all(low, {q(p)}, 1) AS texts, regexp_split_to_array(low, {q(p)}) AS pieces FROM §docs)"""
        for k, p in ((0, f"{retention.KEPT_FOR}({retention.PERIOD})"), (1, f"{retention.LASTS_FOR}({retention.PERIOD})"))),
    "ret_pos": """SELECT f.doc_id, f.src, f.i, f.t, length(f.m) AS n, CAST(list_sum(list_transform(pieces[1:f.i + 1],
            lambda x: length(x))) AS BIGINT) + coalesce(CAST(sum(length(f.m)) OVER (PARTITION BY f.doc_id, f.src ORDER BY f.i
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS a FROM §ret_found f""",
    "ret_dated": f"""SELECT p.*, {days('p.t')} AS days FROM §ret_pos p WHERE src = 0 OR (coalesce({days('p.t')}, 0) > 0 AND
            NOT EXISTS (SELECT 1 FROM §ret_found o WHERE o.doc_id = p.doc_id AND o.src = 0 AND o.t = p.t) AND
            NOT EXISTS (SELECT 1 FROM §ret_found o WHERE o.doc_id = p.doc_id AND o.src = 1 AND o.t = p.t AND o.i < p.i))""",
    "ret_ev": hits([(i, lb, p) for i, (p, lb) in enumerate(retention.EVENTS)], "i", "label"),
    "ret_vg": hits([(i, p) for i, p in enumerate(retention.VAGUE)], "i"),
    "ret_all": f"""SELECT x.doc_id, src, i, {snippet('d.text', 'a - 80', 'a + n + 80')} AS context, period_text, period_days,
            period_type, rating, rating_label, period_type = 'vague' AS is_vague FROM (
        SELECT doc_id, src, i, a, n, t AS period_text, days AS period_days, 'specific' AS period_type,
            {band('days', False)} AS rating, {band('days', True)} AS rating_label FROM §ret_dated
        UNION ALL SELECT doc_id, 2, i, a, b - a, label, NULL, 'event_based', 'good', {q(retention.EVENT_LABEL)} FROM §ret_ev
        UNION ALL SELECT doc_id, 3, i, a, b - a, {q(retention.VAGUE_TEXT)}, NULL, 'vague', 'very_poor', {q(retention.VAGUE_LABEL)} FROM (
            SELECT doc_id, i, a, b, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS nth
            FROM §ret_vg) WHERE nth = 1) x JOIN §docs d USING (doc_id)""",
    "ret_items": """SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY src, i) - 1 AS ord FROM §ret_all""",
    "ret": f"""SELECT d.doc_id, d.domain, coalesce(n, 0) AS n_items, CASE WHEN n IS NULL OR (vague AND NOT specific) THEN 'very_poor'
            ELSE {case_scale('mean', retention.MEAN_CUTS, 'very_poor')} END AS overall_rating, coalesce(vague, FALSE) AS has_vague_retention,
            regexp_matches(low, {q(retention.INDEFINITE)}) AS has_indefinite_retention, coalesce(event, FALSE) AS has_event_based_deletion,
            coalesce(specific, FALSE) AS has_specific_periods, regexp_matches(low, {q(retention.DELETION_ON_REQUEST)}) OR coalesce(event, FALSE)
            AS has_deletion_policy, regexp_matches(low, {q(retention.DELETION_ON_REQUEST)}) AS deletion_on_request, shortest AS shortest_days,
            longest AS longest_days, regexp_matches(low, {q(retention.STORAGE_LIMITATION)}) AS storage_limitation_mentioned
        FROM §docs d LEFT JOIN (SELECT doc_id, count(*) AS n, avg({case_of('rating', retention.RATING_POINTS, 0)}) AS mean,
            bool_or(is_vague) AS vague, bool_or(period_type = 'specific') AS specific, bool_or(period_type = 'event_based') AS event,
            min(period_days) FILTER (WHERE period_days > 0) AS shortest, max(period_days) FILTER (WHERE period_days > 0) AS longest
            FROM §ret_items GROUP BY doc_id) USING (doc_id)""",
    "terms": values([(f, i, p) for f, r, i, _, p, _ in dims.rule_rows() if f in ("vague_term", "hedge", "vague_purpose")],
                    "family", "i", "term"),
    "term_hit": """SELECT doc_id, domain, family, i, term, (length(low) - length(replace(low, term, ''))) // length(term) AS n
        FROM §docs, §terms WHERE contains(low, term)""",
    "wnames": f"""SELECT doc_id, k, i, name FROM (SELECT doc_id, 0 AS k, i, name FROM §docs, (""" + values(
        [(i, n, n.title()) for i, n in enumerate(wording.KNOWN_NAMES)], "i", "low_name", "name") + f""") WHERE contains(low, low_name)
        UNION ALL SELECT doc_id, 1, unnest(range(len(f))), unnest(f) FROM (SELECT doc_id, regexp_extract_all(text, {q(wording.LEGAL_ENTITY)})
        AS f FROM §docs))""",
    "wnamed": """SELECT doc_id, name, rn FROM (SELECT doc_id, name, row_number() OVER (PARTITION BY doc_id ORDER BY k, i) AS rn FROM (
        SELECT doc_id, name, min(struct_pack(k := k, i := i)).k AS k, min(struct_pack(k := k, i := i)).i AS i FROM §wnames
        GROUP BY doc_id, name)) WHERE rn <= 30""",
    "wraw": f"""SELECT d.doc_id, d.domain, coalesce(v.nv, 0) AS nv, coalesce(v.nh, 0) AS nh, coalesce(v.np, 0) AS np,
            {' + '.join(f'CAST(regexp_matches(low, {q(p)}) AS INTEGER)' for p in wording.SPECIFIC_PURPOSES)} AS specific_purpose_count,
            coalesce(w.n, 0) AS named, {count_of('low', wording.PASSIVE)} AS passive, {count_of('low', wording.ACTIVE)} AS active,
            {', '.join(f'{any_of("low", p)} AS {g}' for g, p in wording.ACCOUNTABILITY.items())},
            len(regexp_extract_all(text, '[^\\s.!?]+')) / nullif(len(regexp_extract_all(text, '[^.!?\\s][^.!?]*')), 0) AS mean_sentence,
            len(regexp_extract_all(text, '\\S+')) AS words
        FROM §docs d LEFT JOIN (SELECT doc_id, count(*) FILTER (WHERE family = 'vague_term') AS nv, count(*) FILTER (WHERE family = 'hedge') AS nh,
            count(*) FILTER (WHERE family = 'vague_purpose') AS np FROM §term_hit GROUP BY doc_id) v USING (doc_id)
        LEFT JOIN (SELECT doc_id, count(*) AS n FROM §wnamed GROUP BY doc_id) w USING (doc_id)""",
    "wmid": f"""SELECT *, least(100, 4 * (nv + nh + np)) AS vagueness_score, least(100, 12 * specific_purpose_count) AS specificity_score,
            coalesce(CAST(passive AS DOUBLE) / nullif(passive + active, 0), 0) AS ratio, CAST(trunc(({' + '.join(
                f'CAST({g} AS INTEGER)' for g in wording.ACCOUNTABILITY)}) / CAST(6 AS DOUBLE) * 100) AS INTEGER) AS accountability_score FROM §wraw""",
    "wrd": f"""SELECT *, {case_scale('transparency_score', wording.TRANSPARENCY_CUTS, 'very_low')} AS overall_transparency,
            CASE WHEN coalesce(mean_sentence, 0) < 25 THEN 'accessible' WHEN mean_sentence < 45 THEN 'complex' ELSE 'very_complex' END
            AS readability_rating FROM (SELECT *, CAST(greatest(0, least(100, trunc(specificity_score * CAST(0.3 AS DOUBLE) +
            accountability_score * CAST(0.3 AS DOUBLE) + (1 - ratio) * 100 * CAST(0.2 AS DOUBLE) + least(named, 10) * 3 -
            vagueness_score * CAST(0.2 AS DOUBLE)))) AS INTEGER) AS transparency_score FROM §wmid)""",
    "dkp": values([(i, k, p) for i, t in enumerate(dark_patterns.TYPES) for k, p in enumerate(dark_patterns.PATTERNS[t[0]])],
                  "ord", "k", "p"),
    "dkhit": """SELECT doc_id, ord, k, i, CAST(list_sum(list_transform(pieces[1:i + 1], lambda x: length(x))) AS BIGINT) +
            coalesce(CAST(list_sum(list_transform(found[1:i], lambda x: length(x))) AS BIGINT), 0) AS a, length(found[i + 1]) AS n
        FROM (SELECT *, unnest(range(len(found))) AS i FROM (SELECT doc_id, ord, k, regexp_extract_all(low, p) AS found,
            regexp_split_to_array(low, p) AS pieces FROM §docs, §dkp WHERE regexp_matches(low, p)))""",
    "dark": """SELECT x.doc_id, d.domain, x.ord, t.pattern_type, t.name, t.severity, t.gdpr_reference,
            string_agg(""" + snippet("d.text", "a - 60", "a + n + 60") + """, '|' ORDER BY k, i) AS evidence,
            CAST(round(least(1.0, 0.6 + count(*) * 0.1), 2) AS DOUBLE) AS confidence
        FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, ord ORDER BY k, i) AS nth FROM §dkhit) x JOIN §docs d USING (doc_id)
        JOIN (""" + values([(i, *t) for i, t in enumerate(dark_patterns.TYPES)], "ord", "pattern_type", "name", "severity",
                           "gdpr_reference") + """) t USING (ord) WHERE nth <= 2 GROUP BY ALL""",
    "dark_doc": f"""SELECT *, CASE WHEN high >= 2 THEN 'critical' WHEN high = 1 THEN 'high' WHEN medium >= 2 THEN 'medium'
            WHEN medium + low_n >= 1 THEN 'low' ELSE 'none' END AS overall_risk, CASE WHEN explicit AND granular AND withdrawal AND n = 0
            THEN 'good' WHEN explicit AND withdrawal THEN 'adequate' WHEN high >= 1 THEN 'poor' ELSE 'unclear' END AS consent_mechanism_quality
        FROM (SELECT d.doc_id, d.domain, coalesce(n, 0) AS n, coalesce(high, 0) AS high, coalesce(medium, 0) AS medium,
            coalesce(low_n, 0) AS low_n, regexp_matches(low, {q(dark_patterns.EXPLICIT)}) AS explicit,
            regexp_matches(low, {q(dark_patterns.GRANULAR)}) AS granular, regexp_matches(low, {q(dark_patterns.WITHDRAWAL)}) AS withdrawal
        FROM §docs d LEFT JOIN (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE severity = 'high') AS high,
            count(*) FILTER (WHERE severity = 'medium') AS medium, count(*) FILTER (WHERE severity = 'low') AS low_n
            FROM §dark GROUP BY doc_id) USING (doc_id))""",
    "rightdef": values([(f, i, *r) for f, t in (("gdpr", rights.GDPR), ("ccpa", rights.CCPA)) for i, r in enumerate(t)],
                       "framework", "ord", "right_id", "name", "article"),
    "rhit": hits([(r, k, p) for r, ps in rights.PATTERNS.items() for k, p in enumerate(ps)], "right_id", "k"),
    "rgt": f"""SELECT d.doc_id, d.domain, f.framework, f.ord, f.right_id, f.name, f.article, h.a IS NOT NULL AS covered,
            CASE WHEN h.a IS NOT NULL THEN {snippet('d.text', 'h.a - 50', 'h.b + 80')} END AS evidence
        FROM §docs d CROSS JOIN §rightdef f LEFT JOIN (SELECT doc_id, right_id, arg_min(a, k) AS a, arg_min(b, k) AS b
            FROM §rhit GROUP BY doc_id, right_id) h ON h.doc_id = d.doc_id AND h.right_id = f.right_id""",
    "rgt_doc": f"""SELECT *, CAST(trunc((gdpr_score + ccpa_score) / CAST(2 AS DOUBLE)) AS INTEGER) AS overall_rights_score,
            {case_scale('gdpr_score', rights.GRADE_CUTS, 'F')} AS gdpr_grade, {case_scale('ccpa_score', rights.GRADE_CUTS, 'F')} AS ccpa_grade
        FROM (SELECT doc_id, domain, CAST(trunc(count(*) FILTER (WHERE covered AND framework = 'gdpr') / CAST(9 AS DOUBLE) * 100) AS INTEGER)
            AS gdpr_score, CAST(trunc(count(*) FILTER (WHERE covered AND framework = 'ccpa') / CAST(6 AS DOUBLE) * 100) AS INTEGER) AS ccpa_score
            FROM §rgt GROUP BY doc_id, domain)""",
    "flags": f"""SELECT doc_id, regexp_matches(low, {q(rights.DNT_MENTIONED)}) AS dnt_mentioned, regexp_matches(low, {q(rights.DNT_HONOURED)})
            AS dnt_honored, regexp_matches(low, {q(rights.GPC)}) AS gpc, array_to_string(list_filter([{', '.join(
                f'CASE WHEN {any_of("low", p)} THEN {q(n)} END' for n, p in rights.FRAMEWORKS)}], lambda x: x IS NOT NULL), '|') AS frameworks
        FROM §docs""",
    "trust": values([(r[0], r[1], r[2], r[3], r[4], r[5], "|".join(r[6]), "|".join(r[7]), r[8], r[9]) for r in dims.trust_rows()],
                    "name_lc", "category", "trust_score", "gdpr_compliant", "us_based", "is_data_broker", "typical_data", "purposes",
                    "opt_out_url", "privacy_url"),
    "named": f"""SELECT DISTINCT doc_id, domain, name, text, low FROM (SELECT doc_id, domain, text, low,
            unnest(regexp_extract_all(text, {q(NAMED)})) AS name FROM §docs)""",
    "party": f"""SELECT n.doc_id, n.domain, n.name, coalesce(t.category, 'Unknown') AS category, coalesce(t.trust_score, 50) AS trust_score,
            {case_scale('coalesce(t.trust_score, 50)', recipients.TRUST_CUTS, 'unknown')} AS trust_label,
            coalesce(t.typical_data, '') AS data_types_shared, CASE WHEN near <> '' THEN near ELSE coalesce(t.purposes, '') END AS purposes,
            t.opt_out_url, t.privacy_url, t.gdpr_compliant, coalesce(t.us_based, FALSE) AS cross_border_transfer,
            coalesce(t.is_data_broker, FALSE) AS is_data_broker, near FROM (SELECT doc_id, domain, name, array_to_string(list_filter([{', '.join(
                f'CASE WHEN {any_of("around", p)} THEN {q(n)} END' for n, p in recipients.PURPOSES.items())}], lambda x: x IS NOT NULL), '|') AS near
            FROM (SELECT doc_id, domain, name, {cut('low', 'instr(low, lower(name)) - 1 - 200', 'instr(low, lower(name)) - 1 + 200')} AS around
            FROM §named)) n LEFT JOIN §trust t ON t.name_lc = rtrim(lower(n.name), '.')""",
    "share": f"""SELECT *, named_count + unnamed_count AS n, CASE WHEN data_sold OR data_brokers > 0 THEN 'critical'
            WHEN named_count + unnamed_count // 2 >= 20 OR advertising_partners >= 5 THEN 'high'
            WHEN named_count + unnamed_count // 2 >= 8 OR advertising_partners >= 2 THEN 'medium' ELSE 'low' END AS risk_level,
            least(100, named_count * 3 + unnamed_count + advertising_partners * 5 + CASE WHEN data_sold THEN 20 ELSE 0 END +
            CASE WHEN abroad AND safeguards = '' THEN 10 ELSE 0 END) AS sharing_score
        FROM (SELECT d.doc_id, d.domain, coalesce(p.n, 0) AS named_count, greatest(0, {count_of('low', recipients.UNNAMED)} - coalesce(p.n, 0))
            AS unnamed_count, coalesce(p.adv, 0) AS advertising_partners, coalesce(p.ana, 0) AS analytics_partners,
            coalesce(p.broker, 0) AS data_brokers, regexp_matches(low, {q(recipients.SALE)}) AS data_sold,
            {any_of('low', recipients.TRANSFERS)} AS abroad, array_to_string(list_filter([{', '.join(
                f'CASE WHEN regexp_matches(low, {q(p)}) THEN {q(n)} END' for n, p in recipients.SAFEGUARDS)}], lambda x: x IS NOT NULL), '|') AS safeguards
        FROM §docs d LEFT JOIN (SELECT doc_id, count(*) AS n,
            count(*) FILTER (WHERE contains(lower(category), 'advertising') OR list_contains(string_split(purposes, '|'), 'advertising')) AS adv,
            count(*) FILTER (WHERE contains(lower(category), 'analytics') OR list_contains(string_split(purposes, '|'), 'analytics')) AS ana,
            count(*) FILTER (WHERE is_data_broker) AS broker FROM §party GROUP BY doc_id) p USING (doc_id))""",
    "els": f"""SELECT page_id, domain, idx, el FROM (SELECT page_id, domain, unnest(range(len(f))) AS idx, unnest(f) AS el FROM (
            SELECT page_id, domain, regexp_extract_all(html, {q(rf'(?i){H.COMMENT}|{H.SCRIPT}|<(?:img|iframe)\b[^>]*>')}) AS f FROM §pages))
        WHERE NOT starts_with(el, '<!--')""",
    "srcs": f"""SELECT page_id, domain, idx, lower(regexp_extract(el, '^<([a-zA-Z][a-zA-Z0-9]*)', 1)) AS tag, {attribute('el', 'src')} AS src,
            {attribute('el', 'width')} AS w, {attribute('el', 'height')} AS h FROM §els""",
    "res0": f"""SELECT page_id, domain, idx, CASE tag WHEN 'script' THEN 'script' WHEN 'iframe' THEN 'iframe' ELSE CASE WHEN
            (w IN ('0', '1') AND h IN ('0', '1')) OR {' OR '.join(f"contains(lower(src), {q(x)})" for x in trackers.PIXEL_WORDS)}
            THEN 'pixel' END END AS kind, src AS url, {host('src')} AS host FROM §srcs WHERE src IS NOT NULL""",
    "res": """SELECT page_id, domain, kind, url, host, row_number() OVER (PARTITION BY page_id ORDER BY CASE kind WHEN 'script' THEN 0
            WHEN 'pixel' THEN 1 ELSE 2 END, idx) - 1 AS ord FROM §res0
        WHERE kind IS NOT NULL AND host IS NOT NULL AND host <> domain AND NOT ends_with(host, '.' || domain)""",
    "trk": values(dims.tracker_rows(), "domain", "name", "category", "risk", "fingerprinting", "session_recording", "opt_out"),
    "best": """SELECT r.*, t.domain AS tdomain, t.name, t.category, t.risk, t.fingerprinting, t.session_recording, t.opt_out,
            row_number() OVER (PARTITION BY r.page_id, r.ord ORDER BY length(t.domain) DESC NULLS LAST) AS pick
        FROM §res r LEFT JOIN §trk t ON r.host = t.domain OR ends_with(r.host, '.' || t.domain)""",
    "found": """SELECT page_id, ord, kind, host, url[1:200] AS url, coalesce(name, 'Unknown pixel (' || host || ')') AS name,
            coalesce(category, 'Advertising / Analytics') AS category, coalesce(risk, 'medium') AS risk,
            coalesce(fingerprinting, FALSE) AND kind <> 'pixel' AS fingerprinting,
            coalesce(session_recording, FALSE) AND kind = 'script' AS session_recording, opt_out
        FROM §best WHERE pick = 1 AND (tdomain IS NOT NULL OR kind = 'pixel')""",
    "uniq": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id, host ORDER BY ord) AS nth FROM §found) WHERE nth = 1""",
    "inline": f"""SELECT page_id, idx, regexp_extract(el, '(?i)^<script\\b[^>]*>([\\s\\S]*?)</script\\s*>$', 1) AS body FROM §els
        WHERE regexp_matches(el, '(?i)^<script') AND {attribute('el', 'src')} IS NULL""",
    "fp": f"""SELECT page_id, 'Pattern `' || p || '` found in inline script' AS e FROM (SELECT page_id, CASE {' '.join(
            f'WHEN regexp_matches(body, {q(p)}) THEN {q(p)}' for p in pages.FINGERPRINTING)} END AS p FROM §inline) WHERE p IS NOT NULL
        UNION ALL SELECT page_id, 'Known fingerprinting service: ' || name FROM §found WHERE fingerprinting""",
    "sr": f"""SELECT page_id, 'Session recording pattern found: `' || p[1:40] || '`' AS e FROM (SELECT page_id, CASE {' '.join(
            f'WHEN regexp_matches(body, {q(p)}) THEN {q(p)}' for p in pages.RECORDING)} END AS p FROM §inline) WHERE p IS NOT NULL
        UNION ALL SELECT page_id, 'Known session recorder: ' || name FROM §found WHERE session_recording""",
    "ck0": f"""SELECT page_id, i AS ord, list_transform(string_split(c, ';'), lambda p: trim(p)) AS p FROM (SELECT page_id,
            unnest(range(len(cs))) AS i, unnest(cs) AS c FROM (SELECT page_id, list_filter(string_split(raw_cookies, {NL}), lambda x: x <> '')
            AS cs FROM §pages))""",
    "ck1": """SELECT page_id, ord, trim(split_part(p[1], '=', 1)) AS name, CASE WHEN contains(p[1], '=') THEN
            regexp_extract(p[1], '^[^=]*=(.*)$', 1) ELSE '' END AS value, list_transform(p[2:], lambda x: lower(trim(split_part(x, '=', 1)))) AS ks,
            p[2:] AS vs FROM §ck0""",
    "ck2": "SELECT page_id, ord, name, value, " + ", ".join(
        f"CASE WHEN list_contains(ks, '{k}') THEN CASE WHEN contains(vs[list_position(ks, '{k}')], '=') THEN "
        f"trim(regexp_extract(vs[list_position(ks, '{k}')], '^[^=]*=(.*)$', 1)) ELSE '' END END AS {a}"
        for k, a in (("httponly", "ho"), ("secure", "se"), ("samesite", "ss"), ("path", "pa"), ("domain", "dom"), ("max-age", "ma")))
        + " FROM §ck1",
    "ck": f"""SELECT *, CASE WHEN max_age IS NULL THEN 'session' {' '.join(f'WHEN max_age <= {u} THEN {q(lb)}' for u, lb in pages.DURATIONS)}
            ELSE (max_age // 31536000) || '+ years' END AS duration_label, CASE WHEN {' OR '.join(
                f'starts_with(lower(name), {q(x)})' for x in pages.COOKIE_PREFIXES[0][1])} THEN 'necessary' WHEN {' OR '.join(
                [f'starts_with(lower(name), {q(x)})' for x in pages.COOKIE_PREFIXES[1][1]] +
                [f"contains(lower(coalesce(domain, '')), {q(x)})" for x in pages.COOKIE_DOMAINS[0][1]])} THEN 'analytics' WHEN {' OR '.join(
                [f'starts_with(lower(name), {q(x)})' for x in pages.COOKIE_PREFIXES[2][1]] +
                [f"contains(lower(coalesce(domain, '')), {q(x)})" for x in pages.COOKIE_DOMAINS[1][1]])} THEN 'advertising' ELSE 'unknown' END AS category
        FROM (SELECT page_id, ord, name, CASE WHEN value <> '' THEN value[1:20] || '…' ELSE '' END AS value_preview, ho IS NOT NULL AS httponly,
            se IS NOT NULL AS secure, CASE WHEN ss = '' THEN 'Lax' ELSE ss END AS samesite, coalesce(pa, '/') AS path, nullif(dom, '') AS domain,
            CASE WHEN regexp_matches(ma, '^-*[0-9]+$') THEN CAST(ma AS BIGINT) END AS max_age FROM §ck2)""",
    "cksec": """SELECT page_id, count(*) AS n_cookies, round(avg(CAST(httponly AS INTEGER)) * 100, 1) AS httponly_pct,
            round(avg(CAST(secure AS INTEGER)) * 100, 1) AS secure_pct, round(avg(CASE WHEN samesite <> '' THEN 1 ELSE 0 END) * 100, 1)
            AS samesite_pct FROM §ck GROUP BY page_id""",
    "cmp": f"""SELECT page_id, CASE {' '.join(f'WHEN {any_of("lower(html)", p)} THEN {q(n)}' for n, p in pages.CONSENT_PLATFORMS)} END AS cmp_detected,
            regexp_matches(lower(html), {q(pages.PRIVACY_SANDBOX)}) AS privacy_sandbox_detected FROM §pages""",
    "trk_page": """SELECT p.page_id, p.domain, coalesce(u.n, 0) AS total_tracker_count, coalesce(f.hi, 0) AS high_risk_count,
            x.e IS NOT NULL AS fingerprinting_detected, coalesce(x.e, '') AS fingerprinting_evidence, y.e IS NOT NULL AS session_recording_detected,
            coalesce(y.e, '') AS session_recording_evidence, c.cmp_detected, c.privacy_sandbox_detected, coalesce(k.n_cookies, 0) AS n_cookies,
            coalesce(k.httponly_pct, 0) AS httponly_pct, coalesce(k.secure_pct, 0) AS secure_pct, coalesce(k.samesite_pct, 0) AS samesite_pct
        FROM §pages p JOIN §cmp c USING (page_id) LEFT JOIN (SELECT page_id, count(*) AS n FROM §uniq GROUP BY page_id) u USING (page_id)
        LEFT JOIN (SELECT page_id, count(*) FILTER (WHERE risk IN ('high', 'critical')) AS hi FROM §found GROUP BY page_id) f USING (page_id)
        LEFT JOIN (SELECT page_id, array_to_string(list_sort(list(DISTINCT e))[1:5], '|') AS e FROM §fp GROUP BY page_id) x USING (page_id)
        LEFT JOIN (SELECT page_id, array_to_string(list_sort(list(DISTINCT e))[1:5], '|') AS e FROM §sr GROUP BY page_id) y USING (page_id)
        LEFT JOIN §cksec k USING (page_id)""",
    "dt_doc": """SELECT d.doc_id, count(t.ord) AS types, CAST(coalesce(sum(CASE WHEN sensitivity = 'critical' THEN CASE WHEN gdpr_special_category
            THEN 10 ELSE 8 END WHEN sensitivity = 'high' THEN 4 WHEN sensitivity = 'medium' THEN 1 ELSE 0 END), 0) AS BIGINT) AS points,
            count(*) FILTER (WHERE shared) AS n_shared FROM §docs d LEFT JOIN §dt t USING (doc_id) GROUP BY d.doc_id""",
    "site": """SELECT d.doc_id, d.domain, d.policy_found, length(d.text) AS chars, CASE WHEN NOT d.policy_found THEN 'no_policy'
            WHEN length(d.text) < 100 THEN 'unreadable' ELSE 'full' END AS state, t.types, t.points, t.n_shared, s.n AS n_recipients,
            s.advertising_partners, s.data_sold, s.abroad, s.safeguards, s.unnamed_count, w.transparency_score, w.vagueness_score,
            w.dpo_named, w.legitimate_basis, w.privacy_by_design, w.named, g.gdpr_score, g.ccpa_score, g.overall_rights_score, r.overall_rating,
            r.has_indefinite_retention, r.has_specific_periods, r.has_event_based_deletion, r.deletion_on_request,
            r.storage_limitation_mentioned, k.high, k.medium, k.low_n, k.n AS n_dark, k.consent_mechanism_quality,
            p.page_id IS NOT NULL AS tracked, p.total_tracker_count, p.fingerprinting_detected, p.session_recording_detected, p.n_cookies,
            p.httponly_pct, p.secure_pct, p.samesite_pct, p.cmp_detected, l.dnt_mentioned, l.dnt_honored, l.gpc, l.frameworks
        FROM §docs d JOIN §dt_doc t USING (doc_id) JOIN §share s USING (doc_id) JOIN §wrd w USING (doc_id) JOIN §rgt_doc g USING (doc_id)
        JOIN §ret r USING (doc_id) JOIN §dark_doc k USING (doc_id) JOIN §flags l USING (doc_id) LEFT JOIN §trk_page p ON p.page_id = d.doc_id""",
    "dims": f"""SELECT *, CASE state WHEN 'no_policy' THEN 0 WHEN 'unreadable' THEN 50 ELSE greatest(0, 100 - points - greatest(0, n_shared - 5) * 3 -
            CASE WHEN data_sold THEN 20 ELSE 0 END) END AS data_collection_score,
            CASE state WHEN 'no_policy' THEN 0 WHEN 'unreadable' THEN 50 ELSE greatest(0, 100 - CASE WHEN n_recipients <= 5 THEN n_recipients * 3
            WHEN n_recipients <= 15 THEN 15 + (n_recipients - 5) * 4 ELSE 55 + (n_recipients - 15) * 2 END -
            CASE WHEN advertising_partners > 3 THEN advertising_partners * 4 ELSE 0 END - CASE WHEN data_sold THEN 25 ELSE 0 END -
            CASE WHEN abroad AND safeguards = '' THEN 15 ELSE 0 END - CASE WHEN unnamed_count > 10 THEN 10 ELSE 0 END) END AS sharing_score,
            CASE state WHEN 'no_policy' THEN 0 WHEN 'unreadable' THEN 25 ELSE transparency_score END AS transparency_dim,
            CASE state WHEN 'no_policy' THEN 0 WHEN 'unreadable' THEN 50 ELSE overall_rights_score END AS rights_score,
            CASE state WHEN 'no_policy' THEN 0 WHEN 'unreadable' THEN 50 ELSE greatest(0, {case_of('overall_rating', scoring.RETENTION_SCORE, 0)} -
            CASE WHEN has_indefinite_retention THEN 30 ELSE 0 END) END AS retention_score,
            CASE state WHEN 'no_policy' THEN 0 WHEN 'unreadable' THEN 70 ELSE greatest(0, 100 - high * 15 - medium * 8 - low_n * 4) END AS dark_patterns_score,
            CASE state WHEN 'no_policy' THEN 0 WHEN 'unreadable' THEN CASE WHEN NOT tracked THEN 50 WHEN total_tracker_count = 0 THEN 90
            WHEN total_tracker_count <= 3 THEN 70 WHEN total_tracker_count <= 8 THEN 45 ELSE 20 END ELSE greatest(0, 100 -
            CASE WHEN coalesce(total_tracker_count, 0) > 20 THEN 30 WHEN coalesce(total_tracker_count, 0) > 10 THEN 18
            WHEN coalesce(total_tracker_count, 0) > 5 THEN 10 ELSE 0 END - CASE WHEN coalesce(fingerprinting_detected, FALSE) THEN 25 ELSE 0 END -
            CASE WHEN coalesce(session_recording_detected, FALSE) THEN 15 ELSE 0 END - CASE WHEN n_cookies > 0 AND secure_pct < 50 THEN 10 ELSE 0 END -
            CASE WHEN n_cookies > 0 AND httponly_pct < 50 THEN 8 ELSE 0 END - CASE WHEN n_cookies > 0 AND samesite_pct < 30 THEN 5 ELSE 0 END) END
            AS technical_score FROM §site""",
    "scored": f"""SELECT *, {case_scale('overall', scoring.GRADE_CUTS, 'F')} AS grade, {case_scale('overall', scoring.RISK_CUTS, 'critical')} AS risk_level
        FROM (SELECT *, CASE WHEN state = 'no_policy' THEN 5 ELSE CAST(greatest(0, least(100, trunc({' + '.join(
            f'{c} * CAST({w} AS DOUBLE)' for c, (_, w) in zip(('data_collection_score', 'sharing_score', 'transparency_dim', 'rights_score',
                                                            'retention_score', 'dark_patterns_score', 'technical_score'), scoring.WEIGHTS))}))) AS INTEGER)
            END AS overall FROM §dims)""",
    "fetch": f"""SELECT doc_id AS fetch_id, source AS domain, 'https://' || source || '.example/privacy' AS policy_url,
            TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 HOUR * doc_id AS fetched_at, CASE WHEN (doc_id // 20) % 5 = 4 THEN
            {q(seeds.CLAUSES[0])} || {NL} || {q(seeds.CLAUSES[9])} ELSE {q(seeds.CLAUSES[0])} || {NL} || {q(seeds.CLAUSES[9])} || {NL} || text ||
            {NL} || {pick(seeds.CLAUSES, '(doc_id // 20)')} END AS text FROM documents""",
    "ver": """SELECT fetch_id AS version_id, domain, h AS content_hash, fetched_at, row_number() OVER (PARTITION BY domain ORDER BY fetched_at DESC,
            fetch_id DESC) = 1 AS is_current, policy_url, text FROM (SELECT *, row_number() OVER (PARTITION BY domain, h ORDER BY fetched_at,
            fetch_id) AS nth FROM (SELECT *, sha256(text) AS h FROM §fetch)) WHERE nth = 1""",
    "pair": """SELECT * FROM (SELECT domain, lag(version_id) OVER w AS old_version_id, version_id AS new_version_id, fetched_at AS detected_at,
            lag(text) OVER w AS old_text, text AS new_text FROM §ver WINDOW w AS (PARTITION BY domain ORDER BY fetched_at, version_id))
        WHERE old_version_id IS NOT NULL""",
    "result": """SELECT s.doc_id AS result_id, s.domain, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 HOUR * s.doc_id AS analyzed_at, s.overall AS overall_score,
            s.grade, v.version_id AS policy_version_id FROM §scored s LEFT JOIN §fetch f ON f.fetch_id = s.doc_id LEFT JOIN §ver v ON v.domain = f.domain
            AND v.content_hash = sha256(f.text)""",
    "req": "SELECT event_id, user_id AS tab_id, ts, CASE event_type WHEN 'view' THEN 'navigate' WHEN 'signup' THEN 'close' ELSE 'request' END AS kind, "
           f"CASE event_id % 3 WHEN 0 THEN 'https://www.' || {pick(trackers.LIVE_HOSTS, 'event_id')} || '/t.js' WHEN 1 THEN 'https://cdn' || "
           f"(event_id % 41) || '.' || {pick(trackers.LIVE_HOSTS, 'event_id')} ELSE 'https://static' || (event_id % 41) || '.site.test/a.png' END AS url "
           "FROM events",
    "live": "SELECT unnest(" + q(list(trackers.LIVE_HOSTS)) + ") AS domain",
    "match": f"""SELECT event_id, tab_id, ts, kind, url, tracker, CASE WHEN tracker IS NOT NULL THEN CASE WHEN tracker IN ({', '.join(
            q(h) for h in trackers.LIVE_HIGH_RISK)}) THEN 'high' ELSE 'medium' END END AS risk FROM (SELECT r.*, l.domain AS tracker,
            row_number() OVER (PARTITION BY event_id ORDER BY length(l.domain) DESC NULLS LAST) AS pick
            FROM (SELECT *, {host('url')} AS host FROM §req) r LEFT JOIN §live l ON r.host = l.domain OR ends_with(r.host, '.' || l.domain)) WHERE pick = 1""",
    "epoch": """SELECT *, sum(CASE WHEN kind IN ('navigate', 'close') THEN 1 ELSE 0 END) OVER (PARTITION BY tab_id ORDER BY ts, event_id) AS epoch
        FROM §match""",
    "seen": """SELECT tab_id, CAST(epoch AS BIGINT) AS epoch, tracker, event_id, ts, risk FROM (SELECT *, row_number() OVER (PARTITION BY tab_id, epoch,
            tracker ORDER BY ts, event_id) AS nth FROM §epoch WHERE tracker IS NOT NULL AND kind = 'request') WHERE nth = 1""",
    "lnk0": f"""SELECT page_id, base, url, i, {attribute('a', 'href')} AS href, {squeeze(unescape("regexp_replace(a, '<[^>]*>', ' ', 'g')"))} AS text
        FROM (SELECT page_id, base, url, unnest(range(len(f))) AS i, unnest(f) AS a FROM (SELECT page_id, base, url, regexp_extract_all(
            regexp_replace(html, {q(disc._CLEAN)}, '', 'g'), {q(disc._ANCHOR)}) AS f FROM §pages))""",
}


def absolute(href: str, base: str, page: str) -> str:
    plain = f"regexp_replace({page}, '[?#].*$', '')"
    folder = f"nullif(regexp_extract({plain}, '^(https?://[^/]+(?:/.*)?/)[^/]*$', 1), '')"
    whole = (f"CASE WHEN regexp_matches({href}, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN {href} WHEN starts_with({href}, '//') THEN "
             f"regexp_extract({page}, '^([a-z]+:)', 1) || {href} WHEN starts_with({href}, '/') THEN {base} || {href} "
             f"WHEN starts_with({href}, '?') THEN {plain} || {href} ELSE coalesce({folder}, {base} || '/') || {href} END")
    path = f"regexp_extract({whole}, '^https?://[^/?#]*([^?#]*)', 1)"
    # Segments from the left; ".." takes the last one kept away.
    kept = (f"list_reduce(list_transform(string_split({path}, '/')[2:], lambda s: [s]), lambda a, s: CASE WHEN s[1] = '..' THEN a[1:len(a) - 1] "
            f"WHEN s[1] = '.' THEN a ELSE list_concat(a, s) END, CAST([] AS VARCHAR[]))")
    return (f"CASE WHEN regexp_matches({whole}, '^https?://[^?#]*/[.][.]?([/?#]|$)') THEN regexp_extract({whole}, '^(https?://[^/?#]*)', 1) || '/' || "
            f"array_to_string({kept}, '/') || CASE WHEN regexp_matches({path}, '(^|/)[.][.]?$') AND len({kept}) > 0 THEN '/' ELSE '' END || "
            f"regexp_extract({whole}, '^https?://[^?#]*([\\s\\S]*)$', 1) ELSE {whole} END")


_SKIP = " AND ".join(f"NOT starts_with(href, {q(s)})" for s in discovery.SKIPPED_HREFS)
CTES["lnk1"] = (f"SELECT *, {absolute('href', 'base', 'url')} AS \"full\" FROM §lnk0 WHERE href IS NOT NULL AND href <> '' AND {_SKIP}")
CTES["lnk"] = ("""SELECT page_id, href, text, "full", row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS pos, i FROM (SELECT *, row_number()
    OVER (PARTITION BY page_id, "full" ORDER BY i) AS nth FROM §lnk1) WHERE nth = 1""")
# Regions of a page: every tag with its number, the first that opens a region of each kind, the tag that closes it, and the markup between.
CTES["rtags"] = f"""SELECT page_id, base, url, clean, regexp_extract_all(clean, {q(H.TAG)}) AS tags, string_split_regex(clean, {q(H.TAG)}) AS pieces
    FROM (SELECT page_id, base, url, regexp_replace(html, {q(disc._CLEAN)}, '', 'g') AS clean FROM §pages)"""
CTES["rtag"] = f"""SELECT *, lower(regexp_extract(tag, '^</?([a-zA-Z][a-zA-Z0-9]*)', 1)) AS name, CASE WHEN starts_with(tag, '</') THEN -1
    WHEN ends_with(tag, '/>') THEN 0 ELSE 1 END AS step FROM (SELECT page_id, unnest(tags) AS tag, unnest(range(len(tags))) AS i,
    unnest(pieces[2:]) AS behind FROM §rtags)"""
CTES["ropen"] = f"""SELECT page_id, g, min(i) AS i FROM (SELECT *, {attribute('tag', 'role')} AS role, {attribute('tag', 'id')} AS id,
    ' ' || regexp_replace(coalesce({attribute('tag', 'class')}, ''), '\\s+', ' ', 'g') || ' ' AS words FROM §rtag WHERE NOT starts_with(tag, '</'))
    JOIN (VALUES {', '.join(f"({g}, {q(k)}, {q(v)})" for g, (k, v) in enumerate(discovery.LINK_REGIONS))}) AS r(g, kind, wanted) ON CASE kind
    WHEN 'tag' THEN name = wanted WHEN 'role' THEN role = wanted WHEN 'id' THEN id = wanted ELSE contains(words, ' ' || wanted || ' ') END
    GROUP BY page_id, g"""
CTES["rstop"] = """SELECT page_id, g, min(i) AS stop FROM (SELECT o.page_id, o.g, t.i, sum(CASE WHEN t.i = o.i THEN 1 ELSE t.step END) OVER (PARTITION BY o.page_id, o.g
    ORDER BY t.i) AS depth FROM §ropen o JOIN §rtag s ON s.page_id = o.page_id AND s.i = o.i JOIN §rtag t ON t.page_id = o.page_id
    AND t.name = s.name AND t.i >= o.i) WHERE depth = 0 GROUP BY ALL"""
CTES["reg0"] = """SELECT o.page_id, o.g, string_agg(t.tag || t.behind, '' ORDER BY t.i) AS part FROM §ropen o LEFT JOIN §rstop s USING (page_id, g)
    JOIN §rtag t ON t.page_id = o.page_id AND t.i >= o.i AND t.i < coalesce(s.stop, 1000000000) GROUP BY ALL"""
CTES["reg1"] = f"""SELECT page_id, base, url, g, unnest(range(len(f))) AS i, unnest(f) AS a FROM (SELECT page_id, base, url, g,
    regexp_extract_all(part, {q(disc._ANCHOR)}) AS f FROM (SELECT page_id, base, url, g, part FROM §reg0 JOIN §rtags USING (page_id)
    UNION ALL SELECT page_id, base, url, 99, clean FROM §rtags))"""
CTES["reg2"] = f"""SELECT page_id, g, i, href, text, {absolute('href', 'base', 'url')} AS "full" FROM (SELECT *, {attribute('a', 'href')} AS href,
    {squeeze(unescape("regexp_replace(a, '<[^>]*>', ' ', 'g')"))} AS text FROM §reg1) WHERE href IS NOT NULL AND href <> '' AND {_SKIP}"""
CTES["pref"] = """SELECT page_id, href, text, "full", row_number() OVER (PARTITION BY page_id ORDER BY g, i) - 1 AS pos FROM (SELECT *, row_number()
    OVER (PARTITION BY page_id, href ORDER BY g, i) AS nth FROM §reg2 r WHERE g < 99 OR NOT EXISTS (SELECT 1 FROM §reg2 o WHERE o.page_id = r.page_id
    AND o.g < 99)) WHERE nth = 1"""
CTES["pick"] = f"""SELECT page_id, href, text, "full" AS url FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS nth FROM §pref
    WHERE {any_of('lower(text)', discovery.LINK_TEXTS)} OR {url_signal('href')}) WHERE nth = 1"""
CTES["stored"] = f"""SELECT url, arg_min(html, page_id) AS html FROM (SELECT base || {pick(discovery.POLICY_PATHS[:8], 'page_id')} AS url,
    CASE WHEN page_id % 2 = 0 THEN '<main><p>' || {q(D_TEXT)} || '</p></main>' ELSE '<p>Nothing to see here.</p>' END AS html, page_id FROM §pages)
    GROUP BY url"""
CTES["canon"] = f"""SELECT page_id, ord, p.base || path AS url FROM §pages p, ({values(list(enumerate(discovery.POLICY_PATHS)), 'ord', 'path')})
    WHERE p.base || path IN (SELECT url FROM §stored)"""
CTES["robot"] = f"SELECT page_id, base, replace({pick(seeds.ROBOTS, 'page_id')}, '@', base) AS body FROM §pages"
CTES["smap"] = f"""SELECT sitemap_url, arg_min(body, page_id) AS body FROM (SELECT base || '/sitemap.xml' AS sitemap_url, page_id,
    replace({pick(seeds.SITEMAPS, 'page_id')}, '@', base) AS body FROM §pages UNION ALL SELECT base || '/maps/two.xml', page_id,
    replace({pick(seeds.SITEMAPS, '(page_id + 2)')}, '@', base) FROM §pages) GROUP BY sitemap_url"""
CTES["rmap"] = f"""SELECT page_id, unnest(range(len(f))) AS ord, unnest(f) AS sitemap_url FROM (SELECT page_id, list_concat(
    regexp_extract_all(body, '(?im)^Sitemap:[ \\t]*([^ \\t\\r\\n]+)', 1)[1:5], [{', '.join(f'base || {q(n)}' for n in discovery.SITEMAP_NAMES)}]) AS f
    FROM §robot)"""
CTES["sloc"] = """SELECT sitemap_url, unnest(range(len(f))) AS pos, trim(unnest(f)) AS url FROM (SELECT sitemap_url,
    regexp_extract_all(body, '(?i)<loc>([^<]*)</loc>', 1) AS f FROM §smap)"""
CTES["shit"] = f"SELECT * FROM §sloc WHERE {url_signal('url')}"
CTES["snest"] = """SELECT sitemap_url, unnest(range(len(f))) AS sub, trim(unnest(f)) AS inner_url FROM (SELECT sitemap_url,
    regexp_extract_all(body, '(?i)<sitemap>[^<]*<loc>([^<]*)</loc>', 1)[1:5] AS f FROM §smap)"""
CTES["spick"] = """SELECT page_id, url FROM (SELECT page_id, url, row_number() OVER (PARTITION BY page_id ORDER BY ord, sub, pos) AS nth FROM (
    SELECT r.page_id, r.ord, -1 AS sub, h.pos, h.url FROM §rmap r JOIN §shit h USING (sitemap_url) UNION ALL
    SELECT r.page_id, r.ord, n.sub, h.pos, h.url FROM §rmap r JOIN §snest n USING (sitemap_url) JOIN §shit h ON h.sitemap_url = n.inner_url)) WHERE nth = 1"""


_TAG = q(H.TAG)
_WORDS = lambda name, ws: f"regexp_matches(lower(coalesce({attribute('tag', name)}, '')), {q('|'.join(ws))})"
_LINES = lambda nodes, least: (
    f"array_to_string(list_filter(list_transform(string_split({unescape(f'array_to_string({nodes}, {NL})')}, {NL}), "
    f"lambda n: regexp_replace(n, '^\\s+|\\s+$', '', 'g')), lambda n: length(n) > {least}), {NL})")
CTES["ctags"] = f"""SELECT page_id, regexp_extract_all(clean, {_TAG}) AS tags, string_split_regex(clean, {_TAG}) AS pieces FROM (
    SELECT page_id, {gone('html', discovery.DROPPED_TAGS)} AS clean FROM §pages)"""
CTES["ctag"] = """SELECT page_id, unnest(tags) AS tag, unnest(range(len(tags))) AS i, lower(regexp_extract(unnest(tags), '^</?([a-zA-Z][a-zA-Z0-9]*)', 1))
    AS name FROM §ctags"""
CTES["cbest"] = f"""SELECT page_id, arg_min(i, rank * 1000000 + i) AS opened, arg_min(name, rank * 1000000 + i) AS name FROM (SELECT *, CASE
    WHEN starts_with(tag, '</') THEN NULL WHEN name = 'main' THEN 0 WHEN lower(coalesce({attribute('tag', 'role')}, '')) = 'main' THEN 1
    WHEN {_WORDS('id', discovery.MAIN_ID_WORDS)} THEN 2 WHEN {_WORDS('class', discovery.MAIN_CLASS_WORDS)} THEN 3 WHEN name = 'article' THEN 4
    WHEN name = 'body' THEN 5 END AS rank FROM §ctag) WHERE rank IS NOT NULL GROUP BY page_id"""
CTES["cstop"] = """SELECT page_id, min(i) AS stop FROM (SELECT t.page_id, t.i, sum(CASE WHEN starts_with(t.tag, '</') THEN -1 ELSE 1 END) OVER (
    PARTITION BY t.page_id ORDER BY t.i) AS depth FROM §ctag t JOIN §cbest b ON b.page_id = t.page_id AND b.name = t.name AND t.i >= b.opened)
    WHERE depth = 0 GROUP BY page_id"""
CTES["ctext"] = f"""SELECT t.page_id, {_LINES('pieces[coalesce(opened + 2, 1):coalesce(stop + 1, len(pieces))]' , discovery.MIN_LINE)} AS text
    FROM §ctags t LEFT JOIN §cbest USING (page_id) LEFT JOIN §cstop USING (page_id)"""
_VALUE = q(r'"((?:[^"\\]|\\.)*)"(?:\s*:)?')
CTES["jstr"] = f"""SELECT page_id, string_agg(CASE WHEN contains(s, '<') AND contains(s, '>') THEN {_LINES("string_split_regex(s, '<[^>]*>')", 0)} ELSE s END,
    {NL} ORDER BY idx, k) AS text FROM (SELECT page_id, idx, k, json_extract_string(v, '$') AS s FROM (SELECT page_id, idx, unnest(vs) AS v,
    unnest(range(len(vs))) AS k FROM (SELECT page_id, idx, regexp_extract_all(body, {_VALUE}) AS vs FROM §jscript)) WHERE length(v) > 32 AND NOT ends_with(v, ':'))
    WHERE length(s) > 30 GROUP BY page_id"""
CTES["jscript"] = f"""SELECT page_id, idx, body FROM (SELECT page_id, idx, el, regexp_extract(el, '(?i)^<script\\b[^>]*>([\\s\\S]*?)</script\\s*>$', 1) AS body FROM (
    SELECT page_id, unnest(es) AS el, unnest(range(len(es))) AS idx FROM (SELECT page_id, regexp_extract_all(html, {q(rf'(?i){H.COMMENT}|{H.SCRIPT}')}) AS es
    FROM §pages)) WHERE NOT starts_with(el, '<!--')) WHERE coalesce({attribute('el', 'id')}, '') = '__NEXT_DATA__' OR (lower(coalesce({attribute('el', 'type')}, ''))
    IN ('application/json', 'application/ld+json') AND length(body) > 100)"""
CTES["jnos"] = f"""SELECT page_id, string_agg(t, {NL} ORDER BY k) AS text FROM (SELECT page_id, k, {_LINES("string_split_regex(m, '<[^>]*>')", 0)} AS t FROM (
    SELECT page_id, unnest(ms) AS m, unnest(range(len(ms))) AS k FROM (SELECT page_id, list_concat(regexp_extract_all({gone('html', ())},
    '(?i)<noscript\\b[^>]*>([\\s\\S]*?)</noscript\\s*>', 1), flatten(list_transform(list_filter(list_transform(list_filter(regexp_extract_all(html,
    {q(rf'(?i){H.COMMENT}|{H.SCRIPT}')}), lambda e: NOT starts_with(e, '<!--')), lambda e: regexp_extract(e, '(?i)^<script\\b[^>]*>([\\s\\S]*?)</script\\s*>$', 1)),
    lambda b: regexp_matches(lower(b), 'privacy|gizlilik|kvkk')), lambda b: regexp_extract_all(b, {q("""["'](<[^"']{200,})["']""")}, 1)))) AS ms FROM §pages)))
    WHERE length(t) > 100 GROUP BY page_id"""
CTES["embed"] = f"""SELECT p.page_id, {_LINES("[coalesce(j.text, ''), coalesce(n.text, '')]", discovery.MIN_LINE)} AS embedded FROM §pages p
    LEFT JOIN §jstr j USING (page_id) LEFT JOIN §jnos n USING (page_id)"""


def _ledger(rows, state: str = "full") -> str:
    """doc_id, seq, dimension, reason, points of the rows (test, dimension, reason, points) that hold; reason and points are SQL."""
    return " UNION ALL ".join(f"SELECT doc_id, {1000 + i} AS seq, {q(d)} AS dimension, {r} AS reason, CAST({p} AS INTEGER) AS points FROM §scored "
                              f"WHERE state = {q(state)} AND ({t})" for i, (t, d, r, p) in enumerate(rows))


_MANY = "CASE WHEN n_recipients <= 5 THEN n_recipients * 3 WHEN n_recipients <= 15 THEN 15 + (n_recipients - 5) * 4 ELSE 55 + (n_recipients - 15) * 2 END"
_N = "coalesce(total_tracker_count, 0)"
_PCT = lambda c, name: f"'Only ' || CAST(round_even({c}, 0) AS INTEGER) || '% of cookies have {name}'"
_FIRST = lambda c, n: f"array_to_string(string_split({c}, '|')[1:{n}], ', ')"
_AGAINST = (
    ("n_shared > 5", "data_collection", "n_shared || ' data types shared with third parties'", "(n_shared - 5) * 3"),
    ("data_sold", "data_collection", q("Personal data is sold to third parties"), 20),
    ("n_recipients > 5 AND n_recipients <= 15", "sharing", "n_recipients || ' third-party data recipients'", _MANY),
    ("n_recipients > 15", "sharing", "'Excessive third-party sharing (' || n_recipients || ' parties)'", _MANY),
    ("advertising_partners > 3", "sharing", "advertising_partners || ' advertising partners'", "advertising_partners * 4"),
    ("data_sold", "sharing", q("Data sold to third parties (CCPA opt-out required)"), 25),
    ("abroad AND safeguards = ''", "sharing", q("International data transfers without documented safeguards"), 15),
    ("unnamed_count > 10", "sharing", "'≥' || unnamed_count || ' unnamed third parties referenced'", 10),
    ("NOT dpo_named", "transparency", q("No DPO identified (recommended under GDPR Art. 37)"), 5),
    ("NOT legitimate_basis", "transparency", q("Lawful basis for processing not clearly stated (GDPR Art. 6)"), 8),
    ("has_indefinite_retention", "retention", q("Data retained indefinitely"), 30),
    ("NOT has_specific_periods AND NOT has_event_based_deletion", "retention", q("No specific retention periods stated (violates GDPR Art. 5(1)(e))"), 20),
)
_AGAINST_TECHNICAL = (
    (f"{_N} > 20", "technical", "total_tracker_count || ' trackers detected on website'", 30),
    ("coalesce(fingerprinting_detected, FALSE)", "technical", q("Browser fingerprinting detected (high risk, often unconsented)"), 25),
    ("coalesce(session_recording_detected, FALSE)", "technical", q("Session recording active (captures all user interactions)"), 15),
    ("coalesce(n_cookies, 0) > 0 AND secure_pct < 50", "technical", _PCT("secure_pct", "Secure flag"), 10),
    ("coalesce(n_cookies, 0) > 0 AND httponly_pct < 50", "technical", _PCT("httponly_pct", "HttpOnly flag"), 8),
    ("coalesce(n_cookies, 0) > 0 AND samesite_pct < 30", "technical", _PCT("samesite_pct", "SameSite attribute"), 5),
)
_UNREAD = (
    (f"{_N} BETWEEN 4 AND 8", "technical", "total_tracker_count || ' trackers detected'", 15),
    (f"{_N} > 8", "technical", "total_tracker_count || ' trackers detected'", 30),
    ("TRUE", "transparency", q("Policy page is JavaScript-rendered — full text analysis unavailable"), 20),
)
_FOR = (
    ("n_recipients = 0", "sharing", q("No third-party sharing detected"), 5),
    ("safeguards <> ''", "sharing", f"'Transfer safeguards documented: ' || {_FIRST('safeguards', 2)}", 5),
    ("dpo_named", "transparency", q("Data Protection Officer (DPO) named"), 5),
    ("legitimate_basis", "transparency", q("Lawful basis for processing explicitly stated"), 5),
    ("privacy_by_design", "transparency", q("Privacy by Design/Default principles mentioned"), 5),
    ("named > 5", "transparency", "named || ' third parties specifically named'", 5),
    ("dnt_honored", "rights", q("Do Not Track (DNT) / GPC honored"), 5),
    ("dnt_mentioned AND NOT dnt_honored", "rights", q("DNT mentioned"), 2),
    ("gpc", "rights", q("Global Privacy Control (GPC) supported"), 5),
    ("frameworks <> ''", "rights", f"'Frameworks referenced: ' || {_FIRST('frameworks', 3)}", 3),
    ("has_event_based_deletion", "retention", q("Event-based deletion policy (e.g., upon account closure)"), 10),
    ("deletion_on_request", "retention", q("Data deletion on user request confirmed"), 10),
    ("storage_limitation_mentioned", "retention", q("Storage limitation principle explicitly acknowledged"), 5),
    ("consent_mechanism_quality = 'good'", "dark_patterns", q("Good consent mechanism: explicit, granular, withdrawable"), 10),
    ("consent_mechanism_quality = 'adequate'", "dark_patterns", q("Adequate consent mechanism"), 5),
    ("cmp_detected IS NOT NULL", "technical", "'Consent Management Platform detected: ' || cmp_detected", 8),
    ("total_tracker_count = 0", "technical", q("No trackers detected on website"), 15),
)
_UNREAD_FOR = (("TRUE", "general", q("Privacy policy page exists and is accessible"), 10),
               ("total_tracker_count = 0", "technical", q("No trackers detected"), 10))
CTES["lose"] = f"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY part, seq) - 1 AS pos, dimension, reason, points FROM (
    SELECT doc_id, 0 AS part, ord AS seq, 'data_collection' AS dimension, CASE WHEN gdpr_special_category THEN 'GDPR special category data: ' ELSE
    'Highly sensitive data: ' END || name AS reason, CASE WHEN gdpr_special_category THEN 10 ELSE 8 END AS points FROM §dt JOIN §scored USING (doc_id)
    WHERE sensitivity = 'critical' AND state = 'full' UNION ALL SELECT doc_id, 1, * EXCLUDE (doc_id) FROM ({_ledger(_AGAINST)}) UNION ALL
    SELECT doc_id, 2, ord, 'dark_patterns', 'Dark pattern: ' || name || ' (' || gdpr_reference || ')', {case_of('severity', scoring.DARK_PENALTY, 5)}
    FROM §dark JOIN §scored USING (doc_id) WHERE state = 'full' UNION ALL SELECT doc_id, 3, * EXCLUDE (doc_id) FROM ({_ledger(_AGAINST_TECHNICAL)}) UNION ALL
    SELECT doc_id, 4, * EXCLUDE (doc_id) FROM ({_ledger(_UNREAD, 'unreadable')}) UNION ALL
    SELECT doc_id, 5, 0, 'general', 'No privacy policy found', 95 FROM §scored WHERE state = 'no_policy')"""
CTES["gain"] = f"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY seq) - 1 AS pos, dimension, reason, points FROM (
    {_ledger(_FOR)} UNION ALL {_ledger(_UNREAD_FOR, 'unreadable')})"""


_BLOCK = re.compile(r"§([a-z][a-z_0-9]*)")


def sql(body: str) -> str:
    """A whole query: the blocks that a body names as §block, each after the blocks it reads, then the body."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for other in _BLOCK.findall(CTES[name]):
                visit(other)
            order.append(name)

    for name in _BLOCK.findall(body):
        visit(name)
    parts = ",\n".join(f"b_{n} AS MATERIALIZED ({CTES[n]})" for n in order)
    return _BLOCK.sub(r"b_\1", f"WITH {parts}\n{body}" if parts else body)
