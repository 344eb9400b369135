"""Every query by name: the Spark form, and the check form in SQL where SQL can say it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import text as T
from ..functions import urls as U
from ..operators import (context, dark_patterns, data_types, discovery, extraction, history, match, parties, recipients,
                         reports, retention, rights, scoring, trackers, wording)
from ..rules import answers as answer_rules
from ..rules import dark_patterns as dark_rules
from ..rules import data_types as type_rules
from ..rules import discovery as disc_rules
from ..rules import pages as page_rules
from ..rules import recipients as party_rules
from ..rules import retention as ret_rules
from ..rules import rights as right_rules
from ..rules import scoring as score_rules
from ..rules import trackers as tracker_rules
from ..rules import trust as trust_rules
from ..rules import wording as word_rules
from ..sources import dims, seeds, store, tables
from ..streaming import feeds
from .duck import absolute, any_of, attribute, case_of, count_of, gone, host, lines, likely, norm, pick, q, snippet, sql, url_signal

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if check is not None:
            CHECKS[name] = sql(check)
        return fn
    return add


def _docs(spark, path):
    return tables.policies(spark, path)


def _pages(spark, path):
    return tables.homepages(spark, path)


def _found(spark, path):
    return trackers.found_rows(_pages(spark, path), dims.tracker_table(spark), dims.tracker_rows())


def _parties(spark, path):
    return recipients.parties(_docs(spark, path), dims.trust_table(spark), len(dims.trust_rows()))


def _facts(spark, path, evidence=False):
    """Facts of all sites. Scores, counts and names need no evidence; the queries that show evidence say so."""
    return scoring.site_facts(_docs(spark, path), _pages(spark, path), evidence)


def _scored(spark, path, evidence=False):
    return scoring.score(_facts(spark, path, evidence))


def _results(spark, path):
    """One result per document, an hour apart: overall score, grade, and the version of the fetch that it judges."""
    fetched = tables.fetches(spark, path).select("fetch_id", F.col("domain").alias("d"), F.sha2("text", 256).alias("h"))
    found = _versions(spark, path).select("version_id", F.col("domain").alias("d"), F.col("content_hash").alias("h"))
    judged = fetched.join(found, ["d", "h"]).select(F.col("fetch_id").alias("doc_id"), F.col("version_id").alias("policy_version_id"))
    return _scored(spark, path).select("doc_id", "domain", "overall", "grade").join(judged, "doc_id", "left").select(
        F.col("doc_id").alias("result_id"), "domain", F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 3600).alias("analyzed_at"),
        F.col("overall").alias("overall_score"), "grade", "policy_version_id")


def _versions(spark, path):
    return history.versions(tables.fetches(spark, path))


def _live(spark, path):
    return feeds.live_match(tables.requests(spark, path))


def _joined(col: str) -> str:
    return f"array_join({col}, '|')"


# ---- sources and sinks

@query("s1_crawl_source", """SELECT d.doc_id, d.domain, d.policy_found, length(d.text) AS chars, sha256(d.text) AS content_hash, p.url,
    coalesce(length(p.html), 0) AS html_chars, coalesce(k.n, 0) AS cookies FROM §docs d LEFT JOIN §pages p ON p.page_id = d.doc_id
    LEFT JOIN (SELECT page_id, count(*) AS n FROM §ck0 GROUP BY page_id) k ON k.page_id = d.doc_id""")
def _(spark, path):
    docs = _docs(spark, path).select("doc_id", "domain", "policy_found", F.length("text").alias("chars"),
                                     F.sha2("text", 256).alias("content_hash"))
    pages = _pages(spark, path).select(F.col("page_id").alias("doc_id"), "url", F.length("html").alias("n"),
                                       F.size("cookies").alias("c"))
    return docs.join(pages, "doc_id", "left").select(
        "doc_id", "domain", "policy_found", "chars", "content_hash", "url", F.coalesce("n", F.lit(0)).alias("html_chars"),
        F.coalesce("c", F.lit(0)).alias("cookies"))


@query("s2_tracker_table", """SELECT t.domain, t.name, t.category, t.risk, count(r.host) AS resources FROM §trk t LEFT JOIN §res r
    ON r.host = t.domain GROUP BY ALL""")
def _(spark, path):
    seen = trackers.resources(_pages(spark, path)).groupBy("host").agg(F.count("*").alias("n"))
    return dims.tracker_table(spark).join(seen, F.col("domain") == F.col("host"), "left").select(
        "domain", "name", "category", "risk", F.coalesce("n", F.lit(0)).alias("resources"))


@query("s3_trust_table", """SELECT t.name_lc, t.trust_score, t.typical_data, count(n.name) AS mentions FROM §trust t LEFT JOIN §named n
    ON rtrim(lower(n.name), '.') = t.name_lc GROUP BY ALL""")
def _(spark, path):
    seen = recipients.mentioned(_docs(spark, path)).groupBy("name_lc").agg(F.count("*").alias("n"))
    return dims.trust_table(spark).join(seen, "name_lc", "left").select(
        "name_lc", "trust_score", F.expr(_joined("typical_data")).alias("typical_data"),
        F.coalesce("n", F.lit(0)).alias("mentions"))


_HIT_FAMILIES = ("accountability", "framework", "cookie_topic", "specific_purpose", "passive", "active", "transfer")


def _hit_sql(families) -> str:
    rows = [r for r in dims.rule_rows() if r[0] in families]
    return " UNION ALL ".join(
        f"SELECT {q(f)} AS family, {q(r)} AS rule_id, {i} AS pattern_id, count(*) AS docs, CAST(sum(len(regexp_extract_all(low, {q(p)}))) "
        f"AS BIGINT) AS hits, CAST(sum(length(regexp_extract(low, {q(f'^([^^]*?)(?:{p})'.replace('[^^]', chr(91) + chr(92) + 's' + chr(92) + 'S]'))}, 1))) AS BIGINT) "
        f"AS first_pos_sum FROM §docs WHERE regexp_matches(low, {q(p)}) HAVING count(*) > 0" for f, r, i, _, p, _ in rows)


def _rule_totals(spark, path, families):
    rules = [r for r in dims.rule_rows() if r[0] in families]
    return match.rule_hits(_docs(spark, path), rules).groupBy("family", "rule_id", "pattern_id").agg(
        F.count("*").alias("docs"), F.sum("n").alias("hits"), F.sum("first_pos").alias("first_pos_sum"))


@query("s4_rule_table", _hit_sql(_HIT_FAMILIES))
def _(spark, path):
    return _rule_totals(spark, path, _HIT_FAMILIES)


@query("j3_documents_x_rules", _hit_sql(("gdpr_right", "ccpa_right", "dark_pattern", "retention_event")))
def _(spark, path):
    return _rule_totals(spark, path, ("gdpr_right", "ccpa_right", "dark_pattern", "retention_event"))


@query("s5_saved_results", """SELECT result_id, domain, overall_score, grade, CAST(analyzed_date AS VARCHAR) AS analyzed_date, CASE WHEN result_id % 3 = 0 THEN 'morning'
    ELSE 'evening' END AS run FROM (SELECT *, CAST(analyzed_at AS DATE) AS analyzed_date FROM §result) WHERE analyzed_date >= DATE '2024-01-02'""")
def _(spark, path):
    results, folder = store.kept(_results(spark, path), "results"), store.shared(spark, "saved")
    for run in ("morning", "evening", "morning"):  # a repeated run changes nothing
        store.save_results(results.where((F.col("result_id") % 3 == 0) == F.lit(run == "morning")), folder, run)
    return store.read_results(spark, folder, since="2024-01-02").select(
        "result_id", "domain", "overall_score", "grade", F.col("analyzed_date").cast("string").alias("analyzed_date"), "run")


@query("s7_policy_text", "SELECT version_id, length(text) AS chars, len(regexp_extract_all(text, '\\S+')) AS word_count FROM §ver")
def _(spark, path):
    found = history.with_text(_versions(spark, path), tables.fetches(spark, path))
    return found.select("version_id", F.length("raw_text").alias("chars"), "word_count")


@query("s8_needs_refresh", """SELECT doc_id, domain, force_refresh FROM (SELECT doc_id, source AS domain, lang = 'fr' AS force_refresh FROM documents) r
    WHERE force_refresh OR domain NOT IN (SELECT domain FROM §result WHERE overall_score >= 30)""")
def _(spark, path):
    asked = tables.read(spark, path, "documents").select("doc_id", F.col("source").alias("domain"),
                                                         (F.col("lang") == "fr").alias("force_refresh"))
    return history.needs_refresh(asked, _results(spark, path).where("overall_score >= 30"))


# ---- addresses, markup, pages

_RAW = "CASE page_id % 3 WHEN 0 THEN url || '/' WHEN 1 THEN regexp_replace(url, '^https?:', '') ELSE '//' END"


@query("p1_normalise_url", f"""SELECT page_id, {norm('raw')} AS url, regexp_extract({norm('raw')}, '^https?://([^/?#:]*)', 1) <> '' AS valid
    FROM (SELECT page_id, {_RAW} AS raw FROM pages)""")
def _(spark, path):
    raw = tables.read(spark, path, "pages").select("page_id", F.expr(_RAW).alias("raw"))
    return raw.select("page_id", F.expr(U.normalise_url("raw")).alias("url"), F.expr(U.is_valid("raw")).alias("valid"))


@query("p2_site_domain", "SELECT page_id, domain, base FROM §pages")
def _(spark, path):
    return _pages(spark, path).select("page_id", "domain", "base")


@query("p3_resource_domain", f"SELECT page_id, idx, tag, src, {host('src')} AS host FROM §srcs WHERE src IS NOT NULL")
def _(spark, path):
    els = _pages(spark, path).select("page_id", F.expr(
        f"transform(regexp_extract_all(html, {T.quote(rf'(?i){H.COMMENT}|{H.SCRIPT}|<(?:img|iframe)\b[^>]*>')}, 0), (e, i) -> "
        f"named_struct('idx', i, 'tag', {H.tag_name('e')}, 'src', if(startswith(e, '<!--'), NULL, {H.attribute('e', 'src')})))").alias("es"))
    return T.explode_rows(els, "es", "e").select("page_id", "e.*").where("src IS NOT NULL").withColumn(
        "host", F.expr(U.host("src")))


@query("p4_third_party", "SELECT page_id, ord, kind, host FROM §res")
def _(spark, path):
    return trackers.resources(_pages(spark, path)).select("page_id", "ord", "kind", "host")


@query("p5_main_text", f"SELECT page_id, {lines('html', disc_rules.DROPPED_TAGS, disc_rules.MIN_LINE)} AS text FROM §pages")
def _(spark, path):
    return extraction.main_text(_pages(spark, path)).select("page_id", "text")


@query("p5_container_text", "SELECT page_id, text FROM §ctext")
def _(spark, path):
    return extraction.container_text(_pages(spark, path))


@query("p6_embedded_text", "SELECT page_id, embedded FROM §embed")
def _(spark, path):
    return extraction.embedded_text(_pages(spark, path))


@query("p7_links", 'SELECT page_id, pos, href, text, "full" FROM §lnk')
def _(spark, path):
    return discovery.links(_pages(spark, path))


@query("p8_preferred_links", 'SELECT page_id, pos, href, text, "full" FROM §pref')
def _(spark, path):
    return discovery.preferred_links(_pages(spark, path))


@query("p9_privacy_link", "SELECT page_id, href, text, url FROM §pick")
def _(spark, path):
    return discovery.link_choice(_pages(spark, path))


@query("p10_url_signal", f"""SELECT page_id, pos, {url_signal('"full"')} AS signal FROM §lnk""")
def _(spark, path):
    return discovery.links(_pages(spark, path)).select("page_id", "pos", F.expr(discovery.url_signal("full")).alias("signal"))


@query("p11_likely_policy", f"SELECT doc_id, {likely('text')} AS likely FROM §docs")
def _(spark, path):
    return _docs(spark, path).select("doc_id", T.over_text(lambda text, _: discovery.likely_policy(text)).alias("likely"))


def _candidates(spark, path):
    """Documents as candidate pages: every third asked for under a telling address, every fourth hiding its text in a script."""
    docs = _docs(spark, path)
    hidden = F.col("doc_id") % 4 == 0
    return docs.select("doc_id", F.concat(F.lit("https://"), "domain", F.lit(".example/p")).alias("url"), F.concat(
        F.lit("https://"), "domain", F.when(F.col("doc_id") % 3 == 0, F.lit(".example/privacy")).otherwise(F.lit(".example/x"))).alias("requested"),
        F.when(hidden, F.lit("Loading")).otherwise(F.col("text")).alias("text"), F.when(hidden, F.col("text")).otherwise(F.lit("")).alias("embedded"))


@query("p12_validation", f"""SELECT doc_id, method IS NOT NULL AS valid, method, length(CASE method WHEN 'text' THEN text WHEN 'embedded' THEN embedded
    WHEN 'url' THEN CASE WHEN length(text) > length(embedded) THEN text ELSE embedded END ELSE text END) AS kept_chars FROM (SELECT *, CASE WHEN
    {likely('text')} THEN 'text' WHEN {likely('embedded')} THEN 'embedded' WHEN {url_signal('url')} OR {url_signal('requested')} THEN 'url' END AS method
    FROM (SELECT doc_id, 'https://' || domain || '.example/p' AS url, 'https://' || domain || CASE WHEN doc_id % 3 = 0 THEN '.example/privacy' ELSE
    '.example/x' END AS requested, CASE WHEN doc_id % 4 = 0 THEN 'Loading' ELSE text END AS text, CASE WHEN doc_id % 4 = 0 THEN text ELSE '' END
    AS embedded FROM §docs))""")
def _(spark, path):
    return discovery.judge(_candidates(spark, path)).select("doc_id", "valid", "method", F.length("kept").alias("kept_chars"))


@query("p13_canonical_paths", "SELECT page_id, ord, url FROM §canon")
def _(spark, path):
    return discovery.canonical(_pages(spark, path), tables.policy_pages(spark, path))


@query("p14_sitemap_entries", "SELECT sitemap_url, pos, url FROM §shit")
def _(spark, path):
    return discovery.sitemap_hits(tables.sitemaps(spark, path))


@query("p14_sitemap_choice", "SELECT page_id, url FROM §spick")
def _(spark, path):
    return discovery.sitemap_choice(tables.robots(spark, path), tables.sitemaps(spark, path))


@query("p15_robots_sitemaps", "SELECT page_id, ord, sitemap_url FROM §rmap")
def _(spark, path):
    return discovery.robots_sitemaps(tables.robots(spark, path))


_DISCOVERED = f"""SELECT page_id, method, policy_url, word_count FROM (SELECT c.page_id, c.method, c.url AS policy_url, v.word_count,
    row_number() OVER (PARTITION BY page_id ORDER BY rank, ord) AS nth FROM (SELECT page_id, 'link_scan' AS method, 0 AS rank, 0 AS ord, url FROM §pick
    UNION ALL SELECT page_id, 'canonical_path', 1, ord, url FROM §canon UNION ALL SELECT page_id, 'sitemap', 2, 0, url FROM §spick) c JOIN (
    SELECT url, len(regexp_extract_all(text, '\\S+')) AS word_count FROM (SELECT url, {lines('html', disc_rules.DROPPED_TAGS, 2)} AS text FROM §stored)
    WHERE {likely('text')} OR {url_signal('url')}) v USING (url)) WHERE nth = 1"""


@query("p16_discovery", _DISCOVERED)
def _(spark, path):
    return discovery.choose(_pages(spark, path), tables.policy_pages(spark, path), tables.robots(spark, path),
                            tables.sitemaps(spark, path))


# The document of a site holds what the steps above found.

@query("s6_label_document", f"""SELECT s.doc_id, s.domain, p0.url, w.policy_url, w.word_count AS policy_word_count, w.method AS policy_discovery_method,
    {q("|".join(f"{d}={x}" for d, x in score_rules.WEIGHTS))} AS weights, policy_found, overall AS overall_score, grade, risk_level, data_collection_score AS data_collection,
    sharing_score AS sharing, transparency_dim AS transparency, rights_score AS rights_points, retention_score AS retention_points, dark_patterns_score AS dark_patterns,
    technical_score AS technical, state = 'full' AS has_analysis, tracked AS has_trackers, CASE WHEN state = 'full' THEN coalesce(p.names, '') END AS parties,
    coalesce(l.reasons, '') AS penalties, coalesce(g.reasons, '') AS bonuses FROM §scored s LEFT JOIN (SELECT doc_id, string_agg(name || ' ' || trust_score, '|'
    ORDER BY trust_score, name) AS names FROM §party GROUP BY doc_id) p USING (doc_id) LEFT JOIN (SELECT doc_id, string_agg(reason, '|' ORDER BY pos) AS reasons
    FROM §lose GROUP BY doc_id) l USING (doc_id) LEFT JOIN (SELECT doc_id, string_agg(reason, '|' ORDER BY pos) AS reasons FROM §gain GROUP BY doc_id) g USING (doc_id)
    LEFT JOIN §pages p0 ON p0.page_id = s.doc_id LEFT JOIN ({_DISCOVERED}) w ON w.page_id = s.doc_id""")
def _(spark, path):
    entries = "array<struct<reason:string>>"
    body = ("url string, policy_url string, policy_word_count int, policy_discovery_method string, domain string, policy_found boolean, overall_score int, grade string, risk_level string, score_breakdown struct<data_collection:int,sharing:int,"
            "transparency:int,rights:int,retention:int,dark_patterns:int,technical:int,weights:map<string,double>>, rights struct<gdpr_score:int>, trackers struct<total_tracker_count:int>, "
            f"sharing struct<parties:array<struct<name:string,trust_score:int>>>, penalties {entries}, bonuses {entries}")
    found = discovery.choose(_pages(spark, path), tables.policy_pages(spark, path), tables.robots(spark, path), tables.sitemaps(spark, path))
    crawl = _pages(spark, path).select("page_id", "url").join(found, "page_id", "left").select(
        F.col("page_id").alias("doc_id"), "url", "policy_url", F.col("word_count").alias("policy_word_count"), F.col("method").alias("policy_discovery_method"))
    docs = context.label_json(_scored(spark, path, evidence=True), crawl).withColumn("j", F.from_json("result_json", body))
    b = "j.score_breakdown."
    return docs.select("doc_id", "j.url", "j.policy_url", "j.policy_word_count", "j.policy_discovery_method", "j.domain",
                       F.expr("array_join(transform(map_entries(j.score_breakdown.weights), e -> concat(e.key, '=', e.value)), '|')").alias("weights"), "j.policy_found", "j.overall_score", "j.grade", "j.risk_level", b + "data_collection", b + "sharing", b + "transparency",
                       F.col(b + "rights").alias("rights_points"), F.col(b + "retention").alias("retention_points"), b + "dark_patterns", b + "technical",
                       F.col("j.rights").isNotNull().alias("has_analysis"), F.col("j.trackers").isNotNull().alias("has_trackers"),
                       F.expr("array_join(transform(j.sharing.parties, p -> concat(p.name, ' ', p.trust_score)), '|')").alias("parties"),
                       *[F.array_join(F.col(f"j.{k}.reason"), "|").alias(k) for k in ("penalties", "bonuses")])


@query("p17_word_count_hash", "SELECT doc_id, len(regexp_extract_all(text, '\\S+')) AS words, sha256(text) AS content_hash FROM §docs")
def _(spark, path):
    return _docs(spark, path).select("doc_id", T.word_count(F.col("text")).alias("words"), F.sha2("text", 256).alias("content_hash"))


@query("p18_site_state", "SELECT doc_id, CASE WHEN NOT policy_found THEN 'no_policy' WHEN length(text) < 100 THEN 'unreadable' ELSE 'full' END AS state FROM §docs")
def _(spark, path):
    return _docs(spark, path).select("doc_id", F.expr(scoring.state("policy_found", "length(text)")).alias("state"))


def _label_sql() -> str:
    """First link of each label. No link of the given pages names two labels, so here the labels do not compete."""
    parts = " UNION ALL ".join(
        f"""SELECT page_id, {q(k)} AS label, arg_min("full", i) AS url FROM §lnk1 WHERE starts_with("full", 'http') AND ({' OR '.join(
            f"contains(lower(href), {q(w)}) OR contains(lower(text), {q(w)})" for w in words)}) GROUP BY page_id"""
        for k, words in trust_rules.LABEL_WORDS.items())
    return f"SELECT page_id, label, url FROM ({parts})"


@query("p19_company_pages", _label_sql())
def _(spark, path):
    return discovery.label_links(_pages(spark, path), trust_rules.LABEL_WORDS, trust_rules.PAGE_LABELS)


@query("p20_readable_text", f"""SELECT page_id, ({lines('html', (*disc_rules.DROPPED_TAGS, 'footer'), 5)})[1:6000] AS text FROM §pages""")
def _(spark, path):
    return extraction.page_text(_pages(spark, path), trust_rules.PAGE_CHARS).select("page_id", "text")


def _banner_sql() -> str:
    def part(name, value):
        rule = rf"""(?i)<[a-z][^>]*[\s"'/]{name}\s*=\s*(?:"{value}"|'{value}')"""
        return f"regexp_matches(html, {q(rule)})"
    word, inner = r"""(?:[^"'>]*\s)?(?:%s)(?:\s[^"'>]*)?""", r"""[^"'>]*(?:%s)[^"'>]*"""
    p = page_rules
    return " OR ".join((part("id", f"(?:{'|'.join(p.BANNER_IDS)})"), part("class", word % "|".join(p.BANNER_CLASSES)),
                        part("id", inner % "|".join(p.BANNER_ID_PARTS)), part("class", inner % "|".join(p.BANNER_CLASS_PARTS)),
                        part("aria-label", inner % "|".join(p.BANNER_ARIA_PARTS))))


@query("p21_consent_signals", f"""SELECT p.page_id, coalesce(k.n, 0) AS cookie_count, {_banner_sql()} AS has_consent_banner, s.cmp AS cmp_name FROM §pages p
    LEFT JOIN (SELECT page_id, count(*) AS n FROM §ck0 GROUP BY page_id) k USING (page_id) LEFT JOIN (SELECT page_id, arg_min(cmp, idx) AS cmp FROM (
    SELECT page_id, idx, CASE {' '.join(f"WHEN contains(lower(src), {q(w)}) THEN {q(n)}" for w, n in page_rules.SCRIPT_PLATFORMS)} END AS cmp FROM §srcs
    WHERE tag = 'script') WHERE cmp IS NOT NULL GROUP BY page_id) s USING (page_id)""")
def _(spark, path):
    return trackers.page_signals(_pages(spark, path)).select("page_id", "cookie_count", "has_consent_banner", "cmp_name")


@query("p22_consent_buttons", f"""SELECT p.page_id, coalesce(b.yes AND NOT b.no, FALSE) AS no_reject_option, coalesce(x.n, 0) AS pre_ticked_boxes
    FROM §pages p LEFT JOIN (SELECT page_id, bool_or(regexp_matches(t, '(?i){page_rules.ACCEPT_TEXT}')) AS yes,
    bool_or(regexp_matches(t, '(?i){page_rules.REJECT_TEXT}')) AS no FROM (SELECT page_id, trim(regexp_replace(unnest(regexp_extract_all({gone('html', ())},
    '(?i)<(?:button|a)\\b[^>]*>[\\s\\S]*?</(?:button|a)\\s*>')), '<[^>]*>', '', 'g')) AS t FROM §pages) GROUP BY page_id) b USING (page_id)
    LEFT JOIN (SELECT page_id, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, {q(rf'(?i){H.COMMENT}|{H.SCRIPT}|<input\b[^>]*>')})) AS el
    FROM §pages) WHERE starts_with(lower(el), '<input') AND lower({attribute('el', 'type')}) = 'checkbox' AND regexp_matches(el, '(?i)\\schecked[\\s=/>]')
    AND (contains(lower({attribute('el', 'name')}), 'consent') OR contains(lower({attribute('el', 'id')}), 'consent')) GROUP BY page_id) x USING (page_id)""")
def _(spark, path):
    return trackers.page_signals(_pages(spark, path)).select("page_id", "no_reject_option", "pre_ticked_boxes")


# ---- data categories

_DT = "doc_id, domain, ord, category_id, name, sensitivity, gdpr_special_category, gdpr_article, ccpa_category, evidence"


@query("r1_data_categories", f"SELECT {_DT} FROM §dt")
def _(spark, path):
    return data_types.rows(_docs(spark, path)).withColumn("evidence", F.expr(_joined("evidence"))).drop("shared")


_KW = ", ".join(f"({i}, {k}, {q(w)})" for i, c in enumerate(type_rules.CATEGORIES) for k, w in enumerate(type_rules.KEYWORDS[c[0]]))


@query("r1_data_categories_substring", f"""SELECT doc_id, ord, string_agg(kw, '|' ORDER BY k) AS keywords FROM (SELECT doc_id, ord, k, kw, row_number() OVER
    (PARTITION BY doc_id, ord ORDER BY k) AS nth FROM §docs, (VALUES {_KW}) AS v(ord, k, kw) WHERE contains(low, kw)) WHERE nth <= 2 GROUP BY ALL""")
def _(spark, path):
    found = _docs(spark, path).select("doc_id", T.over_text(lambda _, low: T.array(
        T.struct(ord=str(i), kws=f"slice({T.literals_in(low, type_rules.KEYWORDS[c[0]])}, 1, 2)")
        for i, c in enumerate(type_rules.CATEGORIES))).alias("cs"))
    return T.explode_rows(found, "cs", "c").where("size(c.kws) > 0").select(
        "doc_id", "c.ord", F.expr("array_join(c.kws, '|')").alias("keywords"))


@query("r2_sharing_proximity", "SELECT doc_id, category_id, shared FROM §dt")
def _(spark, path):
    return data_types.rows(_docs(spark, path)).select("doc_id", "category_id", "shared")


@query("t1_sensitivity_order", """SELECT doc_id, category_id, sensitivity, row_number() OVER (PARTITION BY doc_id ORDER BY CASE sensitivity WHEN
    'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, ord) - 1 AS pos FROM §dt""")
def _(spark, path):
    found = data_types.detect(_docs(spark, path)).select("doc_id", F.expr(
        f"transform({data_types.by_sensitivity('data_types')}, (c, i) -> named_struct('pos', i, 'c', c))").alias("cs"))
    return T.explode_rows(found, "cs", "x").select("doc_id", "x.c.category_id", "x.c.sensitivity", "x.pos")


@query("a23_sensitivity_histogram", """SELECT d.doc_id, count(*) FILTER (WHERE sensitivity = 'critical') AS critical_count, count(*) FILTER (WHERE
    sensitivity = 'high') AS high_count, count(*) FILTER (WHERE sensitivity = 'medium') AS medium_count, count(*) FILTER (WHERE sensitivity = 'low')
    AS low_count, count(*) FILTER (WHERE gdpr_special_category) AS special_count, count(*) FILTER (WHERE shared) AS shared_count FROM §docs d
    LEFT JOIN §dt t USING (doc_id) GROUP BY d.doc_id""")
def _(spark, path):
    found = data_types.detect(_docs(spark, path)).select("doc_id", "data_types")
    return found.select("doc_id", *[F.expr(e).cast("bigint").alias(n) for n, e in data_types.counts("data_types").items()])


@query("t5_high_risk_categories", "SELECT doc_id, category_id FROM §dt WHERE sensitivity = 'high'")
def _(spark, path):
    return data_types.rows(_docs(spark, path)).where("sensitivity = 'high'").select("doc_id", "category_id")


# ---- retention

_RET = "doc_id, ord, context, period_text, period_days, period_type, rating, rating_label, is_vague"


def _items(where: str):
    return lambda spark, path: retention.items(_docs(spark, path)).where(where).select(*_RET.split(", "))


query("r3_specific_periods", "SELECT doc_id, i, t AS period_text, a AS first_pos, n AS chars FROM §ret_pos WHERE src = 0")(
    lambda spark, path: _period_rows(spark, path, ret_rules.KEPT_FOR))
query("r4_contextual_periods", f"SELECT {_RET} FROM §ret_items WHERE period_type = 'specific'")(_items("period_type = 'specific'"))
query("r5_event_retention", f"SELECT {_RET} FROM §ret_items WHERE period_type = 'event_based'")(_items("period_type = 'event_based'"))
query("r6_vague_retention", f"SELECT {_RET} FROM §ret_items WHERE period_type = 'vague'")(_items("is_vague"))


def _period_rows(spark, path, lead):
    found = _docs(spark, path).select("doc_id", T.over_text(
        lambda text, low: f"transform({retention._periods(text, low, lead + '(' + ret_rules.PERIOD + ')')}, (p, i) -> "
                          f"named_struct('i', i, 'p', p))").alias("ps"))
    return T.explode_rows(found, "ps", "x").select(
        "doc_id", "x.i", F.col("x.p.t").alias("period_text"), F.col("x.p.s.start").alias("first_pos"),
        F.expr("x.p.s.stop - x.p.s.start").alias("chars"))


@query("r7_retention_flags", "SELECT doc_id, deletion_on_request, storage_limitation_mentioned, has_indefinite_retention FROM §ret")
def _(spark, path):
    return retention.detect(_docs(spark, path)).select("doc_id", "retention.deletion_on_request",
                                                       "retention.storage_limitation_mentioned", "retention.has_indefinite_retention")


@query("f1_period_days", "SELECT doc_id, src, i, t AS period_text, days FROM §ret_dated")
def _(spark, path):
    kept = _period_rows(spark, path, ret_rules.KEPT_FOR).select("doc_id", F.lit(0).alias("src"), "i", "period_text")
    lasts = _period_rows(spark, path, ret_rules.LASTS_FOR).select("doc_id", F.lit(1).alias("src"), "i", "period_text")
    days = lambda df: df.withColumn("days", F.expr(retention.days("period_text")))
    once = days(lasts).groupBy("doc_id", "src", "period_text", "days").agg(F.min("i").alias("i")).join(
        kept.select("doc_id", "period_text").distinct(), ["doc_id", "period_text"], "left_anti").where("days > 0")
    return days(kept).unionByName(once)


@query("f2_period_rating", "SELECT period_days, rating, rating_label, count(*) AS n FROM §ret_items WHERE period_days IS NOT NULL GROUP BY ALL")
def _(spark, path):
    return retention.items(_docs(spark, path)).where("period_days IS NOT NULL").groupBy(
        "period_days", "rating", "rating_label").agg(F.count("*").alias("n"))


@query("a8_retention_summary", """SELECT doc_id, n_items, overall_rating, has_vague_retention, has_event_based_deletion, has_specific_periods,
    has_deletion_policy, shortest_days, longest_days FROM §ret""")
def _(spark, path):
    return retention.detect(_docs(spark, path)).select("doc_id", "retention.*").select(
        "doc_id", "n_items", "overall_rating", "has_vague_retention", "has_event_based_deletion", "has_specific_periods",
        "has_deletion_policy", "shortest_days", "longest_days")


# ---- wording

def _terms(terms):
    return lambda spark, path: wording.term_rows(_docs(spark, path), terms).select("doc_id", "term", "n")


query("r8_vague_terms", "SELECT doc_id, term, n FROM §term_hit WHERE family = 'vague_term'")(_terms(word_rules.VAGUE_TERMS))
query("r9_hedges", "SELECT doc_id, term, n FROM §term_hit WHERE family = 'hedge'")(_terms(word_rules.HEDGES))
query("r10_vague_purposes", "SELECT doc_id, term, n FROM §term_hit WHERE family = 'vague_purpose'")(_terms(word_rules.VAGUE_PURPOSES))


def _wording(*cols):
    return lambda spark, path: wording.detect(_docs(spark, path)).select("doc_id", *[f"wording.{c}" for c in cols])


query("r11_specific_purposes", "SELECT doc_id, specific_purpose_count, specificity_score FROM §wrd")(
    _wording("specific_purpose_count", "specificity_score"))
query("r12_known_names", "SELECT doc_id, name FROM §wnames WHERE k = 0")(
    lambda spark, path: _name_rows(spark, path, lambda text, low: T.each(
        T.literals_in(low, word_rules.KNOWN_NAMES), lambda n: f"initcap({n})")))
query("r13_named_parties", "SELECT doc_id, name FROM §wnamed")(lambda spark, path: _name_rows(spark, path, wording.named_parties))
query("u1_ordered_union", "SELECT doc_id, string_agg(name, '|' ORDER BY rn) AS names FROM §wnamed GROUP BY doc_id")(
    lambda spark, path: wording.detect(_docs(spark, path)).where("size(wording.named_third_parties) > 0").select(
        "doc_id", F.array_join("wording.named_third_parties", "|").alias("names")))
query("r14_passive_voice", "SELECT doc_id, passive AS passive_voice_count FROM §wrd")(_wording("passive_voice_count"))
query("r15_active_voice", "SELECT doc_id, active AS active_voice_count FROM §wrd")(_wording("active_voice_count"))


def _name_rows(spark, path, names):
    found = _docs(spark, path).select("doc_id", T.over_text(names).alias("ns"))
    return T.explode_rows(found, "ns", "name").select("doc_id", "name")


@query("r16_accountability", f"SELECT doc_id, {', '.join(word_rules.ACCOUNTABILITY)}, accountability_score FROM §wrd")
def _(spark, path):
    return wording.detect(_docs(spark, path)).select("doc_id", *[
        F.col("wording.accountability")[g].alias(g) for g in word_rules.ACCOUNTABILITY], "wording.accountability_score")


query("a12_vagueness", "SELECT doc_id, vagueness_score, specificity_score FROM §wrd")(_wording("vagueness_score", "specificity_score"))
query("a13_passive_ratio", "SELECT doc_id, round(ratio, 3) AS passive_voice_ratio FROM §wrd")(_wording("passive_voice_ratio"))
query("a14_transparency", "SELECT doc_id, transparency_score, overall_transparency FROM §wrd")(
    _wording("transparency_score", "overall_transparency"))
query("f9_readability", "SELECT doc_id, coalesce(round(mean_sentence, 1), 0) AS avg_sentence_length, readability_rating, words AS word_count FROM §wrd")(
    _wording("avg_sentence_length", "readability_rating", "word_count"))


@query("a28_radar", """SELECT doc_id, specificity_score AS specificity, accountability_score AS accountability, transparency_score AS transparency,
    CAST(round((1 - round(ratio, 3)) * 100) AS INTEGER) AS active_voice, least(100, named * 10) AS named_parties, greatest(0, 100 - vagueness_score)
    AS non_vague FROM §wrd""")
def _(spark, path):
    found = wording.detect(_docs(spark, path)).select("doc_id", "wording")
    return found.select("doc_id", *[F.expr(e).alias(n) for n, e in wording.radar("wording").items()])


# ---- dark patterns

@query("r17_dark_patterns", "SELECT doc_id, ord, pattern_type, name, severity, gdpr_reference, evidence, confidence FROM §dark")
def _(spark, path):
    return dark_patterns.rows(_docs(spark, path)).withColumn("evidence", F.expr(_joined("evidence"))).withColumn(
        "confidence", F.col("confidence").cast("double")).drop("domain")


def _dark(*cols):
    return lambda spark, path: dark_patterns.detect(_docs(spark, path)).select("doc_id", *[f"dark_patterns.{c}" for c in cols])


query("r18_consent_quality", """SELECT doc_id, explicit AS explicit_consent, granular AS granular_consent, withdrawal, consent_mechanism_quality
    FROM §dark_doc""")(_dark("explicit_consent", "granular_consent", "withdrawal", "consent_mechanism_quality"))
query("a9_dark_summary", """SELECT doc_id, n AS count, high AS high_severity_count, medium AS medium_severity_count, low_n AS low_severity_count,
    overall_risk FROM §dark_doc""")(_dark("count", "high_severity_count", "medium_severity_count", "low_severity_count", "overall_risk"))


# ---- rights

def _rights(table):
    return lambda spark, path: rights.rows(_docs(spark, path), table).select("doc_id", "right_id", "name", "article", "covered", "evidence")


_RGT = "SELECT doc_id, right_id, name, article, covered, evidence FROM §rgt WHERE framework = "
query("r19_gdpr_rights", _RGT + "'gdpr'")(_rights(right_rules.GDPR))
query("r20_ccpa_rights", _RGT + "'ccpa'")(_rights(right_rules.CCPA))
query("r36_evidence", "SELECT framework, right_id, covered, count(*) AS docs, CAST(sum(length(evidence)) AS BIGINT) AS chars FROM §rgt GROUP BY ALL")(
    lambda spark, path: _evidence(spark, path))


def _evidence(spark, path):
    docs = rights.detect(_docs(spark, path)).select("rights")
    both = [T.explode_rows(docs.select(f"rights.{f}"), f, "r").select(F.lit(f).alias("framework"), "r.*") for f in ("gdpr", "ccpa")]
    return both[0].unionByName(both[1]).groupBy("framework", "right_id", "covered").agg(
        F.count("*").alias("docs"), F.sum(F.length("evidence")).alias("chars"))


@query("r21_frameworks", "SELECT doc_id, frameworks FROM §flags")
def _(spark, path):
    return rights.detect(_docs(spark, path)).select("doc_id", F.array_join("rights.frameworks_mentioned", "|").alias("frameworks"))


@query("r22_cookie_topics", "SELECT doc_id, " + ", ".join(f"{any_of('low', p)} AS {t}" for t, p in right_rules.COOKIE_TOPICS.items()) + " FROM §docs")
def _(spark, path):
    return rights.detect(_docs(spark, path)).select("doc_id", *[
        F.col("rights.cookie_compliance")[t].alias(t) for t in right_rules.COOKIE_TOPICS])


@query("r23_browser_signals", "SELECT doc_id, dnt_mentioned, dnt_honored, gpc AS global_privacy_control FROM §flags")
def _(spark, path):
    return rights.detect(_docs(spark, path)).select("doc_id", "rights.dnt_mentioned", "rights.dnt_honored", "rights.global_privacy_control")


@query("a10_rights_coverage", "SELECT doc_id, domain, gdpr_score, gdpr_grade, ccpa_score, ccpa_grade, overall_rights_score FROM §rgt_doc")
def _(spark, path):
    return rights.detect(_docs(spark, path)).select("doc_id", "domain", *[f"rights.{c}" for c in (
        "gdpr_score", "gdpr_grade", "ccpa_score", "ccpa_grade", "overall_rights_score")])


@query("f7_rights_grade", "SELECT gdpr_grade AS grade, count(*) AS docs, min(gdpr_score) AS least, max(gdpr_score) AS most FROM §rgt_doc GROUP BY ALL")
def _(spark, path):
    scored = rights.detect(_docs(spark, path)).select(F.col("rights.gdpr_grade").alias("grade"), "rights.gdpr_score")
    return scored.groupBy("grade").agg(F.count("*").alias("docs"), F.min("gdpr_score").alias("least"), F.max("gdpr_score").alias("most"))


@query("x0_rights_by_source", """SELECT domain, count(*) AS docs, avg(gdpr_score) AS mean_gdpr, avg(ccpa_score) AS mean_ccpa, max(gdpr_score) AS best_gdpr
    FROM §rgt_doc GROUP BY domain""")
def rights_by_source(spark, path):
    """Flagship: seeded documents, rights found, coverage per document, mean per source. One shuffle of four numbers."""
    scored = rights.detect(_docs(spark, path)).select("domain", "rights.gdpr_score", "rights.ccpa_score")
    return scored.groupBy("domain").agg(F.count("*").alias("docs"), F.avg("gdpr_score").alias("mean_gdpr"),
                                        F.avg("ccpa_score").alias("mean_ccpa"), F.max("gdpr_score").alias("best_gdpr"))


# ---- recipients

@query("r24_named_recipients", "SELECT doc_id, name FROM §named")
def _(spark, path):
    return recipients.mentioned(_docs(spark, path)).select("doc_id", "name")


def _mention_sql() -> str:
    low, n = "low", "lower(name)"
    first = f"instr({low}, {n})"
    rest = f"{low}[{first} + length(name):]"
    return f"""SELECT doc_id, name, CASE WHEN b > 0 THEN e1 || '|' || {snippet('text', 'b - 1 - 60', 'b - 1 + length(name) + 80')} ELSE e1 END AS evidence
        FROM (SELECT *, {snippet('text', 'a - 1 - 60', 'a - 1 + length(name) + 80')} AS e1, CASE WHEN instr(rest, {n}) > 0 THEN
        a + length(name) - 1 + instr(rest, {n}) ELSE 0 END AS b FROM (SELECT *, {first} AS a, {rest} AS rest FROM §named))"""


@query("r25_recipient_evidence", _mention_sql())
def _(spark, path):
    return recipients.mentioned(_docs(spark, path)).select("doc_id", "name", F.array_join("evidence", "|").alias("evidence"))


@query("r26_recipient_purposes", "SELECT doc_id, name, near, purposes FROM §party")
def _(spark, path):
    near = recipients.mentioned(_docs(spark, path)).select("doc_id", "name", F.array_join("near", "|").alias("near"))
    return near.join(_parties(spark, path).select("doc_id", "name", F.array_join("purposes", "|").alias("purposes")), ["doc_id", "name"])


def _sharing(*cols):
    return lambda spark, path: recipients.detect(_docs(spark, path)).select("doc_id", *[f"sharing.{c}" for c in cols])


query("r27_unnamed_recipients", "SELECT doc_id, unnamed_count, n AS count FROM §share")(_sharing("unnamed_count", "count"))


@query("r28_sharing_purposes", "SELECT doc_id, " + ", ".join(f"{any_of('low', p)} AS {n}" for n, p in party_rules.PURPOSES.items()) + " FROM §docs")
def _(spark, path):
    return recipients.detect(_docs(spark, path)).select("doc_id", *[
        F.col("sharing.sharing_purposes")[n].alias(n) for n in party_rules.PURPOSES])


query("r29_data_sale", "SELECT doc_id, data_sold FROM §share")(_sharing("data_sold"))


@query("r30_transfers", "SELECT doc_id, abroad AS cross_border_transfers, safeguards FROM §share")
def _(spark, path):
    return recipients.detect(_docs(spark, path)).select("doc_id", "sharing.cross_border_transfers",
                                                        F.array_join("sharing.transfer_safeguards", "|").alias("safeguards"))


@query("j2_recipient_trust", """SELECT doc_id, name, category, trust_score, trust_label, data_types_shared, purposes, opt_out_url, privacy_url, gdpr_compliant,
    cross_border_transfer, is_data_broker FROM §party""")
def _(spark, path):
    return _parties(spark, path).withColumns({"data_types_shared": F.array_join("data_types_shared", "|"),
                                              "purposes": F.array_join("purposes", "|")}).drop("domain", "evidence")


@query("f8_trust_label", "SELECT trust_label, trust_score, count(*) AS n FROM §party GROUP BY ALL")
def _(spark, path):
    return _parties(spark, path).groupBy("trust_label", "trust_score").agg(F.count("*").alias("n"))


query("a11_recipient_summary", """SELECT doc_id, named_count, unnamed_count, advertising_partners, analytics_partners, risk_level, sharing_score FROM §share""")(
    _sharing("named_count", "unnamed_count", "advertising_partners", "analytics_partners", "risk_level", "sharing_score"))
query("a26_data_brokers", "SELECT doc_id, data_brokers FROM §share")(_sharing("data_brokers"))


@query("t2_least_trusted", """SELECT doc_id, name, trust_score, rank FROM (SELECT doc_id, name, trust_score, row_number() OVER (PARTITION BY doc_id
    ORDER BY trust_score, name) AS rank FROM §party) WHERE rank <= 30""")
def _(spark, path):
    return reports.least_trusted(_parties(spark, path), party_rules.MAX_PARTIES).select("doc_id", "name", "trust_score", "rank")


@query("t3_party_search", """SELECT doc_id, name, category, trust_score FROM §party WHERE contains(lower(name), 'advert') OR contains(lower(category), 'advert')""")
def _(spark, path):
    return reports.search(_parties(spark, path), "advert").select("doc_id", "name", "category", "trust_score")


# ---- trackers and cookies

_FOUND = "page_id, ord, kind, host, url, name, category, risk, fingerprinting, session_recording, opt_out"


@query("a5_tracker_resources", f"SELECT {_FOUND} FROM §found")
def _(spark, path):
    return _found(spark, path)


@query("j1_host_to_tracker", "SELECT page_id, ord, host, tdomain AS tracker_domain, name AS tracker FROM §best WHERE pick = 1")
def _(spark, path):
    joined = trackers.match_hosts(trackers.resources(_pages(spark, path)), dims.tracker_table(spark), dims.tracker_rows())
    return joined.select("page_id", "ord", "host", F.col("tracker.domain").alias("tracker_domain"), F.col("tracker.name").alias("tracker"))


@query("a1_by_category", "SELECT page_id, category, count(*) AS n FROM §found GROUP BY ALL")
def _(spark, path):
    found = trackers.detect(_pages(spark, path)).select("page_id", F.map_entries("tracking.by_category").alias("cs"))
    return T.explode_rows(found, "cs", "c").select("page_id", F.col("c.key").alias("category"), F.col("c.value").alias("n"))


def _tracking(**cols):
    return lambda spark, path: trackers.detect(_pages(spark, path)).select("page_id", "tracking").select(
        "page_id", *[F.expr(e).alias(n) for n, e in cols.items()])


query("a2_high_risk", "SELECT page_id, high_risk_count FROM §trk_page")(_tracking(high_risk_count="tracking.high_risk_count"))


@query("a3_first_per_host", "SELECT page_id, host, kind, name, risk FROM §uniq")
def _(spark, path):
    found = trackers.detect(_pages(spark, path)).select("page_id", "tracking.trackers")
    return T.explode_rows(found, "trackers", "t").select("page_id", "t.host", "t.kind", "t.name", "t.risk")


query("a4_third_party_hosts", """SELECT p.page_id, coalesce(array_to_string(list_sort(list(DISTINCT host))[1:50], '|'), '') AS hosts FROM §pages p
    LEFT JOIN §res r USING (page_id) GROUP BY p.page_id""")(_tracking(hosts="array_join(tracking.unique_third_party_domains, '|')"))
query("a6_tracking_flags", "SELECT page_id, fingerprinting_detected, session_recording_detected, total_tracker_count FROM §trk_page")(_tracking(
    fingerprinting_detected="tracking.fingerprinting_detected", session_recording_detected="tracking.session_recording_detected",
    total_tracker_count="tracking.total_tracker_count"))
query("r31_fingerprinting_scripts", "SELECT page_id, fingerprinting_evidence AS evidence FROM §trk_page")(
    _tracking(evidence="array_join(tracking.fingerprinting_evidence, '|')"))
query("r32_recording_scripts", "SELECT page_id, session_recording_evidence AS evidence FROM §trk_page")(
    _tracking(evidence="array_join(tracking.session_recording_evidence, '|')"))
query("r33_inline_tracker_mentions", """SELECT p.page_id, coalesce(s.s, '') AS signals FROM §pages p LEFT JOIN (SELECT page_id, array_to_string(list_sort(
    list(DISTINCT 'Reference to ' || t.name || ' in inline script'))[1:10], '|') AS s FROM §inline i JOIN §trk t ON contains(i.body, t.domain)
    GROUP BY page_id) s USING (page_id)""")(_tracking(signals="array_join(tracking.inline_tracker_signals, '|')"))
query("r34_consent_platform", "SELECT page_id, cmp_detected FROM §trk_page")(_tracking(cmp_detected="tracking.cmp_detected"))
query("r35_privacy_sandbox", "SELECT page_id, privacy_sandbox_detected FROM §trk_page")(
    _tracking(privacy_sandbox_detected="tracking.privacy_sandbox_detected"))
query("a7_cookie_security", "SELECT page_id, n_cookies, httponly_pct, secure_pct, samesite_pct FROM §trk_page")(_tracking(
    n_cookies="cast(tracking.n_cookies as bigint)", httponly_pct="tracking.httponly_pct", secure_pct="tracking.secure_pct",
    samesite_pct="tracking.samesite_pct"))


@query("f3_set_cookie", "SELECT page_id, ord, name, value_preview, httponly, secure, samesite, path, domain, max_age FROM §ck")
def _(spark, path):
    return trackers.cookie_rows(_pages(spark, path)).drop("category", "duration_label")


@query("f4_cookie_category", "SELECT page_id, name, category FROM §ck")
def _(spark, path):
    return trackers.cookie_rows(_pages(spark, path)).select("page_id", "name", "category")


@query("f5_cookie_duration", "SELECT page_id, name, max_age, duration_label FROM §ck")
def _(spark, path):
    return trackers.cookie_rows(_pages(spark, path)).select("page_id", "name", "max_age", "duration_label")


@query("a25_cookie_categories", "SELECT page_id, category, count(*) AS n FROM §ck GROUP BY ALL")
def _(spark, path):
    return trackers.cookie_rows(_pages(spark, path)).groupBy("page_id", "category").agg(F.count("*").alias("n"))


@query("a24_top_tracker_categories", """SELECT page_id, category, n, rank FROM (SELECT page_id, category, count(*) AS n, row_number() OVER (PARTITION BY
    page_id ORDER BY count(*) DESC, category) AS rank FROM §found GROUP BY page_id, category) WHERE rank <= 6""")
def _(spark, path):
    return reports.top_categories(_found(spark, path))


@query("t5_high_risk_trackers", "SELECT page_id, host, name FROM §uniq WHERE risk = 'high'")
def _(spark, path):
    found = trackers.detect(_pages(spark, path)).select("page_id", "tracking.trackers")
    return T.explode_rows(found, "trackers", "t").where("t.risk = 'high'").select("page_id", "t.host", "t.name")


# ---- scores

_DIMS = ("data_collection_score", "sharing_score", "transparency_score", "rights_score", "retention_score", "dark_patterns_score", "technical_score")


def _score(*cols):
    return lambda spark, path: _scored(spark, path).select("doc_id", *cols)


query("a15_data_score", "SELECT doc_id, data_collection_score FROM §scored")(_score("data_collection_score"))
query("a16_sharing_score", "SELECT doc_id, sharing_score FROM §scored")(_score("sharing_score"))
query("a17_policy_scores", "SELECT doc_id, rights_score, retention_score, dark_patterns_score FROM §scored")(
    _score("rights_score", "retention_score", "dark_patterns_score"))
query("a18_technical_score", "SELECT doc_id, technical_score FROM §scored")(_score("technical_score"))
query("a19_overall_score", "SELECT doc_id, state, overall, grade, risk_level, data_collection_score, sharing_score, transparency_dim AS transparency_score, "
      "rights_score, retention_score, dark_patterns_score, technical_score FROM §scored")(_score("state", "overall", "grade", "risk_level", *_DIMS))


@query("f6_grade_and_risk", "SELECT overall, grade, risk_level, count(*) AS sites FROM §scored GROUP BY ALL")
def _(spark, path):
    return _scored(spark, path).groupBy("overall", "grade", "risk_level").agg(F.count("*").alias("sites"))


@query("a21_no_policy", "SELECT doc_id, overall, grade, risk_level, technical_score FROM §scored WHERE state = 'no_policy'")
def _(spark, path):
    return _scored(spark, path).where("state = 'no_policy'").select("doc_id", "overall", "grade", "risk_level", "technical_score")


@query("a22_unreadable", "SELECT doc_id, overall, grade, technical_score FROM §scored WHERE state = 'unreadable'")
def _(spark, path):
    return _scored(spark, path).where("state = 'unreadable'").select("doc_id", "overall", "grade", "technical_score")


_ENTRY = "doc_id, CAST(pos AS INTEGER) AS pos, dimension, reason, points"


@query("a20_ledger", """SELECT doc_id, CAST(coalesce(l.n, 0) AS INTEGER) AS penalties, CAST(coalesce(g.n, 0) AS INTEGER) AS bonuses FROM §scored LEFT JOIN (
    SELECT doc_id, count(*) AS n FROM §lose GROUP BY doc_id) l USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM §gain GROUP BY doc_id) g USING (doc_id)""")
def _(spark, path):
    return _scored(spark, path).select("doc_id", F.size("penalties").alias("penalties"), F.size("bonuses").alias("bonuses"))


@query("a20_ledger_entries", f"SELECT {_ENTRY} FROM §lose")
def _(spark, path):
    return _scored(spark, path).select("doc_id", F.posexplode("penalties").alias("pos", "p")).select("doc_id", "pos", "p.*")


@query("a20_bonus_entries", f"SELECT {_ENTRY} FROM §gain")
def _(spark, path):
    return _scored(spark, path).select("doc_id", F.posexplode("bonuses").alias("pos", "p")).select("doc_id", "pos", "p.*")


@query("a29_alerts", """SELECT doc_id, ord, alert FROM (SELECT doc_id, 0 AS ord, n_dark || ' dark pattern(s) detected in privacy policy' AS alert FROM §scored
    WHERE state = 'full' AND n_dark > 0 UNION ALL SELECT doc_id, 1, 'Browser fingerprinting detected – tracks you without cookies' FROM §scored
    WHERE fingerprinting_detected UNION ALL SELECT doc_id, 2, 'Session recording active – captures all mouse/keyboard activity' FROM §scored
    WHERE session_recording_detected UNION ALL SELECT doc_id, 3, 'Personal data is sold to third parties (CCPA opt-out available)' FROM §scored
    WHERE state = 'full' AND data_sold UNION ALL SELECT doc_id, 4, 'No privacy policy found – legally required under GDPR & CCPA' FROM §scored
    WHERE NOT policy_found UNION ALL SELECT doc_id, 5, 'Only ' || gdpr_score || '% of GDPR rights covered in policy' FROM §scored
    WHERE state = 'full' AND gdpr_score < 50)""")
def _(spark, path):
    return reports.alerts(_facts(spark, path))


# ---- history

@query("h1_versions", "SELECT version_id, domain, content_hash, fetched_at, is_current FROM §ver")
def _(spark, path):
    return _versions(spark, path)


@query("h3_version_pairs", "SELECT domain, old_version_id, new_version_id, detected_at FROM §pair")
def _(spark, path):
    return history.pairs(_versions(spark, path))


query("j5_old_and_new", "SELECT new_version_id, length(old_text) AS old_chars, length(new_text) AS new_chars FROM §pair")(
    lambda spark, path: history.paired_texts(history.pairs(_versions(spark, path)), tables.fetches(spark, path)).select(
        "new_version_id", F.length("old_text").alias("old_chars"), F.length("new_text").alias("new_chars")))


@query("h4_line_changes", """SELECT domain, pair_id, CAST(sum(greatest(b - a, 0)) AS BIGINT) AS added_lines, CAST(sum(greatest(a - b, 0)) AS BIGINT)
    AS removed_lines, round(sum(least(a, b)) * 2.0 / sum(a + b), 4)::DOUBLE AS similarity_ratio FROM (SELECT domain, pair_id, line, sum(a) AS a, sum(b) AS b
    FROM (SELECT domain, new_version_id AS pair_id, unnest(string_split(old_text, chr(10))) AS line, 1 AS a, 0 AS b FROM §pair UNION ALL
    SELECT domain, new_version_id, unnest(string_split(new_text, chr(10))), 0, 1 FROM §pair) GROUP BY ALL) GROUP BY domain, pair_id""")
def _(spark, path):
    return history.line_changes(tables.fetches(spark, path), history.pairs(_versions(spark, path)))


@query("h2_incremental_upsert", """SELECT version_id, domain, content_hash FROM §ver WHERE lower(content_hash) NOT IN (SELECT sha256(text) FROM §fetch WHERE
    fetched_at < TIMESTAMP '2024-01-05' AND domain = §ver.domain)""".replace("§ver.domain", "b_ver.domain"))
def _(spark, path):
    fetched = tables.fetches(spark, path)
    early, late = fetched.where("fetched_at < '2024-01-05'"), fetched.where("fetched_at >= '2024-01-05'")
    known = history.versions(early).select("domain", "content_hash")
    return history.new_versions(late, known).select(F.col("fetch_id").alias("version_id"), "domain", "content_hash")


_RES = "result_id, domain, analyzed_at, overall_score, grade, policy_version_id"


@query("h6_latest_result", f"SELECT {_RES} FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY analyzed_at DESC) AS nth FROM §result) WHERE nth = 1")
def _(spark, path):
    return history.latest(_results(spark, path))


@query("h7_history", f"SELECT {_RES}, nth FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY analyzed_at DESC) AS nth FROM §result) WHERE nth <= 10")
def _(spark, path):
    return history.history(_results(spark, path))


@query("h7_change_history", """SELECT domain, old_version_id, new_version_id, detected_at, nth FROM (SELECT *, row_number() OVER (PARTITION BY domain
    ORDER BY detected_at DESC) AS nth FROM §pair) WHERE nth <= 10""")
def _(spark, path):
    return history.change_history(history.pairs(_versions(spark, path)))


@query("h8_compare", """SELECT domain, newer_at, older_at, newer_score, older_score, newer_grade, older_grade, newer_score - older_score AS score_delta, CASE WHEN older_at IS NULL
    THEN 'Not enough history for comparison' END AS message FROM (SELECT domain, analyzed_at AS newer_at, overall_score AS newer_score, lead(analyzed_at) OVER w
    AS older_at, lead(overall_score) OVER w AS older_score, grade AS newer_grade, lead(grade) OVER w AS older_grade, row_number() OVER w AS nth FROM §result WINDOW w AS (PARTITION BY domain ORDER BY analyzed_at DESC))
    WHERE nth = 1""")
def _(spark, path):
    return history.compare(_results(spark, path))


@query("h9_recent", f"SELECT {_RES} FROM §result ORDER BY analyzed_at DESC, result_id DESC LIMIT 20")
def _(spark, path):
    return history.recent(_results(spark, path))


@query("h10_score_trend", f"SELECT {_RES}, overall_score - lag(overall_score) OVER (PARTITION BY domain ORDER BY analyzed_at) AS score_delta FROM §result")
def _(spark, path):
    return history.trend(store.kept(_results(spark, path), "results"))


@query("j4_result_version", """SELECT r.result_id, r.overall_score, v.version_id, v.is_current FROM §result r LEFT JOIN §ver v ON v.version_id =
    r.policy_version_id""")
def _(spark, path):
    found = _versions(spark, path).select("version_id", "is_current")
    return _results(spark, path).select("result_id", "overall_score", "policy_version_id").join(
        found, F.col("policy_version_id") == F.col("version_id"), "left").drop("policy_version_id")


# ---- parties

def _queue(spark, path):
    named = _parties(spark, path).select(F.col("doc_id").alias("site_id"), F.struct("trust_score", "name").alias("o"), "name", "category",
                                         F.col("opt_out_url").alias("opt_out"))
    ranked = named.select("site_id", F.expr("named_struct('a', o.trust_score, 'b', o.name)").alias("ord"), "name", "category", "opt_out")
    found = _found(spark, path).select(F.col("page_id").alias("site_id"), F.struct(F.col("ord").alias("a"), F.lit("").alias("b")).alias("ord"),
                                       "name", "category", "opt_out")
    return parties.queue(ranked, found)


_QUEUE = """SELECT site_id, name, category, opt_out, row_number() OVER (PARTITION BY site_id ORDER BY kind, a, b) AS pos, lower(name) AS name_lc FROM (SELECT *,
    row_number() OVER (PARTITION BY site_id, lower(name) ORDER BY kind, a, b) AS nth FROM (SELECT doc_id AS site_id, 0 AS kind, trust_score AS a, name AS b,
    name, category, opt_out_url AS opt_out FROM §party UNION ALL SELECT page_id, 1, ord, '', name, category, opt_out FROM §found)) WHERE nth = 1"""


@query("j7_party_queue", f"SELECT site_id, pos, name_lc, name, category, opt_out FROM ({_QUEUE}) WHERE pos <= 12")
def _(spark, path):
    return _queue(spark, path)


def _kept_queue(spark, path):
    """The queue as a table: names are counted, looked up and joined, but no text is searched again for that."""
    return store.kept(_queue(spark, path), "party_queue")


def _company_pages(spark, path):
    """Pages that companies show on their own sites, as found by their links."""
    pages = tables.company_pages(spark, path)
    return discovery.label_links(pages, trust_rules.LABEL_WORDS, trust_rules.PAGE_LABELS, "company_domain").groupBy(
        "company_domain", "label").agg(F.min("url").alias("url"))


_REG = ", ".join("(" + ", ".join(q(v) for v in r) + ")" for r in dims.company_page_rows())
_OWN = len(seeds.COMPANY_DOMAINS) + 1
_DISC = f"""SELECT CASE WHEN page_id % {_OWN} < {_OWN - 1} THEN {pick((*seeds.COMPANY_DOMAINS, ''), 'page_id')} ELSE domain END AS company_domain, label, min(l.url) AS url
    FROM ({_label_sql()}) l JOIN §pages USING (page_id) GROUP BY ALL"""
_GUESS = "CASE WHEN contains(name_lc, '.') THEN trim(name_lc) ELSE replace(replace(name_lc, ' ', ''), ',', '') || '.com' END"
_PAGES = f"""SELECT site_id, pos, name, label, url, 'registry' AS origin FROM ({_QUEUE}) q JOIN (VALUES {_REG}) AS g(company_lc, label, url) ON q.name_lc =
    g.company_lc WHERE pos <= 12 UNION ALL SELECT site_id, pos, name, d.label, d.url, 'discovered' FROM ({_QUEUE}) q JOIN ({_DISC}) d ON {_GUESS} = d.company_domain
    WHERE pos <= 12 AND q.name_lc NOT IN (SELECT company_lc FROM (VALUES {_REG}) AS g(company_lc, label, url))"""


@query("j6_party_pages", f"SELECT site_id, pos, name, label, url, origin FROM ({_PAGES})")
def _(spark, path):
    return parties.with_pages(_kept_queue(spark, path), dims.company_page_table(spark), _company_pages(spark, path))


_REGISTERED = sorted({url for _, label, url in dims.company_page_rows() if label in trust_rules.PAGE_LABELS})
_COMPANIES = sorted({*trust_rules.COMPANY_PAGES, "acme widgets gmbh", "blue river ltd"})


def _researched(spark, path, queue):
    return parties.research(queue, dims.company_page_table(spark), _company_pages(spark, path), tables.company_fetches(spark, path, _REGISTERED),
                            tables.party_answers(spark, path, _COMPANIES))


def _dossiers(spark, path):
    queue = _kept_queue(spark, path)
    return parties.dossiers(queue, _researched(spark, path, queue))


def _party_case(field: str, answered: str) -> str:
    given = " ".join(f"WHEN {q(k)} THEN {q(v[field])}" for k, v in answer_rules.PARTY.items() if k != "answered")
    return f"CASE research {given} ELSE coalesce({answered}, {q(answer_rules.PARTY['answered'][field])}) END"


def _party_list(field: str) -> str:
    read = f"CASE WHEN research = 'answered' THEN coalesce(from_json(json_extract(j, '$.{field}'), '[\"VARCHAR\"]'), []) ELSE [] END"
    return f"CASE WHEN research = 'unread' THEN {q([answer_rules.PARTY_UNREAD_FLAG])} ELSE {read} END" if field == "risk_flags" else read


# One row per site and party; the check works out every party by itself, without dossiers of companies.
_DOSS = f"""SELECT site_id, pos, name, name_lc, category, pages_found, pages_read, context, research, opt_out_url,
    CASE research WHEN 'unread' THEN 'No pages could be fetched for ' || name || '.' WHEN 'unclear' THEN response[1:300] WHEN 'silent' THEN 'AI analysis unavailable.'
    ELSE coalesce(json_extract_string(j, '$.summary'), '') END AS summary, {_party_case('gdpr_role', "json_extract_string(j, '$.gdpr_role')")} AS gdpr_role,
    {_party_case('retention_claimed', "json_extract_string(j, '$.retention_claimed')")} AS retention_claimed,
    {_party_case('trust_score_ai', "CAST(json_extract_string(j, '$.trust_score_ai') AS INTEGER)")} AS trust_score_ai,
    {', '.join(f"{_party_list(f)} AS {f}" for f in parties.PARTY_LISTS if f != 'certifications')},
    list_concat({_party_list('certifications')}, CASE WHEN cert <> '' THEN [cert] ELSE [] END) AS certifications
    FROM (SELECT *, CASE WHEN pages_read = 0 THEN 'unread' WHEN coalesce(response, '') = '' THEN 'silent' WHEN clean IS NULL THEN 'unclear' ELSE 'answered' END AS research,
    CAST(clean AS JSON) AS j
    FROM (SELECT u.site_id, u.pos, u.name, u.name_lc, u.category, coalesce(p.n, 0) AS pages_found, coalesce(p.r, 0) AS pages_read, coalesce(p.context, '') AS context,
    e.cert, coalesce(e.opt, u.opt_out) AS opt_out_url, a.response,
    CASE WHEN json_valid(regexp_replace(a.response, '```(json)?', '', 'g')) THEN regexp_replace(a.response, '```(json)?', '', 'g') END AS clean
    FROM (SELECT * FROM ({_QUEUE}) WHERE pos <= 12) u LEFT JOIN (SELECT site_id, pos, count(*) AS n, count(t.text) FILTER (WHERE t.text <> '') AS r,
    string_agg('=== ' || upper(label) || ' PAGE (' || url || ') ===' || chr(10) || t.text[1:2000],
    chr(10) || chr(10) ORDER BY {case_of('label', {k: i for i, k in enumerate(trust_rules.PAGE_LABELS)})}, url) FILTER (WHERE t.text <> '') AS context FROM ({_PAGES}) g LEFT JOIN (SELECT ({q(_REGISTERED)})[CAST(doc_id %
    {len(_REGISTERED)} AS INTEGER) + 1] AS url, arg_max(text, doc_id) AS text FROM documents GROUP BY 1) t USING (url) WHERE label IN ('privacy', 'security', 'dpa') GROUP BY ALL) p USING (site_id, pos) LEFT JOIN (SELECT site_id, pos, max(CASE WHEN label =
    'certifications' THEN url END) AS cert, max(CASE WHEN label = 'opt_out' THEN url END) AS opt FROM ({_PAGES}) GROUP BY ALL) e USING (site_id, pos)
    LEFT JOIN (SELECT {pick(_COMPANIES, 'conv_id')} AS name_lc, arg_max({pick(seeds.PARTY_ANSWERS, '(conv_id + turn)')}, conv_id * 100000 + turn) AS response FROM conversations
    GROUP BY 1) a USING (name_lc)))"""
_DOSS_LISTS = ", ".join(f"array_to_string({f}, '|') AS {f}" for f in parties.PARTY_LISTS)


@query("l4_dossiers", f"""SELECT site_id, pos, name, category, research, pages_found, pages_read, opt_out_url, summary, gdpr_role, retention_claimed, trust_score_ai,
    {_DOSS_LISTS} FROM ({_DOSS})""")
def _(spark, path):
    return _dossiers(spark, path).withColumns({c: F.array_join(c, "|") for c in parties.PARTY_LISTS})


@query("l4_company_contexts", f"SELECT name_lc, research, pages_read, context FROM ({_DOSS}) GROUP BY ALL")
def _(spark, path):
    return _researched(spark, path, _kept_queue(spark, path)).select("name_lc", "research", "pages_read", "context")


@query("a27_ecosystem", f"""SELECT site_id, count(*) AS parties, CAST(round(avg(trust_score_ai)) AS INTEGER) AS mean_trust, count(*) FILTER (WHERE
    len(risk_flags) > 0) AS with_risk_flags, arg_min(name, trust_score_ai * 100 + pos) AS highest_risk_party FROM ({_DOSS}) GROUP BY site_id""")
def _(spark, path):
    return parties.ecosystem(_dossiers(spark, path))


@query("a30_actions", f"""SELECT site_id, row_number() OVER (PARTITION BY site_id ORDER BY k) - 1 AS pos, action FROM (SELECT site_id, pos AS k, 'Opt out of ' || name ||
    ' tracking: ' || opt_out_url AS action FROM ({_DOSS}) WHERE opt_out_url IS NOT NULL UNION ALL SELECT DISTINCT site_id, 98, {q(parties.SAR)} FROM ({_DOSS}) WHERE gdpr_role =
    'Controller' UNION ALL SELECT DISTINCT site_id, 99, {q(parties.BLOCK)} FROM ({_DOSS}) WHERE contains(lower(array_to_string(risk_flags, ' ')), 'fingerprint')
    UNION ALL SELECT site_id, 100, {q(parties.MANY)} FROM ({_DOSS}) GROUP BY site_id HAVING count(*) > 5 UNION ALL
    SELECT DISTINCT site_id, 101, {q(parties.REVIEW)} FROM ({_DOSS})) QUALIFY pos < 8""")
def _(spark, path):
    return parties.actions(_dossiers(spark, path))


# ---- language-model texts

def _names_sql(agg: str, n: str) -> str:
    return f"coalesce(nullif(array_to_string(({agg}), ', '), ''), {q(n)})"


_CTX = f"""'Domain: ' || s.domain || chr(10) || 'Privacy Score: ' || overall || '/100 (Grade: ' || grade || ', Risk: ' || risk_level || ')' || chr(10) ||
    'Data Collected: ' || coalesce(array_to_string(t.names[1:12], ', '), 'Unknown') || chr(10) || 'Third Parties: ' || n_recipients ||
    ' detected | Data Sold: ' || CASE WHEN data_sold THEN 'YES' ELSE 'No/Not stated' END || chr(10) || 'Active Trackers: ' ||
    coalesce(array_to_string(u.names[1:10], ', '), 'None') || chr(10) || 'Browser Fingerprinting: ' || CASE WHEN fingerprinting_detected THEN 'DETECTED' ELSE
    'Not detected' END || chr(10) || 'Session Recording: ' || CASE WHEN session_recording_detected THEN 'ACTIVE' ELSE 'Not detected' END || chr(10) ||
    'Dark Patterns: ' || coalesce(array_to_string(k.names[1:5], ', '), 'None detected') || chr(10) || 'GDPR Rights Coverage: ' || gdpr_score ||
    '% | CCPA Coverage: ' || ccpa_score || '%' || chr(10) || 'Retention Policy: ' || overall_rating || ' | Vagueness Score: ' || vagueness_score ||
    '/100 | Transparency: ' || transparency_score || '/100' || chr(10) || 'Score Penalties: ' || coalesce(array_to_string(l.reasons[1:5], '; '), 'None') ||
    chr(10) || 'Score Bonuses: ' || coalesce(array_to_string(g.reasons[1:3], '; '), 'None')"""
_CTX_FROM = """FROM §scored s LEFT JOIN (SELECT doc_id, list(name ORDER BY CASE sensitivity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3
    END, ord) AS names FROM §dt GROUP BY doc_id) t USING (doc_id) LEFT JOIN (SELECT page_id, list(name ORDER BY ord) AS names FROM §uniq GROUP BY page_id) u
    ON u.page_id = s.doc_id LEFT JOIN (SELECT doc_id, list(name ORDER BY ord) AS names FROM §dark GROUP BY doc_id) k USING (doc_id)
    LEFT JOIN (SELECT doc_id, list(reason ORDER BY pos) AS reasons FROM §lose GROUP BY doc_id) l USING (doc_id)
    LEFT JOIN (SELECT doc_id, list(reason ORDER BY pos) AS reasons FROM §gain GROUP BY doc_id) g USING (doc_id)"""


@query("l1_summary_context", f"SELECT doc_id, {_CTX} AS context {_CTX_FROM}")
def _(spark, path):
    return context.summary(_scored(spark, path)).select("doc_id", "context")


@query("l1_excerpt", "SELECT doc_id, CASE WHEN text = '' THEN 'No policy text available' ELSE text[1:3500] END AS excerpt FROM §docs")
def _(spark, path):
    return _docs(spark, path).select("doc_id", F.expr(context.excerpt("text")).alias("excerpt"))


_CHAT = """'PRIVACY ANALYSIS FOR ' || s.domain || chr(10) || 'Overall Score: ' || overall || '/100 (Grade: ' || grade || ', Risk Level: ' || risk_level || ')' ||
    chr(10) || chr(10) || 'DATA COLLECTION:' || chr(10) || 'Types Collected: ' || coalesce(array_to_string(t.names[1:15], ', '), 'Unknown') || chr(10) ||
    'Data Sold to Third Parties: ' || CASE WHEN data_sold THEN 'YES' ELSE 'No/Not stated' END || chr(10) || chr(10) || 'TRACKING:' || chr(10) ||
    'Active Trackers: ' || coalesce(array_to_string(u.names[1:10], ', '), 'None detected') || chr(10) || 'Browser Fingerprinting: ' ||
    CASE WHEN fingerprinting_detected THEN 'DETECTED' ELSE 'Not detected' END || chr(10) || 'Session Recording: ' || CASE WHEN session_recording_detected
    THEN 'ACTIVE' ELSE 'Not detected' END || chr(10) || 'Cookies Seen: ' || coalesce(nullif(array_to_string(c.names[1:5], ', '), ''), 'None detected') || chr(10) ||
    chr(10) || 'THIRD PARTIES:' || chr(10) || 'Named Partners: ' || coalesce(array_to_string(r.names[1:10], ', '), 'None named') || chr(10) || chr(10) ||
    'PRIVACY CONCERNS:' || chr(10) || 'Dark Patterns: ' || coalesce(array_to_string(k.names[1:5], ', '), 'None detected') || chr(10) || chr(10) ||
    'USER RIGHTS:' || chr(10) || 'GDPR Rights Covered: ' || coalesce(y.covered, 'None covered') || chr(10) || 'GDPR Rights Missing: ' ||
    coalesce(y.missing, 'All covered')"""
_CHAT_FROM = """LEFT JOIN (SELECT page_id, list(name ORDER BY ord) AS names FROM §ck GROUP BY page_id) c ON c.page_id = s.doc_id
    LEFT JOIN (SELECT doc_id, list(name ORDER BY trust_score, name) AS names FROM §party GROUP BY doc_id) r USING (doc_id)
    LEFT JOIN (SELECT doc_id, string_agg(right_id, ', ' ORDER BY ord) FILTER (WHERE covered) AS covered, string_agg(right_id, ', ' ORDER BY ord)
    FILTER (WHERE NOT covered) AS missing FROM §rgt WHERE framework = 'gdpr' GROUP BY doc_id) y USING (doc_id)"""


@query("l2_chat_context", f"SELECT doc_id, {_CHAT} AS context {_CTX_FROM} {_CHAT_FROM}")
def _(spark, path):
    return context.chat(_scored(spark, path)).select("doc_id", "context")


@query("l3_answers", """SELECT conv_id, turn, k < 2 AS ai_available, CASE k WHEN 0 THEN 'src sells data' WHEN 1 THEN 'all fine' END AS tldr, CASE k WHEN 0 THEN
    'sale|profiling' WHEN 1 THEN '' END AS risks FROM (SELECT conv_id, turn, (conv_id + turn) % 4 AS k FROM conversations)""")
def _(spark, path):
    parsed = context.parse_answers(tables.answers(spark, path))
    return parsed.select("conv_id", "turn", "ai_available", "answer.tldr", F.array_join("answer.headline_risks", "|").alias("risks"))


_NO_ANSWER = {k: " || ".join("CAST(overall AS VARCHAR)" if x == "{score}" else x[1:-1] if x.startswith("{") else q(x) for x in re.split(r"(\{\w+\})", v) if x)
              for k, v in answer_rules.FALLBACK.items()}


@query("l3_analyses", f"""SELECT conv_id, turn, k < 2 AS ai_available, {", ".join(f"CASE k WHEN 0 THEN {q('src sells data' if f == 'tldr' else '')} WHEN 1 THEN "
    f"{q({'tldr': 'all fine', 'plain_summary': 'short'}.get(f, ''))} ELSE {text} END AS {f}" for f, text in _NO_ANSWER.items())}, CASE k WHEN 0 THEN
    'sale|profiling' WHEN 1 THEN '' ELSE {q('|'.join(answer_rules.FALLBACK_RISKS))} END AS risks, CASE k WHEN 0 THEN 2 ELSE 0 END AS n_flags,
    CASE k WHEN 1 THEN 'opt out' ELSE '' END AS actions FROM (SELECT conv_id, turn, (conv_id + turn) % 4 AS k FROM conversations)
    LEFT JOIN (SELECT doc_id AS conv_id, domain, grade, overall FROM §scored) USING (conv_id)""")
def _(spark, path):
    stored = tables.answers(spark, path).withColumn("site_id", F.col("conv_id"))
    sites = _scored(spark, path).select(F.col("doc_id").alias("site_id"), "domain", "grade", "overall")
    return context.analyses(stored, sites).select(
        "conv_id", "turn", "ai_available", *answer_rules.FALLBACK, F.array_join("headline_risks", "|").alias("risks"),
        F.size("red_flags").alias("n_flags"), F.array_join("recommended_actions", "|").alias("actions"))


@query("t4_red_flags", """SELECT conv_id, turn, pos, issue, severity, rank FROM (SELECT conv_id, turn, unnest([0, 1]) AS pos, unnest(['Sale', 'Tracking']) AS issue,
    unnest(['low', 'critical']) AS severity, unnest([3, 0]) AS rank FROM conversations WHERE (conv_id + turn) % 4 = 0)""")
def _(spark, path):
    return context.red_flags(context.parse_answers(tables.answers(spark, path)))


# ---- streams, as their batch twins

@query("w1_live_trackers", "SELECT event_id, tab_id, kind, tracker, risk FROM §match")
def _(spark, path):
    return _live(spark, path).select("event_id", "tab_id", "kind", "tracker", "risk")


@query("w2_tab_trackers", "SELECT tab_id, epoch, tracker, event_id, ts, risk FROM §seen")
def _(spark, path):
    return feeds.first_seen(_live(spark, path))


@query("w3_tab_epochs", "SELECT event_id, tab_id, kind, CAST(epoch AS BIGINT) AS epoch FROM §epoch")
def _(spark, path):
    return feeds.epochs(_live(spark, path)).select("event_id", "tab_id", "kind", "epoch")


@query("w5_badges", """SELECT tab_id, epoch, event_id, count, CASE WHEN count > 15 THEN 'red' WHEN count > 5 THEN 'orange' ELSE 'yellow' END AS level FROM (
    SELECT *, count(*) OVER (PARTITION BY tab_id, epoch ORDER BY ts, event_id) AS count FROM §seen)""")
def _(spark, path):
    return feeds.badges(_live(spark, path)).select("tab_id", "epoch", "event_id", "count", "level")


query("f10_badge_level", """SELECT tab_id, n, CASE WHEN n > 15 THEN 'red' WHEN n > 5 THEN 'orange' ELSE 'yellow' END AS level FROM (SELECT tab_id,
    count(DISTINCT tracker) AS n FROM §match GROUP BY tab_id)""")(
    lambda spark, path: _live(spark, path).groupBy("tab_id").agg(F.countDistinct("tracker").alias("n")).withColumn(
        "level", F.expr(trackers.badge("n"))))


@query("x2_tumbling_trackers", """SELECT date_trunc('hour', ts) AS window_start, tracker, count(*) AS n FROM §match WHERE tracker IS NOT NULL AND kind = 'request'
    GROUP BY ALL""")
def _(spark, path):
    return feeds.tumbling(_live(spark, path))


# ---- fleet reports (our extension)

@query("x1_fleet_report", """SELECT lang, s.domain, count(*) AS sites, round(avg(overall), 4) AS mean_score, round(avg(CAST(grade IN ('A', 'B') AS INTEGER)), 4)
    AS good_share, round(avg(CAST(grade = 'A' AS INTEGER)), 4) AS share_a, round(avg(CAST(grade = 'B' AS INTEGER)), 4) AS share_b, round(avg(CAST(grade = 'C' AS INTEGER)), 4)
    AS share_c, round(avg(CAST(grade = 'D' AS INTEGER)), 4) AS share_d, round(avg(CAST(grade = 'F' AS INTEGER)), 4) AS share_f
    FROM §scored s JOIN (SELECT doc_id, lang FROM §docs) USING (doc_id) GROUP BY ROLLUP (lang, s.domain)""")
def _(spark, path):
    return reports.fleet(_scored(spark, path), "lang", "domain")


@query("x1_fleet_common", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY level, lang, domain, kind ORDER BY sites DESC, name) AS rank FROM (
    SELECT 2 - grouping(lang) - grouping(domain) AS level, lang, domain, kind, name, count(*) AS sites FROM (SELECT d.lang, d.domain, kind, name FROM (
    SELECT DISTINCT doc_id, 'category' AS kind, name FROM §dt UNION ALL SELECT DISTINCT doc_id, 'dark_pattern', name FROM §dark) JOIN §docs d USING (doc_id)
    WHERE policy_found AND length(d.text) >= 100) GROUP BY GROUPING SETS ((lang, domain, kind, name), (lang, kind, name), (kind, name)))) WHERE rank <= 3""")
def _(spark, path):
    return reports.fleet_common(_facts(spark, path), "lang", "domain")


@query("x3_tracker_reach", "SELECT name, count(DISTINCT page_id) AS pages FROM §found GROUP BY name")
def _(spark, path):
    return reports.reach(_found(spark, path))


@query("x3_tracker_pairs", """SELECT a.name AS tracker_a, b.name AS tracker_b, count(DISTINCT a.page_id) AS pages FROM §found a JOIN §found b ON a.page_id =
    b.page_id AND a.name < b.name WHERE NOT starts_with(a.name, 'Unknown pixel') AND NOT starts_with(b.name, 'Unknown pixel') GROUP BY ALL""")
def _(spark, path):
    return reports.pairs_seen(_found(spark, path))
