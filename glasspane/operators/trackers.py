"""Trackers, cookies and script signals per page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cookies as C
from ..functions import html as H
from ..functions import text as T
from ..functions import urls as U
from ..rules import pages as P
from ..rules import trackers as R
from ..sources import dims

KINDS = ("script", "pixel", "iframe")


def _resources(html: str, domain: str) -> str:
    """Addresses that a page loads from other hosts: array<struct<pos, kind, url, host>>, scripts first."""
    def fields(e: str) -> str:
        small = " AND ".join(f"coalesce({H.attribute(e, a)}, '') IN ('0', '1')" for a in ("width", "height"))
        return T.struct(tag=H.tag_name(e), src=H.attribute(e, "src"), small=small)

    def kind(f: str) -> str:
        words = T.either(f"contains(lower({f}.src), {T.quote(w)})" for w in R.PIXEL_WORDS)
        return (f"CASE WHEN {f}.tag = 'script' THEN 'script' WHEN {f}.tag = 'iframe' THEN 'iframe' "
                f"WHEN {f}.small OR {words} THEN 'pixel' END")

    rows = T.each(H.elements(html, "img", "iframe"), lambda e: T.let(fields(e), lambda f: T.struct(
        kind=kind(f), url=f"{f}.src", host=U.host(f"{f}.src"))))
    rows = f"filter({rows}, r -> r.kind IS NOT NULL AND {U.third_party('r.host', domain)})"
    return T.let(rows, lambda r: "concat(" + ", ".join(
        f"filter(transform({r}, (x, i) -> named_struct('pos', i, 'kind', x.kind, 'url', x.url, 'host', x.host)), "
        f"x -> x.kind = '{k}')" for k in KINDS) + ")")


def resources(pages: DataFrame) -> DataFrame:
    """One row per third-party resource: scripts, pixels, iframes, in page order within a kind."""
    found = pages.select("page_id", "domain", F.expr(T.let(T.struct(h="html", d="domain"), lambda r: _resources(
        f"{r}.h", f"{r}.d"))).alias("rs"))
    found = found.selectExpr("page_id", "domain", "transform(rs, (x, i) -> named_struct('ord', i, 'r', x)) AS rs")
    return T.explode_rows(found, "rs", "r").select("page_id", "domain", "r.ord", "r.r.kind", "r.r.url", "r.r.host")


def match_hosts(df: DataFrame, trackers: DataFrame, rows: list[tuple]) -> DataFrame:
    """Joins a `host` column to the tracker with the longest equal or parent host.

    One equi-join per number of labels that occurs in the tracker table, on the last labels of the host. Nothing is
    exploded or ranked, every host stays one row, and each join is a broadcast join while the table is small.
    """
    depths = sorted({r[0].count(".") + 1 for r in rows}, reverse=True)
    fields = [f for f in trackers.columns if f != "domain"]
    for d in depths:
        part = trackers.where(F.size(F.split("domain", "[.]")) == d).select(
            F.col("domain").alias(f"_k{d}"), F.struct("domain", *fields).alias(f"_t{d}"))
        df = df.withColumn(f"_h{d}", F.expr(f"if(size(split(host, '[.]')) >= {d}, substring_index(host, '.', -{d}), "
                                            f"NULL)"))
        df = df.join(dims.small(part, len(rows)), F.col(f"_h{d}") == F.col(f"_k{d}"), "left").drop(f"_h{d}", f"_k{d}")
    best = F.coalesce(*[F.col(f"_t{d}") for d in depths])
    return df.withColumn("tracker", best).drop(*[f"_t{d}" for d in depths])


def found_rows(pages: DataFrame, trackers: DataFrame, rows: list[tuple]) -> DataFrame:
    """One row per resource that is a tracker; pixels of unknown hosts count as medium risk."""
    joined = match_hosts(resources(pages), trackers, rows)
    known, pixel = F.col("tracker").isNotNull(), F.col("kind") == "pixel"
    return joined.where(known | pixel).select(
        "page_id", "ord", "kind", "host", F.substring("url", 1, R.URL_PREVIEW).alias("url"),
        F.coalesce("tracker.name", F.concat(F.lit("Unknown pixel ("), "host", F.lit(")"))).alias("name"),
        F.coalesce("tracker.category", F.lit(R.UNKNOWN_PIXEL_CATEGORY)).alias("category"),
        F.coalesce("tracker.risk", F.lit(R.UNKNOWN_PIXEL_RISK)).alias("risk"),
        (F.coalesce("tracker.fingerprinting", F.lit(False)) & ~pixel).alias("fingerprinting"),
        (F.coalesce("tracker.session_recording", F.lit(False)) & (F.col("kind") == "script"))
        .alias("session_recording"),
        F.col("tracker.opt_out").alias("opt_out"))


def _first_pattern(text: str, patterns) -> str:
    cases = " ".join(f"WHEN {T.matches(text, p)} THEN {T.quote(p)}" for p in patterns)
    return f"CASE {cases} END"


def inline_scripts(html: str) -> str:
    return T.each(f"filter({H.elements(html)}, e -> {H.attribute('e', 'src')} IS NULL)", H.script_body)


def fingerprint_evidence(bodies: str) -> str:
    return T.each(f"array_compact({T.each(bodies, lambda b: _first_pattern(b, P.FINGERPRINTING))})",
                  lambda p: f"concat('Pattern `', {p}, '` found in inline script')")


def recording_evidence(bodies: str) -> str:
    return T.each(f"array_compact({T.each(bodies, lambda b: _first_pattern(b, P.RECORDING))})",
                  lambda p: f"concat('Session recording pattern found: `', substring({p}, 1, 40), '`')")


def mentioned_trackers(bodies: str, rows) -> str:
    """Trackers whose host stands in an inline script."""
    table = T.array(T.struct(d=T.quote(r[0]), n=T.quote(r[1])) for r in rows)
    hit = T.keep(table, lambda t: T.some(bodies, lambda b: f"contains({b}, {t}.d)"))
    return f"array_distinct({T.each(hit, lambda t: f'concat(\'Reference to \', {t}.n, \' in inline script\')')})"


def consent_platform(low_html: str) -> str:
    cases = " ".join(f"WHEN {T.any_match(low_html, p)} THEN {T.quote(name)}" for name, p in P.CONSENT_PLATFORMS)
    return f"CASE {cases} END"


def _known(host: str, table: str) -> str:
    """Facts of the tracker with the longest equal or parent host, from a literal map."""
    return T.let(U.suffixes(host), lambda ss: f"try_element_at(array_compact(transform({ss}, "
                                              f"s -> try_element_at({table}, s))), 1)")


def _detect(html: str, domain: str, headers: str, rows) -> str:
    table = "map(" + ", ".join(f"{T.quote(d)}, " + T.struct(
        name=T.quote(n), category=T.quote(c), risk=T.quote(k), fingerprinting=T.quote(f), session_recording=T.quote(s),
        opt_out="cast(" + T.quote(o) + " as string)") for d, n, c, k, f, s, o in rows) + ")"

    def tracker(r: str, known: str) -> str:
        return T.struct(
            host=f"{r}.host", kind=f"{r}.kind", url=f"substring({r}.url, 1, {R.URL_PREVIEW})",
            name=f"coalesce({known}.name, concat('Unknown pixel (', {r}.host, ')'))",
            category=f"coalesce({known}.category, {T.quote(R.UNKNOWN_PIXEL_CATEGORY)})",
            risk=f"coalesce({known}.risk, {T.quote(R.UNKNOWN_PIXEL_RISK)})",
            fingerprinting=f"coalesce({known}.fingerprinting, false) AND {r}.kind <> 'pixel'",
            session_recording=f"coalesce({known}.session_recording, false) AND {r}.kind = 'script'",
            opt_out=f"{known}.opt_out")

    def gather(rs: str, bodies: str, tbl: str) -> str:
        hits = "array_compact(" + T.each(rs, lambda r: T.let(_known(f"{r}.host", tbl), lambda k: (
            f"if({k} IS NOT NULL OR {r}.kind = 'pixel', {tracker(r, k)}, NULL)"))) + ")"
        return T.struct(rs=rs, hits=hits, fp=fingerprint_evidence(bodies), sr=recording_evidence(bodies),
                        inline=mentioned_trackers(bodies, rows), cookies=C.parse_all(headers),
                        cmp=T.let(f"lower({html})", consent_platform),
                        sandbox=T.let(f"lower({html})", lambda h: T.matches(h, P.PRIVACY_SANDBOX)))

    def finish(g: str) -> str:
        def noted(flag: str, word: str) -> str:
            return f"transform(filter({g}.hits, t -> t.{flag}), t -> concat('Known {word}: ', t.name))"
        fp = f"concat({g}.fp, {noted('fingerprinting', 'fingerprinting service')})"
        sr = f"concat({g}.sr, {noted('session_recording', 'session recorder')})"
        unique = T.distinct_by(f"{g}.hits", "host")
        groups = (f"map_from_entries(transform(array_sort(array_distinct(transform({g}.hits, t -> t.category))), "
                  f"c -> struct(c, size(filter({g}.hits, t -> t.category = c)))))")
        return T.let(unique, lambda first: T.struct(
            trackers=first, total_tracker_count=f"size({first})", by_category=groups,
            high_risk_count=f"size(filter({g}.hits, t -> t.risk IN ('high', 'critical')))",
            fingerprinting_detected=f"size({fp}) > 0",
            fingerprinting_evidence=f"slice(array_sort(array_distinct({fp})), 1, 5)",
            session_recording_detected=f"size({sr}) > 0",
            session_recording_evidence=f"slice(array_sort(array_distinct({sr})), 1, 5)",
            cookies=f"slice({g}.cookies, 1, {P.MAX_COOKIES})", n_cookies=f"size({g}.cookies)",
            httponly_pct=C.flag_share(f"{g}.cookies", "c.httponly"), secure_pct=C.flag_share(f"{g}.cookies", "c.secure"),
            samesite_pct=C.flag_share(f"{g}.cookies", "c.samesite <> ''"),
            cmp_detected=f"{g}.cmp", inline_tracker_signals=f"slice(array_sort({g}.inline), 1, 10)",
            unique_third_party_domains=f"slice(array_sort(array_distinct(transform({g}.rs, r -> r.host))), 1, "
                                       f"{R.MAX_HOSTS})",
            privacy_sandbox_detected=f"{g}.sandbox"))

    return T.let(table, lambda tbl: T.let(_resources(html, domain), lambda rs: T.let(
        inline_scripts(html), lambda b: T.let(gather(rs, b, tbl), finish))))


def detect(pages: DataFrame, rows: list[tuple] | None = None) -> DataFrame:
    """Adds `tracking`: everything a page reveals about trackers and cookies, within its row."""
    rows = dims.tracker_rows() if rows is None else rows
    whole = T.struct(h="html", d="domain", c="cookies")
    return pages.withColumn("tracking", F.expr(T.let(whole, lambda r: _detect(f"{r}.h", f"{r}.d", f"{r}.c", rows))))


def cookie_rows(pages: DataFrame) -> DataFrame:
    """One row per Set-Cookie header."""
    found = pages.select("page_id", F.expr(T.let("cookies", C.parse_all)).alias("cs"))
    found = found.selectExpr("page_id", "transform(cs, (x, i) -> named_struct('ord', i, 'c', x)) AS cs")
    return T.explode_rows(found, "cs", "c").select("page_id", "c.ord", "c.c.*")


def banner(html: str) -> str:
    """True where the markup holds a consent banner."""
    def attr(name: str, value: str) -> str:
        rule = rf"""(?i)<[a-z][^>]*[\s"'/]{name}\s*=\s*(?:"{value}"|'{value}')"""
        return f"({html} rlike {T.quote(rule)})"
    words = r"(?:[^\"'>]*\s)?(?:%s)(?:\s[^\"'>]*)?"
    part = r"[^\"'>]*(?:%s)[^\"'>]*"
    return T.either((
        attr("id", f"(?:{'|'.join(P.BANNER_IDS)})"), attr("class", words % "|".join(P.BANNER_CLASSES)),
        attr("id", part % "|".join(P.BANNER_ID_PARTS)), attr("class", part % "|".join(P.BANNER_CLASS_PARTS)),
        attr("aria-label", part % "|".join(P.BANNER_ARIA_PARTS))))


def script_platform(html: str) -> str:
    """Consent platform of the first script whose address names one."""
    def first(src: str) -> str:
        cases = " ".join(f"WHEN contains({src}, {T.quote(w)}) THEN {T.quote(name)}" for w, name in P.SCRIPT_PLATFORMS)
        return f"CASE {cases} END"
    return (f"try_element_at(array_compact({T.each(H.elements(html), lambda e: T.let(
        f'lower({H.attribute(e, "src")})', first))}), 1)")


def page_signals(pages: DataFrame) -> DataFrame:
    """What a browser would notice on a page: banner, consent platform, cookies, one-sided consent, ticked boxes."""
    def buttons(html: str) -> str:
        rule = r"(?i)<(?:button|a)\b[^>]*>[\s\S]*?</(?:button|a)\s*>"
        clean = H.without(html, ())
        return f"transform(regexp_extract_all({clean}, {T.quote(rule)}, 0), b -> " \
               f"trim(regexp_replace(b, '<[^>]*>', '')))"

    def boxes(html: str) -> str:
        ticked = " AND ".join((
            f"lower(coalesce({H.attribute('e', 'type')}, '')) = 'checkbox'", H.has_attribute("e", "checked"),
            f"(contains(lower(coalesce({H.attribute('e', 'name')}, '')), 'consent') OR "
            f"contains(lower(coalesce({H.attribute('e', 'id')}, '')), 'consent'))"))
        return f"size(filter({H.elements(html, 'input')}, e -> {H.tag_name('e')} = 'input' AND {ticked}))"

    def signals(html: str) -> str:
        accept, reject = T.quote("(?i)" + P.ACCEPT_TEXT), T.quote("(?i)" + P.REJECT_TEXT)
        return T.let(buttons(html), lambda b: T.struct(
            has_consent_banner=banner(html), cmp_name=script_platform(html),
            one_sided=f"exists({b}, x -> x rlike {accept}) AND NOT exists({b}, x -> x rlike {reject})",
            ticked=boxes(html)))

    return pages.select("page_id", F.size("cookies").alias("cookie_count"),
                        F.expr(T.let("html", signals)).alias("s")).select(
        "page_id", "cookie_count", "s.has_consent_banner", "s.cmp_name",
        F.col("s.one_sided").alias("no_reject_option"), F.col("s.ticked").alias("pre_ticked_boxes"))


def badge(n: str) -> str:
    cases = " ".join(f"WHEN {n} > {above} THEN '{colour}'" for above, colour in P.BADGE_CUTS)
    return f"CASE {cases} ELSE 'yellow' END"
