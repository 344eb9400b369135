"""Finding the policy of a site among stored pages: links, usual paths, sitemaps; and judging a page."""

from __future__ import annotations

from pyspark.sql import DataFrame

from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import text as T
from ..functions import urls as U
from ..rules import discovery as R

_ANCHOR = r"(?i)<a\b[^>]*>[\s\S]*?</a\s*>"
_CLEAN = r"(?i)<!--[\s\S]*?-->|<script\b[^>]*>[\s\S]*?</script\s*>"


def _anchors(html: str, base: str, url: str) -> str:
    """Links of markup: array<struct<href, text, full>>, without fragments, scripts, mail and phone links."""
    skip = " OR ".join(f"startswith(l.href, {T.quote(s)})" for s in R.SKIPPED_HREFS)
    found = T.each(f"regexp_extract_all(regexp_replace({html}, {T.quote(_CLEAN)}, ''), {T.quote(_ANCHOR)}, 0)",
                   lambda a: T.struct(href=H.attribute(a, "href"),
                                      text=T.squeeze(H.unescape(f"regexp_replace({a}, '<[^>]*>', ' ')"))))
    kept = f"filter({found}, l -> l.href IS NOT NULL AND l.href <> '' AND NOT ({skip}))"
    return T.each(kept, lambda x: T.struct(href=f"{x}.href", text=f"{x}.text",
                                           full=U.absolute(f"{x}.href", base, url)))


def links(pages: DataFrame) -> DataFrame:
    """Distinct links of each page in order of first appearance: page_id, pos, href, text, full."""
    bound = T.struct(h="html", b="base", u="url")
    found = pages.select("page_id", F.expr(T.let(bound, lambda r: T.distinct_by(_anchors(f"{r}.h", f"{r}.b", f"{r}.u"), "full"))).alias("ls"))
    found = found.selectExpr("page_id", "transform(ls, (x, i) -> named_struct('pos', i, 'l', x)) AS ls")
    return T.explode_rows(found, "ls", "l").select("page_id", "l.pos", "l.l.*")


def _region(kind: str, value: str, o: str) -> str:
    """Whether an opening tag (struct<name, role, id, class>) begins a region; class is a list of words."""
    if kind == "tag":
        return f"{o}.name = {T.quote(value)}"
    return f"contains({o}.class, {T.quote(f' {value} ')})" if kind == "class" else f"coalesce({o}.{kind} = {T.quote(value)}, false)"


def regions(tags: str, names: str) -> str:
    """Indexes of the first element of each kind of region, in the order of the kinds, each once."""
    kinds = sorted({v for k, v in R.LINK_REGIONS if k == "tag"})
    mark = T.quote(r"(?i)^<(?:" + "|".join(kinds) + r")\b|^<[a-z][^>]*[\s\"'/](?:class|id|role)\s*=")
    opened = T.struct(at="i", name=f"element_at({names}, i + 1).name", role=H.attribute("t", "role"), id=H.attribute("t", "id"),
                      **{"class": f"concat(' ', regexp_replace(coalesce({H.attribute('t', 'class')}, ''), '\\\\s+', ' '), ' ')"})
    listed = f"array_compact(transform({tags}, (t, i) -> if(t rlike {mark}, {opened}, NULL)))"
    return T.let(listed, lambda os: "array_distinct(array_compact(array(" + ", ".join(
        f"get(filter({os}, o -> {_region(k, v, 'o')}), 0).at"
        for k, v in R.LINK_REGIONS) + ")))")


def preferred_links(pages: DataFrame) -> DataFrame:
    """Links of the footer, navigation and legal regions in order of preference, else all links of the page.

    A region is a whole element: it ends where its own tag is as often closed as opened, with the page if it is never closed.
    """
    def ranked(clean: str, base: str, url: str) -> str:
        def inside(tags: str) -> str:
            def each(x: str) -> str:
                return T.let(H.closing(f"{x}.names", f"{x}.at"), lambda stop: _anchors(H.between(f"{x}.tags", f"{x}.pieces", f"{x}.at", stop), base, url))
            return T.let(T.struct(tags=tags, names=H.named_steps(tags), pieces=H.pieces(clean)), lambda p: "flatten(" + T.each(
                f"transform({regions(f'{p}.tags', f'{p}.names')}, a -> named_struct('at', a, 'tags', {p}.tags, 'names', {p}.names, 'pieces', {p}.pieces))", each) + ")")
        return T.let(T.let(H.tags(clean), inside), lambda ls: f"if(size({ls}) > 0, {ls}, {_anchors(clean, base, url)})")

    bound = T.struct(h=f"regexp_replace(html, {T.quote(_CLEAN)}, '')", b="base", u="url")
    found = pages.select("page_id", F.expr(T.let(bound, lambda r: T.distinct_by(ranked(f"{r}.h", f"{r}.b", f"{r}.u"), "href"))).alias("ls"))
    found = found.selectExpr("page_id", "transform(ls, (x, i) -> named_struct('pos', i, 'l', x)) AS ls")
    return T.explode_rows(found, "ls", "l").select("page_id", "l.pos", "l.l.*")


def url_signal(url: str) -> str:
    """True where an address marks a policy page."""
    return T.either(f"contains(lower({url}), {T.quote(s)})" for s in R.URL_SIGNALS)


def link_signal(text: str, href: str) -> str:
    return T.let(f"lower({text})", lambda t: T.any_match(t, R.LINK_TEXTS)) + " OR " + url_signal(href)


def link_choice(pages: DataFrame) -> DataFrame:
    """First preferred link of a page that points to a policy."""
    hits = preferred_links(pages).where(F.expr(link_signal("text", "href")))
    return hits.groupBy("page_id").agg(F.min_by(F.struct("href", "text", F.col("full").alias("url")), "pos").alias("l")
                                       ).select("page_id", "l.*")


def policy_words(low: str) -> str:
    return f"size({T.literals_in(low, R.POLICY_WORDS)})"


def likely_policy(text: str) -> str:
    """At least three policy words in at least 200 characters."""
    return T.let(f"lower({text})", lambda low: f"length({low}) >= {R.MIN_POLICY_CHARS} AND "
                                               f"{policy_words(low)} >= {R.MIN_POLICY_WORDS}")


def judge(stored: DataFrame) -> DataFrame:
    """Validates candidate pages (url, requested, text, embedded): own text, then embedded text, then the address.

    Adds valid, method and the text that is kept: the first text that reads like a policy, else the longer one.
    """
    cascade = T.let(T.struct(a=likely_policy("text"), b=likely_policy("embedded"), c=url_signal("url"),
                             d=url_signal("requested")), lambda t: (
        f"CASE WHEN {t}.a THEN 'text' WHEN {t}.b THEN 'embedded' WHEN {t}.c OR {t}.d THEN 'url' END"))
    longer = "if(length(text) > length(embedded), text, embedded)"
    return stored.withColumn("method", F.expr(cascade)).withColumns({
        "valid": F.col("method").isNotNull(),
        "kept": F.expr(f"CASE method WHEN 'text' THEN text WHEN 'embedded' THEN embedded WHEN 'url' THEN {longer} "
                       f"ELSE text END")})


def canonical(pages: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored pages at the usual paths of a site: page_id, ord, url. A stored address is cut into base and path; sites meet it by base."""
    base = F.regexp_extract("url", "^(https?://[^/?#]*)", 1)
    ord = F.expr(T.lookup({p: i for i, p in enumerate(R.POLICY_PATHS)}, "path"))
    kept = stored.select("url", base.alias("base")).distinct().withColumn("path", F.expr("substring(url, length(base) + 1)"))
    return pages.select("page_id", "base").join(kept.withColumn("ord", ord).where("ord IS NOT NULL"), "base").select("page_id", "ord", "url")


def robots_sitemaps(robots: DataFrame) -> DataFrame:
    """Sitemap addresses of a site: up to five named in robots.txt, then three usual names."""
    named = f"slice(regexp_extract_all(body, '(?im)^Sitemap:[ \\\\t]*([^ \\\\t\\\\r\\\\n]+)', 1), 1, {R.MAX_ROBOTS_SITEMAPS})"
    usual = f"transform({T.literals(R.SITEMAP_NAMES)}, n -> concat(base, n))"
    return robots.select("page_id", F.posexplode(F.expr(f"concat({named}, {usual})")).alias("ord", "sitemap_url"))


def _locations(body: str) -> str:
    return f"transform(regexp_extract_all({body}, '(?i)<loc>([^<]*)</loc>', 1), u -> trim(u))"


def _nested(body: str) -> str:
    found = f"regexp_extract_all({body}, '(?i)<sitemap>[^<]*<loc>([^<]*)</loc>', 1)"
    return f"slice(transform({found}, u -> trim(u)), 1, {R.MAX_NESTED_SITEMAPS})"


def sitemap_choice(robots: DataFrame, sitemaps: DataFrame) -> DataFrame:
    """First address with a policy signal in the sitemaps of a site, one level of nested sitemaps included."""
    bodies = sitemaps.select("sitemap_url", F.expr(f"filter({_locations('body')}, u -> {url_signal('u')})").alias("hits"),
                             F.expr(_nested("body")).alias("nested"))
    top = robots_sitemaps(robots).join(bodies, "sitemap_url")
    own = top.select("page_id", "ord", F.lit(-1).alias("sub"), F.get("hits", F.lit(0)).alias("url"))
    inner = top.select("page_id", "ord", F.posexplode("nested").alias("sub", "sitemap_url"))
    below = inner.join(bodies.select("sitemap_url", "hits"), "sitemap_url").select(
        "page_id", "ord", "sub", F.get("hits", F.lit(0)).alias("url"))
    found = own.unionByName(below).where(F.col("url").isNotNull())
    return found.groupBy("page_id").agg(F.min_by("url", F.struct("ord", "sub")).alias("url"))


def sitemap_hits(sitemaps: DataFrame) -> DataFrame:
    """Every sitemap entry with a policy signal: sitemap_url, pos, url."""
    found = sitemaps.select("sitemap_url", F.posexplode(F.expr(_locations("body"))).alias("pos", "url"))
    return found.where(F.expr(url_signal("url")))


def choose(pages: DataFrame, stored: DataFrame, robots: DataFrame, sitemaps: DataFrame) -> DataFrame:
    """Policy page of a site: a link before a usual path before a sitemap entry; the first valid one wins."""
    way = {"link_scan": 0, "canonical_path": 1, "sitemap": 2}
    found = (link_choice(pages).select("page_id", F.lit("link_scan").alias("method"), F.lit(0).alias("ord"), "url")
             .unionByName(canonical(pages, stored).select("page_id", F.lit("canonical_path").alias("method"), "ord",
                                                          "url"))
             .unionByName(sitemap_choice(robots, sitemaps).select("page_id", F.lit("sitemap").alias("method"),
                                                                  F.lit(0).alias("ord"), "url")))
    asked = stored.join(found.select("url").distinct(), "url", "left_semi")
    pages_read = asked.select("url", F.expr(T.let("html", lambda h: H.visible_text(h, R.DROPPED_TAGS, R.MIN_LINE)))
                               .alias("text"))
    judged = judge(pages_read.select("url", F.col("url").alias("requested"), "text", F.lit("").alias("embedded")))
    ok = judged.where("valid").select("url", T.word_count(F.col("kept")).alias("word_count"))
    rank = F.expr(T.lookup(way, "method"))
    return (found.join(ok, "url").groupBy("page_id")
            .agg(F.min_by(F.struct("method", F.col("url").alias("policy_url"), "word_count"),
                          F.struct(rank, "ord")).alias("b")).select("page_id", "b.*"))


def label_links(pages: DataFrame, words: dict, labels, key: str = "page_id") -> DataFrame:
    """Documentation pages of a company: the first link per label, where a link serves its first free label.

    One pass over the links of a page in order: a link takes the first label that it names and that no earlier link
    has taken. Rows carry the page's column `key`.
    """
    def named(text: str, href: str) -> str:
        return T.strings("if(" + T.either(f"contains({href}, {T.quote(w)}) OR contains({text}, {T.quote(w)})"
                                          for w in words[k]) + f", {T.quote(k)}, NULL)" for k in labels)

    bound = T.struct(h="html", b="base", u="url")
    empty = "cast(array() as array<struct<label:string,url:string>>)"
    taken = (f"aggregate(ls, {empty}, (acc, l) -> concat(acc, coalesce(transform(slice(filter("
             f"{named('lower(l.text)', 'lower(l.href)')}, k -> NOT exists(acc, a -> a.label = k)), 1, 1), "
             f"k -> named_struct('label', k, 'url', l.full)), {empty})))")
    found = pages.select(key, F.expr(T.let(bound, lambda r: T.let(
        _anchors(f"{r}.h", f"{r}.b", f"{r}.u"), lambda ls: f"filter({ls}, l -> startswith(l.full, 'http'))")))
        .alias("ls")).select(key, F.expr(taken).alias("ks"))
    return T.explode_rows(found, "ks", "k").select(key, "k.label", "k.url")
