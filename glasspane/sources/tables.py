"""Readers for policies, pages, requests and versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..rules import discovery as D
from . import seeds as S


def read(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}.parquet")


def pick(items, key: Column) -> Column:
    """Item of a fixed list by a row's number."""
    return F.element_at(F.array(*[F.lit(x) for x in items]), (key % len(items) + 1).cast("int"))


def policies(spark: SparkSession, path: str) -> DataFrame:
    """One row per policy text: doc_id, domain, lang, policy_found, text, low (the searchable copy)."""
    docs = read(spark, path, "documents").select("doc_id", "text", "lang", F.col("source").alias("domain"))
    text = F.concat_ws("\n", "text", pick(S.CLAUSES, F.col("doc_id")), pick(S.EXTRAS, F.col("doc_id")))
    return (docs.select("doc_id", "domain", "lang", (F.col("domain") != "src7").alias("policy_found"), text.alias("text"))
            .withColumn("low", T.searchable(F.col("text"))))


def homepages(spark: SparkSession, path: str) -> DataFrame:
    """One row per stored page: page_id, url, domain, base, html, cookies (Set-Cookie headers)."""
    pages = read(spark, path, "pages").select("page_id", "url", "html")
    raw = F.split(pick(S.COOKIES, F.col("page_id")), "\n")
    return pages.select(
        "page_id", "url", F.expr(U.site("url")).alias("domain"), F.expr(U.base("url")).alias("base"),
        F.concat("html", pick(S.FRAGMENTS, F.col("page_id"))).alias("html"),
        F.filter(raw, lambda x: x != "").alias("cookies"))


def policy_pages(spark: SparkSession, path: str) -> DataFrame:
    """Stored pages beside the homepages: url, html. One address of the usual paths per page, first page wins."""
    pages = homepages(spark, path)
    kept = F.when(F.col("page_id") % 2 == 0, F.concat(
        F.lit("<main><p>"), F.lit(D_TEXT), F.lit("</p></main>"))).otherwise(F.lit("<p>Nothing to see here.</p>"))
    stored = pages.select(F.concat("base", pick(D.POLICY_PATHS[:8], F.col("page_id"))).alias("url"),
                          kept.alias("html"), "page_id")
    return stored.groupBy("url").agg(F.min_by("html", "page_id").alias("html"))


# Body of a stored policy page.
D_TEXT = ("This privacy notice explains how we collect personal data, which cookies are set, how consent is asked and "
          "how long the retention of personal information lasts. The data controller answers questions about data "
          "protection within a month of your letter.")


def robots(spark: SparkSession, path: str) -> DataFrame:
    """page_id, base, body of robots.txt."""
    return homepages(spark, path).select(
        "page_id", "base", F.replace(pick(S.ROBOTS, F.col("page_id")), F.lit("@"), F.col("base")).alias("body"))


def sitemaps(spark: SparkSession, path: str) -> DataFrame:
    """Stored sitemap bodies: sitemap_url, body. Two addresses per page, first page wins."""
    pages = homepages(spark, path)
    one = pages.select(F.concat("base", F.lit("/sitemap.xml")).alias("sitemap_url"), "base", "page_id",
                       pick(S.SITEMAPS, F.col("page_id")).alias("raw"))
    two = pages.select(F.concat("base", F.lit("/maps/two.xml")).alias("sitemap_url"), "base", "page_id",
                       pick(S.SITEMAPS, F.col("page_id") + 2).alias("raw"))
    return (one.unionByName(two)
            .select("sitemap_url", "page_id", F.replace("raw", F.lit("@"), F.col("base")).alias("body"))
            .groupBy("sitemap_url").agg(F.min_by("body", "page_id").alias("body")))


def request_url(event_id: Column) -> Column:
    """Address that a test event asks for: tracker hosts, hosts below them, and others."""
    from ..rules.trackers import LIVE_HOSTS
    n = len(LIVE_HOSTS)
    known = pick(LIVE_HOSTS, event_id)
    return (F.when(event_id % 3 == 0, F.concat(F.lit("https://www."), known, F.lit("/t.js")))
            .when(event_id % 3 == 1, F.concat(F.lit("https://cdn"), (event_id % n).cast("string"), F.lit("."), known))
            .otherwise(F.concat(F.lit("https://static"), (event_id % n).cast("string"), F.lit(".site.test/a.png"))))


def requests(spark: SparkSession, path: str) -> DataFrame:
    """Browser events: event_id, tab_id, ts, kind (request, navigate, close), url."""
    return as_requests(read(spark, path, "events"))


def as_requests(events: DataFrame) -> DataFrame:
    kind = (F.when(F.col("event_type") == "view", F.lit("navigate"))
            .when(F.col("event_type") == "signup", F.lit("close")).otherwise(F.lit("request")))
    return events.select("event_id", F.col("user_id").alias("tab_id"), "ts", kind.alias("kind"),
                         request_url(F.col("event_id")).alias("url"))


def fetches(spark: SparkSession, path: str) -> DataFrame:
    """Every fetch of a policy text, oldest first within a domain: fetch_id, domain, policy_url, fetched_at, text."""
    docs = read(spark, path, "documents").select("doc_id", "source", "text")
    nth = F.floor(F.col("doc_id") / 20)
    notice = [F.lit(S.CLAUSES[0]), F.lit(S.CLAUSES[9])]
    text = F.when(nth % 5 == 4, F.concat_ws("\n", *notice)).otherwise(
        F.concat_ws("\n", *notice, "text", pick(S.CLAUSES, nth)))
    return docs.select(
        F.col("doc_id").alias("fetch_id"), F.col("source").alias("domain"),
        F.concat(F.lit("https://"), "source", F.lit(".example/privacy")).alias("policy_url"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 3600).alias("fetched_at"), text.alias("text"))


def answers(spark: SparkSession, path: str) -> DataFrame:
    """Stored model answers: conv_id, turn, response."""
    return read(spark, path, "conversations").select(
        "conv_id", "turn", pick(S.ANSWERS, F.col("conv_id") + F.col("turn")).alias("response"))


def company_pages(spark: SparkSession, path: str) -> DataFrame:
    """Stored pages of company sites: homepages with company_domain, the domain of the company or else of the page."""
    n = len(S.COMPANY_DOMAINS) + 1
    own = F.when(F.col("page_id") % n < n - 1, pick((*S.COMPANY_DOMAINS, ""), F.col("page_id"))).otherwise(F.col("domain"))
    return homepages(spark, path).withColumn("company_domain", own)


def company_fetches(spark: SparkSession, path: str, urls) -> DataFrame:
    """Stored texts of documentation pages: every document is a fetch of one of the addresses (url, at, text)."""
    return read(spark, path, "documents").select(pick(urls, F.col("doc_id")).alias("url"), F.col("doc_id").alias("at"), "text")


def party_answers(spark: SparkSession, path: str, names) -> DataFrame:
    """Stored answers about companies: name_lc, at, response."""
    return read(spark, path, "conversations").select(
        pick(names, F.col("conv_id")).alias("name_lc"), F.struct("conv_id", "turn").alias("at"),
        pick(S.PARTY_ANSWERS, F.col("conv_id") + F.col("turn")).alias("response"))
