"""Companies behind recipients and trackers: research queue, documentation pages, dossiers, actions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..rules import answers as A
from ..rules import trust as R
from ..sources import dims
from .context import json_object
from .hot import attach


def queue(named: DataFrame, trackers: DataFrame, limit: int = R.PARTIES_PER_SITE) -> DataFrame:
    """Parties of a site to look into: recipients first, then trackers, each name once, at most twelve.

    Both inputs carry (site_id, ord, name, category, opt_out).
    """
    both = (named.select("site_id", F.lit(0).alias("kind"), "ord", "name", "category", "opt_out")
            .unionByName(trackers.select("site_id", F.lit(1).alias("kind"), "ord", "name", "category", "opt_out")))
    once = both.groupBy("site_id", F.lower("name").alias("name_lc")).agg(
        F.min_by(F.struct("name", "category", "opt_out", "kind", "ord"), F.struct("kind", "ord")).alias("p"))
    w = W.partitionBy("site_id").orderBy("p.kind", "p.ord", "name_lc")
    return once.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= limit).select(
        "site_id", "pos", "name_lc", "p.name", "p.category", "p.opt_out")


def company_domain(name: str) -> str:
    """Domain under which a company is looked for: a name that holds a dot as it is, else its letters without spaces and commas."""
    return f"if(contains({name}, '.'), trim({name}), concat(regexp_replace({name}, '[ ,]', ''), '.com'))"


def company_pages(companies: DataFrame, registry: DataFrame, discovered: DataFrame) -> DataFrame:
    """Documentation pages of every company (name_lc, each once): those of the registry, or those discovered on its own domain.

    registry: (company_lc, label, url); discovered: (company_domain, label, url). One row per company and label.
    """
    known = dims.small(registry, len(dims.company_page_rows()))
    listed = companies.join(known, companies["name_lc"] == known["company_lc"]).select(
        "name_lc", "label", "url", F.lit("registry").alias("origin"))
    unknown = companies.join(dims.small(registry.select(F.col("company_lc").alias("name_lc")).distinct(),
                                        len(dims.company_page_rows())), "name_lc", "left_anti")
    found = unknown.withColumn("company_domain", F.expr(company_domain("name_lc"))).join(discovered, "company_domain").select(
        "name_lc", "label", "url", F.lit("discovered").alias("origin"))
    return listed.unionByName(found)


def with_pages(parties: DataFrame, registry: DataFrame, discovered: DataFrame) -> DataFrame:
    """Documentation pages per party, found once per company and attached by name."""
    pages = company_pages(parties.select("name_lc").distinct(), registry, discovered)
    listed = pages.groupBy("name_lc").agg(F.collect_list(F.struct("label", "url", "origin")).alias("ps"))
    return attach(parties, listed, "name_lc").select("site_id", "pos", "name", F.explode("ps").alias("p")).select("site_id", "pos", "name", "p.*")


PARTY_ANSWER = ("struct<summary:string,data_collected:array<string>,data_shared_with:array<string>,certifications:array<string>,"
                "gdpr_role:string,data_location:array<string>,retention_claimed:string,risk_flags:array<string>,"
                "positive_signals:array<string>,trust_score_ai:int>")
PARTY_LISTS = ("data_collected", "data_shared_with", "certifications", "data_location", "risk_flags", "positive_signals")


def research(companies: DataFrame, registry: DataFrame, discovered: DataFrame, fetches: DataFrame, answers: DataFrame,
             chars: int = R.DOSSIER_CHARS) -> DataFrame:
    """One dossier per company (name_lc), whatever the number of sites that name it.

    fetches: (url, at, text), of which the newest of an address counts; answers: (name_lc, at, response), of which the newest of a company
    counts. `context` is the prompt: the first `chars` characters (the cut is the feature) of each page read. Only these starts are
    exchanged, the newest one per address and task. A company without a readable page, without an answer, or with one that is not a
    JSON object gets the defaults of each case; fields that an answer lacks are empty.
    """
    rank = F.expr(T.lookup({k: i for i, k in enumerate(R.PAGE_LABELS)}, "label"))
    pages = company_pages(companies.select("name_lc").where("name_lc IS NOT NULL").distinct(), registry, discovered)
    starts = fetches.groupBy("url").agg(F.max_by(F.substring("text", 1, chars), "at").alias("start"))
    read = pages.where(F.col("label").isin(*R.PAGE_LABELS[:R.PAGES_PER_PARTY])).join(starts, "url", "left").groupBy("name_lc").agg(
        F.sort_array(F.collect_list(F.struct(rank.alias("rank"), "label", "url", "start"))).alias("ps"))
    extra = pages.where(F.col("label").isin("certifications", "opt_out")).groupBy("name_lc").agg(
        F.max(F.when(F.col("label") == "certifications", F.col("url"))).alias("listed_certifications"),
        F.max(F.when(F.col("label") == "opt_out", F.col("url"))).alias("listed_opt_out"))
    newest = answers.groupBy("name_lc").agg(F.max_by("response", "at").alias("response"))
    found = companies.select("name_lc").where("name_lc IS NOT NULL").distinct().join(read, "name_lc", "left").join(
        extra, "name_lc", "left").join(newest, "name_lc", "left")

    some = "filter(ps, p -> p.start <> '')"
    context = f"array_join(transform({some}, p -> concat('=== ', upper(p.label), ' PAGE (', p.url, ') ===\\n', p.start)), '\\n\\n')"
    found = found.select("name_lc", "listed_certifications", "listed_opt_out", "response", F.expr("coalesce(size(ps), 0)").alias("pages_found"),
                         F.expr(f"coalesce(size({some}), 0)").alias("pages_read"), F.expr(f"coalesce({context}, '')").alias("context"),
                         F.expr(json_object("response", PARTY_ANSWER)).alias("a"))
    case = (F.when(F.col("pages_read") == 0, "unread").when(F.coalesce("response", F.lit("")) == "", "silent")
            .when(F.col("a").isNull(), "unclear").otherwise("answered"))

    def field(name: str):
        out = F.coalesce(F.col(f"a.{name}"), F.lit(A.PARTY["answered"][name]))
        for k in ("unread", "silent", "unclear"):
            out = F.when(F.col("research") == k, F.lit(A.PARTY[k][name])).otherwise(out)
        return out

    def items(name: str):
        none = F.array().cast("array<string>")
        out = F.when(F.col("research") == "answered", F.coalesce(F.col(f"a.{name}"), none)).otherwise(none)
        if name == "risk_flags":
            out = F.when(F.col("research") == "unread", F.array(F.lit(A.PARTY_UNREAD_FLAG))).otherwise(out)
        if name == "certifications":
            out = F.concat(out, F.when(F.col("listed_certifications") != "", F.array("listed_certifications")).otherwise(none))
        return out.alias(name)

    summary = F.when(F.col("research") == "unclear", F.substring("response", 1, A.PARTY_SUMMARY_CHARS)).otherwise(field("summary"))
    return found.withColumn("research", case).select(
        "name_lc", "research", "pages_found", "pages_read", "context", "listed_opt_out", summary.alias("answer_summary"),
        *[field(n).alias(n) for n in ("gdpr_role", "retention_claimed", "trust_score_ai")], *[items(n) for n in PARTY_LISTS])


def dossiers(parties: DataFrame, researched: DataFrame) -> DataFrame:
    """One row per party of a site: its company's dossier, without the prompt, attached by name.

    A name that a third of all sites share is split over many tasks; texts stay with the company.
    """
    out = attach(parties, researched.drop("context"), "name_lc")
    return out.select(
        "site_id", "pos", "name", "category", "research", "pages_found", "pages_read", F.coalesce("listed_opt_out", "opt_out").alias("opt_out_url"),
        F.when(F.col("research") == "unread", F.concat(F.lit("No pages could be fetched for "), "name", F.lit("."))).otherwise(
            F.col("answer_summary")).alias("summary"), "gdpr_role", "retention_claimed", "trust_score_ai", *PARTY_LISTS)


def ecosystem(found: DataFrame) -> DataFrame:
    """Numbers over the parties of a site."""
    return found.groupBy("site_id").agg(
        F.count("*").alias("parties"), F.round(F.avg("trust_score_ai")).cast("int").alias("mean_trust"),
        F.count_if(F.size("risk_flags") > 0).alias("with_risk_flags"),
        F.min_by("name", F.struct("trust_score_ai", "pos")).alias("highest_risk_party"))


# Advice.
SAR = "Submit Subject Access Requests (SARs) to data controllers to see what they hold about you."
BLOCK = "Use Firefox with uBlock Origin to block fingerprinting scripts."
MANY = ("Consider using a privacy-focused browser extension (uBlock Origin, Privacy Badger) to limit tracking.")
REVIEW = "Review and adjust your consent preferences in the site's cookie settings."
MAX_ACTIONS = 8


def actions(found: DataFrame) -> DataFrame:
    """Recommended actions per site, in order, each once, at most eight.

    Every party gives at most one action and a site has at most twelve parties, so the list of a site is small.
    """
    gathered = found.groupBy("site_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("opt_out_url").isNotNull(), F.struct("pos", F.concat(
            F.lit("Opt out of "), "name", F.lit(" tracking: "), "opt_out_url").alias("a"))))).alias("outs"),
        F.max((F.col("gdpr_role") == "Controller").cast("int")).alias("controller"),
        F.max(F.contains(F.lower(F.array_join("risk_flags", " ")), F.lit("fingerprint")).cast("int")).alias("fingerprint"),
        F.count("*").alias("n"))
    every = (f"slice(array_distinct(concat(transform(outs, o -> o.a), array_compact(array("
             f"if(controller = 1, {T.quote(SAR)}, NULL), if(fingerprint = 1, {T.quote(BLOCK)}, NULL), "
             f"if(n > 5, {T.quote(MANY)}, NULL), {T.quote(REVIEW)})))), 1, {MAX_ACTIONS})")
    return gathered.select("site_id", F.posexplode(F.expr(every)).alias("pos", "action"))
