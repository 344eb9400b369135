"""Numbers that labels, panels and fleet reports show."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T

# Alerts of a site.
ALERTS = (
    ("dark_patterns.count > 0", "concat(dark_patterns.count, ' dark pattern(s) detected in privacy policy')"),
    ("coalesce(tracking.fingerprinting_detected, false)",
     "'Browser fingerprinting detected – tracks you without cookies'"),
    ("coalesce(tracking.session_recording_detected, false)",
     "'Session recording active – captures all mouse/keyboard activity'"),
    ("sharing.data_sold", "'Personal data is sold to third parties (CCPA opt-out available)'"),
    ("NOT policy_found", "'No privacy policy found – legally required under GDPR & CCPA'"),
    ("rights.gdpr_score < 50", "concat('Only ', rights.gdpr_score, '% of GDPR rights covered in policy')"),
)


def alerts(facts: DataFrame) -> DataFrame:
    """One row per alert of a site, in fixed order. Policy alerts only speak of a policy that was read."""
    read = "state = 'full' AND "
    cases = ", ".join(f"if({(read if 'dark' in c or 'sharing' in c or 'rights' in c else '')}{c}, "
                      f"named_struct('ord', {i}, 'alert', {text}), NULL)" for i, (c, text) in enumerate(ALERTS))
    found = facts.withColumn("as", F.expr(f"array_compact(array({cases}))"))
    return T.explode_rows(found.select("doc_id", "as"), "`as`", "a").select("doc_id", "a.*")


def top_categories(found: DataFrame, n: int = 6) -> DataFrame:
    """Most frequent tracker categories of each page."""
    counts = found.groupBy("page_id", "category").agg(F.count("*").alias("n"))
    w = W.partitionBy("page_id").orderBy(F.desc("n"), "category")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


GRADES = "ABCDF"


def fleet(scored: DataFrame, *keys: str) -> DataFrame:
    """Mean score and share of every grade at every level of a hierarchy of keys (our extension)."""
    def share(*grades: str):
        return F.round(F.avg(F.col("grade").isin(*grades).cast("double")), 4)

    return scored.rollup(*keys).agg(
        F.count("*").alias("sites"), F.round(F.avg("overall"), 4).alias("mean_score"), share("A", "B").alias("good_share"),
        *[share(g).alias(f"share_{g.lower()}") for g in GRADES])


def fleet_common(scored: DataFrame, *keys: str, n: int = 3) -> DataFrame:
    """The n most common data categories and dark patterns at every level of a hierarchy of keys (our extension).

    `level` counts the keys that are set, so that a key that is null differs from a total. Sites are counted once per name at the lowest level,
    with partial sums before the only shuffle of their size; higher levels add up these counts. Names come from rule tables, so the names of
    one level and group that are ranked together are few. Ties go to the smaller name.
    """
    def names(kind: str, items: str) -> str:
        return f"transform(array_distinct(transform({items}, x -> x.name)), x -> struct('{kind}' AS kind, x AS name))"

    read = scored.where("state = 'full'")
    found = F.expr(f"concat(coalesce({names('category', 'data_types')}, array()), coalesce({names('dark_pattern', 'dark_patterns.detected')}, array()))")
    rows = T.explode_rows(read.select(*keys, found.alias("fs")), "fs", "f").select(*keys, "f.kind", "f.name")
    lowest = rows.groupBy(*keys, "kind", "name").agg(F.count("*").alias("n"))
    levels = [[*keys[:i], "kind", "name"] for i in range(len(keys) + 1)]
    depth = sum((1 - F.grouping(k).cast("int") for k in keys), F.lit(0))
    sums = lowest.groupingSets(levels, *keys, "kind", "name").agg(depth.alias("level"), F.sum("n").alias("sites"))
    w = W.partitionBy("level", *keys, "kind").orderBy(F.desc("sites"), "name")
    return sums.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("level", *keys, "kind", "rank", "name", "sites")


def reach(found: DataFrame) -> DataFrame:
    """Number of distinct pages per tracker name (our extension).

    Names are made distinct per page before the count, so a tracker on every page costs one row per page.
    """
    return found.select("name", "page_id").distinct().groupBy("name").agg(F.count("*").alias("pages"))


def pairs_seen(found: DataFrame) -> DataFrame:
    """How many pages carry both trackers of a pair (our extension).

    The distinct names of a page are gathered once; a page names at most the known trackers, so its pairs are bounded
    by the tracker table and no page joins another. Counts are summed before the shuffle.
    """
    names = found.where(~F.startswith("name", F.lit("Unknown pixel"))).groupBy("page_id").agg(
        F.sort_array(F.collect_set("name")).alias("ns"))
    both = names.select(F.explode(F.expr(
        "flatten(transform(ns, (a, i) -> transform(slice(ns, i + 2, size(ns)), b -> struct(a AS a, b AS b))))"))
        .alias("p"))
    return both.groupBy("p.a", "p.b").agg(F.count("*").alias("pages")).select(
        F.col("a").alias("tracker_a"), F.col("b").alias("tracker_b"), "pages")


def search(parties: DataFrame, term: str = "", by: str = "trust") -> DataFrame:
    """Parties whose name or category holds a term, in order of trust or name."""
    low = term.lower()
    hits = parties.where(F.contains(F.lower("name"), F.lit(low)) | F.contains(F.lower("category"), F.lit(low)))
    return hits.orderBy(*(["trust_score", "name"] if by == "trust" else ["name"]), "doc_id")


def least_trusted(parties: DataFrame, n: int) -> DataFrame:
    """The n recipients of a document that deserve the least trust."""
    w = W.partitionBy("doc_id").orderBy("trust_score", "name")
    return parties.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
