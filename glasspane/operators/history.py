"""Versions of a policy over time, their changes, and the history of results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from .ordered import previous

def versions(fetches: DataFrame) -> DataFrame:
    """First fetch of every distinct text of a domain; the newest of them is current.

    The hash replaces the text in the grouping, so a hot domain spreads over all partitions; the text is carried by
    the one fetch that opens a version.
    """
    hashed = fetches.withColumn("content_hash", F.sha2("text", 256))
    opened = hashed.groupBy("domain", "content_hash").agg(F.min(F.struct("fetched_at", "fetch_id")).alias("first"))
    first = opened.select("domain", "content_hash", "first.fetched_at", "first.fetch_id")
    newest = first.groupBy("domain").agg(F.max(F.struct("fetched_at", "fetch_id")).alias("m")).select(
        F.col("m.fetch_id").alias("_current"))
    return first.join(newest, F.col("fetch_id") == F.col("_current"), "left").select(
        F.col("fetch_id").alias("version_id"), "domain", "content_hash", "fetched_at",
        F.col("_current").isNotNull().alias("is_current"))


def with_text(found: DataFrame, fetches: DataFrame) -> DataFrame:
    """Versions with address, text and number of words."""
    texts = fetches.select(F.col("fetch_id").alias("version_id"), "policy_url", F.col("text").alias("raw_text"),
                           T.word_count(F.col("text")).alias("word_count"))
    return found.join(texts, "version_id")


def pairs(found: DataFrame) -> DataFrame:
    """Neighbouring versions of a domain: old and new version id. Texts stay out of it."""
    slim = found.select("domain", "version_id", "fetched_at")
    return previous(slim, "domain", "fetched_at", "version_id", "version_id", "old_version_id").where(
        F.col("old_version_id").isNotNull()).select(
        "domain", "old_version_id", F.col("version_id").alias("new_version_id"), F.col("fetched_at").alias("detected_at"))


def paired_texts(found_pairs: DataFrame, fetches: DataFrame) -> DataFrame:
    """Pairs with both texts: every text is looked up once, for the pairs in which it is old or new."""
    sides = F.explode(F.array(F.struct(F.col("old_version_id").alias("fetch_id"), F.lit(True).alias("old")),
                              F.struct(F.col("new_version_id").alias("fetch_id"), F.lit(False).alias("old")))).alias("s")
    met = found_pairs.select("*", sides).join(fetches.select(F.col("fetch_id").alias("_id"), "text"), F.col("s.fetch_id") == F.col("_id"))
    return met.groupBy(*found_pairs.columns).agg(F.max(F.when(F.col("s.old"), F.col("text"))).alias("old_text"),
                                                 F.max(F.when(~F.col("s.old"), F.col("text"))).alias("new_text"))


def line_changes(fetches: DataFrame, found_pairs: DataFrame) -> DataFrame:
    """Lines added and removed between neighbours, as multisets, and the share of lines kept (2M / T).

    Every version is split into lines once; both versions of a pair meet by (pair, hash of the line), so no text is
    joined to a text, and a hot line of one pair is already summed before the shuffle.
    """
    lines = fetches.select("fetch_id", F.explode(F.split("text", "\n")).alias("line"))
    counts = lines.groupBy("fetch_id", F.xxhash64("line", F.length("line")).alias("h"), F.crc32("line").alias("c")).agg(
        F.count("*").alias("n"))
    old = found_pairs.select("domain", F.col("new_version_id").alias("pair_id"), F.col("old_version_id").alias("fetch_id"),
                             F.lit(1).alias("is_old"))
    new = found_pairs.select("domain", F.col("new_version_id").alias("pair_id"), F.col("new_version_id").alias("fetch_id"),
                             F.lit(0).alias("is_old"))
    both = old.unionByName(new).join(counts, "fetch_id")
    per_line = both.groupBy("domain", "pair_id", "h", "c").agg(
        F.sum(F.when(F.col("is_old") == 1, F.col("n")).otherwise(0)).alias("a"),
        F.sum(F.when(F.col("is_old") == 0, F.col("n")).otherwise(0)).alias("b"))
    return per_line.groupBy("domain", "pair_id").agg(
        F.sum(F.greatest(F.col("b") - F.col("a"), F.lit(0))).alias("added_lines"),
        F.sum(F.greatest(F.col("a") - F.col("b"), F.lit(0))).alias("removed_lines"),
        F.round(F.sum(F.least("a", "b")) * 2.0 / F.sum(F.col("a") + F.col("b")), 4).alias("similarity_ratio"))


def latest(results: DataFrame) -> DataFrame:
    """Newest result of each domain."""
    cols = [c for c in results.columns if c != "domain"]
    return results.groupBy("domain").agg(
        F.max_by(F.struct(*cols), F.struct("analyzed_at", "result_id")).alias("r")).select("domain", "r.*")


def _newest(results: DataFrame, n: int, at: str = "analyzed_at", key: str = "result_id") -> DataFrame:
    w = W.partitionBy("domain").orderBy(F.desc(at), F.desc(key))
    return results.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= n)


def history(results: DataFrame, n: int = 10) -> DataFrame:
    """Newest results of each domain. The rank limit is applied before the shuffle as well."""
    return _newest(results, n)


def change_history(changes: DataFrame, n: int = 10) -> DataFrame:
    return _newest(changes, n, "detected_at", "new_version_id")


def compare(results: DataFrame) -> DataFrame:
    """Newest two results side by side; a domain with one result has no older one and no delta."""
    two = _newest(results, 2)
    out = two.groupBy("domain").agg(
        F.max(F.when(F.col("nth") == 1, F.col("overall_score"))).alias("newer_score"),
        F.max(F.when(F.col("nth") == 2, F.col("overall_score"))).alias("older_score"),
        F.max(F.when(F.col("nth") == 1, F.col("grade"))).alias("newer_grade"), F.max(F.when(F.col("nth") == 2, F.col("grade"))).alias("older_grade"),
        F.max(F.when(F.col("nth") == 1, F.col("analyzed_at"))).alias("newer_at"),
        F.max(F.when(F.col("nth") == 2, F.col("analyzed_at"))).alias("older_at"), F.count("*").alias("n"))
    return out.select("domain", "newer_at", "older_at", "newer_score", "older_score", "newer_grade", "older_grade",
                      (F.col("newer_score") - F.col("older_score")).alias("score_delta"),
                      F.when(F.col("n") < 2, F.lit("Not enough history for comparison")).alias("message"))


def recent(results: DataFrame, n: int = 20) -> DataFrame:
    """Newest results over all domains."""
    return results.orderBy(F.desc("analyzed_at"), F.desc("result_id")).limit(n)


def trend(results: DataFrame) -> DataFrame:
    """Change of the score against the result before. The results are read twice: store them where they are costly (store.kept)."""
    before = previous(results, "domain", "analyzed_at", "result_id", "overall_score", "_before")
    return before.withColumn("score_delta", F.col("overall_score") - F.col("_before")).drop("_before")


def needs_refresh(requests: DataFrame, results: DataFrame) -> DataFrame:
    """Requests that must be computed: forced ones, and those of a domain without a result."""
    forced = requests.where("force_refresh")
    rest = requests.where("NOT force_refresh").join(results.select("domain").distinct(), "domain", "left_anti")
    return forced.unionByName(rest.select(*requests.columns))


def new_versions(batch: DataFrame, known: DataFrame) -> DataFrame:
    """Texts of a batch that no earlier batch has seen: one row per new (domain, hash). Only texts that are new are moved."""
    hashed = batch.select("domain", F.sha2("text", 256).alias("content_hash"), "fetched_at", "fetch_id")
    first = hashed.groupBy("domain", "content_hash").agg(F.min(F.struct("fetched_at", "fetch_id")).alias("f"))
    fresh = first.select("domain", "content_hash", "f.*").join(known.select("domain", "content_hash"), ["domain", "content_hash"], "left_anti")
    return fresh.join(batch.select("fetch_id", "policy_url", F.col("text").alias("raw_text")), "fetch_id").select(
        "domain", "content_hash", "fetched_at", "fetch_id", "policy_url", "raw_text")
