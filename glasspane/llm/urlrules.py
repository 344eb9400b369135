"""Addresses allowed or blocked by written rules and by mined ones.

Written rules are hosts with a path; the longest one that fits decides. Addresses that one decides are the labels from which
Spark's FP-growth mines combinations of tokens: parts of the host, words in them, path segments, names and values of the query,
the fragment. Every different labelled address counts once, so copies do not bend the support. Of the rules with a label as
consequent those stay that reach the confidence and have no shorter rule of the same label that is as sure. Addresses
that no written rule decides get the label of the surest mined rule they satisfy, else `otherwise`.

Mined rules stand in an inverted index: each under its rarest token, which an address must hold before the rest is compared. Up to
`most_rules` of them go along with the pages as a literal, so pages are judged where they lie; where more come out, the rules stay a
table, and the different addresses meet them by that token, with the same result. For mining alone, an address shows its `widest` tokens that tell most about the
label, as the number of combinations doubles with every token; matching always looks at all tokens.

Null addresses and those without "://" have an empty host and path and no tokens. Ids may be null or repeated, every row gives
one row. Without labels nothing is mined.
"""

from __future__ import annotations

import json

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_RULE = "array<struct<confidence: double, support: double, size: int, verdict: string, need: array<string>>>"


def _rest(url: Column) -> Column:
    """What stands behind the first "://"."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"\A[^/?#]*", 0), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"\A[^/?#]*([^?#]*)", 1)


def written(rules: list[tuple[str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null where none does. rules: verdict and rule, like ("block", "net/")."""
    rule = verdict = F.lit(None).cast("string")
    for say, text in sorted(rules, key=lambda x: len(x[1])):
        at, start = text.split("/", 1)
        fits = ((host == at) | F.endswith(host, F.lit("." + at))) & F.startswith(path, F.lit("/" + start))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, say).otherwise(verdict)
    return rule, verdict


def tokens(url: Column) -> Column:
    """Different tokens of an address; numbers are one token."""
    def named(kind: str, items: Column) -> Column:
        return F.transform(items, lambda x: F.concat(F.lit(kind + ":"), F.when(x.rlike(r"\A[0-9]+\z"), F.lit("#")).otherwise(x)))
    labels = F.split(host(url), r"\.")
    words = F.flatten(F.transform(F.filter(labels, lambda x: F.contains(x, F.lit("-"))), lambda x: F.split(x, "-")))
    rest = _rest(url)
    query = F.split(F.regexp_extract(rest, r"\A[^?#]*\?([^#]*)", 1), "&")
    pieces = [("host", labels), ("word", words), ("path", F.split(path(url), "/")), ("key", F.transform(query, lambda x: F.substring_index(x, "=", 1))),
              ("value", F.transform(F.filter(query, lambda x: F.contains(x, F.lit("="))), lambda x: F.regexp_extract(x, "=(.*)", 1))),
              ("at", F.array(F.regexp_extract(rest, r"\A[^#]*#(.*)", 1)))]
    return F.array_distinct(F.concat(*[named(k, F.filter(x, lambda y: y != "")) for k, x in pieces]))


def _baskets(labelled: DataFrame, support: float, widest: int) -> DataFrame:
    """items of the different labelled addresses: their most telling tokens and their label."""
    rows = labelled.groupBy("url").agg(F.max("verdict").alias("verdict")).select("verdict", tokens(F.col("url")).alias("tokens"))
    rows = rows.withColumn("row", F.monotonically_increasing_id()).persist()
    total = rows.agg(F.count("*").alias("n"), F.avg((F.col("verdict") == "block").cast("int")).alias("share")).first()
    told = rows.select("row", "verdict", F.explode("tokens").alias("token"))
    tells = (told.groupBy("token").agg(F.count("*").alias("n"), F.avg((F.col("verdict") == "block").cast("int")).alias("p"))
             .where(F.col("n") >= support * total["n"])
             .select("token", (F.abs(F.col("p") - F.lit(total["share"])) * F.sqrt("n")).alias("tells")))
    best = F.slice(F.sort_array(F.collect_list(F.struct("tells", "token")), asc=False), 1, widest)
    baskets = C.durable(told.join(F.broadcast(tells), "token").groupBy("row", "verdict").agg(best.alias("best"))
                        .select(F.concat(F.col("best.token"), F.array(F.concat(F.lit("verdict:"), "verdict"))).alias("items")))
    rows.unpersist()
    return baskets


def _raw(baskets: DataFrame, support: float, confidence: float) -> DataFrame:
    """Rules with a label as consequent: need (sorted), verdict, confidence, support, size."""
    rules = (FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets).associationRules
             .where(F.startswith(F.col("consequent")[0], F.lit("verdict:")) & ~F.exists("antecedent", lambda x: F.startswith(x, F.lit("verdict:")))))
    return rules.select(F.sort_array("antecedent").alias("need"), F.replace(F.col("consequent")[0], F.lit("verdict:"), F.lit("")).alias("verdict"),
                        "confidence", "support", F.size("antecedent").alias("size"))


def _shortest(rows: list) -> list[dict]:
    """The rules that have no shorter rule of the same label that is as sure."""
    out: list[dict] = []
    for r in sorted(rows, key=lambda r: (r["size"], -r["confidence"], r["need"])):
        need = frozenset(r["need"])
        if not any(x["verdict"] == r["verdict"] and x["confidence"] >= r["confidence"] and need > frozenset(x["need"]) for x in out):
            out.append({k: r[k] for k in ("confidence", "support", "size", "verdict", "need")})
    return out


def _shortest_table(rules: DataFrame) -> DataFrame:
    """As _shortest, for any number of rules: each meets the rules that need some of its tokens by these tokens (at most 2 ** widest a rule)."""
    some = F.expr("filter(aggregate(need, array(cast(array() AS array<string>)), (a, t) -> concat(a, transform(a, x -> concat(x, array(t))))), "
                  "x -> size(x) > 0 AND size(x) < size(need))")
    parts = rules.select("need", "verdict", "confidence", F.explode(some).alias("part"))
    shorter = rules.select(F.col("need").alias("part"), "verdict", F.col("confidence").alias("sure"))
    beaten = parts.join(shorter, ["part", "verdict"]).where("sure >= confidence").select("need", "verdict").distinct()
    return rules.join(beaten, ["need", "verdict"], "left_anti")


def mined(labelled: DataFrame, support: float, confidence: float, widest: int, most_rules: int) -> list[dict]:
    """need (tokens), verdict, confidence, support, size of at most `most_rules` rules, for a look at them: the support is doubled until so few come out."""
    baskets = _baskets(labelled, support, widest)
    while True:
        found = _raw(baskets, support, confidence).limit(most_rules + 1).collect()
        if len(found) <= most_rules:
            return _shortest(found)
        support *= 2


def _met(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """url, best: the surest rule whose tokens an address holds, for rules that stay a table. Addresses meet a rule by its rarest token."""
    rules = rules.withColumn("id", F.struct("need", "verdict"))
    each = rules.select("id", "support", F.explode("need").alias("token"))
    common = each.groupBy("token").agg(F.max("support").alias("common"))
    anchor = each.join(common, "token").groupBy("id").agg(F.min(F.struct("common", "token")).alias("a")).select("id", F.col("a.token").alias("token"))
    held = urls.where("url IS NOT NULL").distinct().select("url", tokens(F.col("url")).alias("held"))
    near = held.select("*", F.explode("held").alias("token")).join(rules.join(anchor, "id"), "token")
    return near.where(F.size(F.array_except("need", "held")) == 0).groupBy("url").agg(
        F.max(F.struct("confidence", "support", "size", "verdict", "need")).alias("best"))


def _surest(found: list[dict], held: Column) -> Column:
    """The surest rule whose tokens are all held, by an inverted index from the rarest token of each rule."""
    common = {}
    for r in found:
        for t in r["need"]:
            common[t] = max(common.get(t, 0.0), r["support"])
    index: dict[str, list[dict]] = {}
    for r in found:
        index.setdefault(min(r["need"], key=lambda t: (common[t], t)), []).append(r)
    lookup = F.from_json(F.lit(json.dumps(index)), f"map<string, {_RULE}>")
    near = F.flatten(F.transform(held, lambda t: F.coalesce(F.element_at(lookup, t), F.from_json(F.lit("[]"), _RULE))))
    return F.array_max(F.filter(near, lambda r: F.size(F.array_except(r["need"], held)) == 0))


def judge(pages: DataFrame, rules: list[tuple[str, str]], support: float = 0.005, confidence: float = 0.9, widest: int = 12,
          most_rules: int = 2000, otherwise: str = "allow") -> DataFrame:
    """page_id, host, path, rule (written, else null), verdict, mined (tokens of the mined rule that decides, else null), confidence."""
    base = pages.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    rule, verdict = written(rules, F.col("host"), F.col("path"))
    base = base.withColumns({"rule": rule, "said": verdict})
    labelled = base.where("said IS NOT NULL").select("url", F.col("said").alias("verdict"))
    rules = C.durable(_raw(_baskets(labelled, support, widest), support, confidence))
    found = rules.limit(most_rules + 1).collect()
    free = F.col("said").isNull()
    if len(found) > most_rules:
        met = _met(base.where(free).select("url"), C.durable(_shortest_table(rules))).withColumnRenamed("url", "_url")
        base = base.join(met, free & (F.col("url") == F.col("_url")), "left").drop("_url")
    else:
        found = _shortest(found)
        base = base.withColumn("best", F.when(free, _surest(found, tokens(F.col("url")))) if found else F.lit(None).cast(_RULE[len("array<"):-1]))
    return base.select(
        "page_id", "host", "path", "rule", F.coalesce("said", "best.verdict", F.lit(otherwise)).alias("verdict"),
        F.array_join("best.need", " ").alias("mined"), F.col("best.confidence").alias("confidence"))
