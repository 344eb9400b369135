"""Near-duplicate texts by ProbMinHash on weighted shingles of five words.

* Equal texts fall together by their digest first; from there on only one of them counts, so a group of copies of any size
  costs one row for each copy and one text.
* Signature: every shingle, weighted with 1 + ln(its count), is a Poisson process. Its arrivals go to random registers, and
  each register keeps the shingle that comes first. A text is done as soon as no shingle can come before the latest first
  arrival. Two texts agree in a register with the probability Jaccard similarity of their weighted shingles.
* Banding: 16 bands of 4 registers. Two rounds save work: in each bucket every text is paired with a representative, then with up to
  `heads` of them where its texts are still in different classes. Nothing depends on what these rounds leave out.
* Rest: the texts of all buckets that still hold more than one class are joined exactly. Each shows its prefix, the first
  size - ceil(least * size) + 1 shingles in one common order, frequent ones last; similar texts share a shingle of their prefixes.
  Classes are joined on it first (salted), then their texts, by size and place in the order; texts of one class are never paired.
* Verification: exact Jaccard similarity of the two sets of shingles. Linked texts form classes.

Words are compared in lower case (A-Z). A text of one to four words is one shingle. Null and empty texts and those without a
word are copies of each other. Rows may repeat; ids may be null (a class of such rows only has a null class_id).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from .graph import components, merged

REGISTERS, BANDS = 64, 16
NO_ID = -2**63
_ID = (1 << 44) - 1


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53


def weighted(words: C.Words, width: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles (44 bits), their text and their count, for texts fewer than 2**20."""
    shingle, doc = words.shingles(width)
    both = np.sort((doc.astype(np.uint64) << np.uint64(44)) | (shingle >> np.uint64(20)))
    at = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, np.int64)
    count = np.diff(np.concatenate([at, [len(both)]]))
    return both[at] & np.uint64(_ID), (both[at] >> np.uint64(44)).astype(np.int64), count


def signatures(shingle: np.ndarray, doc: np.ndarray, weight: np.ndarray, n: int, m: int = REGISTERS) -> np.ndarray:
    """n x m shingles that arrive first in each register."""
    time, first = np.full(n * m, np.inf), np.zeros(n * m, np.uint64)
    now, turn = np.zeros(len(shingle)), 0
    while len(shingle):
        turn += 1
        draw = C.mix(shingle + np.uint64(turn * 0x9E3779B97F4A7C15 & (2**64 - 1)))
        now = now - np.log(_uniform(draw)) / weight
        slot = doc * m + (C.mix(draw) % np.uint64(m)).astype(np.int64)
        np.minimum.at(time, slot, now)
        won = time[slot] == now
        first[slot[won]] = shingle[won]
        going = now < time.reshape(n, m).max(1)[doc]
        shingle, doc, weight, now = shingle[going], doc[going], weight[going], now[going]
    return first.reshape(n, m)


def band_keys(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """n x bands hashes; the number of the band is part of the hash."""
    n, m = signature.shape
    rows = signature.reshape(n, bands, m // bands)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), (n, bands)).copy()
    for i in range(rows.shape[2]):
        key = C.mix(key ^ rows[:, :, i])
    return key


def digest(text: Column) -> Column:
    """Digest of a text; all texts without a word have the same."""
    text = F.coalesce(text, F.lit(""))
    return F.unhex(F.md5(F.when(F.btrim(text, F.lit(" \t\n\x0b\x0c\r")) == "", F.lit("")).otherwise(text)))


_SIGNED = pa.schema([("id", pa.int64()), ("key", pa.binary()), ("size", pa.int32()), ("bands", pa.list_(pa.int64()))])


def _sign(bodies: list[bytes], rows: pa.RecordBatch) -> dict:
    shingle, doc, count = weighted(C.Words(bodies))
    size = np.bincount(doc, minlength=len(bodies))
    keys = band_keys(signatures(shingle, doc, 1 + np.log(count), len(bodies))).view(np.int64)
    bands = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS), pa.int32()), pa.array(keys.reshape(-1)),
                                     mask=pa.array(size == 0))
    return {"id": rows["id"], "key": rows["key"], "size": size.astype(np.int32), "bands": bands}


_SETS = pa.schema([("key", pa.binary()), ("shingles", pa.list_(pa.int64()))])


def _sets(bodies: list[bytes], rows: pa.RecordBatch) -> dict:
    shingle, doc = C.Words(bodies).shingles()
    order = np.lexsort((shingle, doc))
    shingle, doc = shingle[order], doc[order]
    new = np.concatenate([[True], (shingle[1:] != shingle[:-1]) | (doc[1:] != doc[:-1])]) if len(doc) else np.zeros(0, bool)
    ends = np.concatenate([[0], np.cumsum(np.bincount(doc[new], minlength=len(bodies)))])
    return {"key": rows["key"], "shingles": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(shingle[new].view(np.int64)))}


def _identified(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), digest(F.col("text")).alias("key"),
                       F.coalesce("text", F.lit("")).cast("binary").alias("body"))


def _candidates(buckets: DataFrame, turn: int, heads: int, least: float) -> DataFrame:
    """Pairs (a, b) of a representative of a bucket and the other texts in it that are as long as similarity needs.

    buckets: band, key, size, root (the class of the text so far), weight (the texts of that class) and degree (links of the text). Texts of other classes are
    paired, and only with representatives of classes at least as large as theirs, so a large class is never paired with a stray text here;
    _rest() pairs those.
    """
    # At first the same text leads in all its buckets, so that classes become stars. Then the texts with most links lead in every
    # second draw, as what has few edits is similar to most of its class. All other draws are made by each bucket for itself.
    draw = [F.xxhash64("key", "band", F.lit(turn * 100 + h)) if turn else F.xxhash64("key") for h in range(heads)]
    hub = [-F.col("degree") if turn == 1 and h % 2 else F.lit(0).cast("long") for h in range(heads)]
    lead = [F.min(F.struct(x.alias("hub"), y.alias("draw"), "key", "size", "root", "weight")) for x, y in zip(hub, draw)]
    drawn = (buckets.groupBy("band").agg(F.array(*lead).alias("heads"), F.min("root").alias("low"), F.max("root").alias("high"))
                      .where("low <> high").select("band", F.explode(F.array_distinct(F.transform("heads", lambda h: h.dropFields("hub", "draw")))).alias("head")))
    paired = buckets.join(drawn, "band").where(
        (F.col("root") != F.col("head.root")) & (F.col("weight") <= F.col("head.weight")) & (F.least("size", "head.size") >= least * F.greatest("size", "head.size")))
    return paired.select(F.least("key", "head.key").alias("a"), F.greatest("key", "head.key").alias("b")).distinct()


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    one, other = (sets.select(F.col("key").alias(k), F.col("shingles").alias(f"of_{k}")) for k in "ab")
    both = F.size(F.array_intersect("of_a", "of_b"))
    either = F.size("of_a") + F.size("of_b") - both
    return pairs.join(one, "a").join(other, "b").where(both >= F.lit(least) * either).select("a", "b")


_PREFIXES = "key binary, root binary, size int, at int, shingle long"


def _prefixes(least: float, frequent: np.ndarray, count: np.ndarray):
    """A function for mapInArrow: the prefix of each text, with places from 0. frequent: shingles in order, count: how frequent they are."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = batch["shingles"]
            size = np.diff(sets.offsets.to_numpy())
            shingle, doc = sets.flatten().to_numpy(), np.repeat(np.arange(len(size)), size)
            rank = np.zeros(len(shingle), np.int64)
            if len(frequent):
                near = np.minimum(np.searchsorted(frequent, shingle), len(frequent) - 1)
                rank = np.where(frequent[near] == shingle, count[near], 0)
            order = np.lexsort((shingle, rank, doc))
            at = np.arange(len(shingle)) - np.repeat(np.cumsum(size) - size, size)
            shown = np.flatnonzero(at <= size[doc] - np.ceil(least * size[doc] - 1e-9))
            of = pa.array(doc[shown])
            yield pa.RecordBatch.from_arrays([batch["key"].take(of), batch["root"].take(of), pa.array(size[doc[shown]], pa.int32()),
                                              pa.array(at[shown], pa.int32()), pa.array(shingle[order][shown], pa.int64())],
                                             names=["key", "root", "size", "at", "shingle"])
    return run


def _rest(apart: DataFrame, sets: DataFrame, least: float, counted: int = 20000, often: int = 8, salted: int = 256) -> DataFrame:
    """Pairs (a, b) that can be as similar as `least`, of all texts of different classes in buckets that hold more than one class.

    apart: band, key, root. The order of shingles is counted in about `counted` texts, where those in `often` texts or more are frequent; any
    order gives the same links, only the number of pairs to verify differs.
    """
    mixed = apart.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("band")
    texts = C.durable(apart.join(mixed, "band", "left_semi").select("key", "root").distinct())
    share = max(1, texts.count() // counted)
    drawn = texts.where(F.pmod(F.xxhash64("key"), F.lit(share)) == 0).join(sets, "key").select(F.explode("shingles").alias("shingle"))
    order = drawn.groupBy("shingle").agg(F.count("*").alias("n")).where(F.col("n") >= often).toArrow().sort_by("shingle")
    shown = texts.join(sets, "key").select("key", "root", "shingles").mapInArrow(
        _prefixes(least, order["shingle"].to_numpy(), order["n"].to_numpy()), _PREFIXES)
    shown = C.durable(shown)
    groups = shown.groupBy("shingle", "root").agg(F.min("size").alias("low"), F.max("size").alias("high"), F.max(F.expr("size - at")).alias("left"))
    shared = groups.groupBy("shingle").agg(F.count("*").alias("classes")).where("classes > 1")
    groups = C.durable(groups.join(shared, "shingle").withColumn("salts", F.ceil(F.col("classes") / salted).cast("int")))
    one = groups.withColumn("salt", F.pmod(F.xxhash64("root"), "salts").cast("int")).alias("one")
    other = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).alias("other")
    # A pair is as similar as `least` if it shares least / (1 + least) of both sizes; from its first common shingle on, it shares no more than either has left.
    ratio = least / (1 + least) - 1e-9
    met = one.join(other, ["shingle", "salt"]).where(
        (F.col("one.root") < F.col("other.root"))
        & (F.col("one.high") >= (least - 1e-9) * F.col("other.low")) & (F.col("other.high") >= (least - 1e-9) * F.col("one.low"))
        & (F.least("one.left", "other.left") >= ratio * (F.col("one.low") + F.col("other.low")))).select(
        "shingle", F.col("one.root").alias("root_a"), F.col("other.root").alias("root_b"))
    for k in "ab":
        side = shown.select("shingle", F.col("root").alias(f"root_{k}"), F.col("key").alias(k), F.col("size").alias(f"size_{k}"), F.expr("size - at").alias(f"left_{k}"))
        met = met.join(side, ["shingle", f"root_{k}"])
    met = met.where((F.least("size_a", "size_b") >= (least - 1e-9) * F.greatest("size_a", "size_b"))
                    & (F.least("left_a", "left_b") >= ratio * (F.col("size_a") + F.col("size_b"))))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def classes(docs: DataFrame, least: float = 0.8, heads: int = 8) -> tuple[DataFrame, DataFrame]:
    """The rows (id, key) and, for each distinct text, key, class_key, first_id (the smallest id of its rows) and copies."""
    rows = C.durable(_identified(docs).mapInArrow(C.by_block(_sign, _SIGNED), "id long, key binary, size int, bands array<long>"))
    distinct = C.durable(rows.groupBy("key").agg(
        F.min(F.when(F.col("id") != NO_ID, F.col("id"))).alias("first_id"), F.min("id").alias("any_id"), F.count("*").alias("copies"),
        F.first("size").alias("size"), F.first("bands").alias("bands")))
    banded = distinct.select("key", "size", F.explode("bands").alias("band"))
    crowded = banded.groupBy("band").count().where("count > 1").select("band")
    buckets = C.durable(banded.join(crowded, "band"))
    wanted = distinct.join(buckets.select("key").distinct(), "key", "left_semi").select("key", F.col("any_id").alias("id"))
    texts = _identified(docs).join(wanted, ["key", "id"], "left_semi").dropDuplicates(["key", "id"])
    sets = C.durable(texts.mapInArrow(C.by_block(_sets, _SETS), "key binary, shingles array<long>"))
    apart = buckets.withColumns({"root": F.col("key"), "weight": F.lit(1).cast("long"), "degree": F.lit(0).cast("long")})
    new = C.durable(_verified(_candidates(apart, 0, 1, least), sets, least))
    root = components(new)
    degree = new.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    known = root.join(root.groupBy("root").agg(F.count("*").alias("weight")), "root").join(degree, "node", "left")
    apart = buckets.join(known.withColumnRenamed("node", "key"), "key", "left").withColumns({
        "root": F.coalesce("root", "key"), "weight": F.coalesce("weight", F.lit(1)), "degree": F.coalesce("degree", F.lit(0))})
    root = merged(root, _verified(_candidates(apart, 1, heads, least), sets, least))
    apart = buckets.select("band", "key").join(root.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    root = merged(root, _verified(_rest(apart, sets, least), sets, least))
    texts = distinct.drop("bands", "any_id", "size")
    return rows, texts.join(root.withColumnRenamed("node", "key"), "key", "left").select(
        "key", F.coalesce("root", "key").alias("class_key"), "first_id", "copies")


def label(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """One row for each row of docs: doc_id, class_id (the smallest id of its class), class_size (rows of the class)."""
    rows, texts = classes(docs, least)
    total = texts.groupBy("class_key").agg(F.min("first_id").alias("class_id"), F.sum("copies").alias("class_size"))
    named = texts.select("key", "class_key").join(total, "class_key").select("key", "class_id", "class_size")
    return rows.select("key", "id").join(named, "key").select(
        F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "class_id", "class_size")


def one_of_each(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """The rows of docs with all their columns, one for each class: the one with the smallest id."""
    _, texts = classes(docs, least)
    chosen = (texts.groupBy("class_key")
              .agg(F.min(F.struct(F.coalesce("first_id", F.lit(2**63 - 1)).alias("by"), "first_id", "key")).alias("x"))
              .select(F.col("x.key").alias("_kept_key"), F.coalesce("x.first_id", F.lit(NO_ID)).alias("_kept_id")))
    known = docs.withColumns({"_kept_key": digest(F.col("text")), "_kept_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))})
    return (known.join(chosen, ["_kept_key", "_kept_id"], "left_semi").dropDuplicates(["_kept_key", "_kept_id"])
            .drop("_kept_key", "_kept_id"))
