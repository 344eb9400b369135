"""Toxic texts by two Kneser-Ney models, one of toxic and one of ordinary texts.

An expression is a word, seen as a chain: its first four bytes, its first six given these, the whole word given these. Each
class has its own discounted counts of every step of the chain; what the discount frees goes to backoff counts that
both classes share: the number of different words that begin so. A rare or new form thus gets its evidence from its
stem, and a form that neither class knows gets the same probability from both.

A text is judged by its log-likelihood ratio per word, over the whole text and over its most toxic runs of 1, 4 and 16
words, so that a long text hides nothing. A logistic unit turns these into a probability.

Models are fitted on at most `sample_rows` labelled ids of each class that are not held out (a fifth of them fits the
logistic unit, the others the counts). Counting is a Spark aggregation; of each step, the `most` most frequent entries that
occur `seen` times are kept, so what is sent to the tasks is bounded. Scoring is one pass over whole texts.

Null and empty texts have no evidence and get the score of a text of neutral words. Ids may be null (scored, never learned
from) or repeated. Without labels of both classes, every text gets the share of label 1, or 0.5 where nothing is labelled.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

STEPS = (4, 6, None)  # bytes of a word that each step of the chain sees
DISCOUNT, RUNS = 0.75, (1, 4, 16)
_EDGE = np.zeros(256, bool)
_EDGE[[b for b in range(33, 127) if not chr(b).isalnum()]] = True


def chains(bodies: list[bytes]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Hash of each step for every word without the punctuation around it, the text of each word, words per text."""
    words = C.Words(bodies)
    place, inner = np.arange(len(words.bytes)), ~_EDGE[words.bytes]
    end = np.maximum.accumulate(np.where(inner, place, -1))[words.end - 1] + 1  # behind the last byte that is no punctuation
    start = np.minimum.accumulate(np.where(inner, place, len(place))[::-1])[::-1][words.start]
    solid = end > start
    words.start, words.end, words.doc = start[solid], end[solid], words.doc[solid]
    steps = [words.hashes(n) ^ np.uint64(i) for i, n in enumerate(STEPS)]
    return steps, words.doc, np.bincount(words.doc, minlength=len(bodies))


def _ratio(seen0, seen1, n0, n1, types0, types1, share):
    """Log of the toxic over the ordinary probability of an entry whose parent has n, with `types` different entries, per class."""
    def p(seen, n, types):
        return np.where(n > 0, (np.maximum(seen - DISCOUNT, 0) + DISCOUNT * types * share) / np.maximum(n, 1), share)
    return np.log(p(seen1, n1, types1)) - np.log(p(seen0, n0, types0))


@dataclass
class Model:
    keys: list[np.ndarray]  # by step: sorted hashes
    ratio: list[np.ndarray]  # log ratio of the entry
    new: list[np.ndarray]  # log ratio of an entry that is not known, by its parent; of the first step: one number
    weight: np.ndarray
    shift: float

    def ratios(self, steps: list[np.ndarray]) -> np.ndarray:
        """Log ratio of every word."""
        out = np.zeros(len(steps[0]))
        parent = np.zeros(len(out), np.int64)
        for keys, ratio, new, hashed in zip(self.keys, self.ratio, self.new, steps):
            if not len(keys):
                break
            at = np.minimum(np.searchsorted(keys, hashed), len(keys) - 1)
            known = keys[at] == hashed
            out += np.where(known, ratio[at], np.where(parent >= 0, new[np.maximum(parent, 0)], 0))
            parent = np.where(known, at, -1)
        return out

    def features(self, bodies: list[bytes]) -> np.ndarray:
        """Mean log ratio of the words of each text, and the largest mean over runs of words."""
        steps, doc, count = chains(bodies)
        ratio, n = self.ratios(steps), len(bodies)
        sums = np.concatenate([[0], np.cumsum(ratio)])
        first = np.concatenate([[0], np.cumsum(count)])
        some = count > 0
        out = np.zeros((n, 1 + len(RUNS)))
        out[some, 0] = (sums[first[1:]] - sums[first[:-1]])[some] / count[some]
        for j, run in enumerate(RUNS):
            stop = np.minimum(np.arange(len(doc)) + run, first[1:][doc]) if len(doc) else np.zeros(0, np.int64)
            if len(doc):
                out[some, 1 + j] = np.maximum.reduceat((sums[stop] - sums[:-1]) / run, first[:-1][some])
        return out

    def scores(self, bodies: list[bytes]) -> np.ndarray:
        z = np.clip(self.features(bodies) @ self.weight + self.shift, -40, 40)
        return 1 / (1 + np.exp(-z))


_COUNTED = pa.schema([("word", pa.int64()), ("six", pa.int64()), ("four", pa.int64()), ("n0", pa.int64()), ("n1", pa.int64())])
_FEATURES = pa.schema([("label", pa.int32()), ("x", pa.list_(pa.float64()))])


def _counted(bodies: list[bytes], rows: pa.RecordBatch) -> dict:
    (four, six, word), doc, _ = chains(bodies)
    toxic = np.asarray(rows["label"])[doc]
    _, first, inverse = np.unique(word, return_index=True, return_inverse=True)
    n1 = np.bincount(inverse, toxic, minlength=len(first)).astype(np.int64)
    return {"word": word[first].view(np.int64), "six": six[first].view(np.int64), "four": four[first].view(np.int64),
            "n0": np.bincount(inverse, minlength=len(first)) - n1, "n1": n1}


def _models(counted: DataFrame, seen: int, most: int) -> Model:
    """Ratios of the entries of each step. counted: word, six, four, n0, n1 of every word."""
    sums = [F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.count("*").alias("words")]
    types = [F.sum((F.col("n0") > 0).cast("long")).alias("t0"), F.sum((F.col("n1") > 0).cast("long")).alias("t1")]
    word = counted.select(F.col("word").alias("key"), F.col("six").alias("parent"), "n0", "n1", F.lit(1).cast("long").alias("words"))
    six = counted.groupBy(F.col("six").alias("key")).agg(F.first("four").alias("parent"), *sums, *types)
    four = six.groupBy(F.col("parent").alias("key")).agg(*sums[:2], F.sum("words").alias("words"), *types)
    four = four.withColumn("parent", F.lit(0).cast("long"))
    total = four.agg(*sums[:2], F.sum("words").alias("words"), *types).first()
    up = {k: np.array([float(total[k] or 0)]) for k in ("n0", "n1", "words", "t0", "t1")}
    names, model = np.zeros(1, np.int64), Model([], [], [], np.zeros(1 + len(RUNS)), 0.0)
    for frame in (four, six, word):
        kept = frame.where(F.col("n0") + F.col("n1") >= seen).orderBy(-(F.col("n0") + F.col("n1")), "key").limit(most).toArrow()
        got = {k: kept[k].to_numpy() for k in kept.column_names}
        order = np.argsort(got["key"].view(np.uint64))
        got = {k: v[order] for k, v in got.items()}
        at = np.minimum(np.searchsorted(names.view(np.uint64), got["parent"].view(np.uint64)), len(names) - 1)
        has = names[at] == got["parent"]
        got, at = {k: v[has] for k, v in got.items()}, at[has]
        model.keys.append(got["key"].view(np.uint64).copy())
        model.ratio.append(_ratio(got["n0"], got["n1"], up["n0"][at], up["n1"][at], up["t0"][at], up["t1"][at], got["words"] / up["words"][at]))
        model.new.append(_ratio(0, 0, up["n0"], up["n1"], up["t0"], up["t1"], 1 / (1 + up["words"])))
        names, up = got["key"], {k: got[k].astype(float) if k in got else None for k in ("n0", "n1", "words", "t0", "t1")}
    return model


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, float]:
    """Newton's method with a slight pull to small weights."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    ridge = np.diag([1e-2 * len(x) ** 0.5] * (len(w) - 1) + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (p - y) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1] / scale, float(w[-1] - (w[:-1] * mean / scale).sum())


def train(docs: DataFrame, labels: DataFrame, held_out: Column, sample_rows: int = 20000, seen: int = 2, most: int = 1 << 18) -> Model:
    """The models fitted on labelled rows that are not held out."""
    picked, count = C.sample(docs, labels, "toxic", held_out, sample_rows)
    if not count.get(0) or not count.get(1):
        prior = 40.0 * (2 * bool(count.get(1)) - 1) if count else 0.0
        return Model([], [], [], np.zeros(1 + len(RUNS)), prior)
    rows = C.durable(picked.select("doc_id", F.col("text").cast("binary").alias("body"), "label"))
    tuning = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(5)) == 0
    counted = rows.where(~tuning).mapInArrow(C.by_block(_counted, _COUNTED), "word long, six long, four long, n0 long, n1 long")
    model = _models(C.durable(counted.groupBy("word").agg(F.first("six").alias("six"), F.first("four").alias("four"),
                                                          F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))), seen, most)

    def work(bodies, batch):
        x = model.features(bodies)
        return {"label": batch["label"], "x": pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), x.shape[1]).cast(pa.list_(pa.float64()))}
    told = rows.where(tuning).mapInArrow(C.by_block(work, _FEATURES), "label int, x array<double>").toArrow()
    y = told["label"].to_numpy().astype(float)
    if 0 < y.sum() < len(y):
        model.weight, model.shift = _logistic(np.array(told["x"].to_pylist()), y)
        model.shift += np.log(count[1] / count[0]) - np.log(y.mean() / (1 - y.mean()))
    return model


_SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64())])


def score(docs: DataFrame, model: Model, held_out: Column) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: more likely toxic), predicted (1 if the score is 0.5 or more) of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(bodies, rows):
        return {"doc_id": rows["doc_id"], "held_out": rows["held_out"], "score": shared.value.scores(bodies)}
    rows = C.texts(docs, held_out.alias("held_out")).withColumn("doc_id", F.col("doc_id").cast("long"))
    out = rows.mapInArrow(C.by_block(work, _SCORED), "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
