"""Language model: a hidden Markov model over words, trained by Baum-Welch, beside a smoothed count model.

Tokens are words in lower case (A-Z) and one end per text. Counts of all training tokens are aggregated by Spark. The
`symbols` - 2 most frequent words and the end are symbols of the model; any other word is the symbol "rare", times the word's share of
the rare ones, (c + 0.1) / Z, where Z sums this over all rare words and one that never occurred.

* Training: every training text is used in every round. Each task runs forward and backward over its texts and gives expected
  counts of starts, transitions and emissions; Spark sums them by index, and one round's sums are the next model. For
  training only, texts are cut into pieces of PIECE tokens, later pieces starting from the stationary distribution.
* Scoring: the scaled forward recursion over each whole text, many texts side by side, gives its exact likelihood.
* Counts of words beyond the TOP most frequent ones (or a few less, so that equal counts stay together) never leave the cluster: texts meet them in a join by word, and only the
  words of a text that are not among the TOP, once each, move.

Null and empty texts consist of the end alone. Ids may be null (they count as the empty text for the fold) or repeated; every
row gives one row. Without training texts all counts are 0 and the model is uniform.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

END = b"\n"  # no word holds it
TOP = 1 << 17
ADD = 0.1
PIECE = 512
FLUSH = 400_000  # different words that a task counts before it hands them on
_COUNTS = pa.schema([("word", pa.binary()), ("n", pa.int64())])


def _count(batches):
    counter: Counter = Counter()

    def out():
        return pa.RecordBatch.from_arrays([pa.array(list(counter), pa.binary()), pa.array(list(counter.values()), pa.int64())], schema=_COUNTS)
    for batch in batches:
        for _, _, bodies in C.blocks(batch):
            counter[END] += len(bodies)
            for body in bodies:
                counter.update(body.lower().split())
            if len(counter) > FLUSH:
                yield out()
                counter.clear()
    yield out()


@dataclass
class Lexicon:
    """The TOP most frequent words with their counts, and what all counts come to."""
    place: dict[bytes, int]
    count: np.ndarray
    tokens: int  # N
    types: int  # V
    symbols: int

    @property
    def known(self) -> int:
        """Symbols of frequent words; then follow the end and rare."""
        return min(self.symbols - 2, len(self.count))

    @property
    def size(self) -> int:
        return self.known + 2

    def rare_mass(self, end: int) -> float:
        """Z: what (c + ADD) comes to over rare words and a word that never occurred."""
        frequent = int(self.count[:self.known].sum()) + end
        return self.tokens - frequent + ADD * max(0, self.types - self.known - (end > 0)) + ADD


_DOCS = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                   ("base", pa.float64()), ("rare_log", pa.float64()), ("n_rare", pa.int64()), ("codes", pa.binary()),
                   ("words", pa.list_(pa.binary())), ("times", pa.list_(pa.int32()))])
_DOCS_SQL = ("doc_id long, held_out boolean, n_tokens long, n_known long, base double, rare_log double, n_rare long, codes binary, "
             "words array<binary>, times array<int>")


def _encode(lexicon: Lexicon, end: int):
    """Symbols of each text, what its frequent words come to, and its other words."""
    logs = np.log10(np.append(lexicon.count, 0) + ADD)
    limit, known = len(lexicon.count), lexicon.known

    def work(bodies, rows):
        find, out = lexicon.place.get, {k: [] for k in ("n_tokens", "n_known", "base", "rare_log", "n_rare", "codes", "words", "times")}
        for body in bodies:
            words = body.lower().split()
            at = np.fromiter((find(w, limit) for w in words), np.int64, len(words))
            other = Counter(words[i] for i in np.flatnonzero(at == limit).tolist())
            top, rare = at[at < limit], at[(at >= known) & (at < limit)]
            codes = np.append(np.where(at < known, at, known + 1), known).astype(np.uint16)
            for k, v in (("n_tokens", len(words) + 1), ("n_known", len(top) + (end > 0)), ("base", float(logs[top].sum() + np.log10(end + ADD))),
                         ("rare_log", float(logs[rare].sum())), ("n_rare", int((at >= known).sum())), ("codes", codes.tobytes()),
                         ("words", list(other)), ("times", list(other.values()))):
                out[k].append(v)
        return {"doc_id": rows["doc_id"], "held_out": rows["held_out"], **out}
    return work


@dataclass
class Model:
    start: np.ndarray  # K
    move: np.ndarray  # K x K
    emit: np.ndarray  # symbols x K

    @staticmethod
    def fresh(states: int, share: np.ndarray, seed: int = 5) -> Model:
        r = np.random.default_rng(seed)
        emit = share[:, None] * r.gamma(2.0, 0.5, (len(share), states))
        move = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
        return Model(np.full(states, 1 / states), move, emit / emit.sum(0))

    def stationary(self) -> np.ndarray:
        p = np.full(len(self.start), 1 / len(self.start))
        for _ in range(200):
            p = p @ self.move
        return p / p.sum()


class Lanes:
    """Sequences side by side: symbols by time, at each time those of the sequences that are still running."""

    def __init__(self, sequences: list[np.ndarray]):
        length = np.array([len(s) for s in sequences])
        self.order = np.argsort(-length, kind="stable")
        length = length[self.order]
        steps = int(length[0])
        self.width = np.searchsorted(-length, -np.arange(steps), side="left")
        self.at = np.concatenate([[0], np.cumsum(self.width)])
        lane = np.repeat(np.arange(len(length)), length)
        time = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        self.symbol = np.empty(int(length.sum()), np.int64)
        self.symbol[self.at[time] + lane] = np.concatenate([sequences[i] for i in self.order])

    def forward(self, model: Model, start: np.ndarray, keep: bool):
        """Log-likelihood of each lane; with `keep`, also the scaled forward values and the scales by time."""
        emitted = None if not keep else model.emit[self.symbol]
        total = np.zeros(self.width[0])
        values = np.empty((len(self.symbol), len(model.start))) if keep else None
        scales = np.empty(len(self.symbol)) if keep else None
        now = start
        for t in range(len(self.width)):
            a, b = self.at[t], self.at[t + 1]
            now = (now[:b - a] @ model.move if t else start) * (emitted[a:b] if keep else model.emit[self.symbol[a:b]])
            scale = now.sum(1)
            now /= scale[:, None]
            if keep:
                values[a:b], scales[a:b] = now, scale
            else:
                total[:b - a] += np.log(scale)
        return (values, scales, emitted) if keep else total


def _sequences(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint16).astype(np.int64) for x in batch["codes"].to_pylist()]


def _runs(sequences: list[np.ndarray], most: int = 1 << 19):
    """Sequences in runs of about `most` symbols."""
    run, size = [], 0
    for s in sequences:
        run.append(s)
        size += len(s)
        if size >= most:
            yield run
            run, size = [], 0
    if run:
        yield run


_EXPECTED = pa.schema([("at", pa.int64()), ("x", pa.float64())])


def _expect(shared):
    """Expected counts of a task's texts, as index and value: starts, then transitions, then emissions."""
    def run(batches):
        model: Model = shared.value
        k, size = len(model.start), len(model.emit)
        stationary, sums = model.stationary(), np.zeros(k + k * k + size * k)
        for batch in batches:
            for run in _runs(_sequences(batch)):
                pieces = [(s[i:i + PIECE], i == 0) for s in run for i in range(0, len(s), PIECE)]
                lanes = Lanes([p for p, _ in pieces])
                opening = np.array([f for _, f in pieces])[lanes.order]
                values, scales, emitted = lanes.forward(model, np.where(opening[:, None], model.start, stationary), True)
                back = np.ones((lanes.width[-1], k))
                moves, belief = np.zeros((k, k)), values
                for t in range(len(lanes.width) - 1, 0, -1):
                    a, b, before = lanes.at[t], lanes.at[t + 1], lanes.at[t - 1]
                    weighted = emitted[a:b] * back / scales[a:b, None]
                    moves += values[before:before + (b - a)].T @ weighted
                    belief[a:b] *= back
                    back = np.ones((lanes.width[t - 1], k))
                    back[:b - a] = weighted @ model.move.T
                belief[:lanes.at[1]] *= back
                sums[:k] += belief[:lanes.at[1]][opening].sum(0)
                sums[k:k + k * k] += (moves * model.move).reshape(-1)
                for j in range(k):
                    sums[k + k * k + j * size:k + k * k + (j + 1) * size] += np.bincount(lanes.symbol, belief[:, j], minlength=size)
        some = np.flatnonzero(sums > 1e-9)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(sums[some])], schema=_EXPECTED)
    return run


def _frequent(counts: DataFrame, most: int) -> DataFrame:
    """The most frequent words, at most `most`: those whose count reaches the lowest step that so many reach.

    Steps are sixteenths of a doubling, so a histogram of a few hundred numbers finds the step, and no task sees more than its share.
    """
    stepped = counts.withColumn("step", F.floor(F.log2("n") * 16).cast("long"))
    reached, least = 0, None
    for r in sorted(stepped.groupBy("step").count().collect(), key=lambda r: -r["step"]):
        reached += r["count"]
        if reached > most:
            break
        least = r["step"]
    return stepped.where(F.lit(False) if least is None else F.col("step") >= least).drop("step")


@dataclass
class Trained:
    lexicon: Lexicon
    end: int
    model: Model
    texts: DataFrame  # every row of the documents, encoded
    counts: DataFrame  # word, n of all training tokens


def train(docs: DataFrame, held_out: Column, states: int = 8, symbols: int = 1 << 14, rounds: int = 4, top: int = TOP) -> Trained:
    """The counts and the model of the texts that are not held out, and all texts encoded by them."""
    rows = C.texts(docs, held_out.alias("held_out")).withColumn("doc_id", F.col("doc_id").cast("long"))
    training = rows.where("NOT held_out").select("body")
    counts = C.durable(training.mapInArrow(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 0"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count("*").alias("types"),
                       F.coalesce(F.max(F.when(F.col("word") == F.lit(END), F.col("n"))), F.lit(0)).alias("end")).first()
    best = _frequent(counts.where(F.col("word") != F.lit(END)), top).toArrow()
    order = sorted(zip((-best["n"].to_numpy()).tolist(), best["word"].to_pylist()))
    lexicon = Lexicon({w: i for i, (_, w) in enumerate(order)}, np.array([-n for n, _ in order], np.int64), total["tokens"], total["types"], symbols)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def encode(batches):
        yield from C.by_block(_encode(shared.value, total["end"]), _DOCS)(batches)
    texts = rows.mapInArrow(encode, _DOCS_SQL)
    texts = C.durable(texts.withColumn("row", F.monotonically_increasing_id()))
    share = np.concatenate([lexicon.count[:lexicon.known], [total["end"], lexicon.rare_mass(total["end"])]]) + ADD
    share /= share.sum()
    model = Model.fresh(states, share)
    for _ in range(rounds if total["tokens"] else 0):
        sent = docs.sparkSession.sparkContext.broadcast(model)
        sums = (texts.where("NOT held_out").select("codes").mapInArrow(_expect(sent), "at long, x double")
                .groupBy("at").agg(F.sum("x").alias("x")).toArrow())
        flat = np.zeros(states + states * states + lexicon.size * states)
        flat[sums["at"].to_numpy()] = sums["x"].to_numpy()
        start, move = flat[:states] + 0.1, flat[states:states + states * states].reshape(states, states) + 0.1
        emit = flat[states + states * states:].reshape(states, lexicon.size).T + 10 * share[:, None]
        model = Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))
    return Trained(lexicon, total["end"], model, texts, counts)


_LIKELY = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                     ("base", pa.float64()), ("rare_log", pa.float64()), ("n_rare", pa.int64()), ("likely", pa.float64())])


def _likely(shared):
    """log10 of the likelihood of the symbols of each text."""
    def run(batches):
        model: Model = shared.value
        for batch in batches:
            out = []
            for run in _runs(_sequences(batch)):
                lanes = Lanes(run)
                some = np.empty(len(run))
                some[lanes.order] = lanes.forward(model, np.broadcast_to(model.start, (len(run), len(model.start))), False)
                out.append(some / np.log(10))
            likely = pa.array(np.concatenate(out) if out else np.zeros(0))
            yield pa.RecordBatch.from_arrays([likely if f.name == "likely" else batch[f.name] for f in _LIKELY], schema=_LIKELY)
    return run


def score(trained: Trained) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    lexicon, spark = trained.lexicon, trained.texts.sparkSession
    other = (trained.texts.select("row", F.explode(F.arrays_zip("words", "times")).alias("x"))
             .select("row", F.col("x.words").alias("word"), F.col("x.times").alias("times")))
    logs = F.log10(F.coalesce("n", F.lit(0)) + ADD)
    met = other.join(trained.counts, "word", "left").groupBy("row").agg(
        F.sum(F.col("times") * logs).alias("more"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("met"))
    shared = spark.sparkContext.broadcast(trained.model)
    likely = trained.texts.select([f.name for f in _LIKELY if f.name != "likely"] + ["codes"]).mapInArrow(
        _likely(shared), "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, rare_log double, "
                         "n_rare long, likely double")
    more = F.coalesce("more", F.lit(0.0))
    all_mass = float(np.log10(lexicon.tokens + ADD * (lexicon.types + 1)))
    rare_mass = float(np.log10(lexicon.rare_mass(trained.end)))
    return likely.join(met, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("met", F.lit(0))).alias("n_known"),
        F.lit(lexicon.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * all_mass).alias("base_score"),
        (F.col("likely") + F.col("rare_log") + more - F.col("n_rare") * rare_mass).alias("score"))
