"""Quality of documents by a convolutional network over bytes, in numpy.

A text is its UTF-8 bytes. Every byte has a learned embedding and one more channel: whether the four bytes that end here stood a
few bytes earlier too. Learned filters slide over the whole text, their responses are pooled by maximum over overlapping
chunks, the chunks by maximum and mean, and a logistic unit turns the pooled responses into one probability.

The network is fitted in one task, so that the driver holds no texts, on a bounded sample: at most `sample_rows` labelled rows of each class, each of at most
`sample_bytes` bytes, taken by a hash of their ids. The shift of the class shares that this makes is taken back by the
counts of all labelled rows. Scoring is one pass over whole texts, without a shuffle.

Null and empty texts get the score of an empty text; ids may be null (they are scored, never learned from) or repeated; a table
without labels of both classes gives every text the share of label 1, or 0.5 where nothing is labelled.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

WIDTH, STRIDE, FILTERS, DEPTH, BACK = 8, 2, 24, 8, 32
CHUNK, HOP = 256, 192  # positions of a filter in a chunk, and from one chunk to the next


def _padded(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, each with WIDTH zero bytes or a few more behind it, and where each begins (a multiple of STRIDE)."""
    sizes = np.array([len(b) + WIDTH + (len(b) % STRIDE) for b in bodies])
    joined = b"".join(b + bytes(n - len(b)) for b, n in zip(bodies, sizes))
    return np.frombuffer(joined, np.uint8), np.concatenate([[0], np.cumsum(sizes)])


def _repeats(raw: np.ndarray) -> np.ndarray:
    """Whether the four bytes that end at a place also end at one of the BACK places before it."""
    out = np.zeros(len(raw), bool)
    if len(raw) < 8:
        return out
    four = raw[3:].astype(np.uint32)
    for i in range(3):
        four |= raw[i:len(raw) - 3 + i].astype(np.uint32) << np.uint32(8 * (3 - i))
    seen = np.zeros(len(four), bool)
    for back in range(2, BACK):
        seen[back:] |= four[back:] == four[:-back]
    out[3:] = seen & (raw[3:] > 0)
    return out


def _chunks(offset: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last position of each chunk, interleaved for reduceat, and the first chunk of each text."""
    first, stop = offset[:-1] // STRIDE, (offset[1:] - WIDTH) // STRIDE + 1
    count = np.maximum(1, -(-(stop - first - (CHUNK - HOP)) // HOP))
    text = np.repeat(np.arange(len(count)), count)
    begin = np.concatenate([[0], np.cumsum(count)])
    start = first[text] + HOP * (np.arange(len(text)) - begin[text])
    return np.stack([start, np.minimum(start + CHUNK, stop[text])], 1).reshape(-1), begin


@dataclass
class Network:
    embedding: np.ndarray  # 256 x DEPTH
    filters: np.ndarray  # WIDTH * (DEPTH + 1) x FILTERS
    bias: np.ndarray
    out: np.ndarray  # 2 * FILTERS
    shift: float

    @staticmethod
    def fresh(seed: int) -> Network:
        r = np.random.default_rng(seed)
        kinds = np.zeros((256, DEPTH), np.float32)
        b = np.arange(256)
        for i, kind in enumerate(((b >= 65) & (b < 91), (b >= 97) & (b < 123), (b >= 48) & (b < 58), b == 32, b < 32,
                                  np.isin(b, list(b".,;:!?'\"()")), (b > 32) & (b < 127) & ~np.isin(b, list(b".,;:!?'\"()")),
                                  b > 127)):
            kinds[kind, i] = 1
        kinds[65:91, 6] = kinds[97:123, 6] = kinds[48:58, 6] = 0
        size = WIDTH * (DEPTH + 1)
        return Network(kinds + r.normal(0, 0.05, kinds.shape).astype(np.float32),
                       r.normal(0, size ** -0.5, (size, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32),
                       r.normal(0, 0.1, 2 * FILTERS).astype(np.float32), 0.0)

    def windows(self, raw: np.ndarray, repeats: np.ndarray) -> np.ndarray:
        n = (len(raw) - WIDTH) // STRIDE + 1
        flat = np.empty((len(raw), DEPTH + 1), np.float32)
        flat[:, :DEPTH] = self.embedding[raw]
        flat[:, DEPTH] = repeats
        step = flat.strides[0]
        return np.lib.stride_tricks.as_strided(flat, (n, WIDTH * (DEPTH + 1)), (STRIDE * step, 4))

    def pooled(self, bodies: list[bytes]) -> np.ndarray:
        """Maximum and mean over the chunks of each text, of the largest response of each filter in a chunk."""
        raw, offset = _padded(bodies)
        repeats, (edges, begin) = _repeats(raw), _chunks(offset)
        n = (len(raw) - WIDTH) // STRIDE + 1
        response = np.empty((n + 1, FILTERS), np.float32)
        response[n] = 0
        for at in range(0, n, 1 << 14):
            stop = min(n, at + (1 << 14))
            part = slice(at * STRIDE, (stop - 1) * STRIDE + WIDTH)
            np.matmul(self.windows(raw[part], repeats[part]), self.filters, out=response[at:stop])
        chunk = np.maximum(np.maximum.reduceat(response, edges, axis=0)[::2] + self.bias, 0)
        return np.hstack([np.maximum.reduceat(chunk, begin[:-1], axis=0),
                          np.add.reduceat(chunk, begin[:-1], axis=0) / np.diff(begin)[:, None]])

    def scores(self, bodies: list[bytes]) -> np.ndarray:
        z = self.pooled(bodies).astype(np.float64) @ self.out + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _batches(sizes: list[int], order: np.ndarray, most: int) -> list[np.ndarray]:
    """The order in runs of at most `most` texts and about 128 kB."""
    turn = np.cumsum([sizes[i] for i in order]) // (128 << 10)
    cuts = np.flatnonzero(np.diff(turn)) + 1
    return [run[i:i + most] for run in np.split(order, cuts) for i in range(0, len(run), most) if len(run)]


def fit(bodies: list[bytes], truth: np.ndarray, rounds: int = 8, batch: int = 48, rate: float = 0.01, seed: int = 7) -> Network:
    """The network after `rounds` passes of Adam over the sample."""
    net, r = Network.fresh(seed), np.random.default_rng(seed)
    names = ("embedding", "filters", "bias", "out")
    first, second, t, channels = {}, {}, 0, DEPTH + 1
    for epoch in range(rounds):
        for pick in _batches([len(b) for b in bodies], r.permutation(len(bodies)), batch):
            raw, offset = _padded([bodies[i] for i in pick])
            repeats, (edges, begin) = _repeats(raw), _chunks(offset)
            response = net.windows(raw, repeats) @ net.filters
            where = np.empty((len(edges) // 2, FILTERS), np.int64)
            for c in range(len(where)):
                where[c] = edges[2 * c] + response[edges[2 * c]:edges[2 * c + 1]].argmax(0)
            chunk = np.maximum(response[where, np.arange(FILTERS)] + net.bias, 0)
            text, count = np.repeat(np.arange(len(pick)), np.diff(begin)), np.diff(begin)
            best = np.stack([begin[d] + chunk[begin[d]:begin[d + 1]].argmax(0) for d in range(len(pick))])
            pooled = np.hstack([chunk[best, np.arange(FILTERS)], np.add.reduceat(chunk, begin[:-1], axis=0) / count[:, None]])
            error = (1 / (1 + np.exp(-np.clip(pooled @ net.out + net.shift, -40, 40))) - truth[pick]) / len(pick)
            up = np.outer(error, net.out)
            down = (up[:, FILTERS:] / count[:, None])[text]
            np.add.at(down, (best, np.arange(FILTERS)), up[:, :FILTERS])
            down *= chunk > 0
            windows = net.windows(raw, repeats)
            grad = {"embedding": np.zeros_like(net.embedding), "filters": np.zeros_like(net.filters), "bias": down.sum(0),
                    "out": pooled.T @ error + 1e-4 * net.out}
            for f in range(FILTERS):
                grad["filters"][:, f] = down[:, f] @ windows[where[:, f]]
                for i in range(WIDTH):
                    np.add.at(grad["embedding"], raw[where[:, f] * STRIDE + i],
                              np.outer(down[:, f], net.filters[i * channels:i * channels + DEPTH, f]))
            t += 1
            for k in names:
                first[k] = 0.9 * first.get(k, 0) + 0.1 * grad[k]
                second[k] = 0.999 * second.get(k, 0) + 0.001 * grad[k] ** 2
                step = rate * (1 - epoch / rounds) * (first[k] / (1 - 0.9 ** t)) / (np.sqrt(second[k] / (1 - 0.999 ** t)) + 1e-8)
                setattr(net, k, (getattr(net, k) - step).astype(np.float32))
            net.shift -= 0.5 * rate * float(error.sum()) * len(pick) ** 0.5
    return net


def train(docs: DataFrame, labels: DataFrame, held_out: Column, sample_rows: int = 500, sample_bytes: int = 32768) -> Network:
    """The network fitted on labelled rows that are not held out."""
    picked, count = C.sample(docs, labels, "quality", held_out, sample_rows)
    usable = picked.where(F.octet_length("text") <= sample_bytes)
    zero, one = (usable.where(F.col("label") == k).orderBy("doc_id", "text").limit(sample_rows) for k in (0, 1))

    def fitted(batches):
        rows = sorted((k, d, t) for batch in batches for d, t, k in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "label"))))
        truth = np.array([k for k, _, _ in rows], float)
        net = fit([t.encode() for _, _, t in rows], truth) if 0 < truth.sum() < len(truth) else None
        yield pa.RecordBatch.from_pydict({"net": [pickle.dumps((net, truth))]})

    sample = zero.union(one).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "label")
    found = sample.coalesce(1).mapInArrow(fitted, "net binary").first()  # at most 2 x sample_rows x sample_bytes
    net, truth = pickle.loads(found["net"]) if found else (None, np.zeros(0))
    if net is None:
        net = Network.fresh(0)
        net.out[:] = 0
        net.shift = 0.0 if not count else 40.0 * (2 * bool(count.get(1)) - 1) if len(count) == 1 else float(np.log(count[1] / count[0]))
        return net
    ones = truth.mean()
    net.shift += np.log(count[1] / count[0]) - np.log(ones / (1 - ones))
    return net


_SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64())])


def score(docs: DataFrame, net: Network, held_out: Column) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: better), predicted (1 if the score is 0.5 or more) of every text."""
    def work(bodies, rows):
        return {"doc_id": rows["doc_id"], "held_out": rows["held_out"], "score": net.scores(bodies)}
    rows = C.texts(docs, held_out.alias("held_out")).withColumn("doc_id", F.col("doc_id").cast("long"))
    out = rows.mapInArrow(C.by_block(work, _SCORED), "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def accepted(docs: DataFrame, net: Network, least: float = 0.5) -> DataFrame:
    """The rows, with all their columns, whose text scores at least `least`. Texts are scored where they lie."""
    columns = docs.columns
    def judge(batches):
        for batch in batches:
            keep = []
            for _, _, bodies in C.blocks(batch, "text"):
                keep.append(net.scores(bodies) >= least)
            yield batch.filter(pa.array(np.concatenate(keep))) if keep else batch
    if columns.count("text") != 1:
        raise ValueError("one column text is needed")
    return docs.mapInArrow(judge, docs.schema)
