"""Importance resampling towards a target distribution: the documents whose words look most like the target's, with Gumbel noise.

Method. A document's features are its runs of one to `longest` consecutive words, hashed into buckets by CRC-32. How much likelier a bucket is in
the target than among the documents gives its gain (add-one smoothing, thousandths of a nat, rounded down); the gains are an array of `buckets`
numbers, and a document's weight is the floored mean of the entries that its features point to. To the weight comes Gumbel noise from a hash of
seed and id, so the highest scores are a draw without replacement with probabilities that follow the weights. The order of all documents comes
from a distributed radix sort, least significant digit first: (score falling, doc_id, n_features) is one composite key of as many bits as the
values' ranges need; each pass counts the digits of every chunk of positions, sums the counts over smaller digits and earlier chunks to offsets,
and gives each row its new position: offset plus its place among the rows of its chunk and digit.

Spark. Two scans of the texts, map-only, in numpy over blocks of about 2 MB: one task returns one array of counts, so `buckets` numbers a task
are shuffled; the gains (80 KB) go out with the second scan. The sort moves four numbers a document, in chunks of CHUNK positions, so no key, however
frequent, has more than CHUNK rows in a group; only the counts by digit (at most 2^DIGIT numbers) reach the driver. Each pass is written to the shared
folder and the one before it deleted: positions are never computed twice, and a lost executor costs the pass at hand.

Results. One row per row of the table. Null and empty texts have no features: weight 0, rank null. A null id is hashed as the empty text and comes
after all ids of the same score. Rows equal in id, score and n_features are interchangeable, each has a rank of its own. An empty target has gains
from the documents' counts alone; an empty table gives an empty result. Other columns are neither read nor returned.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

DIGIT = 11      # most bits of a pass
CHUNK = 1 << 14  # positions that are ranked together
SHORT = 48      # bytes; longer words are hashed one by one
_SOLID = np.zeros(256, bool)
_SOLID[48:58] = _SOLID[97:123] = True
_SOLID[128:] = True

COUNTS = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])
SCORES = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64()), ("score", pa.int64())])


def _crc_table() -> np.ndarray:
    """What one byte does to a CRC-32 (reflected polynomial 0xEDB88320)."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, t >> 1 ^ np.uint32(0xEDB88320), t >> 1)
    return t


CRC = _crc_table()


class Features:
    """The features of a block of texts: `bucket` and `doc` of each, `words` and `features` of each text."""

    def __init__(self, bodies: list[bytes], buckets: int, longest: int):
        joined = C._LOWER[np.frombuffer(b"\n".join(bodies) + b"\n", np.uint8)]
        solid = np.zeros(len(joined) + 1, np.int8)
        solid[1:] = _SOLID[joined]
        edges = np.flatnonzero(np.diff(solid))
        start, size = edges[::2], edges[1::2] - edges[::2]
        offset = np.concatenate([[0], np.cumsum([len(b) + 1 for b in bodies])])
        self.words = np.diff(np.searchsorted(start, offset))
        doc = np.repeat(np.arange(len(bodies)), self.words)
        state = self._words(joined, start, size, np.full(len(start), 0xFFFFFFFF, np.uint32))
        found = [(state, doc)]
        for n in range(1, longest):  # a run of one word more: a space and the next word go through the same sum
            inside = doc[n:] == doc[:-n] if len(doc) > n else np.zeros(0, bool)
            state = state[:len(inside)]
            state = CRC[(state ^ np.uint32(32)) & np.uint32(255)] ^ state >> np.uint32(8)
            state = self._words(joined, start[n:], size[n:], state)
            found.append((state[inside], doc[:len(inside)][inside]))
        self.bucket = (~np.concatenate([s for s, _ in found]) % np.uint32(buckets)).astype(np.int64)
        self.doc = np.concatenate([d for _, d in found])
        self.features = np.bincount(self.doc, minlength=len(bodies))

    @staticmethod
    def _words(text: np.ndarray, start: np.ndarray, size: np.ndarray, state: np.ndarray) -> np.ndarray:
        """CRC states after the bytes of each word, all words a byte at a time."""
        start, size = start[:len(state)], size[:len(state)]
        order = np.argsort(-size, kind="stable")
        at, left, out = start[order], size[order], state[order]
        for k in np.flatnonzero(left > SHORT):
            word = text[at[k]:at[k] + left[k]].tobytes()
            out[k] = ~np.uint32(zlib.crc32(word, int(~out[k])))
        short = int(np.searchsorted(-left, -SHORT))
        for k in range(int(left[short]) if short < len(left) else 0):
            stop = int(np.searchsorted(-left, -k))  # those before it are longer than k
            if stop > short:
                s = out[short:stop]
                out[short:stop] = CRC[(s ^ text[at[short:stop] + k]) & np.uint32(255)] ^ s >> np.uint32(8)
        back = np.empty_like(out)
        back[order] = out
        return back


def counts(docs: DataFrame, buckets: int, longest: int) -> np.ndarray:
    """How many features of all texts each bucket holds."""
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, bodies in C.blocks(batch):
                total += np.bincount(Features(bodies, buckets, longest).bucket, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], schema=COUNTS)
    body = docs.select(F.coalesce("text", F.lit("")).cast("binary").alias("body"))
    out = np.zeros(buckets, np.int64)
    for r in body.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log of how much likelier each bucket is in the target, rounded down."""
    buckets, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + buckets) / ((s + 1.0) * (t_all + buckets))))
                     for s, t in zip(source.tolist(), target.tolist())], np.int64)


def noise(seed: int, doc_id: int | None) -> int:
    """Gumbel noise in thousandths, rounded down, from the hash of seed and id."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, longest: int, seed: int) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of each text."""
    def work(bodies, rows):
        f = Features(bodies, len(gain), longest)
        total = np.bincount(f.doc, gain[f.bucket], minlength=len(bodies)).astype(np.int64)
        weight = total // np.maximum(f.features, 1)
        ids = rows.column("doc_id")
        return {"doc_id": ids, "n_words": f.words, "n_features": f.features, "weight": weight,
                "score": weight + np.array([noise(seed, i) for i in ids.to_pylist()], np.int64)}
    rows = C.texts(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(C.by_block(work, SCORES), "doc_id long, n_words long, n_features long, weight long, score long")


def digit(parts: list[tuple[Column, int]], low: int, width: int) -> Column:
    """Bits low to low + width of the parts set side by side, the first one lowest; a part is a number of so many bits."""
    out, at = F.lit(0).cast("long"), 0
    for value, bits in parts:
        first, last = max(low, at), min(low + width, at + bits)
        if first < last:
            piece = F.shiftrightunsigned(value, first - at).bitwiseAND(F.lit((1 << last - first) - 1).cast("long"))
            out = out.bitwiseOR(F.shiftleft(piece, first - low))
        at += bits
    return out.cast("int")


def radix_ranked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows with `position`, 0 for the first, in the order of the long columns `keys` (the first one decides; nulls last)."""
    spark, folder = rows.sparkSession, C.new_folder(rows.sparkSession, "radix")
    rows = C.durable(rows).withColumn("position", F.monotonically_increasing_id())
    ends = rows.agg(*[f(k).alias(f"{n}_{k}") for k in keys for n, f in (("min", F.min), ("max", F.max))],
                    *[F.coalesce(F.max(F.col(k).isNull()), F.lit(False)).alias(f"null_{k}") for k in keys]).first()
    parts = []
    for k in reversed(keys):
        low, high = ends[f"min_{k}"], ends[f"max_{k}"]
        if low is not None and low < high:
            if high - low < 1 << 62:
                parts.append((F.coalesce(F.col(k) - F.lit(low).cast("long"), F.lit(0).cast("long")), (high - low).bit_length()))
            else:  # the sign bit turned over: order as of numbers without sign
                parts.append((F.coalesce(F.col(k).bitwiseXOR(F.lit(-1 << 63).cast("long")), F.lit(0).cast("long")), 64))
        if ends[f"null_{k}"] and low is not None:
            parts.append((F.col(k).isNull().cast("long"), 1))
    bits = sum(b for _, b in parts)
    passes = max(1, -(-bits // DIGIT))
    width = -(-bits // passes)
    names = [c for c in rows.columns if c != "position"]
    for low in range(0, max(bits, 1), max(width, 1)):
        at = rows.withColumns({"chunk": F.shiftrightunsigned("position", CHUNK.bit_length() - 1), "digit": digit(parts, low, width)})
        count = C.durable(at.groupBy("digit", "chunk").agg(F.count("*").alias("n")))
        base, upto = [0] * (1 << width), 0
        for r in sorted(count.groupBy("digit").agg(F.sum("n").alias("n")).collect()):  # at most 2^DIGIT numbers
            base[r["digit"]], upto = upto, upto + r["n"]
        smaller = F.array(*[F.lit(b).cast("long") for b in base]) if len(base) <= 1 else F.from_json(F.lit(str(base)), "array<long>")
        earlier = Window.partitionBy("digit").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
        offset = count.select("chunk", "digit", (smaller[F.col("digit")] + F.coalesce(F.sum("n").over(earlier), F.lit(0))).alias("offset"))
        place = F.row_number().over(Window.partitionBy("chunk", "digit").orderBy("position"))
        rows = C.written(at.join(offset, ["chunk", "digit"]).select(*names, (F.col("offset") + place - 1).alias("position")), f"{folder}/{low}")
        if low:
            C.removed(spark, f"{folder}/{low - width}")
    return rows


def resample(docs: DataFrame, target: DataFrame, percent: int, seed: int, buckets: int = 10000, longest: int = 1, least_words: int = 20) -> DataFrame:
    """doc_id, n_features, weight, score and rank of each text: 1, 2, ... for the `percent` of those with enough words that are drawn, else null."""
    gain = gains(counts(docs, buckets, longest), counts(target, buckets, longest))
    rows = C.durable(scored(docs, gain, longest, seed))
    enough = F.col("n_words") >= least_words
    n = rows.where(enough).count()
    fields = ["doc_id", "n_features", "weight", "score"]
    order = radix_ranked(rows.where(enough).select(*fields, (-F.col("score")).alias("fall")), ["fall", "doc_id", "n_features"])
    rank = F.col("position") + 1
    drawn = order.select(*fields, F.when(rank <= percent * n // 100, rank).alias("rank"))
    return drawn.unionByName(rows.where(~enough).select(*fields, F.lit(None).cast("long").alias("rank")))
