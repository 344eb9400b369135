"""Shared pieces of the training-data operators: durable checkpoints, Arrow batches, vectorised words and hashes.

A word is a run of bytes other than space and TAB..CR, so the words of a text are found on its UTF-8 bytes.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BYTES = 2 << 20  # texts of a batch are worked through in blocks of about this size; a longer text is a block
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = 4096


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, one in the warehouse."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints"


def durable(df: DataFrame) -> DataFrame:
    """The rows written to the shared checkpoint folder, so that later steps neither recompute nor lose them."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def packed(df: DataFrame, rows: int = 50_000) -> DataFrame:
    """As durable(), for rows of a few numbers: one partition for each `rows` of them.

    Tables of one partition are joined and grouped where they are. Each shuffle or broadcast takes a thread of the driver that stays for a
    minute, so steps that go round and round need as few of them as their rows allow.
    """
    out = durable(df)
    return out.coalesce(parts(out.count(), rows))


def parts(n: int, rows: int = 50_000) -> int:
    """Partitions of a table of n rows of a few numbers."""
    return max(1, -(-n // rows))


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared one."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """The rows as a table at `path`. Unlike a checkpoint it has sizes of its own, so plans that go round and round do not multiply them."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a table that was read for the last time."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def fold(key: str, parts: int) -> Column:
    """Remainder of the CRC-32 of an id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % parts


def texts(df: DataFrame, *more: Column) -> DataFrame:
    """doc_id, text as bytes (null: empty) and other columns, whatever else the table holds."""
    return df.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("body"), *more)


def labels(df: DataFrame, kind: str) -> DataFrame:
    """One row per labelled id: the larger label where there are several; rows without id or label count for nothing."""
    good = df.where(F.col("doc_id").isNotNull() & F.col(kind).isin(0, 1))
    return good.groupBy("doc_id").agg(F.max(kind).cast("int").alias("label"))


def sample(docs: DataFrame, marks: DataFrame, kind: str, held_out: Column, rows: int) -> tuple[DataFrame, dict[int, int]]:
    """doc_id, text, label of at most `rows` ids of each label that are not held out, and how many ids each label has.

    The ids are drawn by hash from the labels alone and sent to all tasks (2 x `rows` numbers), so no text is moved.
    """
    known = labels(marks, kind).where(~held_out)
    count = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    drawn = [known.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for k in (0, 1)]
    picked = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(drawn[0].union(drawn[1])), "doc_id")
    return picked, count


def blocks(batch: pa.RecordBatch, name: str = "body") -> Iterator[tuple[int, int, list[bytes]]]:
    """Runs of rows of a batch with their texts, each about BLOCK_BYTES long."""
    column = batch.column(batch.schema.get_field_index(name))
    if not pa.types.is_binary(column.type):
        column = column.cast(pa.binary())
    ends = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.binary_length(column), 0), dtype=np.int64))
    first = 0
    while first < len(ends):
        before = ends[first - 1] if first else 0
        stop = max(first + 1, int(np.searchsorted(ends, before + BLOCK_BYTES, side="right")))
        yield first, stop, [x or b"" for x in column.slice(first, stop - first).to_pylist()]
        first = stop


def by_block(work: Callable[[list[bytes], pa.RecordBatch], dict], schema: pa.Schema):
    """A function for mapInArrow: work() turns the texts of a block and its rows into columns."""
    def run(batches):
        for batch in batches:
            for first, stop, bodies in blocks(batch):
                columns = work(bodies, batch.slice(first, stop - first))
                yield pa.RecordBatch.from_arrays(
                    [x if isinstance(x := columns[f.name], (pa.Array, pa.ChunkedArray)) else pa.array(x, f.type) for f in schema],
                    schema=schema)
    return run


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit numbers (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & (2**64 - 1), np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_LOW, _HIGH = {}, {}
for _name, _b in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
    _LOW[_name], _HIGH[_name] = _powers(_b, _STEP), _powers(pow(_b, _STEP, 2**64), 1 << 14)


def _power(kind: str, at: np.ndarray) -> np.ndarray:
    high = at // _STEP
    table = _HIGH[kind]
    if len(high) and int(high[-1]) >= len(table):
        table = _powers(int(table[1]), int(high[-1]) + 1)
    return table[high] * _LOW[kind][at % _STEP]


class Words:
    """The words of a block of texts: start, end, doc (index of the text) and the bytes they stand in."""

    def __init__(self, bodies: list[bytes], lower: bool = True):
        self.n_docs = len(bodies)
        joined = np.frombuffer(b"\n".join(bodies) + b"\n", np.uint8)
        self.raw = joined
        self.bytes = _LOWER[joined] if lower else joined
        self.offset = np.concatenate([[0], np.cumsum([len(b) + 1 for b in bodies])]).astype(np.int64)
        solid = np.zeros(len(joined) + 1, np.int8)
        solid[1:] = ~_SPACE[joined]
        edges = np.flatnonzero(np.diff(solid))
        self.start, self.end = edges[::2], edges[1::2]
        first = np.searchsorted(self.start, self.offset)
        self.per_doc = np.diff(first)
        self.first = first[:-1]
        self.doc = np.repeat(np.arange(self.n_docs), self.per_doc)
        self._sums = None

    def hashes(self, limit: int | None = None) -> np.ndarray:
        """64-bit hash of each word, or of its first `limit` bytes."""
        if self._sums is None:
            n = len(self.bytes)
            high = _power("up", np.arange(0, n, _STEP))
            sums = np.multiply.outer(high, _LOW["up"]).reshape(-1)[:n]
            sums *= self.bytes.astype(np.uint64) + np.uint64(1)
            np.cumsum(sums, out=sums)
            self._sums = np.concatenate([np.zeros(1, np.uint64), sums])
        end = self.end if limit is None else np.minimum(self.end, self.start + limit)
        return mix((self._sums[end] - self._sums[self.start]) * _power("down", self.start))

    def shingles(self, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
        """Hash and doc of each run of `width` words; a text of fewer words, but some, gives one run of all its words."""
        words = self.hashes()
        n, out = len(words), np.zeros(max(0, len(words) - width + 1), np.uint64)
        for i in range(width):
            out *= np.uint64(0xD6E8FEB86659FD93)
            out += words[i:n - width + 1 + i]
        whole = self.doc[:len(out)] == self.doc[width - 1:] if len(out) else np.zeros(0, bool)
        out, doc = mix(out[whole]), self.doc[:len(whole)][whole]
        short = np.flatnonzero((self.per_doc > 0) & (self.per_doc < width))
        if len(short):
            more = np.empty(len(short), np.uint64)
            for k, d in enumerate(short):
                h = 0
                for w in words[self.first[d]:self.first[d] + self.per_doc[d]]:
                    h = (h * 0xD6E8FEB86659FD93 + int(w) + 1) & (2**64 - 1)
                more[k] = h
            out, doc = np.concatenate([out, mix(more)]), np.concatenate([doc, short])
            order = np.argsort(doc, kind="stable")
            out, doc = out[order], doc[order]
        return out, doc


def per_doc_sum(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(doc, values, minlength=n)


def slots(spark: SparkSession) -> int:
    return max(2, spark.sparkContext.defaultParallelism)
