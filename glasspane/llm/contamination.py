"""Benchmark items inside documents, by size-partitioned MinHash containment search.

Items of one to eight shingles are looked up exactly, by each of their shingles. The others are divided by their number of shingles
into classes of at most 16, 32, 64 ... shingles. For each class, every document
is cut into windows of twice that size that overlap by half, so an item lies whole in some window and is at least about
a fifth of it, however long the document is. Items and windows get MinHash signatures with one row a band: an item and a
window are candidates where one minimum agrees. Candidates are verified by the exact share of the item's distinct shingles
that the document holds.

Items are the queries: they go to all tasks in blocks of a bounded number of bytes, and documents are scanned once a block,
without a shuffle. Equal items (in lower case, by words) count as one, under their smallest id.

Words are compared in lower case (A-Z); a shingle is five words. An item of one to four words is a single shingle of its
length. Items without words are never found; null and empty documents hold nothing. Repeated documents are all reported.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

WIDTH, HASHES, SMALLEST, EXACT = 5, 48, 16, 8  # EXACT: items of so many shingles are looked up by all of them
BLOCK = 8 << 20  # bytes of item texts that are sent to the tasks at once, in the mean
_r = np.random.default_rng(11)
_MULTIPLY = _r.integers(1, 2**31, HASHES, dtype=np.int64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _r.integers(0, 2**32, HASHES, dtype=np.int64).astype(np.uint32)


def _permuted(shingles: np.ndarray, i: int) -> np.ndarray:
    return (shingles ^ _ADD[i]) * _MULTIPLY[i]


class Index:
    """Items by size class, with the minima of their signatures in order."""

    def __init__(self, items: list[tuple[int | None, bytes]]):
        self.ids = [i for i, _ in items]
        words = C.Words([b for _, b in items])
        shingle, doc = words.shingles(WIDTH)
        self.short, self.classes, exact = {}, {}, []
        by_class: dict[int, list[int]] = {}
        cuts = np.searchsorted(doc, np.arange(len(items) + 1))
        self.sets = [np.unique(shingle[cuts[k]:cuts[k + 1]]) for k in range(len(items))]
        for k, n in enumerate(words.per_doc):
            if 0 < n < WIDTH:
                self.short.setdefault(int(n), []).append(k)
            elif n and len(self.sets[k]) <= EXACT:
                exact.append(k)
            elif n:
                by_class.setdefault(max(SMALLEST, 1 << int(len(self.sets[k]) - 1).bit_length()), []).append(k)
        held = np.concatenate([np.zeros(0, np.uint64), *[self.sets[k] for k in exact]])
        order = np.argsort(held, kind="stable")
        self.exact = held[order], np.repeat(np.array(exact, np.int64), [len(self.sets[k]) for k in exact])[order]
        for width, ks in self.short.items():
            for k in ks:
                self.sets[k] = C.Words([items[k][1]]).shingles(width)[0]
        for size, ks in by_class.items():
            minima = np.array([[_permuted((self.sets[k] >> np.uint64(32)).astype(np.uint32), i).min() for k in ks] for i in range(HASHES)])
            order = minima.argsort(axis=1)
            self.classes[size] = (np.take_along_axis(minima, order, 1), np.array(ks)[order])

    def _windows(self, shingle: np.ndarray, doc: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Candidate texts and items."""
        first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        length = np.diff(np.concatenate([first, [len(doc)]]))
        cuts = {}
        for size in self.classes:
            count = -(-length // size)
            begin = np.repeat(first, count) + size * (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
            of = doc[begin]
            cuts[size] = (begin, of, of[1:] == of[:-1])
        small = (shingle >> np.uint64(32)).astype(np.uint32)
        for i in range(HASHES):
            values = _permuted(small, i)
            for size, (minima, ks) in self.classes.items():
                begin, of, goes_on = cuts[size]
                least = np.minimum.reduceat(values, begin)
                np.minimum(least[:-1], least[1:], out=least[:-1], where=goes_on)
                left = np.searchsorted(minima[i], least)
                hit = np.flatnonzero(minima[i][np.minimum(left, len(ks[i]) - 1)] == least)
                if len(hit):
                    right = np.searchsorted(minima[i], least[hit], side="right")
                    for h, a, b in zip(of[hit], left[hit], right):
                        yield np.full(b - a, h), ks[i][a:b]

    def _looked_up(self, shingle: np.ndarray, doc: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Texts and items of at most EXACT shingles that share one."""
        held, ks = self.exact
        left, right = np.searchsorted(held, shingle), np.searchsorted(held, shingle, side="right")
        hit = np.flatnonzero(left < right)
        for h, a, b in zip(doc[hit], left[hit], right[hit]):
            yield np.full(b - a, h), ks[a:b]

    def search(self, bodies: list[bytes], least: float) -> list[tuple[int, int, int, int]]:
        """(text, item, shingles of the item, of these in the text) for every item whose share in the text is at least `least`."""
        words, out = C.Words(bodies), []
        for width, ks in self.short.items():
            shingle, doc = words.shingles(width)
            for k in ks:
                out += [(int(d), k, 1, 1) for d in np.unique(doc[shingle == self.sets[k][0]]) if words.per_doc[d] >= width]
        long = words.per_doc >= WIDTH
        if not (self.classes or len(self.exact[0])) or not long.any():
            return out
        shingle, doc = words.shingles(WIDTH)
        keep = long[doc]
        shingle, doc = shingle[keep], doc[keep]
        found = [*self._looked_up(shingle, doc), *self._windows(shingle, doc)]
        if not found:
            return out
        pairs = np.unique(np.stack([np.concatenate([x[j] for x in found]) for j in (0, 1)], 1), axis=0)
        own, at = None, -1
        for d, k in pairs.tolist():
            if d != at:
                a, b = np.searchsorted(doc, [d, d + 1])
                own, at = np.unique(shingle[a:b]), d
            shared = len(np.intersect1d(self.sets[k], own, assume_unique=True))
            if shared >= least * len(self.sets[k]):
                out.append((d, k, len(self.sets[k]), shared))
        return out


def _blocks(benchmark: DataFrame, block: int) -> Iterator[list[tuple[int | None, bytes]]]:
    """Distinct items that have a word, in blocks of about `block` bytes."""
    plain = F.btrim(F.regexp_replace(F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"),
                                     "[ \t\n\x0b\x0c\r]+", " "))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), plain.alias("plain")).where("plain <> ''")
    items = items.groupBy("plain").agg(F.min("item_id").alias("item_id"))
    size = items.agg(F.sum(F.octet_length("plain"))).first()[0] or 0
    parts = -(-size // block)
    for part in range(parts):
        rows = items.where(F.pmod(F.xxhash64("plain"), F.lit(parts)) == part) if parts > 1 else items
        yield sorted(((r["item_id"], r["plain"].encode()) for r in rows.collect()), key=lambda x: (x[0] is None, x))


_FOUND = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_shingles", pa.int64()), ("n_shared", pa.int64()),
                    ("containment", pa.float64())])


def find(docs: DataFrame, benchmark: DataFrame, least: float = 0.8, block: int = BLOCK) -> DataFrame:
    """doc_id, item_id, n_shingles, n_shared, containment for every document and item with a containment of at least `least`."""
    spark, out = docs.sparkSession, None
    rows = C.texts(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
    kind = "doc_id long, item_id long, n_shingles long, n_shared long, containment double"
    for items in _blocks(benchmark, block):
        index = spark.sparkContext.broadcast(Index(items))

        def work(bodies, batch, index=index):
            found = index.value.search(bodies, least)
            ids, names = batch["doc_id"].to_pylist(), index.value.ids
            return {"doc_id": [ids[d] for d, _, _, _ in found], "item_id": [names[k] for _, k, _, _ in found],
                    "n_shingles": [n for _, _, n, _ in found], "n_shared": [s for _, _, _, s in found],
                    "containment": [s / n for _, _, n, s in found]}
        part = rows.mapInArrow(C.by_block(work, _FOUND), kind)
        out = part if out is None else out.union(part)
    return spark.createDataFrame([], kind) if out is None else out


def without(docs: DataFrame, benchmark: DataFrame, least: float = 0.8, block: int = BLOCK) -> DataFrame:
    """The rows of docs, with all their columns, that hold no item to a share of `least` or more."""
    spark, schema = docs.sparkSession, docs.schema
    for items in _blocks(benchmark, block):
        index = spark.sparkContext.broadcast(Index(items))

        def clean(batches, index=index):
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for first, _, bodies in C.blocks(batch, "text"):
                    keep[[first + d for d, _, _, _ in index.value.search(bodies, least)]] = False
                yield batch.filter(pa.array(keep))
        docs = docs.mapInArrow(clean, schema)
    return docs
