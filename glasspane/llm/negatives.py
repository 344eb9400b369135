"""Hard negatives: for each anchor and positive, the most similar rows of other labels within a window of scores below the positive's.

Method. Slots: the windows of an anchor overlap, but their upper limits cut the scores into disjoint slots. A task keeps, for each anchor and slot,
the best `negatives` rows it has seen (a combiner: what is below the worst of a full slot is passed over at once); the tasks' lists are cut to the
same number per slot. The slots of an anchor in falling order are one list in the order of score, and the rows under an upper limit are a suffix
of it: the first ones of that suffix, as far as the lower limit, answer a window. So one scan answers all windows of an anchor.

Spark. Rows without label or vector, or with a null or non-finite component, are left out; the others are written once to the shared checkpoint
folder, numbered there. Anchors (the query set) and rows are dealt into blocks and each pair of blocks is one group, scored as a matrix product in
numpy: a task holds ROWS rows and ANCHORS anchors, whatever the labels, so a hot label does not matter. Two passes: the best positives of each anchor,
whose scores give the limits, then the slots. Only the best of each block are shuffled, and Spark cuts them further before that shuffle.

Results. Scores are exact whole numbers (each component x counts as floor(scale * x); beyond the range of long, the limit of that sign). Ties go to the smaller
id, then null ids. Rows count, not ids: of repeated rows each is an anchor, a positive and a negative of its own, and an anchor is never its own positive.
Vectors of different lengths are compared over the shorter one. Anchors without positives, and windows without rows, return nothing; an empty table gives
an empty result. Other columns are neither read nor returned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

ROWS = 1 << 16     # most rows of a block
ANCHORS = 1 << 11  # most anchors of a block
TILE = 1 << 21     # scores that are held at a time
FOUND = pa.schema([("anchor", pa.int64()), ("slot", pa.int32()), ("score", pa.int64()), ("other", pa.int64())])
FOUND_TYPE = "anchor long, slot int, score long, other long"


def matrix(column: pa.ChunkedArray, scale: float) -> np.ndarray:
    """The vectors as floor(scale * x), shorter ones filled with zeros: doubles, or Python numbers where doubles could round a score."""
    lists = pa.concat_arrays([c.cast(pa.list_(pa.float64())) for c in column.chunks]) if column.num_chunks else pa.array([], pa.list_(pa.float64()))
    sizes = np.diff(lists.offsets.to_numpy())
    widest = int(sizes.max(initial=0))
    flat = np.clip(np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False)), -1e300, 1e300)
    if len(sizes) and sizes.min() == widest:
        return flat.reshape(len(sizes), widest)
    out = np.zeros((len(sizes), widest))
    out[np.arange(widest) < sizes[:, None]] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of a and b."""
    wide = min(a.shape[1], b.shape[1])
    a, b = a[:, :wide], b[:, :wide]
    if wide * np.abs(a).max(initial=0) * np.abs(b).max(initial=0) < 2.0**53:
        return (a @ b.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    exact = whole(a) @ whole(b).T
    return np.clip(exact, 1 - 2**63, 2**63 - 1).astype(np.int64)


class Best:
    """The best `most` (score, id) of each anchor and slot among those put in."""

    def __init__(self, anchors: int, slots: int, most: int):
        self.slots, self.most = slots, most
        self.least = np.full(anchors * slots, np.iinfo(np.int64).min)
        self.kept = (np.zeros(0, np.int64),) * 3

    def put(self, group: np.ndarray, score: np.ndarray, other: np.ndarray) -> None:
        """group: anchor * slots + slot."""
        good = score >= self.least[group]
        group, score, other = (np.concatenate([k, x[good]]) for k, x in zip(self.kept, (group, score, other)))
        order = np.lexsort((other, -score, group))
        group, score, other = group[order], score[order], other[order]
        place = np.arange(len(group)) - np.searchsorted(group, group)
        self.kept = tuple(x[place < self.most] for x in (group, score, other))
        full = place == self.most - 1
        self.least[group[full]] = score[full]


NO_ID = np.iinfo(np.int64).max  # a null id, after all others of its score


def _ids(column: pa.ChunkedArray) -> np.ndarray:
    return pa.compute.fill_null(column, NO_ID).to_numpy()


def tile(scale: float, most: int, positives: bool):
    """A function for the rows and the anchors of a pair of blocks: the best rows of each anchor and slot."""
    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        if not rows.num_rows or not anchors.num_rows:
            return FOUND.empty_table()
        a, own = matrix(anchors["query"], scale), anchors["own"].to_numpy()
        labels, ids = rows["label"].to_numpy(), _ids(rows["vec_id"])
        asks, number = anchors["anchor"].to_numpy(), rows["number"].to_numpy()
        if not positives:
            tops = anchors["tops"].to_pylist()
            slots = max(map(len, tops))
            low = anchors["low"].to_numpy()
        best = Best(len(a), 1 if positives else slots, most)
        step = max(1, TILE // len(a))
        for first in range(0, rows.num_rows, step):
            score = products(a, matrix(rows["vec"].slice(first, step), scale))
            same = own[:, None] == labels[first:first + step]
            if positives:
                who, what = np.nonzero(same & (asks[:, None] != number[first:first + step]))
                best.put(who, score[who, what], ids[first + what])
                continue
            slot = np.empty(score.shape, np.int64)
            for k, top in enumerate(tops):  # a score's slot: the first upper limit that is not below it
                slot[k] = np.searchsorted(np.array(top, np.int64), score[k], side="left")
            inside = ~same & (score >= low[:, None]) & (slot < np.array([len(t) for t in tops])[:, None])
            who, what = np.nonzero(inside)
            best.put(who * slots + slot[who, what], score[who, what], ids[first + what])
        group, score, other = best.kept
        anchor, slot = np.divmod(group, best.slots)
        return pa.Table.from_arrays([pa.array(anchors["anchor"].to_numpy()[anchor]), pa.array(slot, pa.int32()), pa.array(score),
                                     pa.array(other, mask=other == NO_ID)], schema=FOUND)
    return run


def _spread(df: DataFrame, own: Column, other: str, count: int, across: int) -> DataFrame:
    """The rows in blocks by `own`, each with every block of the other side."""
    return df.withColumns({("a" if other == "r" else "r"): F.pmod(F.xxhash64(own), F.lit(count)).cast("int"),
                           other: F.explode(F.sequence(F.lit(0), F.lit(across - 1)))})


def best_of(rows: DataFrame, anchors: DataFrame, blocks: tuple[int, int], work, most: int) -> DataFrame:
    """anchor, slot, score, other: the best `most` of each anchor and slot, over all pairs of blocks."""
    r, a = blocks
    left = _spread(rows.drop("asks"), F.col("number"), "a", r, a).groupBy("a", "r")
    right = _spread(anchors.drop("vec_id"), F.col("anchor"), "r", a, r).groupBy("a", "r")
    found = left.cogroup(right).applyInArrow(work, FOUND_TYPE)
    order = Window.partitionBy("anchor", "slot").orderBy(F.col("score").desc(), F.col("other").asc_nulls_last())
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def mine(vectors: DataFrame, anchor: Column, label: Column, low: int, high: int, positives: int = 5, negatives: int = 10,
         scale: float = 256.0) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each row where `anchor` holds and each of its best `positives` other
    rows of the same label, the best `negatives` rows of other labels that score from `low` to `high` percent of the positive."""
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    rows = C.durable(vectors.where(F.col("embedding").isNotNull() & ~odd).select(
        F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col("embedding").alias("vec"),
        F.coalesce(anchor, F.lit(False)).alias("asks")).where(F.col("label").isNotNull())).withColumn("number", F.monotonically_increasing_id())
    asking = C.durable(rows.where("asks").select(F.col("number").alias("anchor"), "vec_id", F.col("label").alias("own"), F.col("vec").alias("query")))
    n, m = rows.count(), asking.count()
    # Blocks are small enough for a task and many enough for the cluster.
    blocks = (max(-(-n // ROWS), min(3 * C.slots(vectors.sparkSession), -(-n // 512)), 1), max(1, -(-m // ANCHORS)))

    near = best_of(rows, asking, blocks, tile(scale, positives, True), positives)
    first = near.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("place", "score", "other"))).alias("near"))
    first = first.join(asking.select("anchor", F.col("vec_id").alias("anchor_id")), "anchor")
    share = "cast(x.score AS DECIMAL(20, 0)) * {0} / 100"
    limits = C.durable(first.withColumn("windows", F.expr(
        f"filter(transform(near, x -> struct(x.other AS positive_id, x.score AS positive_score, cast(ceil({share.format(low)}) AS LONG) AS low,"
        f" cast(floor({share.format(high)}) AS LONG) AS top)), w -> w.low <= w.top)")).where("size(windows) > 0").withColumns({
            "tops": F.expr("array_sort(array_distinct(transform(windows, w -> w.top)))"), "low": F.expr("array_min(transform(windows, w -> w.low))")}))
    limited = asking.join(limits.select("anchor", "tops", "low"), "anchor")
    found = best_of(rows, limited, blocks, tile(scale, negatives, False), negatives)
    falling = found.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct((-F.col("slot")).alias("below"), "place", "score", "other"))).alias("slots"))
    window = limits.join(falling, "anchor").select("anchor_id", "slots", "tops", F.explode("windows").alias("w"))
    suffix = (f"filter(slice(filter(slots, x -> -x.below < array_position(tops, w.top)), 1, {negatives}), x -> x.score >= w.low)")
    return window.select("anchor_id", "w", F.posexplode(F.expr(suffix)).alias("k", "x")).select(
        "anchor_id", F.col("w.positive_id").alias("positive_id"), (F.col("k") + 1).cast("int").alias("rank"), F.col("x.other").alias("negative_id"),
        F.col("w.positive_score").alias("positive_score"), F.col("x.score").alias("negative_score"))

