"""Sources mixed to target weights by Pfair scheduling.

Every source is cut into blocks of `block` rows. A source of weight w gets its k-th block released at slot floor((k - 1) / w) and
due at ceil(k / w); of the released blocks, the one due first takes the next slot. Weights are whole shares of a cycle,
as long as their common denominator makes it, so the shares are the targets themselves. The schedule of one cycle repeats for ever: it depends on the weights alone, and the slot of a block is then arithmetic. At
every slot each source has had its share of the slots so far to within less than one block, as long as it has rows;
the slots of a source that has run out are passed over, so every row is placed exactly once.

Rows are ranked within their source in the order of a digest of id and text. The rank is a window within (source, prefix
of the digest), with prefixes chosen so that a part holds a few thousand rows, plus the count of the parts before; so a
source with a third of all rows is spread like the others. Only counts by source are brought to the driver.

Sources that have no weight, and rows without a source, share the positive weight `rest` as one pool. Rows may repeat, ids and texts may
be null: rows equal in id and text have neighbouring ranks, whichever comes first. An empty table gives an empty one. Columns of the table
named like one that mix() adds are replaced; all others stay, whatever their names.
"""

from __future__ import annotations

import json
from fractions import Fraction
from itertools import accumulate
from math import gcd, lcm

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

REST = ""
LONGEST = 20000  # slots of an exact cycle, at most


def exact(weights: dict[str, float], rest: float) -> dict[str, int]:
    """Slots of each source in the shortest cycle that has the weights exactly, as they are written in decimals."""
    wanted = {**{k: Fraction(str(v)) for k, v in weights.items()}, REST: Fraction(str(rest))}
    if min(wanted.values()) <= 0 or REST in weights:
        raise ValueError("positive weights for `rest` and all named sources are needed")
    whole = lcm(*[v.denominator for v in wanted.values()])
    out = {k: int(v * whole) for k, v in wanted.items()}
    out = {k: v // gcd(*out.values()) for k, v in out.items()}
    if sum(out.values()) > LONGEST:
        raise ValueError(f"the weights need a cycle of {sum(out.values())} slots; give weights of fewer digits")
    return out


def timetable(share: dict[str, int]) -> dict[str, list[int]]:
    """Slots that each source takes in a cycle: earliest deadline first among the released blocks."""
    cycle, done, out = sum(share.values()), dict.fromkeys(share, 0), {k: [] for k in share}
    for slot in range(cycle):
        released = [k for k in share if done[k] * cycle // share[k] <= slot and done[k] < share[k]]
        due = min(released, key=lambda k: (-(-(done[k] + 1) * cycle // share[k]), -Fraction(share[k], cycle), k))
        out[due].append(slot)
        done[due] += 1
    return out


def _literal(value, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(value)), kind)


def mix(docs: DataFrame, weights: dict[str, float], rest: float, block: int = 64, part_rows: int = 4096) -> DataFrame:
    """The rows of docs with mix_pool, mix_rank (from 0 within the pool), mix_block (from 1), mix_slot and mix_position (from 0)."""
    share = exact(weights, rest)
    cycle = sum(share.values())
    slots, pools = timetable(share), sorted(share)
    own = "mix"
    while any(c.startswith(f"{own}__") for c in docs.columns):
        own += "_"
    digest, part, row, upto, here = (f"{own}__{k}" for k in ("digest", "part", "row", "upto", "here"))
    named = F.coalesce(F.col("source").isin([k for k in pools if k != REST]), F.lit(False))
    rows = docs.withColumn("mix_pool", F.when(named, F.col("source")).otherwise(F.lit(REST)))
    count = {r["mix_pool"]: r["count"] for r in rows.groupBy("mix_pool").count().collect()}
    digits = 1
    while 16 ** digits * part_rows < max(count.values(), default=0):
        digits += 1
    rows = rows.withColumn(digest, F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.coalesce("text", F.lit("")))))
    rows = rows.withColumn(part, F.substring(digest, 1, digits))
    before = (rows.groupBy("mix_pool", part).agg(F.count("*").alias(here)).select(
        "mix_pool", part, F.sum(here).over(W.partitionBy("mix_pool").orderBy(part)).alias(upto), here))
    rows = (rows.withColumn(row, F.row_number().over(W.partitionBy("mix_pool", part).orderBy(digest)))
            .join(before, ["mix_pool", part]).withColumn("mix_rank", F.col(upto) - F.col(here) + F.col(row) - 1))
    taken = {k: list(accumulate(int(t in held) for t in range(-1, cycle - 1))) for k, held in ((k, set(slots[k])) for k in pools)}  # slots before each
    table = [{"n": count.get(k, 0), "c": share[k], "taken": taken[k]} for k in pools]
    c = F.element_at(_literal(share, "map<string,long>"), F.col("mix_pool"))
    at = F.element_at(_literal(slots, "map<string,array<long>>"), F.col("mix_pool"))
    rows = rows.withColumn("mix_block", F.expr(f"mix_rank div {block} + 1"))
    turn = F.col("mix_block") - 1
    rows = rows.withColumn("mix_slot", F.floor(turn / c) * cycle + F.get(at, (turn % c).cast("int")))
    placed = F.aggregate(_literal(table, "array<struct<n:long,c:long,taken:array<long>>>"), F.lit(0).cast("long"), lambda total, x: total + F.least(
        x["n"], F.lit(block) * (F.floor(F.col("mix_slot") / cycle) * x["c"] + F.get(x["taken"], (F.col("mix_slot") % cycle).cast("int")))))
    rows = rows.withColumn("mix_position", placed + F.col("mix_rank") - F.lit(block) * (F.col("mix_block") - 1)).drop(digest, part, upto, here, row)
    added = ["mix_pool", "mix_rank", "mix_block", "mix_slot", "mix_position"]
    return rows.select(*[c for c in docs.columns if c not in added], *added)
