"""Joins that keep their balance when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARE = 1000


def _free(name: str, *frames: DataFrame) -> str:
    """A column name that no table uses."""
    used = {c.lower() for f in frames for c in f.columns}
    while name in used:
        name += "_"
    return name


def attach(rows: DataFrame, once: DataFrame, key: str, share: int = SHARE) -> DataFrame:
    """Left join of rows to a table with at most one row per key.

    A key that holds at least one of `share` parts of the rows is hot: there are at most `share` of them, whatever the size of the
    table, so they are broadcast. A hot key's rows are spread over as many parts as it holds shares, and only its row of `once` is copied
    to each part. Other keys meet by key. Rows without a key stay, with nulls. Rows equal in all columns stay together.
    The two tables share no other column.
    """
    part, hot_key, parts = (_free(n, rows, once) for n in ("part", "hot_key", "parts"))
    sizes = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(hot_key)).agg(F.count("*").alias(parts))
    total = rows.agg(F.count("*")).scalar()
    hot = F.broadcast(sizes.where(F.col(parts) * share >= total).select(hot_key, F.ceil(F.col(parts) * share / total).alias(parts)))
    # Rows without a key go to parts of their own, as they meet nothing.
    spread = F.pmod(F.xxhash64(*[c for c in rows.columns if c != key]), F.coalesce(F.col(parts), F.when(F.col(key).isNull(), share), F.lit(1)))
    left = rows.join(hot, F.col(key) == F.col(hot_key), "left").withColumn(part, spread.cast("int")).drop(hot_key, parts)
    right = once.where(F.col(key).isNotNull()).join(hot, F.col(key) == F.col(hot_key), "left").withColumn(
        part, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(parts), F.lit(1)).cast("int") - 1))).drop(hot_key, parts)
    return left.join(right, [key, part], "left").drop(part)
