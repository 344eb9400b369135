"""Row-by-row order within a key that may be hot.

A window over one key runs in one task, however many rows the key has. These two cut a key into days first: the window
runs within (key, day), and what a day hands on to the next comes from one summary row per day, of which even a hot key
has few. Rows are exchanged once, by (key, day); the summaries are aggregated before they move. The key is wrapped in a struct, so
that rows without a key meet their own kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _by_day(df: DataFrame, key: str, at: str) -> DataFrame:
    return df.withColumns({"_key": F.struct(F.col(key)), "_day": F.coalesce(F.to_date(at), F.to_date(F.lit("0001-01-01")))})


def _carry(within: DataFrame, days: DataFrame, summary: Column, carried: Column) -> DataFrame:
    """Adds `_carried`: what the days before hand on to the rows of a day."""
    handed = days.groupBy("_key", "_day").agg(summary.alias("_s")).select("_key", "_day", carried.alias("_carried"))
    return within.join(handed, ["_key", "_day"], "left")


def previous(df: DataFrame, key: str, at: str, tie: str, value: str, name: str) -> DataFrame:
    """Adds the value of the row before, by (at, tie) within a key; null for the first row."""
    days = _by_day(df, key, at)
    w = W.partitionBy("_key", "_day").orderBy(at, tie)
    within = days.withColumns({"_nth": F.row_number().over(w), "_lag": F.lag(value).over(w)})
    joined = _carry(within, days, F.max_by(value, F.struct(at, tie)), F.lag("_s").over(W.partitionBy("_key").orderBy("_day")))
    return joined.withColumn(name, F.when(F.col("_nth") == 1, F.col("_carried")).otherwise(F.col("_lag"))).select(
        *df.columns, name)


def running_sum(df: DataFrame, key: str, at: str, tie: str, value: str, name: str) -> DataFrame:
    """Adds the sum of a value up to and including the row, by (at, tie) within a key."""
    days = _by_day(df, key, at)
    before = W.partitionBy("_key").orderBy("_day").rowsBetween(W.unboundedPreceding, -1)
    within = days.withColumn("_sum", F.sum(value).over(
        W.partitionBy("_key", "_day").orderBy(at, tie).rowsBetween(W.unboundedPreceding, 0)))
    joined = _carry(within, days, F.sum(value), F.coalesce(F.sum("_s").over(before), F.lit(0)))
    return joined.withColumn(name, F.col("_sum") + F.col("_carried")).select(*df.columns, name)
