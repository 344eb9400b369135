"""Tables that jobs write to."""

from __future__ import annotations

import hashlib
import re
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A run that first comes with more days has spans of days as folders.
FOLDERS = 100
# Days of a span, counted from 1970-01-01.
SPANS = tuple(2 ** k for k in range(17))
# Subfolder of runs stored by span, and its folders: digest of the run's name, days of a span, first day of the span.
SPANNED, BY = "spanned", ("stored_run", "stored_days", "stored_from")


def save_results(scored: DataFrame, path: str, run: str | None = None) -> None:
    """Stores scored sites with their documents, by day of analysis and run.

    A run that is repeated, whole or after a failure, replaces its own days and nothing else, so no result is stored twice; runs of other
    names, and each run without a name, add to the same days. Rows without analyzed_at are kept under a day of their own.
    The rows of a day are gathered before they are written (a very large day stays split), so a day costs one file and not one per task.
    A folder costs far more than a row: a run that first comes with more than FOLDERS days is stored by spans of 2, 4, 8 ... days with the day
    in the rows, in FOLDERS folders at most (and one for rows without a day). A run stays as its first save stored it; days of a span that a
    later save leaves out are written again with the others. The days are listed before (one number a day on the driver): store rows with a
    costly analyzed_at first (kept).
    """
    named, run, spark = bool(run), run or uuid.uuid4().hex, scored.sparkSession
    rows = scored.withColumns({"analyzed_date": F.to_date("analyzed_at"), "run": F.lit(run)})
    key, days = "r" + hashlib.sha256(run.encode()).hexdigest(), _days(rows)
    old = _opened(spark, f"{path}/{SPANNED}/{BY[0]}={key}") if named else None
    if old is not None:
        span = int(re.search(f"/{BY[1]}=([0-9]+)/", old.inputFiles()[0])[1])
    else:
        span = next((n for n in SPANS if len({d // n for d in days}) <= FOLDERS), SPANS[-1])
        if span > 1 and named and _has_days(spark, path, run):
            span = 1
    if span == 1:
        _put(rows, path, ("analyzed_date", "run"))
        return
    if old is not None:
        near = old.where(F.unix_date(BY[2]).isin(sorted({d // span * span for d in days})))
        if rest := sorted(_days(near) - days):
            rows = rows.unionByName(near.where(F.unix_date("analyzed_date").isin(rest)).drop(*BY), allowMissingColumns=True)
    first = F.expr(f"date_sub(analyzed_date, pmod(unix_date(analyzed_date), {span}))")
    _put(rows.withColumns(dict(zip(BY, (F.lit(key), F.lit(span), first)))), f"{path}/{SPANNED}", BY)


def read_results(spark: SparkSession, path: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """Stored results; with bounds (days, both included) only the folders that hold those days are read."""
    spanned = _opened(spark, f"{path}/{SPANNED}")
    single = spark.read.parquet(path) if spanned is None else _opened(spark, f"{path}/analyzed_date=*", path)
    for day, test in ((since, ">="), (until, "<=")):
        if day is not None and single is not None:
            single = single.where(f"analyzed_date {test} DATE '{day}'")
        if day is not None and spanned is not None:
            bound = f"date_add({BY[2]}, {BY[1]} - 1)" if test == ">=" else BY[2]
            spanned = spanned.where(f"{bound} {test} DATE '{day}' AND analyzed_date {test} DATE '{day}'")
    if spanned is None:
        return single
    spanned = spanned.drop(*BY)
    if single is None:
        return spanned
    return single.withColumns({"analyzed_date": F.col("analyzed_date").cast("date"), "run": F.col("run").cast("string")}).unionByName(
        spanned, allowMissingColumns=True)


def _days(rows: DataFrame) -> set[int]:
    """The days that the rows have, counted from 1970-01-01."""
    return {r[0] for r in rows.where("analyzed_date IS NOT NULL").select(F.unix_date("analyzed_date")).distinct().collect()}


def _has_days(spark: SparkSession, path: str, run: str) -> bool:
    """Whether the run has folders of single days."""
    try:
        found = spark.read.schema("analyzed_date date, run string").option("basePath", path).parquet(f"{path}/analyzed_date=*")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return not found.where(F.col("run") == run).isEmpty()


def _opened(spark: SparkSession, path: str, base: str | None = None) -> DataFrame | None:
    """The stored rows, or None where nothing is stored."""
    try:
        return spark.read.option("basePath", base or path).parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def _put(rows: DataFrame, path: str, by: tuple[str, ...]) -> None:
    """Writes the rows in folders, the rows of a folder gathered; folders of the same names are replaced."""
    rows.hint("rebalance", *[F.col(c) for c in by]).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def shared(spark: SparkSession, name: str) -> str:
    """A new folder in the one that the cluster shares (spark.checkpoint.dir; where that is unset, in the warehouse)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints"
    return f"{root}/{name}-{uuid.uuid4().hex}"


def kept(rows: DataFrame, name: str) -> DataFrame:
    """The rows written once to the shared folder and read from there: for small tables that several later steps read."""
    path = shared(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
