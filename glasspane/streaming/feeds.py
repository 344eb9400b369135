"""Live streams: tracker requests per browser tab, and policy versions as they arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import text as T
from ..functions import urls as U
from ..operators.ordered import running_sum
from ..operators.trackers import badge
from ..rules import trackers as R

_MAX_LABELS = max(h.count(".") + 1 for h in R.LIVE_HOSTS)


def live_match(requests: DataFrame) -> DataFrame:
    """Adds `tracker` (watched host equal to or above the host asked for) and its `risk`.

    The list of watched hosts is fixed and short, so it is a literal; a stream needs no join and no state for it.
    A bare top-level domain is never tried.
    """
    hosts = f"filter({U.suffixes(U.host('url'))}, s -> contains(s, '.') AND array_contains({T.literals(R.LIVE_HOSTS)}, s))"
    risk = f"if(array_contains({T.literals(R.LIVE_HIGH_RISK)}, tracker), 'high', 'medium')"
    return requests.withColumn("tracker", F.expr(f"try_element_at({hosts}, 1)")).withColumn(
        "risk", F.expr(f"if(tracker IS NULL, NULL, {risk})"))


def tumbling(matched: DataFrame, width: str = "1 hour", delay: str | None = None) -> DataFrame:
    """Tracker requests per time window (our extension)."""
    rows = matched.where(F.col("tracker").isNotNull() & (F.col("kind") == "request"))
    rows = rows.withWatermark("ts", delay) if delay else rows
    return rows.groupBy(F.window("ts", width).alias("w"), "tracker").agg(F.count("*").alias("n")).select(
        F.col("w.start").alias("window_start"), "tracker", "n")


def epochs(matched: DataFrame) -> DataFrame:
    """Adds `epoch`: how often a tab was cleared (navigation or close) up to an event."""
    cleared = matched.withColumn("_clear", F.col("kind").isin("navigate", "close").cast("int"))
    return running_sum(cleared, "tab_id", "ts", "event_id", "_clear", "epoch").drop("_clear")


def first_seen(matched: DataFrame) -> DataFrame:
    """First request to each tracker of a tab since it was cleared: tab_id, epoch, tracker, event_id, ts, risk."""
    hits = epochs(matched).where(F.col("tracker").isNotNull() & (F.col("kind") == "request"))
    return hits.groupBy("tab_id", "epoch", "tracker").agg(
        F.min_by(F.struct("event_id", "ts", "risk"), F.struct("ts", "event_id")).alias("f")).select(
        "tab_id", "epoch", "tracker", "f.*")


def badges(matched: DataFrame) -> DataFrame:
    """Running number of distinct trackers of a tab, after each new one, with the colour of its badge."""
    first = first_seen(matched).withColumns({"_one": F.lit(1), "_tab": F.struct("tab_id", "epoch")})
    counted = running_sum(first, "_tab", "ts", "event_id", "_one", "count")
    return counted.withColumn("level", F.expr(badge("count"))).drop("_one", "_tab")


class TabTrackers(StatefulProcessor):
    """Distinct trackers of a browser tab since its last navigation, in order of first appearance."""

    def __init__(self, idle_ms: int | None = None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        ttl = {"ttlDurationMs": self.idle_ms} if self.idle_ms else {}
        self.seen = handle.getMapState("seen", "tracker string", "nth int", **ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        count = sum(1 for _ in self.seen.keys()) if self.seen.exists() else 0
        out = []
        for r in pd.concat(list(rows)).sort_values(["ts", "event_id"]).itertuples():
            if r.kind in ("navigate", "close"):
                self.seen.clear()
                count = 0
            elif r.tracker and not self.seen.containsKey((r.tracker,)):
                count += 1
                self.seen.updateValue((r.tracker,), (count,))
                out.append((key[0], r.event_id, r.ts, r.tracker, r.risk, count))
        yield pd.DataFrame(out, columns=["tab_id", "event_id", "ts", "tracker", "risk", "count"])

    def close(self) -> None:
        pass


STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = "tab_id long, event_id long, ts timestamp, tracker string, risk string, count int"


def tab_counts(matched: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """Streaming form of `badges`. Needs the RocksDB state store (STATE_STORE); idle tabs may expire.

    The events of a tab in one micro-batch (short rows, as many as a trigger admits) are put in order, whichever file or
    partition they come from.
    """
    rows = matched.where(F.col("tracker").isNotNull() | F.col("kind").isin("navigate", "close"))
    return (rows.select("tab_id", "event_id", "ts", "kind", "tracker", "risk").groupBy("tab_id")
            .transformWithStateInPandas(TabTrackers(idle_ms), OUTPUT, "Update",
                                        "ProcessingTime" if idle_ms else "None")
            .withColumn("level", F.expr(badge("`count`"))))


def version_feed(fetches: DataFrame, path: str, checkpoint: str):
    """Appends every text of a stream that its domain has not had before to a table of versions.

    The hashes that a domain has had are keyed state, so a batch looks at its own rows only. Of equal texts that arrive together, any one opens
    the version.
    """
    hashed = fetches.select("domain", F.sha2("text", 256).alias("content_hash"), "fetched_at", "fetch_id", "policy_url", F.col("text").alias("raw_text"))
    return (hashed.dropDuplicates(["domain", "content_hash"]).writeStream.format("parquet").outputMode("append")
            .option("path", path).option("checkpointLocation", checkpoint))
