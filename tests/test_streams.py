import tempfile

from conftest import SF
from pyspark.sql import functions as F

from glasspane.operators import history
from glasspane.sources import tables
from glasspane.streaming import feeds


def _folder(name):
    return tempfile.mkdtemp(prefix=f"glasspane-{name}-", dir="/tmp")


def _checkpoint(spark):
    """The shared folder of the cluster, or a new one in a test."""
    return spark.conf.get("spark.checkpoint.dir", None) or _folder("checkpoint")


def test_reset_on_navigation(spark):
    rows = [(1, 1, 1, "request", "https://hotjar.com/a"), (2, 1, 2, "request", "https://x.hotjar.com/a"), (3, 1, 3, "request", "https://criteo.com/"),
            (4, 1, 4, "navigate", "https://a.test/"), (5, 1, 5, "request", "https://hotjar.com/a"), (6, 2, 6, "request", "https://com/")]
    df = spark.createDataFrame(rows, "event_id long, tab_id long, t long, kind string, url string").withColumn("ts", F.timestamp_seconds("t"))
    got = feeds.badges(feeds.live_match(df)).orderBy("event_id").collect()
    assert [(r.event_id, r.tracker, r["count"]) for r in got] == [(1, "hotjar.com", 1), (3, "criteo.com", 2), (5, "hotjar.com", 1)]


def test_stream_equals_its_batch_twin(spark):
    """Three micro-batches in order of time, each in several files in no order."""
    source, out = _folder("events"), f"badges_{id(spark)}"
    events = tables.read(spark, SF, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    checkpoint = _checkpoint(spark) + f"/{out}"
    cuts = [None, *(F.timestamp_seconds(F.lit(x)) for x in events.select(F.col("ts").cast("double")).approxQuantile("ts", [0.3, 0.7], 0.0)), None]
    got = set()
    for low, high in zip(cuts, cuts[1:]):
        part = events.where((F.lit(True) if low is None else F.col("ts") >= low) & (F.lit(True) if high is None else F.col("ts") < high))
        part.repartition(5, F.rand(3)).sortWithinPartitions(F.desc("ts")).write.mode("append").parquet(source)
        stream = feeds.live_match(tables.as_requests(spark.readStream.schema(events.schema).parquet(source)))
        def keep(batch, _):
            got.update((r.tab_id, r.event_id, r.tracker, r["count"]) for r in batch.collect())
        q = feeds.tab_counts(stream).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
    twin = feeds.badges(feeds.live_match(tables.as_requests(events)))
    assert got == {(r.tab_id, r.event_id, r.tracker, r["count"]) for r in twin.collect()} and got


def test_version_feed_appends_each_text_once(spark):
    source, out = _folder("fetches"), _folder("versions") + "/v"
    fetched = tables.fetches(spark, SF)
    schema = fetched.schema
    checkpoint = _checkpoint(spark) + f"/feed_{id(out)}"
    for part in (fetched.where("fetch_id < 120"), fetched.where("fetch_id >= 120"), fetched.where("fetch_id < 120")):
        part.coalesce(1).write.mode("append").parquet(source)
        q = feeds.version_feed(spark.readStream.schema(schema).parquet(source), out, checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
    stored = spark.read.parquet(out)
    assert stored.count() == stored.select("domain", "content_hash").distinct().count() == history.versions(fetched).count()


def test_result_sink(spark):
    from glasspane.sources import store
    path = _folder("results") + "/r"
    rows = spark.createDataFrame([(1, "a", 50)], "result_id long, domain string, overall_score int").withColumn(
        "analyzed_at", F.to_timestamp(F.lit("2024-01-02 03:04:05")))
    store.save_results(rows, path)
    store.save_results(rows.withColumn("result_id", F.lit(2).cast("long")), path)
    back = store.read_results(spark, path)
    assert back.count() == 2 and str(back.first().analyzed_date) == "2024-01-02"
