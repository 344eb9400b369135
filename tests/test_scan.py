import datetime as dt
import os
import random
import re
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glasspane.functions import scan
from glasspane.functions import text as T
from glasspane.operators import scoring
from glasspane.plans import catalog
from glasspane.sources import dims, store

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

PATTERNS = sorted({r[4] for r in dims.rule_rows() if r[3] == "regex"})


def test_scan_equals_plain_search():
    """Literals (overlapping, one inside another, at borders of texts), tests of them, and counts against Python's own."""
    rng = random.Random(5)
    lows = ["age", "ages", "health", "health data", "healthcare", "name", "ame", "ein", "a to", "proteção", "zzzzz"]
    words = [*lows, "hea", "lth", "data", "to", "　", "\x85", "\n", ".", "!", "?!", " ", "\xa0x", " ", "eé", ""]
    texts = ["".join(rng.choice(words) + rng.choice(["", " "]) for _ in range(rng.randint(0, 9))) for _ in range(3000)] + ["", "health" * 50_000]
    tests = [*range(len(lows)), ["or", [0, 5]], ["and", [0, ["or", [2, 7]]]], len(lows)]
    column = pa.array(["skipped", *texts])[1:]
    got = scan.scanner(lows, ["Inc"], tests)(column, column).to_pylist()
    space = "[ \\t\\n\\x0b\\f\\r" + T.WIDE_SPACES + "]"
    for text, row in zip(texts, got):
        has = [x in text for x in lows]
        assert [bool(row["bits"][0] >> i & 1) for i in range(len(tests))] == [*has, has[0] or has[5], has[0] and (has[2] or has[7]), False], text
        plain = re.sub(space, " ", text)
        assert (row["words"], row["plain"], row["sentences"]) == tuple(
            len(re.findall(p, plain)) for p in ("[^ ]+", "[^ .!?]+", "[^.!? ][^.!?]*")), text


def test_scan_of_nulls_and_nothing():
    scanned = scan.scanner(["age"], [], [0])
    column = pa.array(["age", None, ""])
    assert [r and r["bits"] for r in scanned(column, column).to_pylist()] == [[1], None, [0]]
    assert scanned(column[:0], column[:0]).to_pylist() == []


@pytest.mark.parametrize("pattern", PATTERNS)
def test_formula_holds_in_every_match(pattern):
    from hypothesis import given, settings
    from hypothesis import strategies as st

    def holds(f, text):
        return f in text if isinstance(f, str) else (all if f[0] == "and" else any)(holds(p, text) for p in f[1])
    found = T.formula(pattern)
    if found:
        @settings(max_examples=15, deadline=None, database=None)
        @given(st.from_regex(pattern, alphabet=st.characters(max_codepoint=127)))
        def check(text):
            m = re.search(pattern, text)
            assert m is None or holds(found, m.group(0))
        check()


def test_every_family_shares_one_scan(policies):
    plan = scoring.analyse(policies("We keep it for 6 months."))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert "contains(" not in T._share_guards("x0", [scoring.rights._analyse("x0.text", "x0.low")])[0][0]


def test_trend_analyses_texts_once(spark):
    plan = catalog.QUERIES["h10_score_trend"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "glasspane_scan" not in plan and "regexp" not in plan


def test_a_day_is_one_file(spark, tmp_path):
    rows = spark.range(0, 4000, 1, 8).select(F.col("id").alias("result_id"), F.timestamp_seconds(F.col("id") % 40 * 86400).alias("analyzed_at"))
    for run in ("a", "b", "a"):
        store.save_results(rows, str(tmp_path / "saved"), run)
    files = list(Path(tmp_path / "saved").rglob("*.parquet"))
    assert len(files) == 80 and store.read_results(spark, str(tmp_path / "saved")).count() == 8000


def _stored(rows):
    return sorted((r["run"], r["result_id"], str(r["analyzed_date"])) for r in rows.collect())


def test_many_days_share_folders(spark, tmp_path):
    path, day = str(tmp_path / "saved"), lambda n: str(dt.date(1970, 1, 1) + dt.timedelta(n))
    rows = spark.range(0, 1301).select(F.col("id").alias("result_id"), F.expr("if(id < 1300, timestamp_seconds((id div 2 - 300) * 86400), NULL)").alias("analyzed_at"))
    want = [(i, day(i // 2 - 300) if i < 1300 else "None") for i in range(1301)]
    for run in ("a/1", "b", "a/1"):
        store.save_results(rows, path, run)
    assert len(list(Path(path).rglob("*.parquet"))) <= 2 * (store.FOLDERS + 1)
    back = store.read_results(spark, path)
    assert back.columns == ["result_id", "analyzed_at", "analyzed_date", "run"]
    assert _stored(back) == sorted((run, *w) for run in ("a/1", "b") for w in want)
    # a later save of some days, new ones too, replaces those and leaves the others of their spans
    some = spark.createDataFrame([(9001, dt.datetime(1970, 1, 3, 5)), (9002, dt.datetime(1971, 3, 1)), (9003, None), (9004, dt.datetime(1999, 1, 1))],
                                 "result_id long, analyzed_at timestamp")
    store.save_results(some, path, "a/1")
    store.save_results(some, path)  # and a run without a name adds to them
    new = [(9001, "1970-01-03"), (9002, "1971-03-01"), (9003, "None"), (9004, "1999-01-01")]
    back = [w for w in _stored(store.read_results(spark, path)) if w[0] in ("a/1", "b")]
    gone = {d for _, d in new}
    assert back == sorted([("b", *w) for w in want] + [("a/1", *w) for w in want if w[1] not in gone] + [("a/1", *w) for w in new])
    assert store.read_results(spark, path).count() == len(back) + 4
    bounded = store.read_results(spark, path, since="1970-01-02", until="1970-01-04")
    assert _stored(bounded) == [w for w in _stored(store.read_results(spark, path)) if "1970-01-02" <= w[2] <= "1970-01-04"]
    assert "stored_from" in bounded._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[-1][:300]


def test_a_run_stays_as_it_was_first_stored(spark, tmp_path):
    path = str(tmp_path / "saved")
    rows = spark.range(0, store.FOLDERS + 5).select(F.col("id").alias("result_id"), F.timestamp_seconds(F.col("id") * 86400).alias("analyzed_at"))
    store.save_results(rows.where("result_id < 3"), path, "007")
    store.save_results(rows.where("result_id < 3"), path, "8")
    store.save_results(rows, path, "007")
    store.save_results(rows, path, "7")
    back = store.read_results(spark, path)
    assert back.count() == 2 * (store.FOLDERS + 5) + 3 and back.where("analyzed_date = DATE '1970-01-02'").count() == 3
    assert len(list(Path(path).glob("analyzed_date=*/run=007"))) == store.FOLDERS + 5


def _bare(value):
    """A fact without its evidence."""
    if isinstance(value, dict):
        return {k: _bare(v) for k, v in value.items() if k not in ("evidence", "context")}
    return [_bare(v) for v in value] if isinstance(value, list) else value


def test_facts_without_evidence_are_the_same_facts(policies):
    docs = policies(
        "We share your email address, passport and health data with third parties. Data is kept for 6 months. Kept for 6 months, for 2 years and for 3 weeks.",
        "We collect your email and location. You have the right to access. We keep it as long as necessary, until you delete your account.",
        "By continuing to use this site you agree. Nothing else, indefinitely.", "", None)
    full, slim = ({r["doc_id"]: r.asDict(True) for r in scoring.analyse(docs, e).collect()} for e in (True, False))
    assert {k: _bare(v) for k, v in full.items()} == {k: _bare(v) for k, v in slim.items()}
    assert full[0]["data_types"][0]["evidence"] and all(d["evidence"] is None for r in slim.values() for d in r["data_types"] or ())
    assert full[0]["retention"]["n_items"] >= 3 and full[1]["rights"]["gdpr_score"] > 0


def test_scores_cut_no_evidence(spark):
    for name in ("a19_overall_score", "a29_alerts", "x1_fleet_common", "l1_summary_context"):
        plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert "concat(…" not in plan, name
    assert "concat(…" in catalog.QUERIES["r19_gdpr_rights"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_texts_of_one_row_group_are_analysed_by_several_tasks(spark, homepages, tmp_path):
    text = F.expr("array_join(transform(sequence(1, 4000), i -> sha2(concat(doc_id, ' ', i), 256)), ' ')")
    rows = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("shop.example").alias("domain"), F.lit(True).alias("policy_found"), text.alias("text"))
    rows.coalesce(1).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs")).withColumn("low", T.searchable(F.col("text")))
    shares = scoring.analyse(docs).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.sum("chars").alias("chars")).collect()
    assert len(shares) > 2 and sum(r["n"] for r in shares) == 40 and sum(r["chars"] for r in shares) == 40 * (4000 * 65 - 1)
    plan = scoring.site_facts(docs, homepages("<p>Hello</p>"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 2  # texts and markup
