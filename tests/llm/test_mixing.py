from fractions import Fraction

import duckdb
import pytest
from pyspark.sql import functions as F

from glasspane.llm import mixing as M
from glasspane.llm import queries as Q


@pytest.mark.parametrize("weights, rest", [({"a": 5, "b": 3, "c": 1}, 1), ({f"s{i}": 1 + i for i in range(30)}, 7), ({"a": 1000}, 1), ({"a": 0.123, "b": 0.57}, 0.3)])
def test_less_than_one_block_from_the_share(weights, rest):
    share = M.exact(weights, rest)
    table = M.timetable(share)
    cycle = sum(share.values())
    assert sorted(s for x in table.values() for s in x) == list(range(cycle))
    total = sum(Fraction(str(v)) for v in weights.values()) + Fraction(str(rest))
    for k, slots in table.items():
        want = Fraction(str(weights.get(k, rest))) / total
        for t in range(cycle + 1):
            assert abs(sum(s < t for s in slots) - t * want) < 1


def test_less_than_one_block_from_the_targets_over_many_cycles(spark):
    total = sum(Fraction(v) for v in Q.TARGETS.values()) + Fraction(Q.REST_WEIGHT)
    docs = spark.range(18600).selectExpr("id AS doc_id", "'x' AS text", "concat('src', id % 20) AS source")
    slots = {}
    for x in M.mix(docs, Q.TARGETS, Q.REST_WEIGHT, block=1).select("mix_pool", "mix_slot").collect():
        slots.setdefault(x["mix_pool"], []).append(x["mix_slot"])
    for k, v in Q.TARGETS.items():
        for n, slot in enumerate(sorted(slots[k])):
            assert abs(n - slot * Fraction(v) / total) < 1 and abs(n + 1 - (slot + 1) * Fraction(v) / total) < 1


def test_shares_are_the_weights_or_refused():
    assert M.exact({"a": 0.1, "b": 0.25}, 0.05) == {"a": 2, "b": 5, "": 1}
    with pytest.raises(ValueError):
        M.exact({"a": 0.1234567}, 1)


def test_same_rows_as_the_check_query(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    cur = con.execute(Q.CHECKS["op2_mixing"])
    columns = [d[0] for d in cur.description]
    want = sorted(map(str, cur.fetchall()))
    assert sorted(str(tuple(r)) for r in Q.mix_sources(spark, sf).select(*columns).collect()) == want


def test_small_parts_give_the_same_order(spark, sf):
    docs = Q.read(spark, sf, "documents")
    ways = [sorted(map(tuple, M.mix(docs, Q.TARGETS, 2, part_rows=n).select("doc_id", "mix_position", "mix_slot").collect())) for n in (4096, 3)]
    assert ways[0] == ways[1]


def test_odd_rows(odd, none):
    out = M.mix(odd, {"src0": 2, "src1": 1}, 1)
    rows = out.collect()
    assert {r[c] for r in rows for c in ("mix__digest", "mix__part", "found")} == {"own"}
    assert M.mix(odd.withColumn("mix_slot", F.lit("own")), {"src0": 2}, 1).columns == [*odd.columns, "mix_pool", "mix_rank", "mix_block", "mix_slot", "mix_position"]
    assert sorted(r["mix_position"] for r in rows) == list(range(len(rows))) and set(odd.columns) < set(out.columns)
    assert {r["mix_pool"] for r in rows} == {"src0", "src1", ""}
    assert M.mix(none, {"src0": 2}, 1).count() == 0
    with pytest.raises(ValueError):
        M.mix(odd, {"src0": 2}, 0)
