import duckdb
import pytest
from conftest import SF

import __spark_entry__ as entry

SAMPLE = ("x0_rights_by_source", "a10_rights_coverage", "r17_dark_patterns", "a5_tracker_resources", "h1_versions", "w5_badges",
          "p16_discovery", "l3_answers", "j1_host_to_tracker")


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["domain", "docs", "mean_gdpr", "mean_ccpa", "best_gdpr"] and df.count() == 20


def test_every_check_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.oracle_sql()) > 140


@pytest.mark.parametrize("name", SAMPLE)
def test_same_rows_as_the_check_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "events", "conversations", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    want = sorted(tuple(map(str, r)) for r in cur.fetchall())
    df = entry.queries()[name](spark, SF).select(*columns)
    assert sorted(tuple(map(str, r)) for r in df.collect()) == want and want
