import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from glasspane.functions import text as T  # noqa: E402
from glasspane.streaming.feeds import STATE_STORE  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    s = (SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4")
         .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.streaming.stateStore.providerClass", STATE_STORE).getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def policies(spark):
    """Makes policy rows from texts."""
    from pyspark.sql import functions as F

    def make(*texts):
        rows = [(i, "shop.example", True, t) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id long, domain string, policy_found boolean, text string").withColumn(
            "low", T.searchable(F.col("text")))
    return make


@pytest.fixture(scope="session")
def homepages(spark):
    """Makes page rows from markup of one site."""
    def make(*htmls, cookies=()):
        rows = [(i, "https://shop.example/", "shop.example", "https://shop.example", h, list(cookies))
                for i, h in enumerate(htmls)]
        return spark.createDataFrame(
            rows, "page_id long, url string, domain string, base string, html string, cookies array<string>")
    return make


@pytest.fixture(scope="session")
def values(spark):
    """Values of SQL expressions over one input column x."""
    def run(expression, *inputs, kind="string"):
        df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
        return [r[0] for r in df.orderBy("i").selectExpr(f"{expression} AS v").collect()]
    return run
