import os

import duckdb
import pytest
from pyspark.sql import functions as F

# Rows that every operator must stand: nulls, empty and blank texts, a very long one, ties, repeated rows.
LONG = " ".join(f"w{i % 97} x{i % 89} y{i % 83}" for i in range(20000))
ODD = [(None, "no id at all, but some words in a row", "en", "src0", 1), (1, None, None, None, None), (2, "", "en", "src1", 0),
       (3, " \n\t ", "en", "", 4), (4, LONG, "en", "src1", len(LONG)), (5, "one two three", "en", "src9", 13),
       (5, "one two three", "en", "src9", 13), (6, "same words here again and again", "de", "elsewhere", 31),
       (7, "same words here again and again", "de", "src0", 31), (None, None, None, "src0", None)]
KIND = "doc_id long, text string, lang string, source string, n_chars long"
# Names that an operator could use itself.
CLASH = ("score", "label", "body", "row", "band", "held_out", "spans", "base", "words", "size", "root", "n", "class_id", "verdict", "host",
         "found", "pii__key", "pii__base", "pii__new", "pii__spans", "key", "mix__digest", "mix__part", "mix__row", "mix__upto", "mix__here", "kind", "x")


@pytest.fixture(scope="session")
def odd(spark):
    """Odd rows with further columns whose names an operator may use itself."""
    return spark.createDataFrame(ODD, KIND).withColumns({k: F.lit("own") for k in CLASH})


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], KIND)


@pytest.fixture(scope="session")
def marks(spark):
    rows = [(None, 1, 0), (1, None, None), (2, 0, 1), (2, 0, 1), (4, 1, 0), (6, 1, 1), (7, 0, 0), (99, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int").withColumn("text", F.lit("own"))


@pytest.fixture(scope="session")
def sf():
    return os.environ.get("TEST_LLM_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="session")
def table(sf):
    """Rows of a table as tuples, read without Spark."""
    def rows(sql, name="documents"):
        return duckdb.sql(sql.replace(name, f"'{sf}/{name}.parquet'", 1)).fetchall()
    return rows
