"""Queries against their SQL on texts that the given tables seldom hold."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera import plans
from tessera.functions import text as T


@pytest.fixture
def against_sql(spark, tmp_path):
    def run(name, texts):
        spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
        held = duckdb.connect()
        held.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
        want = held.sql(plans.ORACLES[name])
        got = plans.QUERIES[name](spark, str(tmp_path)).select(*want.columns)
        return sorted(map(tuple, got.collect())), sorted(want.fetchall())

    return run


def test_years_are_words(against_sql):
    got, want = against_sql("doc_year_mentions", ["1321, 12345 a1999 1999b _2001 4e93f1325\" 2024.", "è1850è 1850-1851", "١٩٩٩ 1999", None, ""])
    assert got == want and dict(got) == {1321: 1, 1850: 2, 1851: 1, 1999: 1, 2024: 1}


def test_texts_with_marker_lines_are_whole(against_sql):
    odd = ["a\n*** end of b\nc", "a*** Endo b\nc", "*** START\n*** end\nx", " *** end", "|a\n|*** end\n||b\r|", "a\n", "\n", "", None]
    got, want = against_sql("doc_between_markers", [t for t in odd for _ in range(4)])  # each with and without either marker
    assert got == want


def test_only_a_line_that_begins_with_a_marker_is_one(spark):
    made = spark.createDataFrame([("x\n  *** Start of\na *** end\n*** start\nb\n*** END\ny",)], "t string")
    assert made.select(T.between_markers(F.col("t"), "*** start", "*** end")).first()[0] == "a *** end\n*** start\nb"
