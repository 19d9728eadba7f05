"""Every registered query against its SQL, and the rows-only ones against their contract."""

import pytest
from pyspark.sql import functions as F

from codeset_engine.plans.queries import ORACLES, QUERIES
from oracle import compare, connect

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = connect(SF)
    yield con
    con.close()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    assert compare(spark, duck, QUERIES[name], ORACLES[name], SF) is None


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_separator_chunks_cover_the_whole_texts(spark):
    chunks = QUERIES["chunk_separator"](spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    per_doc = chunks.join(docs, "doc_id").groupBy("doc_id").agg(
        F.max(F.col("start_index") + F.length("chunk")).alias("end"),
        F.first(F.length("text")).alias("length"),
        F.bool_and(F.col("chunk") == F.substring("text", F.col("start_index") + 1,
                                                 F.length("chunk"))).alias("same"))
    assert per_doc.filter("end <> length OR NOT same").count() == 0
    assert per_doc.count() == docs.filter("length(text) > 0").count()


def test_entry_runs(spark):
    import __spark_entry__ as entry
    df = entry.entry(spark)
    assert df.count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
