"""The registered queries against DuckDB, and the pipeline's stages against their operators."""

import importlib
import zlib

import pytest

from basalt.llm import queries as Q
from comparing import both, connection

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_same_as_duckdb(spark, name):
    got, want = both(spark, connection(SF), Q.queries()[name], Q.oracle_sql()[name], SF)
    assert got == want


def test_pipeline(spark):
    pipeline = importlib.import_module("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = docs
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == first.columns
        assert docs.count() <= first.count()
    assert docs.count() > 0.8 * first.count()
    packed = pipeline.run(spark, SF)
    assert packed.select("doc_id").distinct().count() == docs.count()


def test_the_pipeline_gives_token_ids(spark):
    pipeline = importlib.import_module("corpus_pipeline")
    docs = spark.createDataFrame([(1, "some words to pack", "en", "s", 18), (2, None, None, None, None), (3, "more " * 9000, "en", "s", 45000)], "doc_id long, text string, lang string, source string, n_chars long")
    rows = pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r["doc_id"] for r in rows} >= {1, 3}
    assert all(len(r["ids"]) == 4 * r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"] for r in rows)


def test_odd_rows_through_the_pipeline(spark, odd_docs, no_docs):
    """Nulls, empty and long texts, repeated rows and clashing columns pass every stage; so does an empty table."""
    pipeline = importlib.import_module("corpus_pipeline")
    pii = " write to anna.b@mail.example.com "
    docs = odd_docs
    empty = no_docs
    for name, stage in pipeline.STAGES[:-1]:
        before = docs
        docs, empty = stage(spark, docs, SF), stage(spark, empty, SF)
        assert docs.columns == odd_docs.columns and docs.schema == odd_docs.schema, name
        assert docs.exceptAll(before).count() == 0 and empty.count() == 0, name
        if name == "language_id":  # this stage takes what has no letter; odd rows go on to the others all the same
            assert docs.filter("text is null or trim(text) = ''").count() == 0
            docs = odd_docs
    kept = sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in docs.select("doc_id").collect())
    assert kept == [-1, 1, 2, 3, 4, 7, 8, 10, 11, 12]
    packed = pipeline.STAGES[-1][1](spark, docs, SF)
    assert sorted({-1 if r["doc_id"] is None else r["doc_id"] for r in packed.select("doc_id").collect()}) == kept
    assert pipeline.STAGES[-1][1](spark, empty, SF).count() == 0
    own = spark.createDataFrame([(1, "the of and in" + pii + "an on er re"), (2, None)], "doc_id long, text string")
    rows = {r["doc_id"]: r["text"] for r in pipeline.STAGES[3][1](spark, own, SF).collect()}
    assert "anna.b@" not in rows[1] and rows[2] is None


def test_one_row_of_everything_null(spark):
    pipeline = importlib.import_module("corpus_pipeline")
    docs = spark.createDataFrame([(None,) * 5] * 3, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in pipeline.STAGES[1:-1]:
        docs = stage(spark, docs, SF)
        assert docs.count() == 3
    assert pipeline.STAGES[-1][1](spark, docs, SF).count() == 3
    assert pipeline.STAGES[0][1](spark, docs, SF).count() == 0
