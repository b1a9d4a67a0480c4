import pytest

import corpus_pipeline
from oracle import same
from textloom.llm.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, sf, name):
    same(spark, QUERIES[name], ORACLES[name], sf)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_a_row_for_each_document(spark, name):
    sf = "/root/testdata/sf0.001"
    assert QUERIES[name](spark, sf).count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_pipeline_stages(spark):
    """Each stage against its operator's rule on a small table with planted cases."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    base = docs.filter("length(text) > 2000").orderBy("doc_id").first()
    planted = [(9001, None, "en"), (9002, "12 34 --", "en"), (9003, f"{base.text[:300]} {item} {base.text[300:600]}x", base.lang), (9004, None, None)]
    more = spark.createDataFrame([(i, t, lang, "p", 0) for i, t, lang in planted], docs.schema)
    rows = docs.unionByName(more)
    for name, stage in corpus_pipeline.STAGES:
        before, rows = rows, stage(spark, rows, sf).cache()
        if name != "encode":
            assert rows.columns == docs.columns
        left = {r.doc_id for r in rows.select("doc_id").collect()}
        if name == "language":
            assert not left & {9001, 9002, 9004} and left >= {r.doc_id for r in docs.filter("text rlike '[a-z]{3}'").collect()}
        if name == "line_dedup":
            assert before.count() == rows.count()
        if name == "benchmark":
            assert 9003 not in left
    assert rows.count() > 150
