import os

import pytest

import corpus_pipeline as P

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def test_stages_hand_documents_on(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    assert [n for n, _ in P.STAGES] == ["language identification", "SimHash near duplicates", "suffix-array repeats", "source mixing", "best-fit packing"]
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        counts.append(docs.count())
        if k < len(P.STAGES) - 1:
            assert docs.schema.simpleString() == before.schema.simpleString()
            assert {r.doc_id for r in docs.select("doc_id").collect()} <= {r.doc_id for r in before.select("doc_id").collect()}
    assert columns == before.columns
    assert counts[0] == counts[1] > counts[2] == counts[3]
    assert {"sequence_id", "offset"} <= set(docs.columns)
    ends = [r[0] for r in docs.selectExpr("offset + length").collect()]
    assert max(ends) <= 4096


def test_stages_take_odd_documents(spark):
    rows = [(1, None, "en", None, None), (2, "", None, "s", 0), (None, "some words of a text", None, "s", 20), (3, "some words of a text", "en", "s", 20), (4, "123", "en", None, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SF)
        docs.collect()
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in P.STAGES:
        empty = stage(spark, empty, SF)
        assert empty.collect() == []


def test_run_applies_all(spark):
    assert P.run(spark, SF).count() > 0
