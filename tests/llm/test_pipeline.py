import os

import pytest

import corpus_pipeline

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        new = stage(spark, kept, SF)
        assert new.columns == docs.columns
        new = spark.createDataFrame(new.collect(), docs.schema)
        assert new.exceptAll(kept).isEmpty() and new.count() <= kept.count()
        kept = new
    texts = [r["text"] for r in kept.collect()]
    assert len(set(texts)) == len(texts)
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(r["doc_id"] for r in kept.collect()) and all(r["round_trip"] for r in got)


def test_pipeline_stages_take_nulls_and_nothing(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "one two three four", None, "s", 3), (4, "one two three four", "en", None, 3), (None, "alone", "en", "s", 5)]
    for df in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, SF)
            df = spark.createDataFrame(out.collect(), out.schema)
    assert df.count() == 0
