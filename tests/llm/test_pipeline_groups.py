"""One row of every group of near copies, repeated rows included."""

import corpus_pipeline

TEXT = "one two three four five six seven eight nine ten"


def test_one_row_of_each_group_stays(spark):
    rows = [(1, TEXT, "b"), (1, TEXT, "b"), (1, TEXT, "a"), (2, TEXT, "c"), (3, "other words " * 9, "d"), (4, "", "e"), (None, TEXT, "f"), (None, TEXT, "f")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    found = corpus_pipeline.keep_one_of_each(spark, docs, "")
    assert found.columns == docs.columns
    kept = sorted((r["doc_id"] or 0, r["source"]) for r in found.collect())
    assert kept == [(0, "f"), (0, "f"), (1, "a"), (3, "d"), (4, "e")]


def test_without_repeated_rows_and_without_rows(spark):
    docs = spark.createDataFrame([(2, TEXT, "b"), (1, TEXT, "a")], "doc_id bigint, text string, source string")
    assert [r["doc_id"] for r in corpus_pipeline.keep_one_of_each(spark, docs, "").collect()] == [1]
    assert corpus_pipeline.keep_one_of_each(spark, docs.where("false"), "").collect() == []
