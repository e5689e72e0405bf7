"""Rows that a pipeline stage has to leave as they are."""

import collections

import corpus_pipeline


def test_near_duplicates_keep_rows_without_shingles(spark):
    text = " ".join(f"word{i}" for i in range(60))
    plain = [(None, None, "a"), (None, None, "b"), (None, "", "c"), (None, "", "d"), (3, " \n", "e"), (3, " \n", "e"), (4, None, "f")]
    rows = [*plain, (1, text, "x"), (1, text, "x"), (2, text, "x"), (5, text + " more", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [tuple(r) for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()]
    assert collections.Counter(got) == collections.Counter([*plain, (1, text, "x")])
