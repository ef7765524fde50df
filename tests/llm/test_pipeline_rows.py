"""Decisions on copies are on rows: ids may be null or repeat."""

import corpus_pipeline


def test_repeated_and_null_ids(spark):
    rows = [(5, "a b c"), (5, "a b c"), (None, "a b c"), (3, "other text here"), (7, "quite new"), (7, "other text  here"), (8, "other texthere"), (None, "null only"), (None, "null only"), (9, None), (9, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = [(None, "null only"), (5, "a b c"), (7, "other text  here"), (7, "quite new"), (9, " ")]
    order = lambda r: (r[0] or 0, r[1])
    assert sorted((tuple(r) for r in corpus_pipeline.drop_copies(spark, docs, "").collect()), key=order) == want


def test_near_copies_of_repeated_and_null_ids(spark):
    base = " ".join(f"w{i}" for i in range(100))
    rows = [(5, base), (5, base), (None, base + " x"), (5, "quite other"), (4, base + " y z"), (None, "null only"), (None, "null  only")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()]
    assert sorted((r[0] or 0, " ".join(r[1].split())) for r in got) == [(0, "null only"), (4, base + " y z"), (5, "quite other")]
