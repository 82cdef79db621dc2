"""Rows that near_dedup keeps where ids are null or repeat."""

import corpus_pipeline


def test_null_and_repeated_ids(spark):
    text = " ".join(f"w{k}" for k in range(100))
    rows = [
        (None, "alone without an id"), (None, "another one alone"), (5, "one text of id five"), (5, "other words under five"), (None, text),
        (9, text + " more"), (8, text), (8, text), (3, None), (4, " \n"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    expected = [(3, None), (5, "one text of id five"), (5, "other words under five"), (8, text), (None, "alone without an id"), (None, "another one alone")]
    for parts in (1, 6):
        found = [tuple(r) for r in corpus_pipeline.near_dedup(spark, df.repartition(parts), "").collect()]
        assert sorted(found, key=repr) == sorted(expected, key=repr)
    assert corpus_pipeline.near_dedup(spark, df.where("false"), "").count() == 0
