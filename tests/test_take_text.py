"""The first bytes of texts of any length and alphabet."""

from keyspan import catalog


def test_take_that_cuts_a_code_point(spark, tmp_path):
    texts = ["", "short", "12345678", "123456789", "1234567é", "é" * 9, "日本語の", "123456\U0001f600", None]
    rows = [(k, t) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: (r["n"], r["head"], r["failure"]) for r in catalog.QUERIES["blob_ops"](spark, str(tmp_path)).collect()}
    for k, t in rows:
        if t is None:
            assert found[k] == (None, None, None)
            continue
        body = t.encode()
        try:
            head, failure = body[:8].decode(), None
        except UnicodeDecodeError:
            head, failure = None, "InvalidText"
        assert found[k] == (len(body), head, failure)
    assert [found[k][2] for k in (4, 6, 7)] == ["InvalidText"] * 3
