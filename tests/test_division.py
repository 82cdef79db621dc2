"""Division with dividends of both signs."""

from keyspan import catalog


def test_div_of_negative_dividends(spark, sf_dir):
    events = {r["event_id"]: (r["event_id"] - 500, r["user_id"] % 5) for r in spark.read.parquet(f"{sf_dir}/events.parquet").collect()}
    rows = {r["event_id"]: (r["q"], r["failure"]) for r in catalog.QUERIES["math_div"](spark, sf_dir).collect()}
    assert rows == {i: (int(a / d), None) if d else (None, "DivisionByZero") for i, (a, d) in events.items()}
    assert any(a < 0 and d and a % d for a, d in events.values())
