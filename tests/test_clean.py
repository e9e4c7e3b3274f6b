"""Cleaning rules for raw sale lines."""

from tidewater.operators import ingest
from tidewater.schemas import RAW_SALE


def _rows(spark, rows):
    return spark.createDataFrame(rows, RAW_SALE)


def _kept(spark, rows):
    return {r.transaction_id for r in ingest.clean_sales(_rows(spark, rows)).collect()}


def line(tid, q="2", p="10.50", ts="2024-01-01T10:00:05"):
    return (tid, "P1", "C1", q, p, ts)


def test_quantity_rules(spark):
    rows = [line("ok"), line("zero", q="0"), line("neg", q="-1"), line("txt", q="x"),
            line("frac", q="1.0"), line("empty", q=""), line("blank", q=" 2"),
            line("plus", q="+3")]
    assert _kept(spark, rows) == {"ok", "plus"}


def test_price_rules(spark):
    rows = [line("ok"), line("zero", p="0"), line("txt", p="abc"), line("nan", p="NaN"),
            line("inf", p="Inf"), line("huge", p="1e400"), line("int", p="12")]
    assert _kept(spark, rows) == {"ok", "int"}


def test_very_small_and_large_values_are_kept(spark):
    df = _rows(spark, [line("tiny", q="3", p="0.000000001"), line("big", q="2", p="1e12"),
                       line("many", q="5000000000", p="0.5"), line("less", p="1e-20"),
                       line("too", p="1e15"), line("lots", q="100000000000")])
    got = {r.transaction_id: r.revenue for r in ingest.clean_sales(df).collect()}
    assert {k: str(v.normalize()) for k, v in got.items()} == {
        "tiny": "3E-9", "big": "2E+12", "many": "2.5E+9", "less": "0"}
    assert {r.transaction_id: r.reason for r in ingest.rejected_sales(df).collect()} == {
        "too": "price_out_of_range", "lots": "quantity_out_of_range"}


def test_timestamp_rules(spark):
    rows = [line("s", ts="2024-01-01T10:00:05"), line("f1", ts="2024-01-01T10:00:05.1"),
            line("f6", ts="2024-01-01T10:00:05.123456"), line("z", ts="2024-01-01T10:00:05Z"),
            line("space", ts="2024-01-01 10:00:05"), line("feb30", ts="2024-02-30T10:00:05")]
    assert _kept(spark, rows) == {"s", "f1", "f6"}


def test_revenue_exact_and_rejections_counted(spark):
    df = _rows(spark, [line("a", q="3", p="0.10"), line("b", p="NaN")])
    out = ingest.clean_sales(df).collect()
    assert str(out[0].revenue) == "0.300000000000"
    rej = {r.transaction_id: r.reason for r in ingest.rejected_sales(df).collect()}
    assert rej == {"b": "bad_price"}


def test_hourly_rollup(spark):
    rows = [line("a", q="2", p="10.00", ts="2024-01-01T10:59:59"),
            line("b", q="1", p="5.00", ts="2024-01-01T10:00:00"),
            line("c", q="1", p="5.00", ts="2024-01-01T11:00:00")]
    out = {(str(r.time), r.category_id): (float(r.total_sales), r.total_quantity)
           for r in ingest.hourly_sales(ingest.clean_sales(_rows(spark, rows))).collect()}
    assert out == {("2024-01-01 10:00:00", "C1"): (25.0, 3),
                   ("2024-01-01 11:00:00", "C1"): (5.0, 1)}
