"""Property tests: cleaning agrees with a plain reading of the rules on random inputs, and
the merged per-file roll-up equals the one-shot roll-up for any split of the lines."""

import datetime as dt
import decimal
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from tidewater.operators import ingest
from tidewater.schemas import RAW_SALE

INT_RE = re.compile(r"^[+-]?[0-9]+$")
DEC_RE = re.compile(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
TS_RE = re.compile(r"^(\d{4})-(\d{2})-(\d{2})T(\d{2}):(\d{2}):(\d{2})(\.\d{1,9})?$")


def expect_kept(q, p, ts):
    """The cleaning rules read directly: strict integer > 0, finite decimal > 0 that fits
    the exact types, ISO local stamp with optional fraction and no zone."""
    if q is None or not INT_RE.match(q) or not (0 < int(q) < 10**11):
        return False
    if p is None or not DEC_RE.match(p):
        return False
    raw = decimal.Decimal(p)
    if abs(raw) >= decimal.Decimal(10) ** 14:      # 14 digits before the point
        return False
    if raw <= 0:
        return False
    m = TS_RE.match(ts or "")
    if not m:
        return False
    try:
        dt.datetime(*[int(x) for x in m.groups()[:6]])
    except ValueError:
        return False
    return True


qty = st.one_of(st.integers(-5, 10).map(str), st.sampled_from(["", " 1", "1.0", "x", "+2", "007"]))
price = st.one_of(st.decimals(min_value=-5, max_value=500, places=3, allow_nan=False).map(str),
                  st.sampled_from(["NaN", "Inf", "-0", "1e400", "1e3", ".5", "5.", "abc", ""]))
stamp = st.one_of(
    st.datetimes(min_value=dt.datetime(2000, 1, 1), max_value=dt.datetime(2030, 1, 1))
    .map(lambda d: d.isoformat()),
    st.sampled_from(["2024-02-30T10:00:00", "2024-01-01 10:00:00", "2024-01-01T10:00:00Z",
                     "2024-01-01T10:00", "2024-01-01T25:00:00", ""]))


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(qty, price, stamp), min_size=40, max_size=80))
def test_cleaning_matches_rules(spark, rows):
    data = [(str(i), "P", "C", q, p, ts) for i, (q, p, ts) in enumerate(rows)]
    got = {r.transaction_id for r in
           ingest.clean_sales(spark.createDataFrame(data, RAW_SALE)).collect()}
    want = {str(i) for i, (q, p, ts) in enumerate(rows) if expect_kept(q, p, ts)}
    assert got == want


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(1, 5), st.integers(1, 3), st.integers(0, 47),
                          st.integers(0, 3)), min_size=10, max_size=60))
def test_split_merge_equals_whole(spark, lines):
    data = [(str(i), "P", f"C{c}", str(q), "2.50",
             (dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)).isoformat(), f"f{f}.csv")
            for i, (q, c, h, f) in enumerate(lines)]
    schema = T.StructType(list(RAW_SALE.fields) + [T.StructField("file_name", T.StringType())])
    raw = spark.createDataFrame(data, schema)
    clean = ingest.clean_sales(raw)
    merged = ingest.hourly_merge(ingest.hourly_sales(clean, "file_name"))
    whole = ingest.hourly_sales(clean.drop("file_name"))
    key = lambda r: (str(r.time), r.category_id, str(r.total_sales), r.total_quantity)
    assert sorted(map(key, merged.collect())) == sorted(map(key, whole.collect()))
