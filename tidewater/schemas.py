"""Schemas of the domain tables (DDL of the reference re-expressed as Spark types)."""

from __future__ import annotations

from pyspark.sql import types as T

# Money is exact: sums do not depend on row order or partitioning. A price holds 14 digits
# before and 12 after the point and a quantity 11 digits, so their product fits 38 digits
# without rounding; lines beyond that are reported, not dropped silently.
PRICE = T.DecimalType(26, 12)
QUANTITY = T.DecimalType(11, 0)
MONEY = T.DecimalType(38, 12)

# Raw sale line as it arrives in a CSV file or a stream message: everything is text, and
# the cleaning step decides what is a valid number or stamp.
RAW_SALE_COLUMNS = ["transaction_id", "product_id", "category_id", "quantity",
                    "price_per_unit", "timestamp"]
RAW_SALE = T.StructType([T.StructField(c, T.StringType()) for c in RAW_SALE_COLUMNS])

CLEAN_SALE = T.StructType([
    T.StructField("transaction_id", T.StringType()),
    T.StructField("product_id", T.StringType()),
    T.StructField("category_id", T.StringType()),
    T.StructField("quantity", T.LongType()),
    T.StructField("price_per_unit", PRICE),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("revenue", MONEY),
])

HOURLY_FACT = T.StructType([
    T.StructField("time", T.TimestampNTZType()),
    T.StructField("category_id", T.StringType()),
    T.StructField("total_sales", MONEY),
    T.StructField("total_quantity", T.LongType()),
])

# One source file's part of the fact. Sales that ``MONEY`` cannot sum exactly are kept as integers
# per power of ten (functions/exact.py): ``exp10`` is null in rows of narrow sales.
FACT_DELTA = T.StructType([
    T.StructField("time", T.TimestampNTZType()),
    T.StructField("category_id", T.StringType()),
    T.StructField("exp10", T.IntegerType()),
    T.StructField("total_sales", MONEY),
    T.StructField("wide_high", T.DecimalType(38, 0)),
    T.StructField("wide_low", T.DecimalType(38, 0)),
    T.StructField("total_quantity", T.DecimalType(38, 0)),
    T.StructField("source_file", T.StringType()),
])

CATEGORIES = T.StructType([
    T.StructField("category_id", T.StringType()),
    T.StructField("category_name", T.StringType()),
])

PRODUCTS = T.StructType([
    T.StructField("product_id", T.StringType()),
    T.StructField("product_name", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("category_id", T.StringType()),
])

PROMOTIONS = T.StructType([
    T.StructField("promotion_id", T.StringType()),
    T.StructField("promotion_name", T.StringType()),
    T.StructField("start_date", T.DateType()),
    T.StructField("end_date", T.DateType()),
    T.StructField("discount_percentage", T.IntegerType()),
    T.StructField("target_type", T.StringType()),
    T.StructField("target_id", T.StringType()),
])

LEDGER = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("file_name", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("last_updated", T.TimestampNTZType()),
    T.StructField("file_mtime", T.TimestampNTZType()),
])

FORECAST_POINT = T.StructType([
    T.StructField("forecast_date", T.DateType()),
    T.StructField("predicted_sales", T.DoubleType()),
    T.StructField("lower_bound", T.DoubleType()),
    T.StructField("upper_bound", T.DoubleType()),
])

LIVE_FORECAST = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("model_version_id", T.LongType()),
    T.StructField("category_id", T.StringType()),
    T.StructField("forecast_date", T.DateType()),
    T.StructField("predicted_sales", T.DoubleType()),
    T.StructField("lower_bound", T.DoubleType()),
    T.StructField("upper_bound", T.DoubleType()),
    T.StructField("granularity", T.StringType()),
    T.StructField("forecast_ts", T.TimestampNTZType()),
])

REQUEST_PARAMS = "granularity string, count int"

# Fixed values from the reference's schema and services.
ETL_STATUSES = ["PENDING", "SUCCESS", "FAILED"]
JOB_STATUSES = ["PENDING", "RUNNING", "COMPLETED", "FAILED", "CANCELLED"]
GRANULARITIES = ["daily", "monthly", "yearly"]
# Standard cached set: 90 daily, 24 monthly and 5 yearly points per category.
STANDARD_SET = [("daily", 90), ("monthly", 24), ("yearly", 5)]
MIN_TRAINING_POINTS = 50
