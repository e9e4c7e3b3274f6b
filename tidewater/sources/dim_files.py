"""Dimension and promotion CSV files (S4-S6, F3, Q4): read by header, all text.

The files are small, but a malformed record (a field count different from the header's)
still fails the whole file, exactly like the sales files: the load that follows writes
nothing and records FAILED.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"

# The column layouts of the three files, in file order.
CATEGORY_COLUMNS = ["category_id", "category_name"]
PRODUCT_COLUMNS = ["product_id", "product_name", "description", "category_id"]
PROMOTION_COLUMNS = ["promotion_id", "promotion_name", "start_date", "end_date",
                     "discount_percentage", "target_type", "target_id"]


def read_csv_file(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """All-text positional read with a ``_corrupt_record`` column for bad records."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns]
                          + [T.StructField(CORRUPT, T.StringType())])
    return (spark.read.schema(schema).option("header", "true")
            .option("enforceSchema", "true").option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", CORRUPT).option("escape", '"')
            # an empty field is an empty text, not a missing one
            .option("nullValue", "\u0001").option("emptyValue", "")
            .csv(path))


def split_file(df: DataFrame) -> tuple[DataFrame, bool]:
    """(records, malformed?) — ``malformed`` is one boolean from a distributed probe."""
    # Spark refuses scans that read only the corrupt-record column, so the count also
    # references a data column (one aggregate row reaches the driver).
    first = df.columns[0]
    n_bad = df.agg(F.count(F.when(F.col(CORRUPT).isNotNull(),
                                  F.coalesce(F.col(first), F.lit(""))))).first()[0]
    bad = n_bad > 0
    return df.drop(CORRUPT), bad


def read_categories(spark: SparkSession, path: str):
    return split_file(read_csv_file(spark, path, CATEGORY_COLUMNS))


def read_products(spark: SparkSession, path: str):
    return split_file(read_csv_file(spark, path, PRODUCT_COLUMNS))


def read_promotions(spark: SparkSession, path: str):
    return split_file(read_csv_file(spark, path, PROMOTION_COLUMNS))
