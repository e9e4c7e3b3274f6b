"""Dimensions and promotions: typed loads with row/file rejection
and the catalog reads (O5-O7, F10).

Dimensions are small next to the sales lines, but nothing here assumes it: every check is
an aggregate or an anti-join, never a driver-side loop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.formatting import iso_date
from ..functions.parsing import DECIMAL_TEXT, INT_TEXT, parse_date


def dim_categories(raw: DataFrame) -> DataFrame:
    """Categories (category_id, category_name); a row without a name is skipped."""
    return (raw.select(F.col("category_id").cast("string"), F.col("category_name").cast("string"))
            .where(F.col("category_id").isNotNull() & F.col("category_name").isNotNull()))


def dim_products(raw: DataFrame) -> DataFrame:
    """Products (product_id, product_name, description, category_id)."""
    return (raw.select(*[F.col(c).cast("string") for c in
                         ("product_id", "product_name", "description", "category_id")])
            .where(F.col("product_id").isNotNull() & F.col("product_name").isNotNull()))


def typed_promotions(raw: DataFrame) -> DataFrame:
    """Typed promotion rows plus a ``valid`` flag and a ``fractional`` flag.

    A row whose dates or discount do not parse is invalid (skipped). A discount that parses
    as a number but is not an integer marks the whole load as refused (Q11).
    """
    disc = F.col("discount_percentage")
    return raw.select(
        "promotion_id", "promotion_name",
        parse_date(F.col("start_date")).alias("start_date"),
        parse_date(F.col("end_date")).alias("end_date"),
        F.when(disc.rlike(INT_TEXT), disc.try_cast("int")).alias("discount_percentage"),
        "target_type", "target_id",
        (disc.rlike(DECIMAL_TEXT) & ~disc.rlike(INT_TEXT)).alias("fractional"),
    ).withColumn("valid", F.col("start_date").isNotNull() & F.col("end_date").isNotNull()
                 & (F.col("discount_percentage").isNotNull() | F.col("fractional")))


def dim_promotions(raw: DataFrame) -> DataFrame:
    """The promotions table — valid rows, or no rows at all if any discount is
    fractional (the whole file is refused, Q11). The verdict is one boolean computed by a
    distributed ``isEmpty`` probe; only that boolean reaches the driver."""
    typed = typed_promotions(raw)
    refused = not typed.where(F.col("fractional")).isEmpty()
    return (typed.where(F.col("valid") & F.lit(not refused))
            .select("promotion_id", "promotion_name", "start_date", "end_date",
                    "discount_percentage", "target_type", "target_id"))


def rejected_promotions(raw: DataFrame) -> DataFrame:
    """Rows skipped by the promotion load, for the load report."""
    return typed_promotions(raw).where(~F.col("valid") | F.col("fractional"))


# ------------------------------------------------------------------------ catalog reads
def list_categories(categories: DataFrame) -> DataFrame:
    """Categories by name (ties by id)."""
    return categories.select("category_id", "category_name").orderBy("category_name",
                                                                     "category_id")


def products_by_category(products: DataFrame, category_id: str | None = None) -> DataFrame:
    """Products by name, optionally of one category (filter pushed to the scan)."""
    df = products
    if category_id:
        df = df.where(F.col("category_id") == category_id)
    return df.select("product_id", "product_name", "description", "category_id") \
        .orderBy("product_name", "product_id")


def list_promotions(promotions: DataFrame) -> DataFrame:
    """Promotions by start date, dates as yyyy-MM-dd text."""
    return (promotions.orderBy("start_date", "promotion_id")
            .select("promotion_id", "promotion_name",
                    iso_date(F.col("start_date")).alias("start_date"),
                    iso_date(F.col("end_date")).alias("end_date"),
                    "discount_percentage", "target_type", "target_id"))
