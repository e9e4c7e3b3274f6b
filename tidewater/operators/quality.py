"""Integrity reports the reference leaves to database constraints.

Each report is a DataFrame of offending keys; an empty report means the constraint holds.
All are anti-joins or grouped counts: partial aggregation keeps a hot key cheap.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fk_orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str,
               relation: str) -> DataFrame:
    """Child keys without a parent row, with the number of child rows each.

    The child (possibly sale lines) is counted per key first — partial aggregation folds a
    hot key map-side — so the anti-join sees one row per distinct key, not every line."""
    keys = parent.select(F.col(parent_key).alias("_pk")).distinct()
    counts = child.groupBy(F.col(child_key).alias("_ck")).agg(F.count(F.lit(1)).alias("n_rows"))
    return (counts.join(keys, F.col("_ck") == F.col("_pk"), "left_anti")
            .select(F.lit(relation).alias("relation"), F.col("_ck").cast("string").alias("key"),
                    "n_rows"))


def duplicate_keys(df: DataFrame, keys: list[str], table: str) -> DataFrame:
    """Keys that occur more than once (a unique constraint that would be violated)."""
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
            .where(F.col("n_rows") > 1)
            .select(F.lit(table).alias("table_name"),
                    F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("key"),
                    "n_rows"))


def union_reports(*reports: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), reports)


def category_mismatch(sales: DataFrame, products: DataFrame) -> DataFrame:
    """Sale lines whose category differs from their product's category, counted per
    (sale category, product category). Products are a dimension; AQE broadcasts them
    only when their measured size is under the broadcast threshold."""
    prod = products.select(F.col("product_id").alias("_pid"),
                           F.col("category_id").alias("product_category"))
    # Pre-aggregate lines per (product, sale category): the join then sees one row per
    # distinct pair, and a product with a third of all lines is folded map-side.
    per = sales.groupBy("product_id", "category_id").agg(F.count(F.lit(1)).alias("_n"))
    return (per.join(prod, F.col("product_id") == F.col("_pid"))
            .where(F.col("category_id") != F.col("product_category"))
            .groupBy(F.col("category_id").alias("sale_category"), "product_category")
            .agg(F.sum("_n").alias("n_lines")))
