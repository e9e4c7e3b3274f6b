"""Promotion targeting and the promotion calendar.

The reference asks, per category, for promotions aimed at the category or at one of its
products (an OR over an IN-subquery), re-querying for every category. Here it is one plan
for all categories: the two target types are disjoint branches, each an equi-join, joined
by ``unionByName``; an OR join condition would become a nested loop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PROMO_COLS = ["promotion_id", "promotion_name", "start_date", "end_date"]


def promotion_targets(promotions: DataFrame, products: DataFrame) -> DataFrame:
    """(category_id, promotion) for every promotion, by its target type.

    category-targeted: the target id is the category. product-targeted: the product's
    category (a semi-join of products into the promotion, J1). Any other target type
    matches nothing. A product-targeted promotion whose product is unknown has no category.
    """
    by_category = (promotions.where(F.col("target_type") == "category")
                   .select(F.col("target_id").alias("category_id"), *PROMO_COLS))
    prod = products.select(F.col("product_id"), F.col("category_id"))
    by_product = (promotions.where(F.col("target_type") == "product")
                  .join(prod, F.col("target_id") == F.col("product_id"))
                  .select("category_id", *PROMO_COLS))
    return by_category.unionByName(by_product)


def promotion_days(targets: DataFrame) -> DataFrame:
    """One row per (category, promotion, calendar day), both ends included.

    A promotion whose start is after its end has no day (``sequence`` would throw on
    reversed bounds, so those rows are filtered first).
    """
    return (targets.where(F.col("start_date") <= F.col("end_date"))
            .select("category_id", "promotion_id", "promotion_name",
                    F.explode(F.sequence("start_date", "end_date",
                                         F.expr("INTERVAL 1 DAY"))).alias("ds")))


def promotion_features(days: DataFrame) -> DataFrame:
    """Model input: one row per (category, promotion name, day) — overlapping promotions
    of one name do not duplicate a day (deviation Q14)."""
    return days.select("category_id", "promotion_name", "ds").distinct()
