"""Registered dimension, promotion and integrity queries (FIXTURES C, D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import store
from ..operators import dims, ingest, promotions, quality
from ..sources.tables import (categories_from_part, historical_forecasts_from_orders,
                              ledger_from_orders, live_forecasts_from_orders,
                              model_versions_from_orders, performance_from_orders,
                              products_from_part, raw_promotions_from_part, read_table,
                              sales_lines_from_lineitem)
from .q_reads import HIST_SQL, LIVE_SQL
from .registry import register

PROMOS_SQL = """
  SELECT 'PROMO_' || CAST(p_partkey AS VARCHAR) AS promotion_id,
         'promo ' || CAST((p_partkey // 40) % 6 AS VARCHAR) AS promotion_name,
         CAST(DATE '1995-01-01' + CAST((p_partkey * 7) % 2400 AS INTEGER) AS DATE) AS start_date,
         CAST(DATE '1995-01-01' + CAST((p_partkey * 7) % 2400 + 5 AS INTEGER) AS DATE) AS end_date,
         CAST(10 + 5 * ((p_partkey // 40) % 5) AS INTEGER) AS discount_percentage,
         CASE WHEN p_partkey % 80 = 0 THEN 'category' ELSE 'product' END AS target_type,
         CASE WHEN p_partkey % 80 = 0 THEN p_brand ELSE CAST(p_partkey AS VARCHAR) END
           AS target_id
  FROM part WHERE p_partkey % 97 <> 0
"""
PRODUCTS_SQL = """
  SELECT CAST(p_partkey AS VARCHAR) AS product_id, p_name AS product_name,
         p_type AS description, p_brand AS category_id FROM part
"""
TARGETS_SQL = f"""
  SELECT target_id AS category_id, promotion_id, promotion_name, start_date, end_date
  FROM ({PROMOS_SQL}) WHERE target_type = 'category'
  UNION ALL
  SELECT pr.category_id, p.promotion_id, p.promotion_name, p.start_date, p.end_date
  FROM ({PROMOS_SQL}) p JOIN ({PRODUCTS_SQL}) pr ON p.target_id = pr.product_id
  WHERE p.target_type = 'product'
"""
DAYS_SQL = f"""
  SELECT category_id, promotion_id, promotion_name,
         CAST(unnest(generate_series(start_date, end_date, INTERVAL 1 DAY)) AS DATE) AS ds
  FROM ({TARGETS_SQL}) WHERE start_date <= end_date
"""


def products(spark, sf_dir):
    return dims.dim_products(products_from_part(read_table(spark, sf_dir, "part")))


def categories(spark, sf_dir):
    return dims.dim_categories(categories_from_part(read_table(spark, sf_dir, "part")))


def promos(spark, sf_dir):
    return dims.dim_promotions(raw_promotions_from_part(read_table(spark, sf_dir, "part")))


def targets(spark, sf_dir):
    return promotions.promotion_targets(promos(spark, sf_dir), products(spark, sf_dir))


def days(spark, sf_dir):
    return promotions.promotion_days(targets(spark, sf_dir))


@register("dim_categories",
          "SELECT DISTINCT p_brand AS category_id, p_brand AS category_name FROM part")
def q_dim_categories(spark, sf_dir):
    return categories(spark, sf_dir)


@register("dim_products", PRODUCTS_SQL)
def q_dim_products(spark, sf_dir):
    return products(spark, sf_dir)


@register("dim_promotions", PROMOS_SQL)
def q_dim_promotions(spark, sf_dir):
    return promos(spark, sf_dir)


@register("list_categories", """
SELECT DISTINCT p_brand AS category_id, p_brand AS category_name FROM part
ORDER BY category_name, category_id""")
def q_list_categories(spark, sf_dir):
    return dims.list_categories(categories(spark, sf_dir))


@register("products_by_category", f"{PRODUCTS_SQL} ORDER BY product_name, product_id")
def q_products_by_category(spark, sf_dir):
    return dims.products_by_category(products(spark, sf_dir))


@register("list_promotions", f"""
SELECT promotion_id, promotion_name, strftime(start_date, '%Y-%m-%d') AS start_date,
       strftime(end_date, '%Y-%m-%d') AS end_date, discount_percentage, target_type, target_id
FROM ({PROMOS_SQL}) ORDER BY start_date, promotion_id""")
def q_list_promotions(spark, sf_dir):
    return dims.list_promotions(promos(spark, sf_dir))


@register("promotion_targets", TARGETS_SQL)
def q_promotion_targets(spark, sf_dir):
    return targets(spark, sf_dir)


@register("promotion_days", DAYS_SQL)
def q_promotion_days(spark, sf_dir):
    return days(spark, sf_dir)


@register("fk_orphans", f"""
SELECT 'products.category_id->categories' AS relation, p.category_id AS key,
       COUNT(*) AS n_rows
FROM ({PRODUCTS_SQL}) p
WHERE p.category_id NOT IN (SELECT DISTINCT p_brand FROM part WHERE p_brand IS NOT NULL)
GROUP BY 1, 2
UNION ALL
SELECT 'sales.category_id->categories' AS relation, p_type AS key, COUNT(*) AS n_rows
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
WHERE p_type NOT IN (SELECT DISTINCT p_brand FROM part WHERE p_brand IS NOT NULL)
GROUP BY 1, 2
UNION ALL
SELECT 'forecast_performance.model_version_id->model_versions', CAST(o_custkey % 50 AS VARCHAR),
       COUNT(*) FROM orders
WHERE o_custkey % 50 NOT IN (SELECT o_orderkey FROM orders) GROUP BY 1, 2
UNION ALL
SELECT 'live_forecasts.model_version_id->model_versions', CAST(model_version_id AS VARCHAR), COUNT(*)
FROM ({LIVE_SQL}) WHERE model_version_id NOT IN (SELECT o_orderkey FROM orders) GROUP BY 1, 2
UNION ALL
SELECT 'historical_forecasts.model_version_id->model_versions', CAST(model_version_id AS VARCHAR),
       COUNT(*)
FROM ({HIST_SQL}) WHERE model_version_id NOT IN (SELECT o_orderkey FROM orders) GROUP BY 1, 2""")
def q_fk_orphans(spark, sf_dir):
    """Products -> categories (holds), sale lines by part type -> categories by brand
    (every line is an orphan: the two are different codings), and the tables that refer to a
    model version."""
    cats = categories(spark, sf_dir)
    o = read_table(spark, sf_dir, "orders")
    versions = model_versions_from_orders(o)
    refer = {"forecast_performance": performance_from_orders(o),
             "live_forecasts": live_forecasts_from_orders(o),
             "historical_forecasts": historical_forecasts_from_orders(o)}
    sales = sales_lines_from_lineitem(read_table(spark, sf_dir, "lineitem"),
                                      read_table(spark, sf_dir, "part"))
    return quality.union_reports(
        quality.fk_orphans(products(spark, sf_dir), cats, "category_id", "category_id",
                           "products.category_id->categories"),
        quality.fk_orphans(sales, cats, "category_id", "category_id",
                           "sales.category_id->categories"),
        *[quality.fk_orphans(t, versions, "model_version_id", "id",
                             f"{name}.model_version_id->model_versions")
          for name, t in refer.items()])


@register("duplicate_keys", f"""
SELECT 'hourly_sales' AS table_name, CAST(time AS VARCHAR) || '|' || category_id AS key,
       COUNT(*) AS n_rows
FROM (SELECT date_trunc('hour', ts) AS time, event_type AS category_id FROM events
      GROUP BY 1, 2) GROUP BY 1, 2 HAVING COUNT(*) > 1
UNION ALL
SELECT 'etl_job_status' AS table_name, 'f' || CAST(o_orderkey % 5000 AS VARCHAR) AS key,
       COUNT(*) AS n_rows
FROM orders GROUP BY 1, 2 HAVING COUNT(*) > 1
UNION ALL
SELECT 'forecast_performance', CAST(o_custkey % 50 AS VARCHAR) || '|'
       || CAST(o_orderdate + INTERVAL 7 DAYS AS VARCHAR) || '|'
       || CASE WHEN o_orderkey % 2 = 0 THEN 'mape' ELSE 'rmse' END, COUNT(*)
FROM orders GROUP BY 1, 2 HAVING COUNT(*) > 1
UNION ALL
SELECT 'historical_forecasts', category_id || '|' || CAST(forecast_date AS VARCHAR), COUNT(*)
FROM ({HIST_SQL}) GROUP BY 1, 2 HAVING COUNT(*) > 1""")
def q_duplicate_keys(spark, sf_dir):
    """The fact is unique on (time, category), model versions on (category, version), live
    forecasts on (category, date, granularity) and the dimensions on their ids; the ledger
    history repeats file names (the ledger table keeps the latest row per file), performance
    rows repeat, and the archive repeats a date once per version."""
    from .q_ingest import events_fact
    o = read_table(spark, sf_dir, "orders")
    return quality.union_reports(
        quality.duplicate_keys(events_fact(spark, sf_dir), ["time", "category_id"],
                               "hourly_sales"),
        quality.duplicate_keys(ledger_from_orders(o), ["file_name"], "etl_job_status"),
        quality.duplicate_keys(performance_from_orders(o), [
            "model_version_id", "evaluation_period_end", "metric_name"], "forecast_performance"),
        quality.duplicate_keys(historical_forecasts_from_orders(o), [
            "category_id", "forecast_date"], "historical_forecasts"),
        quality.duplicate_keys(model_versions_from_orders(o), ["category_id", "version"],
                               "model_versions"),
        quality.duplicate_keys(live_forecasts_from_orders(o), [
            "category_id", "forecast_date", "granularity"], "live_forecasts"),
        quality.duplicate_keys(products(spark, sf_dir), ["product_id"], "products"),
        quality.duplicate_keys(categories(spark, sf_dir), ["category_id"], "categories"))


@register("category_mismatch", """
SELECT p.p_type AS sale_category, p.p_brand AS product_category, COUNT(*) AS n_lines
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
WHERE CAST(l.l_quantity AS INTEGER) > 0 AND p.p_retailprice > 0 AND p.p_type <> p.p_brand
GROUP BY 1, 2""")
def q_category_mismatch(spark, sf_dir):
    """Sale lines coded by part type against the product dimension coded by brand."""
    sales = ingest.clean_sales(sales_lines_from_lineitem(read_table(spark, sf_dir, "lineitem"),
                                                         read_table(spark, sf_dir, "part")))
    return quality.category_mismatch(sales, products(spark, sf_dir))


@register("rejected_promotions", """
SELECT COUNT(*) AS n_rejected FROM part WHERE p_partkey % 97 = 0""")
def q_rejected_promotions(spark, sf_dir):
    raw = raw_promotions_from_part(read_table(spark, sf_dir, "part"))
    return dims.rejected_promotions(raw).agg(F.count(F.lit(1)).alias("n_rejected"))


@register("dim_products_csv", PRODUCTS_SQL)
def q_dim_products_csv(spark, sf_dir):
    """S5 through the file path: products derived from ``part`` are written as CSV files
    to the shared scratch folder and read back by the dimension reader (quoted text
    fields, header, whole-file check)."""
    from ..session import scratch_path
    from ..sources import dim_files
    out = scratch_path(spark, "products-csv")
    (products_from_part(read_table(spark, sf_dir, "part"))
     .write.mode("overwrite").option("header", "true").option("escape", '"').csv(out))
    raw, bad = dim_files.read_products(spark, out)
    if bad:
        raise ValueError("products file has malformed records")
    return dims.dim_products(raw)


@register("metadata_refresh", f"""
SELECT 1 AS version, 'categories' AS table_name, COUNT(DISTINCT category_id) AS n_rows,
       min(category_id) AS first_key FROM ({PRODUCTS_SQL}) WHERE category_id < 'Brand#3'
UNION ALL SELECT 1, 'products', COUNT(*), min(product_id) FROM ({PRODUCTS_SQL})
          WHERE category_id < 'Brand#3'
UNION ALL SELECT 2, 'categories', COUNT(DISTINCT category_id), min(category_id) FROM ({PRODUCTS_SQL})
UNION ALL SELECT 2, 'products', COUNT(*), min(product_id) FROM ({PRODUCTS_SQL})""")
def q_metadata_refresh(spark, sf_dir):
    """Both dimensions committed together: first those of some brands, then all, then a
    refresh without one brand's category, which is refused. One row per commit and table."""
    from ..session import scratch_path
    from . import etl
    part = read_table(spark, sf_dir, "part")
    raw_c, raw_p = categories_from_part(part), products_from_part(part)
    root = scratch_path(spark, "metadata")
    some, gap = F.col("category_id") < "Brand#3", F.col("category_id") != "Brand#11"
    for cats, prods in ((raw_c.where(some), raw_p.where(some)), (raw_c, raw_p),
                        (raw_c.where(gap), raw_p)):
        etl.refresh_metadata(spark, cats, prods, f"{root}/categories", f"{root}/products")
    out = None
    for version in range(1, store.manifest(spark, root)[0] + 1):
        for name, key in (("categories", "category_id"), ("products", "product_id")):
            one = store.read_version(spark, f"{root}/{name}", version).agg(
                F.lit(version).alias("version"), F.lit(name).alias("table_name"),
                F.count(F.lit(1)).alias("n_rows"), F.min(key).alias("first_key"))
            out = one if out is None else out.unionByName(one)
    return out


@register("register_twice", """
SELECT o_orderkey AS id, o_orderpriority AS category_id,
       row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) = 1
         AS is_latest
FROM orders""")
def q_register_twice(spark, sf_dir):
    """Versions registered in overlapping batches, one of them twice: each is in the
    registry once, and one per category is the latest."""
    from ..session import scratch_path
    from . import training
    rows = model_versions_from_orders(read_table(spark, sf_dir, "orders"))
    path = f"{scratch_path(spark, 'versions')}/registry"
    half = F.col("id") % 2 == 0
    for batch in (rows.where(half), rows, rows.where(~half)):
        training.register_versions(spark, batch, path)
    return training.latest_versions(spark, path).select("id", "category_id", "is_latest")
