"""Driver test tables (parquet) and their mapping onto the sales domain.

The test data is a TPC-H-like star schema plus an ``events`` table. FIXTURES.md §2 maps it
onto the domain; every mapping here is a plain projection, so Catalyst prunes the scan to
the columns used and pushes filters into the parquet reader.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ---------------------------------------------------------------- A. sales lines from events
def sales_lines_from_events(events: DataFrame, as_text: bool = False) -> DataFrame:
    """Sale lines from the ``events`` table. The quantity is the JSON text at ``$.k`` (it
    is parsed strictly by ``clean_sales``); price and stamp are typed, or rendered as text
    with ``as_text`` (the CSV / stream message shape)."""
    price = F.col("value").cast("decimal(20,8)")
    ts = F.col("ts")
    if as_text:
        price = price.cast("string")
        ts = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return events.select(
        F.col("event_id").cast("string").alias("transaction_id"),
        F.col("user_id").cast("string").alias("product_id"),
        F.col("event_type").alias("category_id"),
        F.get_json_object("props", "$.k").alias("quantity"),
        price.alias("price_per_unit"),
        ts.alias("timestamp"),
    )


# ------------------------------------------------- B. daily sales lines from lineitem x part
def sales_lines_from_lineitem(lineitem: DataFrame, part: DataFrame,
                              category: str = "p_type") -> DataFrame:
    """Typed sale lines from ``lineitem`` joined to ``part``; category = p_type or p_brand.

    A typed source: quantity int, price decimal(20,8), timestamp as stamp; ``clean_sales``
    applies the same validity rules without parsing text.

    ``part`` is a dimension (20k rows per 0.1 sf); the join is left to AQE, which
    broadcasts it at run time only when its measured size is under the threshold.
    """
    p = part.select("p_partkey", F.col(category).alias("category_id"), "p_retailprice")
    return (
        lineitem.select("l_partkey", "l_orderkey", "l_linenumber", "l_quantity", "l_shipdate")
        .join(p, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.concat_ws("-", F.col("l_orderkey").cast("string"),
                        F.col("l_linenumber").cast("string")).alias("transaction_id"),
            F.col("l_partkey").cast("string").alias("product_id"),
            "category_id",
            F.col("l_quantity").cast("int").alias("quantity"),
            F.col("p_retailprice").cast("decimal(20,8)").alias("price_per_unit"),
            F.col("l_shipdate").alias("timestamp"),
        )
    )


# ------------------------------------------------------------------- C. dimensions from part
def products_from_part(part: DataFrame) -> DataFrame:
    return part.select(
        F.col("p_partkey").cast("string").alias("product_id"),
        F.col("p_name").alias("product_name"),
        F.col("p_type").alias("description"),
        F.col("p_brand").alias("category_id"),
    )


def categories_from_part(part: DataFrame) -> DataFrame:
    return part.select(F.col("p_brand").alias("category_id"),
                       F.col("p_brand").alias("category_name")).distinct()


# ---------------------------------------------------------------- D. promotions from part
def raw_promotions_from_part(part: DataFrame) -> DataFrame:
    """Promotion rows as text, the CSV shape (FIXTURES D): one per part; every 97th part
    has an end date that is none, so its promotion is rejected."""
    k = F.col("p_partkey")
    slot = F.expr("p_partkey div 40")
    start = F.date_add(F.lit("1995-01-01").cast("date"), (k * 7 % 2400).cast("int"))
    return part.select(
        F.concat(F.lit("PROMO_"), k.cast("string")).alias("promotion_id"),
        F.concat(F.lit("promo "), (slot % 6).cast("string")).alias("promotion_name"),
        F.date_format(start, "yyyy-MM-dd").alias("start_date"),
        F.when(k % 97 == 0, F.lit("no end")).otherwise(
            F.date_format(F.date_add(start, 5), "yyyy-MM-dd")).alias("end_date"),
        (F.lit(10) + F.lit(5) * (slot % 5)).cast("string").alias("discount_percentage"),
        F.when(k % 80 == 0, F.lit("category")).otherwise(F.lit("product")).alias("target_type"),
        F.when(k % 80 == 0, F.col("p_brand")).otherwise(k.cast("string")).alias("target_id"),
    )


# ------------------------------------------- E. ledger, jobs, registry, forecasts from orders
def _status():
    return (F.when(F.col("o_orderstatus") == "F", F.lit("FAILED"))
            .when(F.col("o_orderstatus") == "O", F.lit("PENDING"))
            .otherwise(F.lit("SUCCESS")))


def ledger_from_orders(orders: DataFrame) -> DataFrame:
    """ETL ledger history: every order is one status write; file names repeat."""
    return orders.select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("f"), (F.col("o_orderkey") % 5000).cast("string")).alias("file_name"),
        _status().alias("status"),
        F.col("o_orderdate").alias("last_updated"),
        F.lit(None).cast("timestamp_ntz").alias("file_mtime"),
    )


def listing_from_orders(orders: DataFrame) -> DataFrame:
    """A directory listing: f0..f5999 style names, a superset of the ledger's files."""
    return orders.select(
        F.concat(F.lit("f"), (F.col("o_orderkey") % 6000).cast("string"),
                 F.lit(".csv")).alias("file_name")).distinct()


def jobs_from_orders(orders: DataFrame) -> DataFrame:
    """Forecast request jobs (async queue rows) with JSON request parameters."""
    gran = F.when(F.col("o_orderkey") % 11 == 0, F.lit("weekly")).otherwise(
        F.element_at(F.array(*[F.lit(g) for g in ("daily", "monthly", "yearly")]),
                     (F.col("o_orderkey") % 3 + 1).cast("int")))
    # every 13th customer asks for no points, every 17th leaves the number out
    count = F.when(F.col("o_custkey") % 17 != 0, F.when(F.col("o_custkey") % 13 == 0, F.lit(0))
                   .otherwise((F.col("o_custkey") % 30 + 1).cast("int")))
    status = _status()
    return orders.select(
        F.col("o_orderkey").cast("string").alias("job_id"),
        F.col("o_orderpriority").alias("category_id"),
        F.to_json(F.struct(gran.alias("granularity"), count.alias("count"))).alias("request_params"),
        status.alias("status"),
        F.when(status == "FAILED", F.lit("downstream error")).alias("error_message"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_orderdate").alias("updated_at"),
        F.col("o_orderkey").alias("seq"),
    )


def model_versions_from_orders(orders: DataFrame) -> DataFrame:
    """Model registry rows: one version per order, category = order priority."""
    return orders.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderpriority").alias("category_id"),
        F.concat(F.date_format("o_orderdate", "yyyyMMddHHmmss"), F.lit("-"),
                 F.col("o_orderkey").cast("string")).alias("version"),
        F.col("o_orderdate").alias("training_date_utc"),
        F.col("o_custkey").alias("training_data_points"),
    )


def live_forecasts_from_orders(orders: DataFrame) -> DataFrame:
    """A live forecast cache: per priority and period, avg/min/max of the order total.

    daily = order date, monthly = month end, yearly = 31 December (period-end stamps as
    the reference's month/year frequencies give).
    """
    d = F.to_date("o_orderdate")
    keyed = orders.select(
        F.col("o_orderpriority").alias("category_id"), F.col("o_totalprice").alias("price"),
        F.col("o_custkey").alias("ckey"),
        F.explode(F.array(
            F.struct(F.lit("daily").alias("granularity"), d.alias("forecast_date")),
            F.struct(F.lit("monthly").alias("granularity"), F.last_day(d).alias("forecast_date")),
            F.struct(F.lit("yearly").alias("granularity"),
                     F.make_date(F.year(d), F.lit(12), F.lit(31)).alias("forecast_date")),
        )).alias("g"))
    return (
        keyed.groupBy("category_id", F.col("g.granularity").alias("granularity"),
                      F.col("g.forecast_date").alias("forecast_date"))
        .agg(F.round(F.avg("price"), 4).alias("predicted_sales"),
             F.round(F.min("price"), 4).alias("lower_bound"),
             F.round(F.max("price"), 4).alias("upper_bound"),
             F.min("ckey").alias("model_version_id"))
    )


def historical_forecasts_from_orders(orders: DataFrame) -> DataFrame:
    """Archived daily forecasts per model version (= o_custkey % 3)."""
    return (
        orders.select(F.col("o_orderpriority").alias("category_id"),
                      (F.col("o_custkey") % 3).alias("model_version_id"),
                      F.to_date("o_orderdate").alias("forecast_date"),
                      F.col("o_totalprice").alias("price"))
        .groupBy("model_version_id", "category_id", "forecast_date")
        .agg(F.round(F.avg("price"), 4).alias("predicted_sales"),
             F.round(F.min("price"), 4).alias("lower_bound"),
             F.round(F.max("price"), 4).alias("upper_bound"))
    )


def requests_from_orders(orders: DataFrame) -> DataFrame:
    """Forecast requests: every priority x granularity x period (5 = a hit, 5000 = a gap).

    Built with ``explode`` over literal arrays, not cross joins."""
    combos = F.array(*[F.struct(F.lit(g).alias("granularity"), F.lit(n).alias("period"))
                       for g in ("daily", "monthly", "yearly") for n in (5, 5000)])
    return (orders.select(F.col("o_orderpriority").alias("category_id")).distinct()
            .select("category_id", F.explode(combos).alias("r"))
            .select(F.concat_ws(":", "category_id", "r.granularity",
                                F.col("r.period").cast("string")).alias("request_id"),
                    "category_id", F.col("r.granularity").alias("granularity"),
                    F.col("r.period").alias("period")))


def performance_from_orders(orders: DataFrame) -> DataFrame:
    """forecast_performance rows (long format): one metric per order."""
    return orders.select(
        F.col("o_orderkey").alias("id"),
        (F.col("o_custkey") % 50).alias("model_version_id"),
        F.col("o_orderdate").alias("evaluation_period_start"),
        (F.col("o_orderdate") + F.expr("INTERVAL 7 DAYS")).alias("evaluation_period_end"),
        F.when(F.col("o_orderkey") % 2 == 0, F.lit("mape")).otherwise(F.lit("rmse"))
        .alias("metric_name"),
        (F.col("o_totalprice") / 1000).alias("metric_value"),
    )
