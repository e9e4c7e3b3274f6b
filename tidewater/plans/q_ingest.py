"""Registered ingest queries: cleaning, hourly roll-up, files, ledger (FIXTURES A, E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import store
from ..operators import ingest
from ..schemas import RAW_SALE_COLUMNS
from ..session import scratch_path
from ..sources import sales_files
from ..sources.tables import (ledger_from_orders, listing_from_orders, read_table,
                              sales_lines_from_events, sales_lines_from_lineitem)
from . import etl
from .registry import register

# DuckDB text of the events -> sale-line mapping, shared by several statements.
EV_QTY = "CAST(json_extract_string(props, '$.k') AS INTEGER)"
EV_PRICE = "CAST(CAST(value AS DECIMAL(20,8)) AS DECIMAL(26,12))"
EV_CLEAN = f"""
  SELECT CAST(event_id AS VARCHAR) AS transaction_id, CAST(user_id AS VARCHAR) AS product_id,
         event_type AS category_id, CAST({EV_QTY} AS BIGINT) AS quantity, {EV_PRICE} AS price_per_unit,
         ts, {EV_QTY} * {EV_PRICE} AS revenue
  FROM events
  WHERE {EV_QTY} > 0 AND {EV_PRICE} > 0 AND ts IS NOT NULL
"""
EV_HOURLY = f"""
  SELECT date_trunc('hour', ts) AS time, category_id,
         CAST(SUM(revenue) AS DECIMAL(38,12)) AS total_sales,
         CAST(SUM(quantity) AS BIGINT) AS total_quantity
  FROM ({EV_CLEAN}) GROUP BY 1, 2
"""


def events_clean(spark, sf_dir):
    return ingest.clean_sales(sales_lines_from_events(read_table(spark, sf_dir, "events")))


def events_fact(spark, sf_dir):
    return ingest.hourly_sales(events_clean(spark, sf_dir))


@register("clean_sales", f"""
SELECT transaction_id, product_id, category_id, quantity, price_per_unit, ts, revenue
FROM ({EV_CLEAN})""")
def q_clean_sales(spark, sf_dir):
    return events_clean(spark, sf_dir).select(
        "transaction_id", "product_id", "category_id", "quantity", "price_per_unit", "ts",
        "revenue")


@register("hourly_sales", EV_HOURLY)
def q_hourly_sales(spark, sf_dir):
    return events_fact(spark, sf_dir)


@register("hourly_sales_daily", """
SELECT date_trunc('hour', l.l_shipdate) AS time, p.p_type AS category_id,
       CAST(SUM(CAST(l.l_quantity AS INTEGER) * CAST(CAST(p.p_retailprice AS DECIMAL(20,8)) AS DECIMAL(26,12)))
            AS DECIMAL(38,12)) AS total_sales,
       CAST(SUM(CAST(l.l_quantity AS INTEGER)) AS BIGINT) AS total_quantity
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
WHERE CAST(l.l_quantity AS INTEGER) > 0 AND p.p_retailprice > 0
GROUP BY 1, 2""")
def q_hourly_sales_daily(spark, sf_dir):
    """FIXTURES B: lineitem x part as daily sale lines by part type."""
    raw = sales_lines_from_lineitem(read_table(spark, sf_dir, "lineitem"),
                                    read_table(spark, sf_dir, "part"))
    return ingest.hourly_sales(ingest.clean_sales(raw))


@register("rejected_sales", f"""
SELECT reason, COUNT(*) AS n_rows FROM (
  SELECT CASE WHEN {EV_QTY} IS NULL THEN 'bad_quantity'
              WHEN {EV_QTY} <= 0 THEN 'non_positive_quantity'
              WHEN {EV_PRICE} IS NULL THEN 'bad_price'
              WHEN {EV_PRICE} <= 0 THEN 'non_positive_price'
              WHEN ts IS NULL THEN 'bad_timestamp' END AS reason
  FROM events) WHERE reason IS NOT NULL GROUP BY 1""")
def q_rejected_sales(spark, sf_dir):
    """Q2: dropped sale lines counted by reason."""
    raw = sales_lines_from_events(read_table(spark, sf_dir, "events"))
    return ingest.rejected_sales(raw).groupBy("reason").agg(F.count(F.lit(1)).alias("n_rows"))


@register("hourly_merge", EV_HOURLY)
def q_hourly_merge(spark, sf_dir):
    """Per-file (per-day) partial roll-ups merged additively equal the one-shot roll-up."""
    clean = events_clean(spark, sf_dir).withColumn(
        "file_name", F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit(".csv")))
    per_file = ingest.hourly_sales(clean, "file_name")
    return ingest.hourly_merge(per_file)


def _daily_csv_dir(spark, sf_dir):
    """Derive one sales CSV file per day from ``events`` under the shared scratch folder."""
    out = scratch_path(spark, "sales-csv")
    sales_files.write_daily_sales_csv(
        sales_lines_from_events(read_table(spark, sf_dir, "events"), as_text=True), out)
    return out


@register("scan_sales_csv", """
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, COUNT(*) AS n_lines FROM events GROUP BY 1""")
def q_scan_sales_csv(spark, sf_dir):
    """Positional scan of files derived from ``events``, lines counted per day."""
    scanned = sales_files.scan_sales_csv(spark, _daily_csv_dir(spark, sf_dir))
    return scanned.groupBy(F.substring("timestamp", 1, 10).alias("day")).agg(
        F.count(F.lit(1)).alias("n_lines"))


# Files with bad lines, derived from events: one file per (day, event_id mod 4). By day of the
# month mod 7: 3 - every 50th line lacks a field (the file FAILS); 5 - every 10th quantity is no
# number (the row is skipped); 4 - of 20 quantities one has twelve digits, of 20 prices one is 1e20
# (both are valid, kept by the wide sums and counted); 6 - the category is quoted and holds doubled quotes and a
# comma (legal); 2 - every 50th line has a quote inside a plain field (FAILS).
DIRTY_LINES = f"""
  SELECT strftime(ts, '%Y-%m-%d') || '-' || CAST(event_id % 4 AS VARCHAR) || '.csv' AS file_name, ts,
         CASE WHEN day(ts) % 7 = 6 THEN event_type || ', "x"' ELSE event_type END AS category_id,
         CASE WHEN day(ts) % 7 = 4 AND event_id % 20 = 0 THEN 250000000000 ELSE {EV_QTY} END AS quantity,
         CASE WHEN day(ts) % 7 = 4 AND event_id % 20 = 1 THEN '1e20' ELSE CAST({EV_PRICE} AS VARCHAR) END
           AS price,
         day(ts) % 7 = 3 AND event_id % 50 < 4 AS short,
         day(ts) % 7 = 2 AND event_id % 50 < 4 AS quoted,
         day(ts) % 7 = 4 AND (event_id % 20 = 0 AND {EV_PRICE} > 0 OR event_id % 20 = 1 AND {EV_QTY} > 0)
           AS large,
         CASE WHEN day(ts) % 7 = 4 AND event_id % 20 = 0 THEN {EV_PRICE} > 0
              WHEN day(ts) % 7 = 4 AND event_id % 20 = 1 THEN {EV_QTY} > 0
              ELSE {EV_QTY} > 0 AND {EV_PRICE} > 0 AND NOT (day(ts) % 7 = 5 AND event_id % 10 = 0)
              END AS good
  FROM events
"""
DIRTY_OUTCOME = f"""
  SELECT file_name, CASE WHEN bool_or(quoted) THEN 0 ELSE COUNT(*) END AS n_records,
         CAST(CASE WHEN bool_or(quoted) THEN 1 ELSE SUM(CAST(short AS INTEGER)) END AS BIGINT)
           AS n_malformed,
         CASE WHEN bool_or(quoted) OR bool_or(short) THEN 'FAILED' ELSE 'SUCCESS' END AS status,
         CAST(CASE WHEN bool_or(quoted) OR bool_or(short) THEN 0
              ELSE SUM(CAST(good AS INTEGER)) END AS BIGINT) AS n_valid,
         CAST(CASE WHEN bool_or(quoted) OR bool_or(short) THEN 0
              ELSE SUM(CAST(large AS INTEGER)) END AS BIGINT) AS n_wide
  FROM ({DIRTY_LINES}) GROUP BY 1
"""


def dirty_csv_dir(spark, sf_dir):
    """Writes the files described above to the shared scratch folder."""
    e = sales_lines_from_events(read_table(spark, sf_dir, "events"), as_text=True)
    k = F.col("transaction_id").cast("long")
    kind = F.day(F.to_date(F.substring("timestamp", 1, 10))) % 7
    cat = F.when(kind == 6, F.concat(F.lit('"'), "category_id", F.lit(', ""x"""'))).otherwise(
        F.col("category_id"))
    qty = (F.when((kind == 5) & (k % 10 == 0), F.lit("many"))
           .when((kind == 4) & (k % 20 == 0), F.lit("250000000000")).otherwise(F.col("quantity")))
    price = F.when((kind == 4) & (k % 20 == 1), F.lit("1e20")).otherwise(F.col("price_per_unit"))
    stamp = F.when((kind == 2) & (k % 50 < 4), F.concat("timestamp", F.lit('"'))).otherwise(
        F.col("timestamp"))
    head = ["transaction_id", "product_id", cat, qty, price]
    line = F.when((kind == 3) & (k % 50 < 4), F.concat_ws(",", *head)).otherwise(
        F.concat_ws(",", *head, stamp))
    name = F.concat_ws("-", F.substring("timestamp", 1, 10), (k % 4).cast("string"))
    lines = e.select(name.alias("_file"), line.alias("value"), F.lit(1).alias("_o"))
    header = lines.select("_file").distinct().select(
        "_file", F.lit(",".join(RAW_SALE_COLUMNS)).alias("value"), F.lit(0).alias("_o"))
    out = scratch_path(spark, "dirty-csv")
    (lines.unionByName(header).repartition("_file").sortWithinPartitions("_file", "_o", "value")
     .drop("_o").write.partitionBy("_file").option("compression", "none").format("csv")
     .option("quote", "").option("sep", "\u0001").option("emptyValue", "").save(out))
    return out


@register("file_quality", f"""
SELECT file_name, n_records, n_malformed, status FROM ({DIRTY_OUTCOME})""")
def q_file_quality(spark, sf_dir):
    return sales_files.scan_quality(spark, dirty_csv_dir(spark, sf_dir))


@register("load_sales_outcome", f"SELECT * FROM ({DIRTY_OUTCOME})")
def q_load_sales_outcome(spark, sf_dir):
    """Outcome per file of one load cycle over files with bad lines."""
    return etl.load_sales(spark, dirty_csv_dir(spark, sf_dir), scratch_path(spark, "dirty-fact"),
                          scratch_path(spark, "dirty-ledger"), "2024-02-01 00:00:00") \
        .select("file_name", "n_records", "n_malformed", "status", "n_valid", "n_wide")


@register("load_sales_fact", f"""
SELECT date_trunc('hour', ts) AS time, category_id,
       SUM(CASE WHEN price = '1e20' THEN CAST(CAST(quantity AS DECIMAL(5,0)) * CAST('1e20' AS DECIMAL(21,0))
                                              AS DECIMAL(38,12))
                ELSE CAST(CAST(quantity AS DECIMAL(12,0)) * CAST(price AS DECIMAL(26,12))
                          AS DECIMAL(38,12)) END) AS total_sales,
       CAST(SUM(quantity) AS BIGINT) AS total_quantity
FROM ({DIRTY_LINES}) JOIN ({DIRTY_OUTCOME}) o USING (file_name)
WHERE good AND o.status = 'SUCCESS' GROUP BY 1, 2""")
def q_load_sales_fact(spark, sf_dir):
    """The fact after loading the same files (the FAILED ones add nothing)."""
    fact = scratch_path(spark, "dirty-fact")
    etl.load_sales(spark, dirty_csv_dir(spark, sf_dir), fact, scratch_path(spark, "dirty-ledger"),
                   "2024-02-01 00:00:00")
    return store.read_fact(spark, fact).drop("total_value")


LEDGER_SQL = """
  SELECT o_orderkey AS id, 'f' || CAST(o_orderkey % 5000 AS VARCHAR) AS file_name,
         CASE o_orderstatus WHEN 'F' THEN 'FAILED' WHEN 'O' THEN 'PENDING' ELSE 'SUCCESS' END
           AS status,
         o_orderdate AS last_updated
  FROM orders
"""
LEDGER_LATEST_SQL = f"""
  SELECT id, file_name, status, last_updated FROM (
    SELECT *, row_number() OVER (PARTITION BY file_name
                                 ORDER BY last_updated DESC, id DESC) AS rn
    FROM ({LEDGER_SQL})) WHERE rn = 1
"""


@register("ledger_latest", LEDGER_LATEST_SQL)
def q_ledger_latest(spark, sf_dir):
    return ingest.ledger_latest(ledger_from_orders(read_table(spark, sf_dir, "orders")))


@register("files_to_process", f"""
SELECT DISTINCT 'f' || CAST(o_orderkey % 6000 AS VARCHAR) || '.csv' AS file_name
FROM orders
WHERE 'f' || CAST(o_orderkey % 6000 AS VARCHAR) NOT IN (
  SELECT file_name FROM ({LEDGER_LATEST_SQL}) WHERE status = 'SUCCESS')""")
def q_files_to_process(spark, sf_dir):
    orders = read_table(spark, sf_dir, "orders")
    return ingest.files_to_process(listing_from_orders(orders), ledger_from_orders(orders))


@register("recent_etl_jobs", f"""
SELECT id, file_name, status, strftime(last_updated, '%Y-%m-%dT%H:%M:%SZ') AS last_updated
FROM ({LEDGER_SQL}) ORDER BY last_updated DESC, id DESC LIMIT 50""")
def q_recent_etl_jobs(spark, sf_dir):
    return ingest.recent_etl_jobs(ledger_from_orders(read_table(spark, sf_dir, "orders")))
