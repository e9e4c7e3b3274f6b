"""Registered streaming queries: the events table replayed as a JSON sale stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources.tables import read_table, sales_lines_from_events
from ..streaming import hourly, late
from .q_ingest import EV_CLEAN, EV_HOURLY
from .registry import register

ARRIVALS = 6


def _six_days():
    """Number of the delivery by the day of the month of a message's stamp."""
    return F.floor((F.substring("timestamp", 9, 2).cast("int") - 1) / 6)


def _deliver(spark, sf_dir, arrival, each):
    """Stand-in source: the events as JSON messages in ``ARRIVALS`` deliveries, numbered by
    ``arrival``, that reach the source folder one after the other; ``each(source)`` runs after
    every one of them."""
    staged, src = scratch_path(spark, "staged-messages"), scratch_path(spark, "sale-messages")
    lines = sales_lines_from_events(read_table(spark, sf_dir, "events"), as_text=True)
    number = F.greatest(F.lit(0), F.least(arrival.cast("int"), F.lit(ARRIVALS - 1)))  # null: the first
    lines.withColumn("arrival", number).write.partitionBy("arrival").json(staged)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(src).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path(src))
    for i in range(ARRIVALS):
        if fs.exists(path(f"{staged}/arrival={i}")):
            fs.rename(path(f"{staged}/arrival={i}"), path(f"{src}/arrival={i}"))
        each(src)


@register("stream_hourly", EV_HOURLY)
def q_stream_hourly(spark, sf_dir):
    """Events -> JSON messages in six deliveries of whole days, one or more triggers each
    -> Structured Streaming (watermark 2 h, update mode, foreachBatch replace-upsert) -> the
    stream-owned table. Equals the batch roll-up because no message is later than the
    watermark."""
    table, checkpoint = scratch_path(spark, "stream-fact"), scratch_path(spark, "stream-ckpt")
    _deliver(spark, sf_dir, _six_days(),
             lambda src: hourly.run_stream_to_table(spark, src, table, checkpoint))
    return hourly.read_stream_table(spark, table)


@register("late_rows", f"""
WITH sales AS (
  SELECT date_trunc('hour', ts) AS time, category_id, ts, revenue, quantity,
         LEAST((day(ts) - 1) // 6 + CASE WHEN CAST(transaction_id AS BIGINT) % 10 = 3 THEN 1 ELSE 0 END,
               {ARRIVALS - 1}) AS arrival
  FROM ({EV_CLEAN})),
heads AS (SELECT arrival, MAX(ts) AS newest FROM sales GROUP BY arrival),
marks AS (
  SELECT arrival, MAX(newest) OVER (ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING
                                    AND 1 PRECEDING) - INTERVAL 2 HOUR AS mark FROM heads),
flagged AS (
  SELECT s.*, COALESCE(s.time + INTERVAL 1 HOUR <= m.mark, FALSE) AS late
  FROM sales s JOIN marks m USING (arrival))
SELECT time, category_id,
       CAST(COALESCE(SUM(CASE WHEN NOT late THEN revenue END), 0) AS DECIMAL(38,12)) AS total_sales,
       CAST(COALESCE(SUM(CASE WHEN NOT late THEN quantity END), 0) AS BIGINT) AS total_quantity,
       CAST(COUNT(CASE WHEN late THEN 1 END) AS BIGINT) AS late_rows,
       CAST(COALESCE(SUM(CASE WHEN late THEN revenue END), 0) AS DECIMAL(38,12)) AS late_sales,
       CAST(COALESCE(SUM(CASE WHEN late THEN quantity END), 0) AS BIGINT) AS late_quantity
FROM flagged GROUP BY time, category_id""")
def q_late_rows(spark, sf_dir):
    """The same messages, some of which come one delivery late; totals of the on-time
    rows, and the late ones counted apart. The batches are compacted between two deliveries."""
    table, checkpoint = scratch_path(spark, "counted"), scratch_path(spark, "counted-ckpt")
    behind = F.when(F.col("transaction_id").cast("long") % 10 == 3, 1).otherwise(0)
    done = []

    def each(src):
        late.run_counted_stream(spark, src, table, checkpoint)
        done.append(src)
        if len(done) == ARRIVALS // 2:
            late.compact_counted(spark, table)

    _deliver(spark, sf_dir, _six_days() + behind, each)
    return late.read_counted(spark, table)
