"""Hourly totals of a sale stream with an account of its late rows.

Spark's own windowed aggregation drops a row that is later than the watermark without a trace.
Here each micro-batch is reduced to what it adds per (hour, category), on-time and late rows
apart, and that is committed under the batch's number together with the newest stamp seen so
far. So no row is lost, on-time plus late totals are the batch recount over all messages, and
whoever runs the nightly recount (T4) sees beforehand which hours it will change.

A row is late when its hour had ended ``delay`` or more before the newest stamp of all earlier
batches. The rule depends on the committed batches alone: a batch that is delivered again after
a failure gives the same rows, and is not added twice.

The stream keeps no state in memory. A batch is one aggregation with partial sums before the
exchange, however hot an hour or a category is, and reads nothing of the table but one stamp.
``compact_counted`` folds the batches into one folder while the stream runs.

Defined results: messages that ``clean_sales`` drops count nowhere; a batch without valid rows
moves nothing; rows of the first batch are never late; a stamp far in the future makes all that
follows late, as it does with a watermark, and late rows are still counted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import store
from ..functions.parsing import hour_of
from ..operators.ingest import clean_sales
from ..schemas import MONEY
from .hourly import read_sale_messages, run_number


def batch_totals(clean: DataFrame, newest: str | None, delay: str) -> DataFrame:
    """What a micro-batch of clean sale lines adds per (hour, category, late); ``newest``: the
    newest stamp of the earlier batches."""
    hour = hour_of(F.col("ts"))
    late = F.lit(False) if newest is None else (
        hour + F.expr("INTERVAL 1 HOUR")
        <= F.lit(newest).cast("timestamp_ntz") - F.expr(f"INTERVAL {delay}"))
    return (clean.groupBy(hour.alias("time"), "category_id", late.alias("late"))
            .agg(F.count(F.lit(1)).alias("n"), F.sum("revenue").cast(MONEY).alias("sales"),
                 F.sum("quantity").cast("long").alias("quantity"), F.max("ts").alias("newest")))


def count_batch(table_path: str, run: int, delay: str):
    """``foreachBatch`` sink: commits a micro-batch's totals once."""
    def _apply(batch: DataFrame, batch_id: int) -> None:
        at = store.progress(batch.sparkSession, table_path)
        before = at["note"] if at and at["run"] == run else None

        def newest(written: DataFrame) -> str | None:
            top = written.agg(F.max("newest").cast("string")).first()[0]
            if before is None or top is None:
                return top or before
            return written.sparkSession.range(1).select(F.greatest(
                F.lit(before).cast("timestamp_ntz"),
                F.lit(top).cast("timestamp_ntz")).cast("string")).first()[0]

        store.commit_batch(batch_totals(batch, before, delay), table_path, run, batch_id, newest)
    return _apply


def run_counted_stream(spark: SparkSession, source: str, table_path: str, checkpoint: str,
                       delay: str = "2 hours", max_files_per_trigger: int | None = None) -> None:
    """Reads the messages available in ``source`` and adds them to the table."""
    clean = clean_sales(read_sale_messages(spark, source,
                                           max_files_per_trigger=max_files_per_trigger))
    at = store.progress(spark, table_path)
    run = run_number(spark, checkpoint, at and at["run"])
    q = (clean.writeStream.option("checkpointLocation", checkpoint)
         .foreachBatch(count_batch(table_path, run, delay))
         .trigger(availableNow=True).start())
    q.awaitTermination()


def read_counted(spark: SparkSession, table_path: str) -> DataFrame | None:
    """Per (hour, category): totals of the on-time rows, and number and totals of the late ones
    (None before the first batch)."""
    rows = store.read_current(spark, table_path)
    if rows is None:
        return None

    def total(name: str, late: bool, kind) -> F.Column:
        mine = F.col("late") if late else ~F.col("late")
        return F.coalesce(F.sum(F.when(mine, F.col(name))), F.lit(0)).cast(kind)

    return rows.groupBy("time", "category_id").agg(
        total("sales", False, MONEY).alias("total_sales"),
        total("quantity", False, "long").alias("total_quantity"),
        total("n", True, "long").alias("late_rows"), total("sales", True, MONEY).alias("late_sales"),
        total("quantity", True, "long").alias("late_quantity"))


def compact_counted(spark: SparkSession, table_path: str) -> int:
    """Folds the batches committed so far into one folder."""
    return store.compact(spark, table_path, lambda rows: rows.groupBy(
        "time", "category_id", "late").agg(
            F.sum("n").alias("n"), F.sum("sales").cast(MONEY).alias("sales"),
            F.sum("quantity").cast("long").alias("quantity"), F.max("newest").alias("newest")))
