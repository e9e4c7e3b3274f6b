"""Streaming twin of the batch roll-up.

Sale messages (one JSON object per sale, the fields of a sales CSV line) are cleaned by the
same ``clean_sales`` as the batch path, rolled up in 1-hour tumbling windows per category
with a watermark, and upserted into a stream-owned table. Update mode emits the *full*
total of every window that changed, so the sink *replaces* (hour, category) rows — adding
would double count. Rows within the watermark are always counted; Spark may still count or
may drop a row later than the watermark (its documented guarantee), and state of windows
older than the watermark is evicted, so memory stays bounded. The nightly batch recount over
the files stays authoritative (T4).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ingest import clean_sales
from ..schemas import MONEY, RAW_SALE, RAW_SALE_COLUMNS

# Topic name the reference's collector was prepared to publish to.
TOPIC = "sales_transactions"

# Room for the batch ids of one run in a folder's number.
RUN = 1 << 40


def read_sale_messages(spark: SparkSession, source: str, fmt: str = "json",
                       max_files_per_trigger: int | None = None,
                       kafka_servers: str | None = None) -> DataFrame:
    """A stream of raw sale lines. ``fmt='json'`` reads JSON-lines files from a folder;
    ``fmt='kafka'`` reads the topic (needs the Kafka connector on the classpath)."""
    if fmt == "kafka":
        if not kafka_servers:
            raise ValueError("kafka_servers is needed for the Kafka source")
        msgs = (spark.readStream.format("kafka")
                .option("kafka.bootstrap.servers", kafka_servers)
                .option("subscribe", source).load()
                .select(F.col("value").cast("string").alias("json")))
        return msgs.select(F.from_json("json", RAW_SALE).alias("m")).select("m.*")
    reader = spark.readStream.schema(RAW_SALE).option("mode", "PERMISSIVE")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.json(source).select(*RAW_SALE_COLUMNS)


def stream_hourly(raw_stream: DataFrame, watermark: str = "2 hours") -> DataFrame:
    """Watermarked 1-hour tumbling totals per category."""
    # Event time must be a zoned TIMESTAMP for watermarks; the session zone is UTC, so the
    # wall clock is unchanged and the window start is cast back to the zone-less type.
    clean = clean_sales(raw_stream).withColumn("ts", F.col("ts").cast("timestamp"))
    return (clean.withWatermark("ts", watermark)
            .groupBy(F.window("ts", "1 hour"), "category_id")
            .agg(F.sum("revenue").cast(MONEY).alias("total_sales"),
                 F.sum("quantity").cast("long").alias("total_quantity"))
            .select(F.col("window.start").cast("timestamp_ntz").alias("time"), "category_id",
                    "total_sales", "total_quantity"))


def upsert_batch(table_path: str, run: int = 0):
    """``foreachBatch`` sink — each micro-batch writes its changed (hour, category) totals
    to a folder of its own, ``batch=<run * RUN + id>``; readers take the row of the latest batch
    per key. Batch ids start at 0 again with a new checkpoint, hence the run before them.

    Update mode emits full totals, so the latest one is right. Nothing that an earlier batch
    wrote is touched: a crash in the middle of a write can lose only the folder of the batch
    that Spark will replay, and a replay overwrites that folder with the same rows."""
    def _apply(batch: DataFrame, batch_id: int) -> None:
        (batch.select("time", "category_id", "total_sales", "total_quantity")
         .write.mode("overwrite").parquet(f"{table_path}/batch={run * RUN + batch_id}"))
    return _apply


def run_number(spark: SparkSession, checkpoint: str, last: int | None) -> int:
    """The number of the run that a checkpoint belongs to, kept in the checkpoint's folder. A
    checkpoint that has none yet (new, or lost and made anew) gets the one after ``last``, the
    newest run that the table knows."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/run-number")
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(p):
        stream = fs.open(p)
        try:
            return int(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
    number = 0 if last is None else last + 1
    draft = jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/.run-number")
    out = fs.create(draft, True)
    out.write(bytearray(str(number).encode()))
    out.close()
    fs.rename(draft, p)
    return number


def _last_run(spark: SparkSession, table_path: str) -> int | None:
    """Newest run among the batch folders of a table."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(table_path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [st.getPath().getName() for st in (fs.listStatus(p) if fs.exists(p) else [])]
    return max((int(n[6:]) // RUN for n in names if n.startswith("batch=")), default=None)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(p))


def read_stream_table(spark: SparkSession, table_path: str):
    """The stream-owned hourly table (or None before the first batch): per (hour, category) the
    totals of the latest complete batch that changed it."""
    if not _exists(spark, table_path):
        return None
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(table_path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = [st.getPath().toString() for st in fs.listStatus(p) if fs.exists(
        jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS"))]
    if not done:
        return None
    rows = spark.read.option("basePath", table_path).parquet(*done)
    latest = F.max_by(F.struct("total_sales", "total_quantity"), "batch").alias("v")
    return (rows.groupBy("time", "category_id").agg(latest)
            .select("time", "category_id", "v.total_sales", "v.total_quantity"))


def compact_stream_table(spark: SparkSession, table_path: str, target: str) -> None:
    """Writes the current totals as one batch folder of a new table (run between streams)."""
    read_stream_table(spark, table_path).write.parquet(f"{target}/batch=-1")


def run_stream_to_table(spark: SparkSession, source: str, table_path: str,
                        checkpoint: str, watermark: str = "2 hours",
                        max_files_per_trigger: int | None = None) -> None:
    """Run the stream until the available input is consumed (``availableNow``)."""
    agg = stream_hourly(read_sale_messages(spark, source,
                                           max_files_per_trigger=max_files_per_trigger),
                        watermark)
    run = run_number(spark, checkpoint, _last_run(spark, table_path))
    q = (agg.writeStream.outputMode("update")
         .option("checkpointLocation", checkpoint)
         .foreachBatch(upsert_batch(table_path, run))
         .trigger(availableNow=True).start())
    q.awaitTermination()
