"""Sales ingest: cleaning, hourly roll-up, file ledger and the idempotent fact merge.

Design for scale: raw sale lines are the only input that grows with the business (100 TB);
everything downstream of ``hourly_sales`` is hours x categories. The roll-up therefore runs
as one hash aggregate with map-side partial aggregation, so the shuffle carries at most one
row per (task, hour, category) regardless of how hot a category is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.formatting import rfc3339
from ..functions.parsing import hour_of, parse_double, parse_int, parse_price, parse_sale_ts
from ..schemas import MONEY, PRICE, QUANTITY


def clean_sales(raw: DataFrame) -> DataFrame:
    """Typed, valid sale lines.

    A quantity or price that is not a number, or is not positive, drops the row; so does a
    stamp that is not ``yyyy-MM-ddTHH:mm:ss[.fraction]``. The sign of a price is that of its
    unrounded value. Non-finite prices and values too large for the exact types are left out
    and listed by ``rejected_sales``. Extra columns (for example ``file_name``) pass through.
    """
    extra = [c for c in raw.columns if c not in
             ("transaction_id", "product_id", "category_id", "quantity", "price_per_unit",
              "timestamp")]
    typed = raw.select(
        *extra,
        "transaction_id", "product_id", "category_id",
        _quantity(raw).alias("quantity"),
        _price(raw).alias("price_per_unit"),
        _stamp(raw).alias("ts"), _price_value(raw).alias("_price"),
    )
    exact = F.col("quantity").try_cast(QUANTITY)
    return (
        typed.where((F.col("quantity") > 0) & (F.col("_price") > 0) & exact.isNotNull()
                    & F.col("price_per_unit").isNotNull() & F.col("ts").isNotNull())
        .withColumn("revenue", (exact * F.col("price_per_unit")).cast(MONEY))
        .drop("_price")
    )


def _type_of(raw: DataFrame, name: str):
    return raw.schema[name].dataType


def _quantity(raw: DataFrame):
    """Text is parsed strictly; an already integral column (typed source) is used as is."""
    dt = _type_of(raw, "quantity")
    if isinstance(dt, (T.IntegerType, T.LongType, T.ShortType, T.ByteType)):
        return F.col("quantity").try_cast("long")
    return parse_int(F.col("quantity").cast("string"))


def _price(raw: DataFrame):
    dt = _type_of(raw, "price_per_unit")
    if isinstance(dt, (T.DecimalType, T.IntegerType, T.LongType)):
        return F.col("price_per_unit").try_cast(PRICE)
    if isinstance(dt, (T.DoubleType, T.FloatType)):
        v = F.col("price_per_unit")
        return F.when(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), v.try_cast(PRICE))
    return parse_price(F.col("price_per_unit").cast("string"))


def _price_value(raw: DataFrame):
    """The unrounded price as a double (null when it is no finite number)."""
    dt = _type_of(raw, "price_per_unit")
    v = F.col("price_per_unit")
    if isinstance(dt, T.StringType):
        v = parse_double(v)
    else:
        v = v.cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), v)


def _stamp(raw: DataFrame):
    dt = _type_of(raw, "timestamp")
    if isinstance(dt, (T.TimestampNTZType, T.TimestampType)):
        return F.col("timestamp").cast("timestamp_ntz")
    return parse_sale_ts(F.col("timestamp").cast("string"))


def rejected_sales(raw: DataFrame) -> DataFrame:
    """Rows that clean_sales drops, with the reason (for counting, Q2); valid numbers that the
    exact types cannot hold are ``quantity_out_of_range`` and ``price_out_of_range``."""
    q = _quantity(raw)
    p = _price_value(raw)
    ts = _stamp(raw)
    reason = (F.when(q.isNull(), F.lit("bad_quantity"))
              .when(q <= 0, F.lit("non_positive_quantity"))
              .when(p.isNull(), F.lit("bad_price"))
              .when(p <= 0, F.lit("non_positive_price"))
              .when(q.try_cast(QUANTITY).isNull(), F.lit("quantity_out_of_range"))
              .when(_price(raw).isNull(), F.lit("price_out_of_range"))
              .when(ts.isNull(), F.lit("bad_timestamp")))
    return raw.withColumn("reason", reason).where(F.col("reason").isNotNull())


def hourly_sales(clean: DataFrame, *keys: str) -> DataFrame:
    """Roll-up to (hour, category) [+ keys]: total revenue (exact) and total quantity (A1)."""
    return (
        clean.groupBy(*keys, hour_of(F.col("ts")).alias("time"), "category_id")
        .agg(F.sum("revenue").cast(MONEY).alias("total_sales"),
             F.sum("quantity").cast("long").alias("total_quantity"))
    )


def hourly_merge(*partials: DataFrame) -> DataFrame:
    """Additive merge of per-file partial roll-ups into the fact.

    Each input is one delta per source file; the fact is the sum over deltas. Because a
    re-run replaces a file's delta instead of adding to it, loading a file twice changes
    nothing (Q7).
    """
    cols = ["time", "category_id", "total_sales", "total_quantity"]
    union = partials[0].select(*cols)
    for p in partials[1:]:
        union = union.unionByName(p.select(*cols))
    return (union.groupBy("time", "category_id")
            .agg(F.sum("total_sales").cast(MONEY).alias("total_sales"),
                 F.sum("total_quantity").cast("long").alias("total_quantity")))


# --------------------------------------------------------------------------------- ledger
def ledger_latest(ledger: DataFrame) -> DataFrame:
    """Last status per file (S16): the write with the latest stamp, ties by higher id.

    ``max_by`` over a struct is a plain hash aggregate with partial aggregation, so a file
    with millions of status writes never lands in one task as a group.
    """
    return (
        ledger.groupBy("file_name")
        .agg(F.max_by(F.struct("id", "status", "last_updated"),
                      F.struct("last_updated", "id")).alias("w"))
        .select(F.col("w.id").alias("id"), "file_name", F.col("w.status").alias("status"),
                F.col("w.last_updated").alias("last_updated"))
    )


def succeeded_files(ledger: DataFrame) -> DataFrame:
    """files whose latest status is SUCCESS."""
    return ledger_latest(ledger).where(F.col("status") == "SUCCESS").select("file_name")


def files_to_process(listing: DataFrame, ledger: DataFrame,
                     by_name_only: bool = True) -> DataFrame:
    """Listed ``*.csv`` files minus files already loaded with SUCCESS.

    FAILED and PENDING files are retried; a name never seen is new. With
    ``by_name_only=False`` the ledger key is (name, modification time): a file rewritten
    under the same name is loaded again (Q9); both frames then need ``file_mtime``.
    Ledger names are compared without their ``.csv`` suffix.
    """
    csv_only = listing.where(F.col("file_name").endswith(".csv"))
    latest = ledger_latest(ledger) if by_name_only else (
        ledger.groupBy("file_name", "file_mtime")
        .agg(F.max_by("status", F.struct("last_updated", "id")).alias("status")))
    done = latest.where(F.col("status") == "SUCCESS").select(
        F.concat(F.regexp_replace("file_name", r"\.csv$", ""), F.lit(".csv")).alias("done_name"),
        *([] if by_name_only else [F.col("file_mtime").alias("done_mtime")]))
    cond = csv_only["file_name"] == done["done_name"]
    if not by_name_only:
        cond = cond & (csv_only["file_mtime"] == done["done_mtime"])
    return csv_only.join(done, cond, "left_anti").select("file_name")


def ledger_rows(status_per_file: DataFrame, as_of) -> DataFrame:
    """New ledger rows (id, file_name, status, last_updated, file_mtime) stamped with the
    run time; the id is a stable hash of (file, run time)."""
    ts = F.lit(as_of).cast("timestamp_ntz")
    mtime = (F.col("file_mtime").cast("timestamp_ntz") if "file_mtime" in status_per_file.columns
             else F.lit(None).cast("timestamp_ntz"))
    return status_per_file.select(
        F.pmod(F.xxhash64("file_name", ts), F.lit(1 << 62)).alias("id"),
        "file_name", "status", ts.alias("last_updated"), mtime.alias("file_mtime"))


def recent_etl_jobs(ledger: DataFrame, limit: int | str | None = 50) -> DataFrame:
    """Most recent ETL ledger rows; default 50, capped at 200; text limit -> 0."""
    n = _clamp_limit(limit, default=50, cap=200)
    return (ledger.orderBy(F.col("last_updated").desc(), F.col("id").desc())
            .limit(n)
            .select("id", "file_name", "status",
                    rfc3339(F.col("last_updated"))
                    .alias("last_updated")))


def _clamp_limit(limit, default: int, cap: int) -> int:
    """The gateway's parse: missing -> default, not a number -> 0, above cap -> cap."""
    if limit is None:
        return default
    try:
        n = int(str(limit))
    except ValueError:
        n = 0
    return min(max(n, 0), cap)
