"""E1 — the sales load as one pass over the pending files (replaces the 20-worker loader).

    list *.csv -> minus files already SUCCESS in the ledger -> one scan of all pending files,
    split and cleaned line by line, reduced at once to (file, field count, hour, category)
    totals -> written once; header widths, outcomes, deltas and ledger rows are all derived
    from that small table -> deltas of SUCCESS files (dynamic partition overwrite: a re-run
    replaces, never adds) -> ledger rows.

Only files with a quoted line break or bad quoting are read a second time, by lines too.
Spark tasks replace the worker pool; a file is still the unit of atomicity: its delta
partition and its ledger row are written by the same job, and a file whose delta write
failed is not marked SUCCESS, so the next run retries it (Q8).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import store
from ..functions import exact
from ..functions.parsing import hour_of
from ..operators import dims, ingest
from ..schemas import FACT_DELTA, LEDGER, RAW_SALE_COLUMNS
from ..sources import sales_files
from ..util import materialize

OUTCOME = ("file_name string, status string, n_records long, n_malformed long, n_valid long, "
           "n_wide long")
SUMS = ["sales", "high", "low", "quantity"]


def pending_files(spark: SparkSession, sales_dir: str, ledger_path: str,
                  by_name_only: bool = True) -> DataFrame:
    """Listed files that still need loading, with their path and modification time."""
    listing = sales_files.list_sales_files(spark, sales_dir).withColumn(
        "file_mtime", F.col("modification_time").cast("timestamp_ntz"))
    ledger = store.read_or_empty(spark, ledger_path, LEDGER)
    todo = ingest.files_to_process(listing.select("file_name", "file_mtime"), ledger,
                                   by_name_only)
    return todo.join(listing, "file_name")


def file_totals(records: DataFrame) -> DataFrame:
    """Records reduced to one row per (file, field count, hour, category, exponent of wide sales):
    number of records, of valid and of wide ones, exact sums, the place of the first record, and
    what that one adds.

    The first record of a file is its header, which counts for nothing even if it reads like
    a sale; its share is kept apart so that it can be taken off again."""
    fields = F.col("fields")
    raw = records.select("file_name", "place", "whole", F.size(fields).alias("width"), *[
        F.get(fields, F.lit(i)).alias(c) for i, c in enumerate(RAW_SALE_COLUMNS)])
    typed = raw.select(
        "file_name", "place", "whole", "width", "category_id",
        ingest._quantity(raw).alias("q"), ingest._price(raw).alias("p"),
        ingest._price_value(raw).alias("v"), ingest._stamp(raw).alias("ts"))
    q, p, v = F.col("q"), F.col("p"), F.col("v")
    valid = F.coalesce(F.col("whole") & (F.col("width") >= 6) & (q > 0) & (v > 0)
                       & F.col("ts").isNotNull(), F.lit(False))
    judged = typed.select("*", valid.alias("ok"), (valid & exact.is_wide(q, p, v)).alias("wide"))
    ok, wide = F.col("ok"), F.col("wide")
    rows = judged.select(
        "file_name", "place", "whole", "width", "ok", "wide",
        F.when(ok, hour_of(F.col("ts"))).alias("time"),
        F.when(ok, F.col("category_id")).alias("category_id"),
        F.when(wide, exact.exponent(v)).alias("exp10"),
        F.when(ok & ~wide, exact.narrow_revenue(q, p)).alias("sales"),
        F.when(wide, exact.wide_high(q, v)).alias("high"),
        F.when(wide, exact.wide_low(q, v)).alias("low"),
        F.when(ok, q.cast("decimal(19,0)")).alias("quantity"))
    return (rows.groupBy("file_name", "whole", "width", "time", "category_id", "exp10")
            .agg(F.count(F.lit(1)).alias("n"), F.sum(ok.cast("long")).alias("n_ok"),
                 F.sum(wide.cast("long")).alias("n_wide"), *[F.sum(c).alias(c) for c in SUMS],
                 F.min_by(F.struct("place", "ok", "wide", *SUMS), "place").alias("first")))


def load_outcome(totals: DataFrame, todo: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per-file outcome and the deltas of the SUCCESS files, from ``file_totals``.

    A file is FAILED if it has no record at all (empty: no header), a badly quoted line, or a
    record whose field count differs from the header's; records that are all too short are
    skipped and the file is SUCCESS. ``n_wide`` counts the valid records of a SUCCESS file that the
    wide sums hold (``functions/exact.py``)."""
    head = totals.groupBy("file_name").agg(
        F.min_by(F.struct("width", "first.place"), "first.place").alias("h"))
    joined = totals.join(head, "file_name")
    is_head = F.col("first.place") == F.col("h.place")
    # A difference of two 38-digit decimals would lose their last decimal.
    spare = lambda c: F.col(c).cast(exact.SUM) if c.endswith("sales") else F.col(c)
    less = lambda c: F.when(is_head, F.coalesce(spare(f"first.{c}"), F.lit(0))).otherwise(F.lit(0))
    taken = joined.select(
        "file_name", "time", "category_id", "exp10", "width", F.col("h.width").alias("header"),
        "whole", (F.col("n") - is_head.cast("long")).alias("n"),
        (F.col("n_ok") - (is_head & F.col("first.ok")).cast("long")).alias("n_ok"),
        (F.col("n_wide") - (is_head & F.col("first.wide")).cast("long")).alias("n_wide"),
        *[(spare(c) - less(c)).cast(joined.schema[c].dataType).alias(c) for c in SUMS])
    bad = ~F.col("whole") | (F.col("width") != F.col("header"))
    per_file = taken.groupBy("file_name").agg(
        F.sum("n").alias("n_records"), F.sum(F.when(bad, F.col("n")).otherwise(0)).alias("_bad"),
        F.max(~F.col("whole")).alias("_quote"), F.sum("n_ok").alias("_ok"),
        F.sum("n_wide").alias("_wide"))
    failed = F.col("n_records").isNull() | (F.col("_bad") > 0) | F.col("_quote")
    outcome = todo.select("file_name", "file_mtime").join(per_file, "file_name", "left").select(
        "file_name", F.when(failed, F.lit("FAILED")).otherwise(F.lit("SUCCESS")).alias("status"),
        F.coalesce("n_records", F.lit(0)).alias("n_records"),
        F.greatest(F.coalesce("_bad", F.lit(0)),
                   F.coalesce(F.col("_quote"), F.lit(False)).cast("long")).alias("n_malformed"),
        F.when(failed, F.lit(0)).otherwise(F.col("_ok")).cast("long").alias("n_valid"),
        F.when(failed, F.lit(0)).otherwise(F.col("_wide")).cast("long").alias("n_wide"),
        "file_mtime")
    good = outcome.where("status = 'SUCCESS'").select("file_name")
    delta = (taken.where("n_ok > 0").join(good, "file_name")
             .groupBy(F.col("file_name").alias("source_file"), "time", "category_id", "exp10")
             .agg(*[F.sum(c).alias(c) for c in SUMS])
             .withColumnsRenamed({"sales": "total_sales", "high": "wide_high", "low": "wide_low",
                                  "quantity": "total_quantity"})
             .select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in FACT_DELTA]))
    # A marker row per loaded file, so that a file without valid rows replaces its old delta.
    markers = good.select(*[
        (F.col("file_name") if f.name == "source_file" else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in FACT_DELTA])
    return outcome, delta.unionByName(markers)


def load_sales(spark: SparkSession, sales_dir: str, fact_path: str, ledger_path: str,
               as_of, by_name_only: bool = True) -> DataFrame:
    """Run one load cycle. Returns the per-file outcome (file_name, status, n_records,
    n_malformed, n_valid, n_wide)."""
    todo = materialize(pending_files(spark, sales_dir, ledger_path, by_name_only))
    # Spark scans a list of paths; it is as long as the folder's listing, which its file index
    # holds on the driver anyway.
    paths = {r.file_name: r.path for r in todo.select("file_name", "path").collect()}
    if not paths:
        return spark.createDataFrame([], OUTCOME)
    totals = materialize(file_totals(sales_files.read_lines(spark, list(paths.values()))))
    odd = [r.file_name for r in totals.where(~F.col("whole")).select("file_name").distinct()
           .collect()]
    if odd:
        again = file_totals(sales_files.read_whole(spark, [paths[o] for o in odd]))
        totals = materialize(totals.join(again.select("file_name").distinct(), "file_name",
                                         "left_anti").select(*again.columns).unionByName(again))
    outcome, delta = load_outcome(totals, todo)
    outcome = materialize(outcome)
    store.write_file_deltas(delta, fact_path)
    store.append(ingest.ledger_rows(outcome, as_of), ledger_path)
    return outcome.drop("file_mtime")


def load_metadata(raw_categories: DataFrame, raw_products: DataFrame):
    """E1 metadata (S10/S11): validate both dimensions together; a repeated category or
    product id, or a product whose category is unknown, refuses the whole refresh. Returns
    both tables and the report (relation, key, n_rows)."""
    from ..operators import quality
    cats = dims.dim_categories(raw_categories)
    prods = dims.dim_products(raw_products)
    named = lambda df, key, table: quality.duplicate_keys(df, [key], table).withColumnRenamed(
        "table_name", "relation")
    report = quality.union_reports(
        quality.fk_orphans(prods, cats, "category_id", "category_id",
                           "products.category_id->categories"),
        named(cats, "category_id", "categories"), named(prods, "product_id", "products"))
    return cats, prods, report


def _ledger_status(spark: SparkSession, names: list[str], status: str, ledger_path: str,
                   as_of) -> None:
    rows = spark.createDataFrame([(n, status) for n in names], "file_name string, status string")
    store.append(ingest.ledger_rows(rows, as_of), ledger_path)


def refresh_metadata(spark: SparkSession, raw_categories: DataFrame, raw_products: DataFrame,
                     categories_path: str, products_path: str, ledger_path: str | None = None,
                     as_of=None, names=("categories.csv", "products.csv")) -> DataFrame:
    """Refresh both dimensions on every run, all or nothing: they are written
    only when no key is repeated and no product is an orphan; the outcome (SUCCESS or FAILED)
    is recorded in the ledger for both files. Returns the report of offending keys.

    Both tables (folders of one parent folder) become current in one commit, so that no reader
    and no crash sees products without their categories; a refresh that another writer
    overtakes is applied after it, as the input is the whole table."""
    cats, prods, orphans = load_metadata(raw_categories, raw_products)
    cats, prods, orphans = materialize(cats), materialize(prods), materialize(orphans)
    ok = orphans.isEmpty()
    if ok:
        (root, c_name), (other, p_name) = store._place(categories_path), store._place(products_path)
        if root != other:
            raise ValueError("both tables must be folders of one parent folder")
        store.commit(root, replace={c_name: cats, p_name: prods})
    if ledger_path:
        _ledger_status(spark, list(names), "SUCCESS" if ok else "FAILED", ledger_path, as_of)
    return orphans


def load_promotions(spark: SparkSession, raw_promotions: DataFrame, promotions_path: str,
                    ledger_path: str | None = None, as_of=None,
                    name: str = "promotions.csv") -> DataFrame:
    """Typed promotions; invalid rows skipped; a fractional discount or a repeated
    id refuses
    the whole file (nothing written, FAILED in the ledger). Returns the skipped rows."""
    from ..operators import quality
    promos = dims.dim_promotions(raw_promotions)
    refused = (promos.isEmpty() and not raw_promotions.isEmpty() and not
               dims.typed_promotions(raw_promotions).where("fractional").isEmpty()) or not \
        quality.duplicate_keys(promos, ["promotion_id"], "promotions").isEmpty()
    if not refused:
        store.write_snapshot(promos, promotions_path)
    if ledger_path:
        _ledger_status(spark, [name], "FAILED" if refused else "SUCCESS", ledger_path, as_of)
    return dims.rejected_promotions(raw_promotions)


def refresh_metadata_files(spark: SparkSession, categories_csv: str, products_csv: str,
                           categories_path: str, products_path: str, ledger_path: str,
                           as_of) -> str:
    """S4/S5/S10/S11 from files: a malformed record in either file fails both (nothing
    written, FAILED recorded); otherwise the all-or-nothing orphan check decides."""
    from ..sources import dim_files
    cats, bad_c = dim_files.read_categories(spark, categories_csv)
    prods, bad_p = dim_files.read_products(spark, products_csv)
    names = [categories_csv.rsplit("/", 1)[-1], products_csv.rsplit("/", 1)[-1]]
    if bad_c or bad_p:
        _ledger_status(spark, names, "FAILED", ledger_path, as_of)
        return "FAILED"
    orphans = refresh_metadata(spark, cats, prods, categories_path, products_path,
                               ledger_path, as_of, names)
    return "SUCCESS" if orphans.isEmpty() else "FAILED"


def load_promotions_file(spark: SparkSession, promotions_csv: str, promotions_path: str,
                         ledger_path: str, as_of) -> str:
    """S6 from a file: malformed record or fractional discount -> FAILED, nothing written."""
    from ..sources import dim_files
    raw, bad = dim_files.read_promotions(spark, promotions_csv)
    name = promotions_csv.rsplit("/", 1)[-1]
    if bad:
        _ledger_status(spark, [name], "FAILED", ledger_path, as_of)
        return "FAILED"
    load_promotions(spark, raw, promotions_path, ledger_path, as_of, name)
    latest = ingest.ledger_latest(spark.read.parquet(ledger_path)).where(
        F.col("file_name") == name).first()
    return latest.status
