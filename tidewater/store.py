"""Where tables live between jobs: plain parquet folders with two conventions.

* Per-file deltas (Q7): the hourly fact is stored as one partition per source file
  (``source_file=<name>``) and written with dynamic partition overwrite, so re-loading a
  file replaces its delta instead of adding to it; the fact is the sum over partitions.
* Snapshots (Q20): a table that is replaced as a whole (live forecasts, dimensions) is
  written to a new ``snap=<id>`` folder; readers follow the newest *complete* snapshot
  (its ``_SUCCESS`` marker is written last by Spark), so they never see a half-written or
  empty table.
* Commits: tables that change together (categories and products; live forecasts and their
  archive) or whose keys are unique (registry, performance) are written to folders of their own,
  which no reader sees, and then named in a numbered manifest. A manifest is created complete
  and only if its number is free, so of two writers one wins the number and the other starts
  from the winner's state; a crash before it leaves folders that nothing names.
* Stream tables are committed batch by batch: the manifest that names a micro-batch's folder also
  holds how far the stream has come, so a batch that is delivered again adds nothing. ``compact``
  puts one folder in the place of many while batches go on arriving and readers go on reading,
  and ``drop_old_manifests`` removes what only old manifests name.
The ledger is a plain parquet append: its readers take the latest row per file.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import exact
from .schemas import FACT_DELTA
from .util import materialize


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    _, p, fs = _fs(spark, path)
    return bool(fs.exists(p))


# ------------------------------------------------------------------------ per-file deltas
def write_file_deltas(per_file: DataFrame, fact_path: str) -> None:
    """Write per-file hourly deltas (``FACT_DELTA``); only the partitions of the files present
    are replaced.

    Rows are sorted by time inside each file, so parquet min/max statistics let time-range
    reads skip row groups (the role of the reference's time partitioning) without a second
    partition level that a re-loaded file could leave stale."""
    (per_file.select(*FACT_DELTA.names)
     .repartition("source_file")
     .sortWithinPartitions("source_file", "time", "category_id", "exp10")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("source_file").parquet(fact_path))


def read_fact(spark: SparkSession, fact_path: str, start=None, end=None) -> DataFrame:
    """The fact: sum of the per-file deltas per (hour, category) (A2), optionally for
    ``start <= time < end`` (pushed to the parquet scan). Rows without a stamp only mark that
    a file was loaded.

    ``total_value`` is the total as a double, whatever its size; ``total_sales`` is null when the
    total has over 25 digits before the point, ``total_quantity`` when it is beyond a long. An hour
    and category has at most one wide sum per power of ten that a double can have (some 650)."""
    deltas = spark.read.schema(FACT_DELTA).parquet(fact_path).where(F.col("time").isNotNull())
    if start is not None:
        deltas = deltas.where(F.col("time") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        deltas = deltas.where(F.col("time") < F.lit(end).cast("timestamp_ntz"))
    sums = deltas.groupBy("time", "category_id", "exp10").agg(
        *[F.sum(c).alias(c) for c in ("total_sales", "wide_high", "wide_low", "total_quantity")])
    wide = F.when(F.col("exp10").isNotNull(), F.struct(
        "exp10", F.col("wide_high").alias("high"), F.col("wide_low").alias("low")))
    merged = sums.groupBy("time", "category_id").agg(
        F.max("total_sales").alias("narrow"), F.collect_list(wide).alias("wide"),
        F.sum("total_quantity").alias("quantity"))
    return merged.select(
        "time", "category_id", exact.total_money(F.col("narrow"), F.col("wide")).alias("total_sales"),
        F.col("quantity").try_cast("long").alias("total_quantity"),
        exact.total_value(F.col("narrow"), F.col("wide")).alias("total_value"))


# ------------------------------------------------------------------------------ snapshots
def _snapshots(spark: SparkSession, table_path: str) -> list[str]:
    """Names of the complete snapshots, oldest first."""
    jvm, p, fs = _fs(spark, table_path)
    if not fs.exists(p):
        return []
    names = [st.getPath().getName() for st in fs.listStatus(p)
             if st.getPath().getName().startswith("snap=") and fs.exists(
                 jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS"))]
    return sorted(names, key=lambda n: (int(n[5:].split("-")[0]), n))


def snapshot_ids(spark: SparkSession, table_path: str) -> list[int]:
    return [int(n[5:].split("-")[0]) for n in _snapshots(spark, table_path)]


def _next(spark: SparkSession, table_path: str) -> tuple[int, str]:
    """Number and folder of a new snapshot; the random suffix keeps two writers apart."""
    ids = snapshot_ids(spark, table_path)
    number = ids[-1] + 1 if ids else 1
    return number, f"{table_path}/snap={number}-{uuid.uuid4().hex[:12]}"


def write_snapshot(df: DataFrame, table_path: str) -> int:
    """Write ``df`` as the next snapshot; it becomes current once complete. Of two writers at
    once both write their own folder and readers agree on one of them."""
    number, path = _next(df.sparkSession, table_path)
    df.write.parquet(path)
    return number


def write_group(tables: dict[str, DataFrame], root: str) -> int:
    """Write several tables as one snapshot of ``root``: all of them become current together,
    when the marker file is created last."""
    spark = next(iter(tables.values())).sparkSession
    number, path = _next(spark, root)
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}")
    _, marker, fs = _fs(spark, f"{path}/_SUCCESS")
    fs.create(marker, False).close()
    return number


def read_current(spark: SparkSession, table_path: str, schema=None) -> DataFrame | None:
    """The table as of the newest commit of its folder that names it, or its newest snapshot."""
    root, name = _place(table_path)
    folders = manifest(spark, root)[1].get(name)
    if folders:
        return _read_folders(spark, root, folders)
    names = _snapshots(spark, table_path)
    if not names:
        return spark.createDataFrame([], schema) if schema is not None else None
    return spark.read.parquet(f"{table_path}/{names[-1]}")


def read_group(spark: SparkSession, root: str, name: str, schema=None) -> DataFrame | None:
    """One table of the current snapshot that ``write_group`` wrote."""
    names = _snapshots(spark, root)
    if not names:
        return spark.createDataFrame([], schema) if schema is not None else None
    return spark.read.parquet(f"{root}/{names[-1]}/{name}")


def read_group_history(spark: SparkSession, root: str, name: str, schema) -> DataFrame:
    """All rows that the snapshots of ``root`` hold in one of their tables."""
    names = _snapshots(spark, root)
    if not names:
        return spark.createDataFrame([], schema)
    return spark.read.parquet(*[f"{root}/{n}/{name}" for n in names])


def drop_old_snapshots(spark: SparkSession, table_path: str, keep: int = 2) -> None:
    """Removes all but the newest ``keep`` complete snapshots (readers may hold the last ones)."""
    for name in _snapshots(spark, table_path)[:-keep]:
        _, p, fs = _fs(spark, f"{table_path}/{name}")
        fs.delete(p, True)


# ------------------------------------------------------------------------------- commits
class Conflict(RuntimeError):
    """Another writer has changed a table since its contents were read."""


def _place(table_path: str) -> tuple[str, str]:
    """Root folder and name of a table."""
    root, _, name = table_path.rstrip("/").rpartition("/")
    return root, name


def manifest(spark: SparkSession, root: str, version: int | None = None) -> tuple[int, dict]:
    """Number and content of the newest manifest of ``root`` (or of ``version``): the folders,
    relative to it, that make up each table. (0, {}) before the first commit."""
    jvm, p, fs = _fs(spark, f"{root}/_manifest")
    if version is None:
        found = [int(st.getPath().getName()[:-5]) for st in (fs.listStatus(p) if fs.exists(p) else [])
                 if st.getPath().getName().endswith(".json") and
                 not st.getPath().getName().startswith(".")]
        version = max(found, default=0)
    if not version:
        return 0, {}
    stream = fs.open(jvm.org.apache.hadoop.fs.Path(p, f"{version:010d}.json"))
    try:
        return version, json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _create_manifest(spark: SparkSession, root: str, version: int, tables: dict) -> bool:
    """Compare and set: the whole manifest appears under its number, or nothing does if the
    number is taken (a rename that does not overwrite)."""
    jvm, folder, fs = _fs(spark, f"{root}/_manifest")
    draft = jvm.org.apache.hadoop.fs.Path(folder, f".{uuid.uuid4().hex}.json")
    out = fs.create(draft, False)
    try:
        out.write(bytearray(json.dumps(tables, sort_keys=True).encode()))
    finally:
        out.close()
    options = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    none = spark.sparkContext._gateway.new_array(options, 1)
    none[0] = options.NONE
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        files.rename(fs.makeQualified(draft), fs.makeQualified(
            jvm.org.apache.hadoop.fs.Path(folder, f"{version:010d}.json")), none)
        return True
    except Exception as e:
        fs.delete(draft, False)
        if "FileAlreadyExistsException" in str(e):
            return False
        raise


def _read_folders(spark: SparkSession, root: str, folders: list[str]) -> DataFrame:
    return spark.read.parquet(*[f"{root}/{f}" for f in folders])


def commit(root: str, replace: dict[str, DataFrame] | None = None,
           append: dict[str, DataFrame] | None = None, base: int | None = None) -> int:
    """Makes new contents of several tables of ``root`` current at once; returns the number of
    the manifest.

    ``base``: the manifest that the contents were made from. If another commit has since
    changed one of these tables, nothing changes and ``Conflict`` is raised; commits of other
    tables are taken over. Without it the last writer of a table wins."""
    replace, append = replace or {}, append or {}
    spark = next(iter({**replace, **append}.values())).sparkSession
    new = {name: f"{name}/gen={uuid.uuid4().hex}" for name in (*replace, *append)}
    for name, df in {**replace, **append}.items():
        df.write.parquet(f"{root}/{new[name]}")
    before = manifest(spark, root, base)[1] if base is not None else None
    while True:
        head, tables = manifest(spark, root)
        for name in new if before is not None else ():
            if tables.get(name) != before.get(name):
                raise Conflict(f"{root}/{name} has changed since manifest {base}")
        named = tables | {n: [new[n]] for n in replace} | {
            n: tables.get(n, []) + [new[n]] for n in append}
        if _create_manifest(spark, root, head + 1, named):
            return head + 1


def read_version(spark: SparkSession, table_path: str, version: int) -> DataFrame:
    """A table as of a manifest of its folder."""
    root, name = _place(table_path)
    return _read_folders(spark, root, manifest(spark, root, version)[1][name])


def append_unique(df: DataFrame, table_path: str, keys: list[str]) -> int:
    """Appends the rows whose key the table lacks and returns their number, so that a retry or
    an overlapping batch adds nothing twice. A writer that comes in between makes the
    comparison start again from its state. A key that occurs twice in ``df`` is an error.

    Null keys count as values, like any other."""
    spark = df.sparkSession
    root, name = _place(table_path)
    rows = materialize(df)
    twice = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").first()
    if twice is not None:
        raise ValueError(f"key {twice.asDict()} occurs more than once in one batch")
    while True:
        base, tables = manifest(spark, root)
        fresh = rows
        if name in tables:
            known = _read_folders(spark, root, tables[name]).select(
                *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
            same = F.lit(True)
            for i, k in enumerate(keys):
                same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
            fresh = materialize(rows.join(known, same, "left_anti"))
        n = fresh.count()
        if not n:
            return 0
        try:
            commit(root, append={name: fresh}, base=base)
            return n
        except Conflict:
            continue


# -------------------------------------------------------------------------- stream batches
def progress(spark: SparkSession, table_path: str) -> dict | None:
    """How far a stream table has come: run, batch, and the note of the last commit."""
    root, name = _place(table_path)
    return manifest(spark, root)[1].get(f"{name}#progress")


def _passed(tables: dict, name: str, run: int, batch: int) -> bool:
    at = tables.get(f"{name}#progress")
    return at is not None and (at["run"], at["batch"]) >= (run, batch)


def commit_batch(df: DataFrame, table_path: str, run: int, batch: int, note) -> bool:
    """Adds the rows of one micro-batch to a stream table, once: False if the table is already
    past (run, batch). ``note`` makes a small JSON value from the written rows, which is
    committed with them.

    Batches of one run add up. The first batch of a later run, which reads its source from the
    start because its checkpoint was lost, starts the table anew; what it replaces can be read
    with ``read_version`` until the old manifests are dropped."""
    spark = df.sparkSession
    root, name = _place(table_path)
    if _passed(manifest(spark, root)[1], name, run, batch):
        return False
    folder = f"{name}/gen={uuid.uuid4().hex}"
    df.write.parquet(f"{root}/{folder}")
    at = {"run": run, "batch": batch, "note": note(_read_folders(spark, root, [folder]))}
    while True:
        head, tables = manifest(spark, root)
        if _passed(tables, name, run, batch):
            return False
        last = tables.get(f"{name}#progress")
        kept = tables.get(name, []) if last and last["run"] == run else []
        if _create_manifest(spark, root, head + 1,
                            tables | {name: kept + [folder], f"{name}#progress": at}):
            return True


def compact(spark: SparkSession, table_path: str, reduce) -> int:
    """Puts one folder with ``reduce`` of the table's rows in the place of the folders it has
    now; returns the number of the manifest (0: nothing to do).

    Batches committed meanwhile stay named after it. If the table was started anew or compacted
    by another writer meanwhile, nothing changes and ``Conflict`` is raised. No folder is
    removed, so readers that hold an earlier manifest finish undisturbed."""
    root, name = _place(table_path)
    old = manifest(spark, root)[1].get(name, [])
    if len(old) < 2:
        return 0
    folder = f"{name}/gen={uuid.uuid4().hex}"
    reduce(_read_folders(spark, root, old)).write.parquet(f"{root}/{folder}")
    while True:
        head, tables = manifest(spark, root)
        now = tables.get(name, [])
        if now[:len(old)] != old:
            raise Conflict(f"{table_path} has been replaced during its compaction")
        if _create_manifest(spark, root, head + 1, tables | {name: [folder] + now[len(old):]}):
            return head + 1


def _folders(tables: dict) -> set[str]:
    return {f for name, folders in tables.items() if not name.endswith("#progress")
            for f in folders}


def drop_old_manifests(spark: SparkSession, root: str, keep: int = 10) -> int:
    """Removes all but the newest ``keep`` manifests and the folders that only those name;
    returns the number of folders removed. ``keep`` has to span the longest read, since a
    reader holds the folders of the manifest it started from."""
    if keep < 1:
        raise ValueError("the newest manifest cannot be dropped")
    jvm, p, fs = _fs(spark, f"{root}/_manifest")
    numbers = sorted(int(st.getPath().getName()[:-5]) for st in (fs.listStatus(p) if fs.exists(p) else [])
                     if not st.getPath().getName().startswith("."))
    held = set().union(*[_folders(manifest(spark, root, n)[1]) for n in numbers[-keep:]])
    path = jvm.org.apache.hadoop.fs.Path
    gone = set()
    for n in numbers[:-keep]:
        for folder in _folders(manifest(spark, root, n)[1]) - held - gone:
            fs.delete(path(f"{root}/{folder}"), True)
            gone.add(folder)
        fs.delete(path(p, f"{n:010d}.json"), False)  # last, so that a crash leaves it to be found
    return len(gone)


# ------------------------------------------------------------------------------- appends
def append(df: DataFrame, table_path: str) -> None:
    df.write.mode("append").parquet(table_path)


def read_or_empty(spark: SparkSession, table_path: str, schema) -> DataFrame:
    if exists(spark, table_path):
        return spark.read.parquet(table_path)
    return spark.createDataFrame([], schema)
