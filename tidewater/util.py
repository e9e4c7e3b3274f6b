"""Small helpers shared by the operators: lineage cuts and shipping the package to executors
for the few Arrow/pandas steps."""

from __future__ import annotations

import io
import os
import zipfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .session import checkpoint_root

def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage: write ``df`` to the shared checkpoint folder (``spark.checkpoint.dir``)
    and continue from the written copy. Reliable checkpoints survive executor loss; used at
    natural boundaries (training fact, fitted parameters, back-test errors) that several
    later steps read."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def number_rows(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """``df`` with the place (from 0) of every row among those with its ``keys``, by ``order``.

    No window over a key: rows are range-partitioned and sorted by key and order, so a hot key
    spreads over many tasks, numbered inside their partition, and written; the counts per (key,
    partition) are summed up and joined back. ``keys`` must not be null."""
    at = F.monotonically_increasing_id()
    done = materialize(df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
                       .withColumn("_id", at))
    part, row = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    rows = done.select(*df.columns, part.alias("_part"), row.alias("_row"))
    counts = rows.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"),
                                              F.min("_row").alias("_first"))
    own = Window.partitionBy(*keys).orderBy("_part")
    shifts = counts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
                           F.col("_part").alias("_p"),
                           (F.sum("_n").over(own) - F.col("_n") - F.col("_first")).alias("_shift"))
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        same = same & (F.col(k) == F.col(f"_k{i}"))
    return rows.join(shifts, same).select(*df.columns, (F.col("_row") + F.col("_shift")).alias(name))


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``tidewater`` importable in Python workers, as ``--py-files`` would.

    The package is zipped in memory and written through the Hadoop FileSystem API into the
    shared checkpoint folder (``spark.checkpoint.dir``), then added with ``addPyFile``, so
    every executor fetches the same copy. Deployments that install the package on the
    executors can skip this (``spark.tidewater.shipPackage=false``)."""
    sc = spark.sparkContext
    key = (id(sc), sc.applicationId)
    if key in _SHIPPED:
        return
    if spark.conf.get("spark.tidewater.shipPackage", "true") == "false":
        _SHIPPED.add(key)
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _dirs, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg_dir)))
    root = checkpoint_root(spark).rstrip("/")
    target = f"{root}/tidewater-{sc.applicationId}.zip"
    jvm = sc._jvm
    path = jvm.org.apache.hadoop.fs.Path(target)
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    out = fs.create(path, True)
    try:
        out.write(bytearray(buf.getvalue()))
    finally:
        out.close()
    sc.addPyFile(path.toString())
    _SHIPPED.add(key)
