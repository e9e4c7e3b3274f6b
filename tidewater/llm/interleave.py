"""Shards that all hold the mixture of the sources: proportional stratified interleaving.

Rows are shuffled by a seeded hash and ranked within their source; a row of rank r among the n
rows of its source has the fractional rank (r + 1/2) / n. Sorted by it, every stretch of the
order holds each source in proportion, so cutting the order into equal counts gives shards
whose counts differ by one at most and whose number of rows of a source differs from its share
by two at most.

Neither ranking uses a window over a source or the whole table: rows are range-partitioned and
sorted, numbered inside their partition, and the partitions' counts are summed up, so a source
with a third of all rows spreads over as many tasks as its rows need. Only ids, sizes and
checksums are shuffled; one row per partition and source is all that the sums read.

Defined results: null sources are a source of their own; a null text has no bytes and the
checksum of an empty one; long texts count by their bytes and are not split; rows with equal
ids keep an order by checksum and size, and wholly equal rows are interchangeable; equal texts
are not held together (their ranks are unrelated); an empty table gives no rows; columns beyond
the id, text and source are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import discard, settle

SEED = "interleave-1"
SHARDS = 8


def _numbered(df: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """``df`` in a total order, written: ``_part`` numbers the ranges, ``_row`` the rows of one.
    The numbers are those of the writing task's sorted partition, so they are read, never
    computed again."""
    at = F.monotonically_increasing_id()
    return settle(df.repartitionByRange(*order).sortWithinPartitions(*order)
                  .withColumn("_id", at)
                  .select(*df.columns, F.shiftright("_id", 33).cast("int").alias("_part"),
                          F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)).alias("_row")), name)


def interleave(docs: DataFrame, shards: int = SHARDS, seed: str = SEED, id_col: str = "doc_id",
               text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size (bytes of the text plus one), text_crc32, source, source_rank, shard, slot
    (place in the shard, from 0)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = settle(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
              .cast("binary")).alias("_mix")), "interleave-rows")
    ties = ["_mix", "doc_id", "text_crc32", "size"]
    ranked = _numbered(base, ["source", *ties], "interleave-ranked")
    # rows of a source in the partitions before, and in all
    own = Window.partitionBy("source")
    parts = (ranked.groupBy("source", "_part")
             .agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
             .select("source", "_part", (F.sum("_n").over(own.orderBy("_part")) - F.col("_n")
                                         - F.col("_first")).alias("_shift"),
                     F.sum("_n").over(own).alias("_all")))
    rank = F.col("_row") + F.col("_shift")
    strata = (ranked.alias("r").join(
        parts.alias("p"), (F.col("r._part") == F.col("p._part"))
        & F.col("r.source").eqNullSafe(F.col("p.source")))
        .select("r.doc_id", "r.source", "r.size", "r.text_crc32", "r._mix",
                rank.alias("source_rank"), ((rank + F.lit(0.5)) / F.col("_all")).alias("_share")))
    placed = _numbered(strata, ["_share", "source", *ties], "interleave-placed")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    starts = sums.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    total = placed.agg(F.count("*").alias("n")).first()["n"]
    discard(base, ranked)
    out = (placed.join(starts, "_part").withColumn("_at", F.col("_row") + F.col("_start"))
           .withColumn("shard", F.expr(f"int(_at * {shards}L div {max(total, 1)}L)")))
    return out.select(
        "doc_id", "size", "text_crc32", "source", "source_rank", "shard",
        F.expr(f"_at - (shard * {total}L + {shards - 1}L) div {shards}L").alias("slot"))
