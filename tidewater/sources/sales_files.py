"""Sales CSV files: listing, records and per-file quality.

A file is the unit of atomicity: a malformed record (a field count that differs from the
header's, a stray quote) fails the whole file, a bad *value* drops only its row. All files are
read in one scan of text lines; a line that is a whole record by itself is split with column
expressions. Only files with a line that is not (a quoted line break, or bad quoting) are read
again, as lines too: no file is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import RAW_SALE_COLUMNS

CORRUPT = "_corrupt_record"

# Inside of a quoted field, and one field of a record: quoted with doubled quotes inside, or free
# of quotes and commas. Every repeat is possessive, so a match keeps no state for each character,
# quote or field and fields of any length and number are split in linear time.
INSIDE = r'[^"]*+(?:""[^"]*+)*+'
FIELD = rf'"{INSIDE}"|[^",]*+(?!")'
WHOLE_RECORD = rf"^(?:{FIELD})(?:,(?:{FIELD}))*+$"
NEXT_FIELD = rf",({FIELD})"
# Lines of a record with a quoted line break: the first, the last, and those between.
OPENS = rf'^(?:(?:{FIELD}),)*+"{INSIDE}$'
CLOSES = rf'^{INSIDE}"(?:,(?:{FIELD}))*+$'
GOES_ON = rf'^{INSIDE}(?:"(?:,(?:{FIELD}))*+,"{INSIDE})?$'


def _scan_schema(width: int) -> T.StructType:
    cols = RAW_SALE_COLUMNS + [f"_extra_{i}" for i in range(max(width - 6, 0))]
    return T.StructType([T.StructField(c, T.StringType()) for c in cols]
                        + [T.StructField(CORRUPT, T.StringType())])


def list_sales_files(spark: SparkSession, directory: str) -> DataFrame:
    """``*.csv`` files directly in ``directory`` (not recursive), with mtime; empty
    files too. A folder ``_file=<name>`` with one written part counts as ``<name>.csv``.

    The listing is the file system's own, as Spark's file index keeps it on the driver for
    any scan of the folder."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(directory)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    rows = []
    for pattern, named in (("*.csv", False), ("_file=*/*.csv", True)):
        for st in fs.globStatus(jvm.org.apache.hadoop.fs.Path(root, pattern)) or []:
            if st.isFile():
                path = st.getPath()
                name = path.getParent().getName()[6:] + ".csv" if named else path.getName()
                rows.append((name, path.toString(), st.getModificationTime(), st.getLen()))
    return spark.createDataFrame(rows, "file_name string, path string, ms long, length long") \
        .select("file_name", "path", F.timestamp_millis("ms").alias("modification_time"), "length")


def file_key(path: Column) -> Column:
    """The name that a file's path is known by (see ``list_sales_files``)."""
    named = F.regexp_extract(path, r"/_file=([^/]*)/[^/]*$", 1)
    return F.when(named != "", F.concat(named, F.lit(".csv"))).otherwise(
        F.element_at(F.split(path, "/"), -1))


def split_record(line: Column) -> Column:
    """Fields of a line that is a whole record; doubled quotes inside quotes become one."""
    quoted = F.transform(
        F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(NEXT_FIELD), F.lit(1)),
        lambda f: F.when(f.startswith('"'), F.replace(
            F.substring(f, F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"'))).otherwise(f))
    return F.when(line.contains('"'), quoted).otherwise(F.split(line, ",", -1))


def read_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One scan of all files: file_name, place (block, number: ordered inside a file), whole
    (the line is a record by itself), fields. Blank lines are skipped."""
    lines = spark.read.text(paths).select(
        "value", file_key(F.col("_metadata.file_path")).alias("file_name"),
        F.struct(F.col("_metadata.file_block_start").alias("block"),
                 F.monotonically_increasing_id().alias("number")).alias("place"))
    line = F.col("value")
    whole = ~line.contains('"') | line.rlike(WHOLE_RECORD)
    return lines.where(line != "").select(
        "file_name", "place", whole.alias("whole"),
        F.when(whole, split_record(line)).alias("fields"))


def read_whole(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Records of files with quoted line breaks or bad quoting: the columns of ``read_lines``; a
    file with bad quoting has one row that is not ``whole``. Quoted line breaks belong to the
    field, blank lines are skipped, a carriage return before a line feed is dropped.

    Lines with an odd number of quotes open or close a quoted line break, so their running number
    tells which lines belong together. It is carried from block to block, and each line is judged
    by itself: only the lines of a record with a line break are brought together."""
    value = F.col("value")
    lines = spark.read.option("lineSep", "\n").text(paths).select(
        F.regexp_replace("value", r"\r\z", "").alias("value"),
        file_key(F.col("_metadata.file_path")).alias("file_name"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("number")).withColumn(
        "odd", (F.length("value") - F.length(F.replace(value, F.lit('"'), F.lit("")))) % 2)
    by_block = Window.partitionBy("file_name").orderBy("block")
    blocks = lines.groupBy("file_name", "block").agg(F.sum("odd").alias("n")).select(
        "file_name", "block", (F.sum("n").over(by_block) - F.col("n")).alias("carried"),
        (F.sum("n").over(Window.partitionBy("file_name")) % 2 > 0).alias("unclosed"))
    by_line = Window.partitionBy("file_name", "block").orderBy("number")
    turns = lines.join(blocks, ["file_name", "block"]).withColumn(
        "turn", F.col("carried") + F.sum("odd").over(by_line))
    begins = (F.col("turn") - F.col("odd")) % 2 == 0  # outside quotes before the line
    ends = F.col("turn") % 2 == 0  # and after it
    shape = (F.when(begins & ends, value.rlike(WHOLE_RECORD))
             .when(begins, value.rlike(OPENS)).when(ends, value.rlike(CLOSES))
             .otherwise(value.rlike(GOES_ON)))
    judged = turns.select("file_name", F.struct("block", "number").alias("place"), "value", "turn",
                          (begins & ends).alias("alone"),
                          (shape & ~F.col("unclosed")).alias("fine"))
    bad = judged.where(~F.col("fine")).select("file_name").distinct()
    kept = judged.join(bad, "file_name", "left_anti")
    alone = kept.where("alone AND value <> ''").select("file_name", "place", "value")
    joined = (kept.where("NOT alone")
              .groupBy("file_name", F.floor((F.col("turn") - 1) / 2).alias("record"))
              .agg(F.sort_array(F.collect_list(F.struct("place", "value"))).alias("lines"))
              .select("file_name", F.col("lines")[0]["place"].alias("place"),
                      F.array_join(F.col("lines")["value"], "\n").alias("value")))
    records = alone.unionByName(joined).select(
        "file_name", "place", F.lit(True).alias("whole"), split_record(value).alias("fields"))
    zero = F.lit(0).cast("long")
    return records.unionByName(bad.select(
        "file_name", F.struct(zero.alias("block"), zero.alias("number")).alias("place"),
        F.lit(False).alias("whole"), F.lit(None).cast("array<string>").alias("fields")))


def header_width(header: Column) -> Column:
    """Field count of a header line (quoted commas count as text)."""
    return F.when(~header.contains('"') | header.rlike(WHOLE_RECORD),
                  F.size(split_record(header)))


def header_widths(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Field count of each file's header line (Q4): files are grouped by width.

    Only the first block of every file is inspected: rows of one block come out of the
    reader in file order, so the header is the row with the lowest position in block 0.
    """
    lines = (spark.read.option("pathGlobFilter", "*.csv").text(paths)
             .select("value", F.col("_metadata.file_path").alias("path"),
                     F.col("_metadata.file_block_start").alias("_block"))
             .where((F.col("_block") == 0) & (F.col("value") != "")))
    first = (lines.withColumn("_pos", F.monotonically_increasing_id())
             .groupBy("path")
             .agg(F.min_by("value", "_pos").alias("header")))
    return first.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), "path",
                        header_width(F.col("header")).alias("header_width"))


def scan_sales_csv(spark: SparkSession, paths: list[str] | str, width: int = 6,
                   multi_line: bool = False) -> DataFrame:
    """Positional scan of sales files that share one header width.

    All columns are read as text (cleaning decides validity). Records with a different field
    count land in ``_corrupt_record`` (Spark flags short and long rows in PERMISSIVE mode).
    ``multi_line`` allows quoted line breaks inside a field but makes every file a single
    task; sale lines carry no free text, so files stay splittable by default.

    ``file_name`` is the file's own name, or ``<day>.csv`` when the files sit in
    ``_day=<day>`` partition folders (the layout Spark itself writes).
    """
    schema = _scan_schema(width)
    df = (spark.read.schema(schema)
          .option("header", "true")
          .option("enforceSchema", "true")
          .option("mode", "PERMISSIVE")
          .option("columnNameOfCorruptRecord", CORRUPT)
          .option("escape", '"').option("nullValue", "\u0001").option("emptyValue", "")
          .option("multiLine", str(multi_line).lower())
          .option("pathGlobFilter", "*.csv")
          .csv(paths))
    name = F.col("_metadata.file_name")
    cols = [c for c in df.columns if c not in ("_day", "_file")]
    for part in ("_day", "_file"):
        if part in df.columns:
            name = F.concat(F.col(part).cast("string"), F.lit(".csv"))
    return df.select(*cols, name.alias("file_name"),
                     F.col("_metadata.file_modification_time").alias("file_mtime"))


def file_quality(scanned: DataFrame) -> DataFrame:
    """Per-file status from records (``read_lines`` / ``read_whole``) — FAILED when any
    record is malformed, else SUCCESS. The first record is the header: it sets the field count
    and is not counted."""
    per_width = (scanned.groupBy("file_name", F.size("fields").alias("width"), "whole")
                 .agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("place")))
    head = per_width.groupBy("file_name").agg(F.min_by("width", "place").alias("header"))
    bad = ~F.col("whole") | (F.col("width") != F.col("header"))
    return (per_width.join(head, "file_name").groupBy("file_name")
            .agg((F.sum("n") - 1).alias("n_records"),
                 F.coalesce(F.sum(F.when(bad, F.col("n"))), F.lit(0)).alias("n_malformed"))
            .select("file_name", "n_records", "n_malformed",
                    F.when(F.col("n_malformed") > 0, F.lit("FAILED"))
                    .otherwise(F.lit("SUCCESS")).alias("status")))


def read_records(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, list[str]]:
    """Lines of all files, and the names of those that need ``read_whole``."""
    lines = read_lines(spark, paths)
    odd = [r.file_name for r in lines.where(~F.col("whole")).select("file_name").distinct()
           .collect()]
    return lines, odd


def scan_quality(spark: SparkSession, directory: str) -> DataFrame:
    """S1-S3 for a folder: outcome per listed file, with ``read_whole`` where needed."""
    listed = list_sales_files(spark, directory)
    paths = {r.file_name: r.path for r in listed.select("file_name", "path").collect()}
    lines, odd = read_records(spark, list(paths.values()))
    if odd:
        lines = lines.where(~F.col("file_name").isin(odd)).unionByName(
            read_whole(spark, [paths[o] for o in odd]))
    return (listed.select("file_name").join(file_quality(lines), "file_name", "left")
            .select("file_name", F.coalesce("n_records", F.lit(0)).alias("n_records"),
                    F.coalesce("n_malformed", F.lit(0)).alias("n_malformed"),
                    F.coalesce("status", F.lit("FAILED")).alias("status")))


def write_daily_sales_csv(raw_lines: DataFrame, directory: str, files_per_day: int = 4) -> None:
    """Write raw sale lines as CSV files, several per day (for tests and for deriving file
    inputs from the driver tables). Output: ``<dir>/_file=<day>-<k>/part-*.csv``, known as
    ``<day>-<k>.csv``; lines of a day are dealt by the hash of their id."""
    part = F.pmod(F.xxhash64("transaction_id"), F.lit(files_per_day))
    (raw_lines.withColumn("_file", F.concat_ws("-", F.substring("timestamp", 1, 10),
                                               part.cast("string")))
     .repartition("_file")
     .sortWithinPartitions("_file", "transaction_id")
     .write.mode("overwrite").partitionBy("_file")
     .option("header", "true").csv(directory))
