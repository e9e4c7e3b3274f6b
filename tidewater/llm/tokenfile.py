"""Token ids in a binary format: patched frame of reference.

Ids are cut into blocks of 256. A block stores its minimum, and the differences to it in a bit
width that covers 95 % of them; the others are exceptions (place and full difference). A
segment holds a run of whole documents: header, document index, block index (base, width,
exceptions, start of the packed words), packed words, exceptions. The block index lets a reader
unpack any block alone. Segments are written as rows of a Parquet table by Spark's own
committer, so a lost executor leaves no half-written file.

Defined results: a null or empty text is just the end id; repeated ids stay in their order of
arrival; a null id sorts first; an empty table writes no segment and reads back no rows.
A very long text is a document of a segment like any other, in as many blocks as it needs.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .pieces import byte_level
from .textkit import batches, prepare

BLOCK = 256
PERCENT = 95
MAGIC = b"PFOR1\0\0\0"
_U = np.uint64


def _bits(x: np.ndarray) -> np.ndarray:
    """Number of bits of each value."""
    return np.ceil(np.log2(x.astype(float) + 1)).astype(np.int64)


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of 64 k values of ``width`` bits into rows of k * width words."""
    rows = values.reshape(-1, 64).T.astype(_U)
    out = np.zeros((width, rows.shape[1]), _U)
    for j in range(64):
        word, shift = divmod(j * width, 64)
        out[word] |= rows[j] << _U(shift)
        if shift + width > 64:
            out[word + 1] |= rows[j] >> _U(64 - shift)
    return out.T.reshape(len(values), -1)


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    """Inverse of ``_pack``: rows of BLOCK // 64 * width words into rows of BLOCK values."""
    cols = np.ascontiguousarray(words.reshape(-1, width).T)
    out = np.empty((64, cols.shape[1]), _U)
    mask = _U((1 << width) - 1)
    for j in range(64):
        word, shift = divmod(j * width, 64)
        x = cols[word] >> _U(shift)
        if shift + width > 64:
            x = x | (cols[word + 1] << _U(64 - shift))
        out[j] = x & mask
    return out.T.reshape(len(words), -1)


def encode_segment(ids: np.ndarray, doc_ids: list, lengths: np.ndarray, end_id: int) -> bytes:
    """One segment of whole documents."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    grid = np.full(blocks * BLOCK, ids[-1] if n else 0, np.uint32)
    grid[:n] = ids
    grid = grid.reshape(blocks, BLOCK)
    base = grid.min(axis=1)
    diff = grid - base[:, None]
    rank = BLOCK * PERCENT // 100
    width = np.maximum(_bits(np.partition(diff, rank, axis=1)[:, rank]), 1)
    size = width * (BLOCK // 64)
    start = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), _U)
    late = diff >= (_U(1) << width.astype(_U))[:, None]
    low = np.where(late, 0, diff)
    for w in np.unique(width):
        own = np.flatnonzero(width == w)
        words[start[own][:, None] + np.arange(int(w) * (BLOCK // 64))] = _pack(low[own], int(w))
    where = np.flatnonzero(late.ravel())
    known = np.array([d is not None for d in doc_ids], np.uint8)
    return b"".join([
        MAGIC, struct.pack("<6q", n, blocks, len(doc_ids), len(words), len(where), end_id),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), known.tobytes(),
        np.asarray(lengths, "<i8").tobytes(),
        base.astype("<u4").tobytes(), width.astype("<u1").tobytes(),
        late.sum(axis=1).astype("<u2").tobytes(), start.astype("<i8").tobytes(),
        words.astype("<u8").tobytes(), (where % BLOCK).astype("<u1").tobytes(),
        diff.ravel()[where].astype("<u4").tobytes()])


class Segment:
    """Reader of one segment."""

    def __init__(self, raw: bytes) -> None:
        if raw[:8] != MAGIC:
            raise ValueError("not a token segment")
        self.n, blocks, docs, n_words, n_late, self.end_id = struct.unpack_from("<6q", raw, 8)
        at = 56

        def part(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, count, at)
            at += out.nbytes
            return out

        ids = part("<i8", docs)
        known = part("<u1", docs)
        self.doc_ids = [int(d) if k else None for d, k in zip(ids, known)]
        self.lengths = part("<i8", docs)
        self.base, self.width = part("<u4", blocks), part("<u1", blocks)
        self.late = part("<u2", blocks)
        self.start = part("<i8", blocks)
        self.words = part("<u8", n_words)
        self.late_at, self.late_diff = part("<u1", n_late), part("<u4", n_late)
        self.late_from = np.cumsum(self.late, dtype=np.int64) - self.late

    def blocks(self, first: int, last: int) -> np.ndarray:
        """Ids of the blocks from ``first`` up to ``last`` (exclusive), found by the index."""
        width = self.width[first:last]
        out = np.empty((last - first, BLOCK), np.uint32)
        for w in np.unique(width):
            own = np.flatnonzero(width == w)
            index = self.start[first:last][own][:, None] + np.arange(int(w) * (BLOCK // 64))
            out[own] = _unpack(self.words[index], int(w))
        count = self.late[first:last].astype(np.int64)
        at = int(self.late_from[first]) if last > first else 0
        row = np.repeat(np.arange(last - first), count)
        out[row, self.late_at[at:at + len(row)]] = self.late_diff[at:at + len(row)]
        return (out + self.base[first:last, None]).reshape(-1)

    def ids(self) -> np.ndarray:
        return self.blocks(0, len(self.base))[: self.n]

    def slice(self, start: int, end: int) -> np.ndarray:
        """Ids from ``start`` up to ``end``, reading only the blocks that hold them."""
        first, last = start // BLOCK, -(-end // BLOCK)
        return self.blocks(first, last)[start - first * BLOCK:end - first * BLOCK]


def write_tokens(docs: DataFrame, target: str, path: str, end_id: int = 0, segment_ids: int = 1 << 18) -> None:
    """Encodes all texts and writes their segments in ascending doc_id order: the rows are
    range-partitioned and sorted, each task writes the segments of one range."""
    prepare(docs.sparkSession)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_level(path)
        shard, number, before = TaskContext.get().partitionId(), 0, 0
        parts: list[np.ndarray] = []
        doc_ids: list = []
        lengths: list[np.ndarray] = []

        def segment() -> pa.RecordBatch:
            ids = np.concatenate(parts)
            raw = encode_segment(ids, doc_ids, np.concatenate(lengths), end_id)
            return pa.RecordBatch.from_pydict(
                {"shard": pa.array([shard], pa.int32()), "segment": pa.array([number], pa.int32()),
                 "start": pa.array([before], pa.int64()), "n_ids": pa.array([len(ids)], pa.int64()),
                 "payload": pa.array([raw], pa.binary())})

        for batch in batches(rows, 300_000):
            ids, off = encoder.ids(batch.column(1).to_pylist())
            parts.append(np.insert(ids, off[1:], np.uint32(end_id)))
            lengths.append(np.diff(off) + 1)
            doc_ids += batch.column(0).to_pylist()
            if sum(map(len, parts)) >= segment_ids:
                yield (done := segment())
                number, before = number + 1, before + done.column(3)[0].as_py()
                parts, doc_ids, lengths = [], [], []
        if parts:
            yield segment()

    (docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
     .mapInArrow(run, "shard int, segment int, start long, n_ids long, payload binary")
     .write.parquet(target))


def read_tokens(spark: SparkSession, source: str, with_ids: bool = False) -> DataFrame:
    """Reads segments back: doc_id, start (ids of all documents before), n_tokens, ids_crc32,
    and the ids themselves if asked. Only one row per shard goes through the driver."""
    files = spark.read.parquet(source)
    sums = files.groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect()
    offsets, before = [], 0
    for row in sums:
        offsets.append((row["shard"], before))
        before += row["n"]
    prepare(spark)
    placed = files.join(F.broadcast(spark.createDataFrame(offsets, "shard int, shard_start long")),
                        "shard")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (
        ", ids array<long>" if with_ids else "")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for first, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                seg = Segment(raw.as_py())
                ids = seg.ids().astype("<u4")
                ends = np.cumsum(seg.lengths)
                starts = ends - seg.lengths
                spans = list(zip(starts.tolist(), ends.tolist()))
                cols = {"doc_id": pa.array(seg.doc_ids, pa.int64()),
                        "start": pa.array(starts + first, pa.int64()),
                        "n_tokens": pa.array(seg.lengths, pa.int64()),
                        "ids_crc32": pa.array([zlib.crc32(ids[a:b]) for a, b in spans], pa.int64())}
                if with_ids:
                    cols["ids"] = pa.array([ids[a:b].tolist() for a, b in spans],
                                           pa.list_(pa.int64()))
                yield pa.RecordBatch.from_pydict(cols)

    return placed.select((F.col("start") + F.col("shard_start")).alias("first"),
                         "payload").mapInArrow(run, schema)
