"""Batches of documents as rows of one written table, and packed arrays as message columns.

Operators that look something up for every word or n-gram of every document would shuffle
billions of tiny rows. Instead the documents are written once as batches of about 1 MB of text
(Arrow bytes in one column); a batch asks each shard for all its keys in one row, the shard
merges the rows of all batches and answers row by row, and answers meet their batch again by its
id. A shard holds the keys with its hash, so it is as large as its share of the distinct keys
of each batch, and a hot key costs one entry per batch. One task takes all messages of a shard at
once, so the number of shards follows the bytes of text in the written table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import settle
from .textkit import batches, prepare, text_bytes

TEXT_BYTES = 1_000_000
SHARD_BYTES = 16_000_000  # text for each shard
_OPTIONS = pa.ipc.IpcWriteOptions(compression="zstd")


def dump(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=_OPTIONS) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def load(raw: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(raw) as reader:
        return reader.read_next_batch()


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed message."""
    head = np.array([len(arrays), *[x for a in arrays for x in (len(a), ord(a.dtype.char))]],
                    np.int64)
    raw = head.tobytes() + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)
    return np.int64(len(raw)).tobytes() + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def unpack(message: bytes) -> list[np.ndarray]:
    size = int(np.frombuffer(message, np.int64, 1)[0])
    raw = pa.Codec("zstd").decompress(message[8:], size, asbytes=True)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    head = np.frombuffer(raw, np.int64, 2 * n, 8)
    at, out = 8 * (2 * n + 1), []
    for length, kind in zip(head[::2].tolist(), head[1::2].tolist()):
        one = np.frombuffer(raw, chr(kind), length, at)
        out.append(one)
        at += one.nbytes
    return out


def write_batches(docs: DataFrame, name: str, batch_bytes: int | None = None) -> DataFrame:
    """(batch, size, docs): all rows of ``docs`` (with a column ``text``) in written batches. Batch
    numbers are final once written: partition number times 2 ** 32 plus a running number. ``size``
    is the bytes of text."""
    prepare(docs.sparkSession)
    limit = batch_bytes or TEXT_BYTES

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        size = text_size = 0

        def out() -> pa.RecordBatch:
            one = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            return pa.RecordBatch.from_pydict({"batch": pa.array([number], pa.int64()),
                                               "size": pa.array([text_size], pa.int64()),
                                               "docs": pa.array([dump(one)], pa.binary())})

        for part in batches(rows, limit):
            held.append(part)
            size += part.nbytes
            text_size += int(text_bytes(part.column(part.schema.get_field_index("text")))[1][-1])
            if size >= limit:
                yield out()
                held, size, text_size, number = [], 0, 0, number + 1
        if held:
            yield out()

    return settle(docs.mapInArrow(run, "batch long, size long, docs binary"), name)


def shards(table: DataFrame) -> int:
    """Number of shards for a written batch table: one for each ``SHARD_BYTES`` of its text, at
    least as many as the session has shuffle partitions."""
    total = table.agg(F.sum("size")).first()[0] or 0
    return max(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")),
               -(-total // SHARD_BYTES))


def ask(table: DataFrame, make: Callable[..., Iterator[tuple[int, bytes]]]) -> DataFrame:
    """(shard, batch, message) of every batch; ``make(batch row)`` yields (shard, message)."""
    names = table.columns

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows:
            for row in part.to_pylist():
                got = list(make(row))
                yield pa.RecordBatch.from_pydict({
                    "shard": pa.array([s for s, _ in got], pa.int32()),
                    "batch": pa.array([row["batch"]] * len(got), pa.int64()),
                    "message": pa.array([m for _, m in got], pa.binary())})

    return table.select(*names).mapInArrow(run, "shard int, batch long, message binary")


def answer(asked: DataFrame, n: int, reply: Callable[[int, list[bytes]], list[bytes | None]],
           noted: bool = False) -> DataFrame:
    """(batch, shard, message): each of ``n`` shards sees the messages of all batches at once and gives one
    reply per message (none for nothing to say). ``noted``: the reply comes with a list of
    numbers of the whole shard, which stand as ``note`` on its first row."""

    def run(group: pa.Table) -> pa.Table:
        batch = group.column("batch").to_pylist()
        order = sorted(range(len(batch)), key=batch.__getitem__)
        shard = group.column("shard")[0].as_py()
        messages = group.column("message").to_pylist()
        replies, note = reply(shard, [messages[k] for k in order]), None
        if noted:
            replies, note = replies
        some = [k for k, r in enumerate(replies) if r is not None]
        cols = {"batch": pa.array([batch[order[k]] for k in some], pa.int64()),
                "shard": pa.array([shard] * len(some), pa.int32()),
                "message": pa.array([replies[k] for k in some], pa.binary())}
        if noted:
            cols["note"] = pa.array([note if k == some[0] else None for k in some],
                                    pa.list_(pa.int64()))
        return pa.table(cols)

    return asked.repartition(n, "shard").groupBy("shard").applyInArrow(
        run, "batch long, shard int, message binary" + ", note array<long>" * noted)


def meet(table: DataFrame, **answers: DataFrame) -> DataFrame:
    """The batch table with one column per round of answers, under the name it is given: an
    array of (shard, message), at most one per shard."""
    for name, one in answers.items():
        grouped = one.groupBy("batch").agg(
            F.collect_list(F.struct("shard", "message")).alias(name))
        table = table.join(grouped, "batch", "left")
    return table


def by_shard(keys: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """Shard numbers that occur, with the positions of their keys in order."""
    own = ((keys >> np.uint64(33)) % np.uint64(n)).astype(np.int64)
    order = np.argsort(own, kind="stable")
    cuts = np.flatnonzero(np.diff(own[order])) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield int(own[part[0]]), part
