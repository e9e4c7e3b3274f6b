"""Vectorised text steps that run inside Arrow batches of Spark tasks.

Words are ``[^\\x20\\x09-\\x0D]+``. They are found on the UTF-8 bytes of a whole Arrow batch at
once, and get 64-bit hashes from prefix sums of a polynomial, so no Python loop runs per word.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

from ..util import ship_package

_U = np.uint64
_MULT = 0x9E3779B97F4A7C15


# Rows and bytes of one Arrow batch. Texts run to thousands of characters, so the default of
# 10,000 rows makes buffers of tens of MB on both sides of the pipe.
ARROW_ROWS, ARROW_BYTES = 1000, 8 << 20


def prepare(spark: SparkSession) -> None:
    """Makes the package importable in Python workers and keeps Arrow batches of texts small."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes (splitmix64)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(_MULT))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_POWERS = [np.ones(1, _U), np.ones(1, _U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the polynomial's base and of its inverse, modulo 2 ** 64."""
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_MULT, pow(_MULT, -1, 1 << 64))):
            p = np.full(size, base, _U)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS[0], _POWERS[1]


def span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of ``values`` (random-looking 64-bit codes of the symbols)."""
    up, down = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, _U)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(_U) * _U(_MULT))


@dataclass
class Words:
    """Words of a batch of texts: bytes, span of each word, and word offsets per text."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    offsets: np.ndarray  # words of text i: offsets[i] .. offsets[i + 1]

    def doc_of(self) -> np.ndarray:
        """Index of the text of each word."""
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))

    def hashes(self, lower: bool = False) -> np.ndarray:
        """64-bit hash of each word (of its A-Z in lower case if asked)."""
        if not len(self.start):
            return np.zeros(0, _U)
        data = _LOWER[self.data] if lower else self.data
        return span_hashes(_BYTE[data], self.start, self.end)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and byte offsets of a string column; a null counts as an empty text."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def words(column: pa.Array) -> Words:
    """Words of every text of a string column."""
    data, off = text_bytes(column)
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(len(off), np.int64))
    solid = ~_SPACE[data]
    starts, ends = solid.copy(), solid.copy()
    starts[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    first = off[:-1][off[:-1] < off[1:]]
    last = off[1:][off[:-1] < off[1:]] - 1
    starts[first] = solid[first]
    ends[last] = solid[last]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return Words(data, start, end, np.searchsorted(start, off))


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive word hashes (runs may cross texts: see ``inside``)."""
    if len(hashes) < n:
        return np.zeros(0, _U)
    out = hashes[: len(hashes) - n + 1].copy()
    for j in range(1, n):
        out = mix(out * _U(_MULT) + hashes[j: len(hashes) - n + 1 + j])
    return out


def inside(offsets: np.ndarray, n: int) -> np.ndarray:
    """Start positions of all runs of n words that lie in one text."""
    total = int(offsets[-1])
    if total < n:
        return np.zeros(0, np.int64)
    ok = np.ones(total - n + 1, bool)
    for k in range(1, n):  # a run that starts k words before a boundary crosses it
        b = offsets[1:-1] - k
        b = b[(b >= 0) & (b < len(ok))]
        ok[b] = False
    return np.flatnonzero(ok)


def batches(table_iter, limit: int = 4_000_000, text: str = "text"):
    """Cuts Arrow batches so that each holds about ``limit`` bytes of text (one row at least)."""
    for batch in table_iter:
        if not batch.num_rows:
            continue
        size = text_bytes(batch.column(batch.schema.get_field_index(text)))[1][1:]
        at, done = 0, 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(size, done + limit, "right")))
            yield batch.slice(at, to - at)
            at, done = to, int(size[to - 1])
