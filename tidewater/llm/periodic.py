"""Periodic runs of words, found with a dictionary of basic factors.

The dictionary names the stretch of 2 ** k words at every position, level by level, from the
pair of names of its halves; equal names mean equal words. Positions whose stretch stands only
once in the document lose their name, and so all their longer stretches. At each level of use,
the successor of an occurrence (the next one of its name) within twice the level's length
proposes the distance as a period: successors at one distance form arithmetic progressions,
progressions of one period that overlap by it are merged, and what remains is extended on both
sides by halving through the dictionary and deduplicated. A successor is the nearest
occurrence, so a proposed period of a stretch that repeats twice or more is its smallest one.

A run of length L and period q has L >= max(min_length, min_repeats * q), at least three periods.
The lowest level of use is the greatest with 2 ** k <= min_length * (1 - 1 / min_repeats). There for
q <= 2 ** k, and at the level with q <= 2 ** k < 2 q for longer periods, the first stretch of a run
reaches over a period, so that no nearer occurrence exists inside the run and its successor is
q words on.

Names are exact: words enter by Arrow's dictionary encoding, not by hashes. One document lies in
one row of one batch, there is no shuffle.

Defined results: a null or empty text has no words, no runs and an empty collapsed text; rows are
judged one by one, repeated ids or rows too; a very long text is read whole, with some 4 bytes
for each word and level that still has repeats; an empty table gives no rows; columns beyond the
id and text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import Words, batches, prepare, words

MIN_LENGTH, MIN_REPEATS = 24, 3
SCHEMA = ("doc_id long, n_words long, "
          "runs array<struct<start: long, length: long, period: long>>, collapsed string")


def word_names(w: Words) -> np.ndarray:
    """Names (from 1) of the words of a batch: equal in one text for equal words, never equal
    in different texts."""
    size = w.end - w.start
    solid = np.zeros(len(w.data) + 1, np.int8)
    solid[w.start] += 1
    np.add.at(solid, w.end, -1)
    joined = w.data[np.cumsum(solid[:-1], dtype=np.int8).astype(bool)]
    offsets = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    column = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets),
                                              pa.py_buffer(np.ascontiguousarray(joined)))
    kinds = column.dictionary_encode()
    code = kinds.indices.to_numpy().astype(np.int64)
    return np.unique(w.doc_of() * len(kinds.dictionary) + code, return_inverse=True)[1] + 1


class Factors:
    """Levels of names; 0 stands for a stretch that occurs once or leaves the batch."""

    def __init__(self, names: np.ndarray) -> None:
        self.n = len(names)
        self.levels = [self._dense(np.arange(self.n), names)]

    def _dense(self, at: np.ndarray, names: np.ndarray) -> np.ndarray:
        """Names at some positions as an array over all, without those that occur once."""
        _, place, count = np.unique(names, return_inverse=True, return_counts=True)
        out = np.zeros(self.n, np.int32)
        again = count[place] > 1
        out[at[again]] = place[again] + 1
        return out

    def grow(self) -> bool:
        """Adds the level of twice the length; false if no stretch of it occurs twice."""
        half, step = self.levels[-1], 1 << (len(self.levels) - 1)
        at = np.flatnonzero(half[: max(self.n - step, 0)])
        at = at[half[at + step] > 0]
        if not len(at):
            return False
        level = self._dense(at, (half[at].astype(np.int64) << 32) | half[at + step])
        self.levels.append(level)
        return bool(level.any())

    def same(self, k: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the stretches of level k at a and b are inside the batch and equal."""
        ok = (a >= 0) & (b < self.n)
        level = self.levels[k]
        x = level[np.where(ok, a, 0)]
        return ok & (x > 0) & (x == level[np.where(ok, b, 0)])

    def progressions(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, word after the last, distance) of maximal arithmetic progressions of
        successors at level k within twice its length."""
        level, size = self.levels[k], 1 << k
        at = np.flatnonzero(level)
        at = at[np.argsort(level[at], kind="stable")]
        gap = np.diff(at)
        gap[(np.diff(level[at]) != 0) | (gap > 2 * size)] = 0
        # a progression goes on while the next successor of the same name is as far and no word
        # between the two is left uncompared
        new = np.ones(len(gap), bool)
        new[1:] = (gap[1:] != gap[:-1]) | (gap[1:] > size)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(gap))
        some = gap[first] > 0
        first, last = first[some], last[some]
        return at[first], at[last] + size, gap[first]

    def extend(self, start: np.ndarray, end: np.ndarray, period: np.ndarray):
        """Moves both ends of periodic stretches as far as the period holds."""
        start, end = start.copy(), end.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            size = 1 << k
            todo = np.arange(len(end))
            while len(todo):
                todo = todo[self.same(k, end[todo] - period[todo], end[todo])]
                end[todo] += size
            todo = np.arange(len(start))
            while len(todo):
                a = start[todo] - size
                todo = todo[self.same(k, a, a + period[todo])]
                start[todo] -= size
        return start, end


def _merged(start: np.ndarray, end: np.ndarray, period: np.ndarray):
    """Unions of stretches of one period that share as many words as it at least."""
    order = np.lexsort((start, period))
    start, end, period = start[order], end[order], period[order]
    # far apart by period, so that one running maximum serves all
    lift = np.concatenate([[0], np.cumsum(np.diff(period) != 0)]) * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + lift)
    new = np.ones(len(start), bool)
    new[1:] = (start + lift)[1:] > reach[:-1] - period[1:]
    new[1:] |= period[1:] != period[:-1]
    first = np.flatnonzero(new)
    return start[first], np.maximum.reduceat(end, first), period[first]


def runs_of(names: np.ndarray, min_length: int = MIN_LENGTH, min_repeats: int = MIN_REPEATS):
    """(start, length, period) of all runs of a batch's words, by start and period."""
    if min_repeats < 3 or min_length < 3:
        raise ValueError("runs hold three periods at least")
    none = np.zeros(0, np.int64)
    lowest = int(min_length * (min_repeats - 1) // min_repeats).bit_length() - 1
    factors, found = Factors(names), []
    while True:
        k = len(factors.levels) - 1
        if k >= lowest:
            start, end, period = factors.progressions(k)
            if len(start):
                found.append(_merged(start, end, period))
        if not factors.levels[-1].any() or not factors.grow():
            break
    if not found:
        return none, none, none
    start, end, period = _merged(*(np.concatenate(x) for x in zip(*found)))
    start, end = factors.extend(start, end, period)
    long = end - start >= np.maximum(min_length, min_repeats * period)
    runs = np.unique(np.stack([start, end - start, period], 1)[long], axis=0)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    return runs[:, 0], runs[:, 1], runs[:, 2]


def _collapsed(w: Words, drop: np.ndarray) -> pa.Array:
    """Kept words of each text, joined by one space."""
    data = w.data.copy()
    kept = np.flatnonzero(~drop)
    doc = w.doc_of()[kept]
    more = np.zeros(len(kept), np.int64)  # another kept word of the text follows
    more[:-1] = doc[1:] == doc[:-1]
    data[w.end[kept[more > 0]]] = 32
    edge = np.zeros(len(data) + 2, np.int8)
    edge[w.start[kept]] += 1
    np.add.at(edge, w.end[kept] + more, -1)
    size = np.zeros(len(w.offsets) - 1, np.int64)
    np.add.at(size, doc, w.end[kept] - w.start[kept] + more)
    offsets = np.zeros(len(w.offsets), np.int64)
    np.cumsum(size, out=offsets[1:])
    out = np.ascontiguousarray(data[np.cumsum(edge[:len(data)], dtype=np.int8).astype(bool)])
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets),
                                            pa.py_buffer(out)).cast(pa.string())


def find_runs(docs: DataFrame, min_length: int = MIN_LENGTH, min_repeats: int = MIN_REPEATS,
              id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (start, length, period by word number, sorted by start and
    period), collapsed (the words without those that any run holds after its first period)."""
    prepare(docs.sparkSession)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows, 1_000_000):
            w = words(batch.column(1))
            n = len(w.start)
            start, length, period = runs_of(word_names(w), min_length, min_repeats) if n else (
                np.zeros(0, np.int64),) * 3
            edge = np.zeros(n + 1, np.int64)
            np.add.at(edge, start + period, 1)
            np.add.at(edge, start + length, -1)
            doc = np.searchsorted(w.offsets, start, "right") - 1
            cuts = np.searchsorted(doc, np.arange(len(w.offsets))).astype(np.int32)
            one = pa.StructArray.from_arrays(
                [pa.array(x, pa.int64()) for x in (start - w.offsets[doc], length, period)],
                ["start", "length", "period"])
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0).cast(pa.int64()),
                "n_words": pa.array(np.diff(w.offsets), pa.int64()),
                "runs": pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), one),
                "collapsed": _collapsed(w, np.cumsum(edge[:n]) > 0)})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


def best_run(runs: str = "runs"):
    """The run of greatest length / period (exact; ties: smallest start, then period)."""
    one = lambda a, b: a["length"] * b["period"] - b["length"] * a["period"]
    return F.reduce(F.col(runs), F.get(F.col(runs), F.lit(0)),
                    lambda best, x: F.when(one(x, best) > 0, x).otherwise(best))
