"""Quality classifier: a factorisation machine over hashed words, structure statistics and
metadata.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2)): all pairwise
interactions of a document's features in time linear in their number. Word features are
presence flags of hashed lower-case words, scaled to unit length; the others are standardised
statistics of the text and the length that the table states.

Training uses a bounded sample of the labelled rows (``MAX_TRAIN``, those with the smallest
hash of their id), which is joined to the documents by broadcast, and runs on the driver in
numpy; scoring is one Arrow pass over all documents without a shuffle. Labels, language,
source and id are never inputs of a score.

Defined results: null and empty texts are scored from their (zero) statistics; repeated rows
get equal scores; repeated labels of one id count as junk if one of them says so; without any
usable label every score is 0.5; an empty table gives no rows; further columns are ignored.
Very long texts are scored from all their words.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textkit import batches, mix, prepare, words

BUCKETS = 1 << 16
RANK = 8
MAX_TRAIN = 8000
EPOCHS = 12
THRESHOLD = 0.7
FOLDS, HELD_OUT = 4, 2

STATS = ["log_words", "word_length", "upper", "digits", "symbols", "exclaim", "bars", "distinct",
         "same_as_last", "lines", "stops", "top_word", "log_chars_stated"]


def held_out() -> Column:
    """Rows never learnt from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def _share(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Share of the set flags between each pair of offsets."""
    sums = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=sums[1:])
    return (sums[off[1:]] - sums[off[:-1]]) / np.maximum(np.diff(off), 1)


_KIND = np.zeros((6, 256), bool)
for _k, _chars in enumerate(["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "#*$%&<>@^~{}[]\\", "!",
                             "|", ".,;:?"]):
    _KIND[_k, [ord(c) for c in _chars]] = True


def features(texts: pa.Array, stated: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct word buckets of all texts in a row, their offsets, and the statistics."""
    w = words(texts)
    n = len(w.offsets) - 1
    low = w.hashes(lower=True)
    doc = w.doc_of()
    bucket = (mix(low) % np.uint64(BUCKETS)).astype(np.int64)
    pairs, count = np.unique(doc * BUCKETS + bucket, return_counts=True)
    own = pairs // BUCKETS
    off = np.searchsorted(own, np.arange(n + 1))
    n_words = np.diff(w.offsets)
    top = np.zeros(n)
    np.maximum.at(top, own, count)
    same = np.zeros(len(low), bool)
    same[1:] = (low[1:] == low[:-1]) & (doc[1:] == doc[:-1])
    size = np.zeros(n, np.int64)
    np.add.at(size, doc, w.end - w.start)
    # byte offsets of the texts: first byte of the first word to last byte of the last one
    has = n_words > 0
    at = np.zeros(n, np.int64)
    to = np.zeros(n, np.int64)
    at[has] = w.start[w.offsets[:-1][has]]
    to[has] = w.end[w.offsets[1:][has] - 1]
    rates = []
    for kind in range(6):
        sums = np.zeros(len(w.data) + 1, np.int64)
        np.cumsum(_KIND[kind][w.data], out=sums[1:])
        rates.append((sums[to] - sums[at]) / np.maximum(to - at, 1))
    breaks = np.zeros(len(w.data) + 1, np.int64)
    np.cumsum(w.data == 10, out=breaks[1:])
    per = np.maximum(n_words, 1)
    stats = np.stack([
        np.log1p(n_words), size / per, rates[0], rates[1], rates[2], rates[3], rates[4],
        np.diff(off) / per, _share(same, w.offsets), (breaks[to] - breaks[at]) / per, rates[5],
        top / per, np.log1p(np.maximum(stated, 0))], axis=1)
    return (pairs % BUCKETS).astype(np.int32), off, stats


@dataclass
class Model:
    """Weights of the machine; the statistics come after the word buckets."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def inputs(self, off: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        value = 1.0 / np.sqrt(np.maximum(np.diff(off), 1))
        return value, np.clip((stats - self.mean) / self.scale, -6, 6)

    def parts(self, idx: np.ndarray, off: np.ndarray, value: np.ndarray, dense: np.ndarray):
        """Linear part, factor sums and sums of squares per document."""
        n = len(off) - 1

        def by_doc(rows: np.ndarray) -> np.ndarray:
            out = np.zeros((n, *rows.shape[1:]))
            some = np.diff(off) > 0
            if some.any():
                out[some] = np.add.reduceat(rows, off[:-1][some], axis=0, dtype=float)
            return out

        v, vd = self.factors[idx], self.factors[BUCKETS:]
        lin = by_doc(self.linear[idx]) * value + dense @ self.linear[BUCKETS:]
        s = by_doc(v) * value[:, None] + dense @ vd
        q = by_doc(v * v).sum(axis=1) * value ** 2 + (dense ** 2) @ (vd ** 2).sum(axis=1)
        return lin, s, q

    def score(self, idx: np.ndarray, off: np.ndarray, stats: np.ndarray) -> np.ndarray:
        value, dense = self.inputs(off, stats)
        lin, s, q = self.parts(idx, off, value, dense)
        z = self.bias + lin + 0.5 * ((s * s).sum(axis=1) - q)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS, rank: int = RANK,
          rate: float = 0.1, decay: float = 1e-4, seed: int = 7) -> Model:
    """Fits the machine to (buckets, statistics, label) rows with AdaGrad on logistic loss."""
    rng = np.random.default_rng(seed)
    dims = BUCKETS + len(STATS)
    stats = np.array([r[1] for r in rows]).reshape(len(rows), len(STATS))
    label = np.array([r[2] for r in rows], float)
    mean = stats.mean(axis=0) if len(rows) else np.zeros(len(STATS))
    scale = np.maximum(stats.std(axis=0), 1e-6) if len(rows) else np.ones(len(STATS))
    model = Model(0.0, np.zeros(dims), rng.normal(0, 0.01, (dims, rank)), mean, scale)
    if not len(rows):
        return Model(0.0, model.linear, model.factors * 0, mean, scale)
    g_bias, g_lin, g_fac = 1e-8, np.full(dims, 1e-8), np.full((dims, rank), 1e-8)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), 128):
            pick = order[at:at + 128]
            idx = np.concatenate([rows[i][0] for i in pick]).astype(np.int64)
            off = np.zeros(len(pick) + 1, np.int64)
            np.cumsum([len(rows[i][0]) for i in pick], out=off[1:])
            value, dense = model.inputs(off, stats[pick])
            lin, s, q = model.parts(idx, off, value, dense)
            z = model.bias + lin + 0.5 * ((s * s).sum(axis=1) - q)
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label[pick]) / len(pick)
            x = np.repeat(value, np.diff(off))
            doc = np.repeat(np.arange(len(pick)), np.diff(off))
            used, place = np.unique(idx, return_inverse=True)
            d_lin = np.bincount(place, err[doc] * x, len(used)).astype(float) \
                + decay * model.linear[used]
            pull = err[doc, None] * (x[:, None] * s[doc] - (x * x)[:, None] * model.factors[idx])
            d_fac = np.stack([np.bincount(place, pull[:, f], len(used)) for f in range(rank)],
                             1).astype(float)
            d_fac += decay * model.factors[used]
            own = slice(BUCKETS, None)
            d_lin_s = dense.T @ err + decay * model.linear[own]
            d_fac_s = (dense * err[:, None]).T @ s - ((dense ** 2).T @ err)[:, None] \
                * model.factors[own] + decay * model.factors[own]
            d_bias = err.sum()
            g_bias += d_bias ** 2
            model.bias -= rate * d_bias / np.sqrt(g_bias)
            for where, dl, df in ((used, d_lin, d_fac), (own, d_lin_s, d_fac_s)):
                g_lin[where] += dl ** 2
                g_fac[where] += df ** 2
                model.linear[where] -= rate * dl / np.sqrt(g_lin[where])
                model.factors[where] -= rate * df / np.sqrt(g_fac[where])
    return model


def _input(docs: DataFrame) -> DataFrame:
    stated = F.col("n_chars") if "n_chars" in docs.columns else F.length("text")
    return docs.select("doc_id", "text", F.coalesce(stated, F.lit(0)).cast("double").alias("stated"))


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> Model:
    """Model learnt from at most ``most`` labelled documents outside the held-out fold."""
    spark = docs.sparkSession
    prepare(spark)
    picked = (labels.select("doc_id", F.col("quality").alias("y"))
              .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out())
              .groupBy("doc_id").agg(F.min("y").alias("y"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
    rows = _input(docs).join(F.broadcast(picked), "doc_id")  # at most ``most`` small rows

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(parts, 2_000_000):
            idx, off, stats = features(batch.column(1), batch.column(2).to_numpy())
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0),
                "idx": pa.array([idx[a:b].tobytes() for a, b in zip(off[:-1], off[1:])], pa.binary()),
                "stats": pa.array([s.tobytes() for s in stats], pa.binary()),
                "y": batch.column(3).cast(pa.int32())})

    got = rows.select("doc_id", "text", "stated", "y").mapInArrow(
        run, "doc_id long, idx binary, stats binary, y int").collect()
    got = sorted(((r.doc_id, bytes(r.idx), bytes(r.stats), r.y) for r in got))
    return train([(np.frombuffer(i, np.int32), np.frombuffer(s, float), y) for _, i, s, y in got])


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(Model(
        model.bias, model.linear.astype(np.float32), model.factors.astype(np.float32),
        model.mean, model.scale))  # about 2.4 MB, fixed by BUCKETS and RANK

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(parts, 1_000_000):
            idx, off, stats = features(batch.column(1), batch.column(2).to_numpy())
            p = shared.value.score(idx, off, stats)
            held = [d is not None and zlib.crc32(str(d).encode()) % FOLDS == HELD_OUT
                    for d in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0).cast(pa.int64()), "held_out": pa.array(held, pa.bool_()),
                "score": pa.array(p, pa.float64()),
                "predicted": pa.array((p >= threshold).astype(np.int32))})

    return _input(docs).mapInArrow(
        run, "doc_id long, held_out boolean, score double, predicted int")


def reject_low_quality(docs: DataFrame, labels: DataFrame,
                       threshold: float = THRESHOLD) -> DataFrame:
    """Documents with a score of at least the threshold, all columns kept. A model that was
    fitted on no row (its factors are zero) says nothing, so all documents stay."""
    model = fit(docs, labels)
    if not model.factors.any():
        return docs
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    stated = "n_chars" if "n_chars" in docs.columns else None
    names = docs.columns

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = names.index("text")
        for batch in batches(parts, 1_000_000):
            if stated:
                n = batch.column(names.index(stated)).cast(pa.float64()).fill_null(0).to_numpy()
            else:
                n = np.array([len(x or "") for x in batch.column(t).to_pylist()], float)
            idx, off, stats = features(batch.column(t), n)
            yield batch.filter(pa.array(shared.value.score(idx, off, stats) >= threshold))

    return docs.mapInArrow(run, docs.schema)
