"""Nearest neighbours by largest inner product with a permutation index.

Pivots are a bounded sample of the vectors. Every vector is represented by the order of its
``PREFIX`` nearest pivots; inverted files list, per pivot, the vectors that have it, with its
place. A query walks the files of its own pivots, which adds up the footrule distance between
the two orders (a pivot that one side lacks counts as place ``PREFIX``); the best ``SHARE`` of a
shard's vectors by that distance are ranked again by the true inner product in double precision.

Largest inner product becomes nearest vector by one more coordinate, sqrt(M^2 - |x|^2), which is
zero for queries. M is the largest norm of the vector's norm range, not of the table: beside a
vector that is 1e8 times as long, 1 - |x|^2 / M^2 rounds to 1, and all others get the same pivot
order. Ranges span ``RANGE`` powers of two, from the largest norm down, so few long vectors, which
hold most of the largest products, are an index of their own. Every query searches each range;
one of up to ``LEAST`` vectors is ranked whole.

Queries and vectors are dealt in blocks: a task holds the inverted files of one shard (about
``SHARD_ROWS`` vectors) and the queries of one block, and returns the best k of the shard.
``share=1`` ranks every vector and is exact.

Defined results: vectors that are null, zero, of another length than most, without id, or hold
null or non-finite components take no part; ties go to the smaller id; of repeated rows of one
query id the smallest vector asks, and no row of the query's id is its neighbour; with fewer
than k candidates all are returned; an empty table gives no rows. Norms may have any finite size;
products beyond the range of doubles score infinite, minus infinity where infinities cancel.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import settle
from .textkit import prepare

PIVOTS, PREFIX = 256, 64
SHARE, LEAST = 0.2, 400
SHARD_ROWS, QUERY_ROWS = 16384, 1024
RANGE = 3  # a norm range spans this many powers of two
_POWERS = 2200  # more than the powers of two that doubles reach
_LARGEST = float(np.finfo(float).max)


def _matrix(column, dims: int) -> np.ndarray:
    flat = pa.chunked_array(column.chunks if hasattr(column, "chunks") else [column])
    return np.concatenate([np.asarray(c.flatten(), float) for c in flat.chunks]
                          or [np.zeros(0)]).reshape(-1, dims)


def _norms(vectors: np.ndarray) -> np.ndarray:
    """Norms of rows without zero rows; no square leaves the range of doubles."""
    most = np.abs(vectors).max(axis=1)
    with np.errstate(over="ignore"):
        return np.minimum(most * np.sqrt(((vectors / most[:, None]) ** 2).sum(axis=1)), _LARGEST)


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Rows divided by their norms."""
    x = vectors / np.abs(vectors).max(axis=1)[:, None]
    return x / np.sqrt((x ** 2).sum(axis=1))[:, None]


def extend(vectors: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows divided by the largest norm of their range, and the coordinate that makes them one
    long."""
    x = _unit(vectors) * (_norms(vectors) / most)[:, None]
    return x, np.sqrt(np.maximum(0, 1 - (x ** 2).sum(axis=1)))


def orders(vectors: np.ndarray, extra: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The nearest pivots of each (extended) vector, nearest first, ties to the first pivot.
    All points have the same norm, so the largest product is the nearest."""
    near = np.concatenate([vectors, extra[:, None]], axis=1) @ pivots.T
    return np.argsort(-near, axis=1, kind="stable")[:, :prefix].astype(np.int16)


class Shard:
    """Inverted files over the pivot orders of some vectors, in ascending order of id."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, order: np.ndarray, pivots: int) -> None:
        rank = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[rank], vectors[rank]
        order = order[rank]
        self.prefix = order.shape[1]
        longest = _norms(self.vectors).max() if len(rank) else 1.0
        self.small = (self.vectors / longest).astype(np.float32)
        flat = order.ravel()
        by_pivot = np.argsort(flat, kind="stable")
        self.rows = (by_pivot // self.prefix).astype(np.int32)
        self.place = (by_pivot % self.prefix).astype(np.int32)
        self.start = np.searchsorted(flat[by_pivot], np.arange(pivots + 1))

    def candidates(self, order: np.ndarray, count: int) -> np.ndarray:
        """The ``count`` rows with the least footrule distance, ties to the smaller id. The
        distance is a constant less twice the sum of prefix - max(place, place) over the
        pivots that both orders have."""
        n = len(self.ids)
        if count >= n:
            return np.arange(n)
        gain = np.zeros(n, np.int32)
        for place, pivot in enumerate(order.tolist()):
            a, b = self.start[pivot], self.start[pivot + 1]
            gain[self.rows[a:b]] += self.prefix - np.maximum(self.place[a:b], place)
        key = -gain.astype(np.int64) * n + np.arange(n)
        return np.sort(np.argpartition(key, count - 1)[:count])

    def search(self, query_id: int, query: np.ndarray, order: np.ndarray, k: int, share: float,
               least: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the best k candidates, by score, then by id."""
        rows = self.candidates(order, max(int(np.ceil(share * len(self.ids))), least))
        rows = rows[self.ids[rows] != query_id]
        if len(rows) > k:  # rough products first; the bound covers their rounding
            rough = self.small[rows] @ _unit(query[None, :])[0].astype(np.float32)
            bar = np.partition(rough, len(rows) - k)[len(rows) - k] - 1e-5
            rows = rows[rough >= bar]
        with np.errstate(over="ignore", invalid="ignore"):
            exact = (self.vectors[rows] * query).sum(axis=1)
        exact[np.isnan(exact)] = -np.inf
        best = np.lexsort((self.ids[rows], -exact))[:k]
        return self.ids[rows[best]], exact[best]


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, share: float = SHARE,
           least: int = LEAST, pivots: int = PIVOTS, prefix: int = PREFIX,
           shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of ``vectors`` (vec_id, embedding) found for
    every row of ``queries`` (the same columns)."""
    spark = vectors.sparkSession
    prepare(spark)
    schema = "query_id long, rank int, vec_id long, score double"

    def clean(df: DataFrame) -> DataFrame:
        v = F.col("v")
        return df.select(F.col("vec_id").cast("long").alias("id"),
                         F.col("embedding").cast("array<double>").alias("v")).where(
            F.col("id").isNotNull() & (F.size(v) > 0)
            & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
            & F.exists(v, lambda x: x != 0))

    most = F.array_max(F.transform("v", F.abs))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + (x / F.col("m")) * (x / F.col("m")))
    norm = F.least(F.col("m") * F.sqrt(square), F.lit(_LARGEST))
    rows = clean(vectors).withColumn("m", most).withColumn("m", norm).withColumn(
        "g", F.floor(F.log2("m")).cast("int"))
    found = (rows.groupBy(F.size("v").alias("dims"), "g")
             .agg(F.count("*").alias("n"), F.max("m").alias("m")))
    total = Window.partitionBy("dims")
    found = (found.withColumn("all", F.sum("n").over(total)).orderBy(F.desc("all"), "dims", F.desc("g"))
             .limit(_POWERS).collect())
    if not found:
        return spark.createDataFrame([], schema)
    dims = found[0]["dims"]
    ranges = []  # largest norm, rows and powers of two of each
    for r in found:
        if r["dims"] == dims:
            if not ranges or r["g"] <= ranges[-1]["powers"][0] - RANGE:
                ranges.append({"m": r["m"], "n": 0, "powers": []})
            ranges[-1]["n"] += r["n"]
            ranges[-1]["powers"].append(r["g"])
    longest = {g: r["m"] for r in ranges for g in r["powers"]}
    rows = rows.where(F.size("v") == dims)
    asks = clean(queries).where(F.size("v") == dims).groupBy("id").agg(F.min("v").alias("v"))
    picked = rows.orderBy(F.xxhash64("id", F.lit(17)), "id", "v").limit(pivots).collect()
    base, extra = extend(np.array([r["v"] for r in picked], float).reshape(-1, dims),
                         np.array([longest[r["g"]] for r in picked]))
    base = np.concatenate([base, extra[:, None]], axis=1)
    shared = spark.sparkContext.broadcast(base)  # at most ``pivots`` vectors
    width = min(prefix, len(base))

    def order_rows(is_query: bool):
        def run(parts):
            for part in parts:
                x = _matrix(part.column(1), dims)
                if is_query:
                    x, extra = _unit(x), np.zeros(len(x))
                else:
                    x, extra = extend(x, part.column(2).to_numpy(zero_copy_only=False))
                o = orders(x, extra, shared.value, width)
                o = pa.array([r.tobytes() for r in o], pa.binary())
                if is_query:
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), o],
                                                     ["id", "v", "o"])
                else:
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(3), o],
                                                     ["id", "v", "s", "o"])
        return run

    # Every range gets whole shards of its own.
    first, shards, n_shards = {}, {}, 0
    for r in ranges:
        count = -(-r["n"] // shard_rows)
        for g in r["powers"]:
            first[g], shards[g] = n_shards, count
        n_shards += count
    of = lambda m: F.create_map(*[F.lit(x) for e in m.items() for x in e])[F.col("g")]
    index = rows.select(
        "id", "v", of(longest).alias("m"),
        (of(first) + F.pmod(F.xxhash64("id", F.lit(3)), of(shards))).cast("int").alias("s")
    ).mapInArrow(order_rows(False), "id long, v array<double>, s int, o binary")
    asked = settle(asks.mapInArrow(order_rows(True), "id long, v array<double>, o binary"),
                   "ann-queries")
    n_blocks = max(1, -(-asked.count() // query_rows))
    spread = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    left = index.select("s", spread(n_blocks).alias("b"), "id", "v", "o")
    right = asked.select(spread(n_shards).alias("s"),
                         F.pmod(F.xxhash64("id", F.lit(5)), F.lit(n_blocks)).cast("int").alias("b"),
                         "id", "v", "o")

    def block(vecs: pa.Table, asks_: pa.Table) -> pa.Table:
        got = {"query_id": [], "vec_id": [], "score": []}
        if vecs.num_rows and asks_.num_rows:
            take = lambda t: np.frombuffer(
                b"".join(t.column("o").to_pylist()), np.int16).reshape(-1, width)
            shard = Shard(vecs.column("id").to_numpy(), _matrix(vecs.column("v"), dims), take(vecs),
                          len(shared.value))
            for q, v, o in zip(asks_.column("id").to_pylist(), _matrix(asks_.column("v"), dims),
                               take(asks_)):
                ids, scores = shard.search(q, v, o, k, share, least)
                got["query_id"] += [q] * len(ids)
                got["vec_id"] += ids.tolist()
                got["score"] += scores.tolist()
        return pa.table({"query_id": pa.array(got["query_id"], pa.int64()),
                         "vec_id": pa.array(got["vec_id"], pa.int64()),
                         "score": pa.array(got["score"], pa.float64())})

    found = left.groupBy("s", "b").cogroup(right.groupBy("s", "b")).applyInArrow(
        block, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
