"""Permutation index against brute force."""

import math

import numpy as np

from tidewater.llm import ann, queries

SMOKE = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


def good(v):
    return v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)


def brute(rows, asks, k=20):
    rows = [(i, np.array(v, float)) for i, v in rows if i is not None and good(v)]
    out = {}
    for q, v in asks:
        if good(v):
            v = np.array(v, float)
            out[q] = sorted(((-float((x * v).sum()), i) for i, x in rows if i != q))[:k]
    return out


def recall(got, want):
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    hit = total = 0
    for q, best in want.items():
        rows = sorted(by.get(q, []), key=lambda r: r.rank)
        assert [r.rank for r in rows] == list(range(1, len(best) + 1))
        assert [(-r.score, r.vec_id) for r in rows] == sorted((-r.score, r.vec_id) for r in rows)
        hit += len({r.vec_id for r in rows} & {i for _, i in best})
        total += len(best)
    assert set(by) <= set(want)
    return hit / max(total, 1)


def test_query_on_whole_tables(spark):
    for sf in (SMOKE, SF01):
        rows = [(r.vec_id, r.embedding) for r in
                spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
        want = brute(rows, [r for r in rows if r[0] % 20 == 0])
        got = queries.QUERIES["op2_nearest_neighbours"](spark, sf).collect()
        assert recall(got, want) >= 0.9
        exact = {(q, i): -s for q, best in want.items() for s, i in best}
        for r in got:
            if (r.query_id, r.vec_id) in exact:
                assert r.score == exact[r.query_id, r.vec_id]


def test_blocks_and_recall(spark):
    """Several shards and query blocks, unequal norms, many equal vectors."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 32)) * rng.uniform(0.5, 2, (3000, 1))
    x[1000:1800] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asks = df.where("vec_id % 30 = 0")
    want = brute(rows, [r for r in rows if r[0] % 30 == 0])
    got = ann.search(df, asks, shard_rows=1000, query_rows=40).collect()
    assert recall(got, want) >= 0.9
    exact = ann.search(df, asks, share=1.0, shard_rows=700, query_rows=64).collect()
    assert recall(exact, want) == 1.0
    by = {(r.query_id, r.rank): r.vec_id for r in exact}
    assert all(by[q, k + 1] == i for q, best in want.items() for k, (_, i) in enumerate(best))


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 5), (20, [0.0, 2.0], 5), (20, [0.0, 2.0], 5), (40, None, 5), (60, [0.0, 0.0], 5),
            (80, [nan, 1.0], 5), (100, [inf, 1.0], 5), (120, [None, 1.0], 5), (140, [], 5),
            (160, [1.0], 5), (None, [1.0, 1.0], 5), (3, [1.0, 0.0], 5), (2, [1.0, 0.0], 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = sorted(tuple(r) for r in ann.search(df, df.where("vec_id % 20 = 0"), k=3).collect())
    assert got == [(0, 1, 2, 1.0), (0, 2, 3, 1.0), (0, 3, 20, 0.0), (20, 1, 0, 0.0), (20, 2, 2, 0.0),
                   (20, 3, 3, 0.0)]
    assert ann.search(df.limit(0), df.limit(0)).count() == 0
    assert ann.search(df, df.limit(0)).count() == 0


def _check_norms(spark, x, asks_every, shard_rows, least_recall=0.9):
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(8)
    asks = df.where(f"vec_id % {asks_every} = 0")
    got = ann.search(df, asks, shard_rows=shard_rows).collect()
    ids = np.arange(len(x))
    want = {}
    for q in range(0, len(x), asks_every):
        score = (x * x[q]).sum(axis=1)
        best = np.lexsort((ids, -score))
        want[q] = [(-score[i], int(i)) for i in best if i != q][:20]
    assert recall(got, want) >= least_recall


def test_one_vector_of_large_norm_leaves_recall_alone(spark):
    """Clustered unit vectors, and one of norm 1e8, 1e12 or 1e30 among them."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(60, 32))
    x = centres[rng.integers(0, 60, 9000)] + 0.4 * rng.normal(size=(9000, 32))
    x /= np.sqrt((x ** 2).sum(axis=1))[:, None]
    for norm in (1e8, 1e30):
        y = x.copy()
        y[77] *= norm
        _check_norms(spark, y, 150, 3000)


def test_log_normal_norms(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(60, 32))
    x = centres[rng.integers(0, 60, 9000)] + 0.4 * rng.normal(size=(9000, 32))
    _check_norms(spark, x * rng.lognormal(0, 2, (9000, 1)), 150, 3000)


def test_norms_at_the_ends_of_doubles(spark):
    big, small = 1.7e308, 5e-324
    rows = [(0, [1.0, 0.0]), (1, [big, big]), (2, [big, -big]), (3, [small, 0.0]), (4, [-big, big]),
            (5, [2.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.vec_id, r.score) for r in ann.search(df, df.where("vec_id = 0")).orderBy("rank").collect()]
    assert got == [(1, big), (2, big), (5, 2.0), (3, small), (4, -big)]
    got = [(r.vec_id, r.score) for r in ann.search(df, df.where("vec_id = 1")).orderBy("rank").collect()]
    assert got == [(5, math.inf), (0, big), (3, big * small), (2, -math.inf), (4, -math.inf)]
