"""Language-model scores against a plain count model; the trie against dictionaries."""

import math
import re
import zlib
from collections import Counter

import numpy as np

from tidewater.llm import ngrams, queries

SMOKE = "/root/testdata/sf0.001"


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def held(k):
    return k is not None and zlib.crc32(str(k).encode()) % 7 == 2


def brute(rows, mu=ngrams.MU):
    one, two = Counter(), Counter()
    for k, t in rows:
        if not held(k):
            w = tokens(t)
            one.update(w)
            two.update(zip([None, *w], w))
    n, v = sum(one.values()), len(one)
    out = {}
    for k, t in rows:
        w = tokens(t)
        base = score = 0.0
        for a, b in zip([None, *w], w):
            p = (one[b] + 1) / (n + v + 1)
            base += math.log10(p)
            c = two[a, b]
            alpha = 10 ** (-math.ceil(-math.log10(c / (one[a] + mu)) / ngrams.STEP - 1e-9)
                           * ngrams.STEP) if c else 0.0
            score += math.log10(alpha + mu / (one[a] + mu) * p)
        out[k] = (held(k), len(w), sum(one[x] > 0 for x in w), n, base, score)
    return out


def hold(got, rows):
    want = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        w = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4]
        assert math.isclose(r.base_score, w[4], rel_tol=1e-9, abs_tol=1e-9)
        assert math.isclose(r.score, w[5], rel_tol=1e-9, abs_tol=1e-9), (r, w)


def test_whole_table(spark, monkeypatch):
    monkeypatch.setattr(ngrams, "BATCH_BYTES", 100_000)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMOKE}/documents.parquet").collect()]
    got = queries.QUERIES["op8_ngram_scores"](spark, SMOKE).collect()
    hold(got, rows)
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_edge_rows(spark):
    rows = [(1, "A b a B"), (2, None), (3, ""), (4, " \n"), (5, "a " * 3000), (7, "b\x0ba"), (None, "z")]
    docs = spark.createDataFrame([(k, t, "w") for k, t in rows], "doc_id long, text string, words string")
    hold(ngrams.score(docs).collect(), rows)
    assert ngrams.score(docs.limit(0)).count() == 0
    alone = [(k, "x y") for k in range(40) if held(k)]
    got = ngrams.score(spark.createDataFrame(alone, "doc_id long, text string")).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and r.score == 0 for r in got)


def test_elias_fano():
    rng = np.random.default_rng(3)
    for n, top in ((1, 5), (7, 3), (1000, 50), (1000, 10**12), (5000, 9000)):
        v = np.sort(rng.integers(0, top + 1, n))
        ef = ngrams.EliasFano.build(v)
        assert (ef.get(np.arange(n)) == v).all()
        x = np.concatenate([v, rng.integers(0, top + 3, 500), [0, top, top + 5]])
        lo = rng.integers(0, n + 1, len(x))
        hi = np.minimum(n, lo + rng.integers(0, n + 1, len(x)))
        want = [a + int(np.searchsorted(v[a:b], y, "left")) for y, a, b in zip(x, lo, hi)]
        assert (ef.successor(x, lo, hi) == want).all()


def test_trie(tmp_path):
    rng = np.random.default_rng(5)
    pairs = sorted({(int(a), int(b)) for a, b in rng.integers(0, 60, (800, 2))})
    a, b = (np.array(x) for x in zip(*pairs))
    codes = rng.integers(1, 256, len(a)).astype(np.uint8)
    ngrams.Trie.build(a, b, codes).save(str(tmp_path / "t"))
    trie = ngrams.Trie.open(str(tmp_path / "t"))
    known = dict(zip(pairs, codes.tolist()))
    x, y = np.divmod(np.arange(65 * 65), 65)
    assert trie.find(x, y).tolist() == [known.get(p, 0) for p in zip(x.tolist(), y.tolist())]


def test_codes_round_down_at_every_size():
    p = np.concatenate([10.0 ** -np.arange(0, 20, 0.013), [1e-12, 1.15e-8, 1e-9, 2.0 ** -63, 1.0]])
    back = ngrams.dequantise(ngrams.quantise(p))
    assert (back <= p * (1 + 1e-8)).all() and (back > p * 10 ** -0.26).all()
    fine = p >= 1e-6
    assert (back[fine] > p[fine] * 10 ** (-ngrams.STEP * 1.001)).all()
    assert ngrams.dequantise(np.zeros(1, np.uint8))[0] == 0.0
