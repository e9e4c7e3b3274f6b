"""Near-duplicates against a brute-force version over all pairs."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tidewater.llm import minhash, queries, textkit

SMOKE = "/root/testdata/sf0.001"


def sets_of(texts, n):
    out = {}
    for k, t in texts:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        out[k] = {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else (
            {tuple(w)} if w else set())
    return out


def brute(texts, n, percent=80):
    sets = sets_of(texts, n)
    up = {k: k for k in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    where = {}
    for k in ids:
        for g in sets[k]:
            where.setdefault(g, []).append(k)
    for k in ids:
        seen = {}
        for g in sets[k]:
            for o in where[g]:
                if o < k:
                    seen[o] = seen.get(o, 0) + 1
        for o, both in seen.items():
            if 100 * both >= percent * (len(sets[k]) + len(sets[o]) - both):
                a, b = sorted((root(k), root(o)))
                up[b] = a
    return {k: (len(sets[k]), root(k)) for k in ids}


def run(spark, texts, n):
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    return minhash.near_duplicates(docs, n).collect()


def hold(rows, want):
    assert len(rows) == len(want)
    for r in rows:
        assert (r.n_shingles, r.component_id) == want[r.doc_id], r
        assert r.kept == (r.doc_id == r.component_id)


def test_random_groups(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(300)]
    texts, k = [], 0
    for _ in range(25):
        base = [rng.choice(vocab) for _ in range(rng.choice([3, 12, 60, 150]))]
        for _ in range(rng.choice([1, 3, 12])):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            texts.append((k, " ".join(words)))
            k += 1
    rng.shuffle(texts)
    texts += [(k, None), (k + 1, ""), (k + 2, " \n\t"), (k + 3, "One two"), (k + 4, "one\ntwo")]
    for n in (4, 5):
        hold(run(spark, texts, n), brute(texts, n))


def test_chains(spark):
    """A drifting text: neighbours are linked, the ends are not alike."""
    rng = random.Random(5)
    words = [f"a{i}" for i in range(120)]
    texts = []
    for k in range(60):
        texts.append((k * 7 % 61, " ".join(words)))
        words[k * 2 % 120] = f"n{k}"
    hold(run(spark, texts, 4), brute(texts, 4))


def test_edge_rows(spark):
    docs = spark.createDataFrame(
        [(1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (2, "a b c d e f", "y"), (None, "a b c d e f", "z"),
         (3, None, "n")], "doc_id long, text string, comp string")
    rows = minhash.near_duplicates(docs, 4).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in rows if r.doc_id) == [
        (1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True)]
    kept = minhash.drop_near_duplicates(docs, 4).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "3", "None"]
    assert minhash.near_duplicates(docs.limit(0), 4).count() == 0
    assert minhash.drop_near_duplicates(docs.limit(0), 4).count() == 0


def test_signature_estimates():
    """Signatures agree on about the share of common shingles, with a small spread."""
    rng = np.random.default_rng(1)
    errors = []
    for size, both in ((40, 20), (200, 160), (1000, 300)):
        for _ in range(40):
            pool = rng.integers(0, 1 << 63, 2 * size, dtype=np.int64).astype(np.uint64)
            a, b = np.sort(pool[:size]), np.sort(pool[size - both:2 * size - both])
            sig = minhash.signatures(np.concatenate([a, b]), np.array([0, size, 2 * size]))
            errors.append((sig[0] == sig[1]).mean() - both / (2 * size - both))
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.05


@pytest.mark.parametrize("text", ["a b c d e", "x"])
def test_levels_fill_every_place(text):
    grams, off = minhash.shingles(textkit.words(pa.array([text, None, ""])), 4)
    sig = minhash.signatures(grams, off)
    assert (sig[0] != ~np.uint64(0)).all() and (sig[1:] == ~np.uint64(0)).all()
    ranks = [sorted((sig[0] >> np.uint64(56)).tolist())]
    assert max(ranks[0]) < minhash.PLACES


def test_whole_table(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMOKE}/documents.parquet").collect()]
    hold(queries.QUERIES["op4_near_duplicates"](spark, SMOKE).collect(), brute(texts, 4))


def test_repeated_id_keeps_the_smallest_text(spark):
    """Whatever the partitions: of rows with one id the smallest text stays, then the smallest
    other columns; a column named like a helper is kept."""
    rows = [(1, "one two three four five six", 9), (1, "alpha beta gamma delta epsilon", 2),
            (1, "alpha beta gamma delta epsilon", 1), (2, "quite another text than these here", 5)]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string, _copies int").repartition(3)
        assert sorted(tuple(r) for r in minhash.drop_near_duplicates(docs).collect()) == [rows[2], rows[3]]
