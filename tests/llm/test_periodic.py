"""Periodic runs against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewater.llm import periodic, queries
from tidewater.llm.textkit import words

SMOKE = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain(w, least, times):
    n, out = len(w), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            size = i - s + q
            if size >= max(least, times * q) and not any(
                    s2 <= s and s2 + l2 >= s + size for s2, l2, _ in out):
                out.append((s, size, q))
            i = max(i, s + 1)
    return sorted((s, size, q) for s, size, q in out)


def some_text(rng):
    n, v = rng.randint(1, 200), rng.choice([1, 2, 2, 3, 6])
    w = [rng.randint(1, v) for _ in range(n)]
    for _ in range(rng.randint(0, 3)):
        a = rng.randrange(n)
        p, b = rng.randint(1, max(1, (n - a) // 2)), rng.randint(a, n)
        for i in range(a, b):
            w[i] = w[a + (i - a) % p]
    return w


def test_runs_against_brute_force():
    rng = random.Random(3)
    for _ in range(400):
        w = some_text(rng)
        least, times = rng.choice([(24, 3), (24, 3), (6, 3), (10, 4), (3, 3)])
        got = list(zip(*(x.tolist() for x in periodic.runs_of(np.array(w), least, times))))
        assert got == plain(w, least, times)
    with pytest.raises(ValueError):
        periodic.runs_of(np.ones(9, np.int64), 24, 2)


def test_texts_in_one_batch_do_not_mix():
    column = pa.array(["a b", None, "", "a b a b", " a\x0bb ", "a b"] * 30)
    w = words(column)
    assert not len(periodic.runs_of(periodic.word_names(w))[0])
    names, doc = periodic.word_names(w), w.doc_of()
    assert all(len(set(doc[names == k])) == 1 for k in set(names))


def check(rows, texts):
    for r in rows:
        w = WORDS.findall(texts[r.doc_id] or "")
        runs = plain(w, 24, 3)
        assert [tuple(x) for x in r.runs] == runs and r.n_words == len(w)
        gone = {i for s, size, q in runs for i in range(s + q, s + size)}
        assert r.collapsed == " ".join(x for i, x in enumerate(w) if i not in gone)


def test_documents(spark):
    rng = random.Random(5)
    texts = {i: " \n".join(f"é{x}" for x in some_text(rng)) for i in range(60)}
    texts |= {100: None, 101: "", 102: " \t\n", 103: "x " * 30_000, 104: "no runs here",
              105: " ".join(f"w{i}" for i in range(60_000)), 106: "a b c " * 9 + "\U0001F600"}
    docs = spark.createDataFrame([(i, t, "r", 1) for i, t in texts.items()] + [(103, texts[103], "r", 1)],
                                 "doc_id long, text string, runs string, n_words int")
    rows = periodic.find_runs(docs).collect()
    assert len(rows) == len(texts) + 1
    check([r for r in rows if r.doc_id not in (103, 105)], texts)
    assert [(r.n_words, r.runs, r.collapsed) for r in rows if r.doc_id == 105] == [
        (60_000, [], texts[105])]
    assert [list(map(tuple, r.runs)) for r in rows if r.doc_id == 103] == [[(0, 30_000, 1)]] * 2
    assert periodic.find_runs(docs.limit(0)).count() == 0


def test_best_run_is_compared_exactly(spark):
    runs = [(0, 24, 8), (30, 30, 10), (70, 31, 10), (110, 62, 20), (200, 31, 10)]
    df = spark.createDataFrame([(runs,), ([],)],
                               "runs array<struct<start: long, length: long, period: long>>")
    got = [r.b and tuple(r.b) for r in df.select(periodic.best_run().alias("b")).collect()]
    assert got == [(70, 31, 10), None]


def test_query_over_the_prescribed_texts(spark):
    docs = queries.with_periods(queries.table(spark, SMOKE, "documents")).cache()
    texts = {r.doc_id: r.text for r in docs.collect()}
    check(periodic.find_runs(docs).collect(), texts)
    got = queries.QUERIES["op13_periodic_runs"](spark, SMOKE)
    assert got.where(F.col("n_runs") > 0).count() > 10
    empty = hashlib.sha256(b"").hexdigest()
    assert all((r.runs_sha256 == empty) == (r.n_runs == 0) == (r.start is None) for r in got.collect())
