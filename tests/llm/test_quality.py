"""Quality rules against plain Python, the classifier by held-out accuracy."""

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidewater.llm import fm, queries, rules

SMOKE = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def measures(text):
    text = text or ""
    w = WORDS.findall(text)
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    spots = {}
    for i in range(len(w) - 7):
        spots.setdefault(tuple(w[i:i + 8]), []).append(i)
    covered = {i + k for s in spots.values() if len(s) > 1 for i in s for k in range(8)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered))


TEXTS = [None, "", " \n ", "a b c d e f g h " * 5, "x " * 50, "one two three\n" * 6,
         " ".join(f"w{i}" for i in range(30)), "é ß \U0001F600 # * $", "A1 b\x0bc\x0cd\x1ce",
         " ".join(f"w{i % 17}" for i in range(200)), "END\n\n\nEND\n END", "q " * 20000,
         " ".join(str(i) for i in range(30000)), "a b c d e f g h i a b c d e f g h"]


def test_measures(spark):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], 1)],
                                 "doc_id long, text string, n_words int")
    rows = rules.apply_policy(rules.ledger(docs)).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert got == measures(TEXTS[r.doc_id])
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.kept and r.base_failed)
    assert rules.ledger(docs.limit(0)).count() == 0


def test_ablations(spark):
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet")
    book = rules.ledger(docs).cache()
    for r in rules.ablations(book).collect():
        left = [x for x in rules.POLICIES[r.policy] if x != r.rule]
        cond = dict(rules.RULES)
        fails = " OR ".join(f"({cond[x]})" for x in rules.POLICIES[r.policy])
        without = " OR ".join(f"({cond[x]})" for x in left) or "FALSE"
        assert r.n_docs == book.count()
        assert r.n_kept == book.where(f"NOT ({fails})").count()
        assert r.n_kept_without_rule == book.where(f"NOT ({without})").count()


def test_clean_documents_pass_the_rules(spark):
    """Labelled good texts that the base does not reject are kept."""
    good = spark.read.parquet(f"{SF01}/labels.parquet").where("quality = 1")
    got = queries.QUERIES["op10_quality_rules"](spark, SF01).join(good, "doc_id")
    assert got.where("NOT base_failed AND NOT kept").count() == 0


def test_sum_of_squares_identity():
    rng = np.random.default_rng(0)
    rows = [(rng.choice(fm.BUCKETS, 5, False).astype(np.int32), rng.normal(size=len(fm.STATS)),
             int(i % 2)) for i in range(40)]
    model = fm.train(rows, epochs=2)
    idx = np.concatenate([r[0] for r in rows])
    off = np.arange(0, 201, 5)
    stats = np.array([r[1] for r in rows])
    value, dense = model.inputs(off, stats)
    for k, p in enumerate(model.score(idx, off, stats)):
        feats = [*[(i, value[k]) for i in rows[k][0]],
                 *[(fm.BUCKETS + j, dense[k, j]) for j in range(len(fm.STATS))]]
        z = model.bias + sum(model.linear[i] * x for i, x in feats)
        z += sum(model.factors[i] @ model.factors[j] * x * y for a, (i, x) in enumerate(feats)
                 for j, y in feats[a + 1:])
        assert np.isclose(p, 1 / (1 + np.exp(-z)))


def test_held_out_accuracy(spark):
    got = queries.QUERIES["op9_quality_classifier"](spark, SF01).join(
        spark.read.parquet(f"{SF01}/labels.parquet"), "doc_id").collect()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == r.quality for r in held) >= 0.95 * len(held)


def test_labels_of_the_held_out_fold_are_not_learnt(spark):
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet")
    labels = spark.read.parquet(f"{SMOKE}/labels.parquet")
    twisted = labels.withColumn("quality", F.when(fm.held_out(), 1 - F.col("quality")).otherwise(
        F.col("quality")))
    a, b = fm.fit(docs, labels), fm.fit(docs, twisted)
    assert a.bias == b.bias and (a.linear == b.linear).all()


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, None, None, 0.5), (2, "", 0, 0.5), (3, "x " * 40000, 80000, 0.5),
                                  (3, "x " * 40000, 80000, 0.5), (None, "a b", 3, 0.5)],
                                 "doc_id long, text string, n_chars long, score double")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 1, 0), (None, 1, 0), (3, None, 0)],
                                   "doc_id long, quality int, toxic int")
    model = fm.fit(docs, labels)
    rows = fm.score(docs, model).collect()
    assert len(rows) == 5 and len({r.score for r in rows if r.doc_id == 3}) == 1
    none = fm.fit(docs, labels.limit(0))
    assert {r.score for r in fm.score(docs, none).collect()} == {0.5}
    assert fm.score(docs.limit(0), none).count() == 0
    kept = fm.reject_low_quality(docs, labels, threshold=0.0)
    assert kept.columns == docs.columns and kept.count() == 5


def test_features_do_not_depend_on_the_batch():
    texts = ["Aa bb aa!", "", "c | d\ne", None, "ZZ 12"]
    whole = fm.features(pa.array(texts), np.zeros(5))
    for k, t in enumerate(texts):
        idx, off, stats = fm.features(pa.array([t], pa.string()), np.zeros(1))
        assert idx.tolist() == whole[0][whole[1][k]:whole[1][k + 1]].tolist()
        assert np.allclose(stats[0], whole[2][k])
