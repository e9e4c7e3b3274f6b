"""Phrases against plain counting, the index against scans of its text."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tidewater.llm import collocations as C


def plain(rows, depth, least):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, depth + 1):
                for i in range(len(w) - m + 1):
                    f[lang, tuple(w[i:i + m])] += 1
    out = {}
    for (lang, g), a in f.items():
        if len(g) < 2 or a < least:
            continue
        score, k = min((1000000 * a * a // (f[lang, g[:k]] * f[lang, g[k:]]), k)
                       for k in range(1, len(g)))
        inside = any(b >= least and 100 * b >= 50 * a and len(h) > len(g) and any(
            h[i:i + len(g)] == g for i in range(len(h))) for (o, h), b in f.items() if o == lang)
        out[lang, " ".join(g)] = (a, f[lang, g[:k]], f[lang, g[k:]], n[lang], score, inside)
    return out


def corpus(rng, n):
    words = ["a", "b", "C", "dé", "e", "f'", "g-h", "I", "İx"]
    text = lambda: "".join(rng.choice(words) + rng.choice([" ", "  ", "\t", " ", " ", ". ", ",", "\n"])
                           for _ in range(rng.randint(0, 60)))
    return [(rng.choice(["en", "en", "fr", None, "und"]), rng.choice([text(), text(), None, "", "a b c"]))
            for _ in range(n)]


@pytest.mark.parametrize("depth, least", [(3, 10), (2, 10), (4, 5)])
def test_against_plain_counting(spark, depth, least):
    rows = corpus(random.Random(depth), 150)
    docs = spark.createDataFrame([(x, t, 1, "q") for x, t in rows],
                                 "lang string, text string, n int, word string").repartition(7)
    got = {(r.lang, r.phrase): (r.a, r.l, r.r, r.n, r.score, r.dropped)
           for r in C.mine(docs, depth, least, shard_bytes=300).collect()}
    assert got == plain(rows, depth, least) and got
    first = C.top(C.mine(docs, depth, least), 5).collect()
    for lang in {r.lang for r in first}:
        own = sorted((-v[4], -v[0], p.encode()) for (o, p), v in got.items() if o == lang and not v[5])
        assert [r.phrase.encode() for r in sorted(first, key=lambda r: r["rank"]) if r.lang == lang] == [
            p for *_, p in own[:5]]


def test_empty_tables_and_rare_words(spark):
    docs = spark.createDataFrame([("en", "one two"), (None, None)], "lang string, text string")
    assert C.mine(docs).count() == 0 and C.mine(docs.limit(0)).count() == 0


def test_counts_beyond_64_bits(spark):
    """Squares of counts times a million are compared as decimals."""
    big = 3_000_000_011
    row = spark.range(1).selectExpr(
        f"cast({big} as decimal(19,0)) a", f"cast({big + 7} as decimal(19,0)) l")
    got = row.selectExpr("cast(a * a * 1000000 as decimal(38,0)) div cast(a * l as decimal(38,0)) s")
    assert got.first().s == 1000000 * big * big // (big * (big + 7))


def test_intervals_of_the_index():
    """Both intervals of every phrase hold just the suffixes that start with it, forwards and
    mirrored, whichever side it was extended on."""
    rng = np.random.default_rng(1)
    text = np.concatenate([[0], rng.choice(4, 300), [0]])
    text = text[np.append(True, (text[1:] > 0) | (text[:-1] > 0))]
    seen = lambda p: sum(text[i:i + len(p)].tolist() == p for i in range(len(text)))
    both = C.Bidirectional(text, 3)
    for sides in ((False, True), (True, False), (True, True), (False, False)):
        level = both.words()
        for left in sides:
            level = both.extend(level, left)
            phrases = level["words"].tolist()
            assert len(set(map(tuple, phrases))) == len(phrases)
            assert [seen(p) for p in phrases] == level["size"].tolist()
            every = {tuple(text[i:i + len(phrases[0])].tolist())
                     for i in range(len(text) - len(phrases[0]) + 1)}
            assert {x for x in every if 0 not in x} == set(map(tuple, phrases))
