"""Substring dedup against a brute-force version."""

import hashlib
import random
import re

import pyarrow as pa

from tidewater.llm import batchtable, queries, substrings

SMOKE = "/root/testdata/sf0.001"


def brute(texts, n=13):
    words = [(k, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for k, t in texts]
    first = {}
    for k, w in words:
        for i in range(len(w) - n + 1):
            g = tuple(w[i:i + n])
            first[g] = min(first.get(g, k), k)
    out = {}
    for k, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            if first[tuple(w[i:i + n])] < k:
                gone[i:i + n] = [True] * n
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[k] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)
    return out


def hold(rows, want):
    assert len(rows) == len(want)
    for r in rows:
        assert (r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id][:3], r


def sample(seed, vocab, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocab)]
    passages = [[rng.choice(words) for _ in range(rng.randint(8, 60))] for _ in range(12)]
    out = []
    for k in range(n):
        t = []
        for _ in range(rng.randint(0, 6)):
            p = list(rng.choice(passages)) if rng.random() < 0.6 else [
                rng.choice(words) for _ in range(rng.randint(1, 40))]
            if rng.random() < 0.3:
                p[rng.randrange(len(p))] = "edit"
            a = rng.randrange(len(p))
            t += p[a // 3:]
        out.append((k, rng.choice([" ", "\n", " \t"]).join(t)))
    rng.shuffle(out)
    return out


def test_random(spark, monkeypatch):
    from tidewater.llm import batchtable
    monkeypatch.setattr(batchtable, "TEXT_BYTES", 3000)
    texts = sample(1, 400, 120) + sample(2, 3, 0)
    hold(substrings.repeated_words(spark.createDataFrame(texts, "doc_id long, text string")).collect(),
         brute(texts))


def test_few_words_many_ties(spark):
    """A two-word language repeats minimizers inside and between documents."""
    texts = sample(7, 2, 40) + [(1000, "a " * 200), (1001, "a " * 50), (1002, None), (1003, ""),
                                (1004, " \n")]
    hold(substrings.repeated_words(spark.createDataFrame(texts, "doc_id long, text string")).collect(),
         brute(texts))


def test_edge_rows(spark):
    text = " ".join(f"x{i}" for i in range(20))
    docs = spark.createDataFrame(
        [(1, "m", text + "\n\nend", 3), (1, "m", text + "\n\nend", 3), (None, "n", text, 4),
         (2, "k", f"é  start {text} tail  z", 5), (3, None, text, None)],
        "doc_id long, marks string, text string, n_chars long")
    rows = sorted(((r.doc_id or 0, r.n_removed) for r in substrings.repeated_words(docs).collect()))
    assert rows == [(0, 0), (1, 0), (1, 0), (2, 20), (3, 20)]
    cut = {r.marks: r for r in substrings.cut_repeats(docs).collect()}
    assert cut["k"].text == "é  start tail  z" and cut["k"].n_chars == 16
    assert cut["m"].text == text + "\n\nend" and cut["m"].n_chars == 3
    assert cut[None].text == "" and cut["n"].text == text
    assert substrings.repeated_words(docs.limit(0)).count() == 0
    assert substrings.cut_repeats(docs.limit(0)).count() == 0


def phrase(n, seed=11):
    """Documents with one phrase of 12 words between words of their own, every fifth repeated."""
    rng = random.Random(seed)
    line = " ".join(f"licence{i}" for i in range(12))
    own = lambda m: " ".join(f"v{rng.randrange(10 ** 6)}" for _ in range(m))
    out = []
    for k in range(n):
        out.append((k, out[-1][1] if k % 5 == 4 else f"{own(rng.randint(0, 9))} {line} {own(9)}"))
    rng.shuffle(out)
    return out


def test_hot_phrase_stays_right(spark, monkeypatch):
    """Minimizers of few and of many occurrences, compared in both ways, in and across batches."""
    for limit, size in ((0, 3000), (2, 3000), (20, 10 ** 6), (20, 3000)):
        monkeypatch.setattr(substrings, "HOT_RUNS", limit, raising=False)
        monkeypatch.setattr(batchtable, "TEXT_BYTES", size)
        texts = phrase(150) + [(1000 + k, t) for k, t in sample(1, 400, 60)] + [(2000, "a " * 90)]
        docs = spark.createDataFrame(texts, "doc_id long, text string")
        hold(substrings.repeated_words(docs).collect(), brute(texts))


def test_hot_phrase_is_spread():
    """No shard gets the sequences of a phrase that stands in every document."""
    n, texts = 64, phrase(6000)
    batches = []
    for k in range(0, len(texts), 500):
        part = pa.RecordBatch.from_pydict({"doc_id": [i for i, _ in texts[k:k + 500]],
                                           "text": [t for _, t in texts[k:k + 500]]})
        batches.append({"batch": k, "docs": batchtable.dump(part)})

    def send(make, reply, name):
        shards = {}
        for row in batches:
            for shard, message in make(row):
                shards.setdefault(shard, []).append((row, message))
        for row in batches:
            row[name] = []
        for shard, got in shards.items() if reply else ():
            for (row, _), r in zip(got, reply(shard, [m for _, m in got])):
                if r is not None:
                    row[name].append({"shard": shard, "message": r})
        return [sum(sum(a.nbytes for a in batchtable.unpack(m)) for _, m in got)
                for got in shards.values()]

    first = substrings._shared
    send(substrings._ask_minimizers(n, 13, 6),
         first(substrings.HOT_RUNS) if hasattr(substrings, "HOT_RUNS") else first, "shared")
    sizes = send(substrings._ask_windows(n, 13, 6), None, "marks")
    assert max(sizes) < 0.1 * sum(sizes)


def test_shards_follow_the_input(spark, monkeypatch):
    """The session has 4 shuffle partitions; a larger table still has small shards."""
    texts = sample(1, 400, 120)
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    monkeypatch.setattr(batchtable, "TEXT_BYTES", 3000)
    monkeypatch.setattr(batchtable, "SHARD_BYTES", 1000, raising=False)
    want = -(-sum(len(t) for _, t in texts) // 1000)
    table, n = substrings._marked(docs, 13, 6)
    assert n == want > 4
    asked = batchtable.ask(table.drop("shared", "marks"), substrings._ask_minimizers(n, 13, 6))
    got = batchtable.answer(asked, n, substrings._shared(1000))
    assert got.rdd.getNumPartitions() == n
    assert asked.select("shard").distinct().count() > n / 2
    hold(substrings.repeated_words(docs).collect(), brute(texts))


def test_automaton():
    rng = random.Random(4)
    for _ in range(200):
        refs = [[rng.randint(0, 2) for _ in range(rng.randint(0, 12))] for _ in range(3)]
        tree = substrings.SuffixAutomaton()
        for r in refs:
            tree.add(r)
        text = [rng.randint(0, 2) for _ in range(15)]
        facts = {tuple(r[i:j]) for r in refs for i in range(len(r)) for j in range(i + 1, len(r) + 1)}
        want = [max([n for n in range(1, k + 2) if tuple(text[k + 1 - n:k + 1]) in facts], default=0)
                for k in range(len(text))]
        assert list(tree.statistics(text)) == want


def test_whole_table(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMOKE}/documents.parquet").collect()]
    hold(queries.QUERIES["op5_substring_dedup"](spark, SMOKE).collect(), brute(texts))
