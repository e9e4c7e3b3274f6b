"""Interleaving against a plain sort, its law, and the mixture of every shard."""

import hashlib
import zlib
from collections import Counter

from tidewater.llm import interleave, queries

SMOKE = "/root/testdata/sf0.001"


def plain(rows, shards, seed):
    """(doc_id, source, text) -> {doc_id: (shard, slot)} by sorting everything."""
    mix = lambda d: hashlib.md5(f"{seed}:{d}".encode()).hexdigest()
    by = {}
    for d, s, _ in rows:
        by.setdefault(s, []).append((mix(d), d))
    order = sorted(((r + 0.5) / len(x), s is not None, s or "", m, d)
                   for s, x in by.items() for r, (m, d) in enumerate(sorted(x)))
    out, seen = {}, Counter()
    for at, (*_, d) in enumerate(order):
        k = at * shards // len(order)
        out[d] = (k, seen[k])
        seen[k] += 1
    return out


def docs_of(spark, rows):
    return spark.createDataFrame([(d, s, t, 5, 6) for d, s, t in rows],
                                 "doc_id long, source string, text string, size int, _part int")


def test_against_a_plain_sort(spark):
    rows = [(i, None if i % 50 == 0 else "" if i % 50 == 1 else f"s{min(i % 9, 3)}",
             None if i % 7 == 0 else "é" * (i % 11)) for i in range(700)]
    for shards, seed in ((8, interleave.SEED), (3, "other")):
        got = interleave.interleave(docs_of(spark, rows), shards, seed).collect()
        assert {r.doc_id: (r.shard, r.slot) for r in got} == plain(rows, shards, seed)
        text = {d: (t or "").encode() for d, _, t in rows}
        assert all(r.size == len(text[r.doc_id]) + 1 and
                   r.text_crc32 == zlib.crc32(text[r.doc_id]) for r in got)
        counts = Counter(r.shard for r in got)
        assert max(counts.values()) - min(counts.values()) <= 1
        for source, n in Counter(s for _, s, _ in rows).items():
            own = Counter(r.shard for r in got if r.source == source)
            assert all(abs(own[k] - n * counts[k] / len(rows)) <= 2 for k in range(shards))


def test_repeats_few_rows_and_empty_table(spark):
    rows = [(1, "a", "x"), (1, "a", "x"), (1, "a", "y"), (None, "a", "long " * 200_000), (2, "b", None)]
    got = interleave.interleave(docs_of(spark, rows)).collect()
    assert sorted(r.doc_id or 0 for r in got) == [0, 1, 1, 1, 2]
    assert len({r.shard for r in got}) == 5 and {r.slot for r in got} == {0}
    assert interleave.interleave(docs_of(spark, rows).limit(0)).count() == 0


def test_query_slots_have_no_gaps(spark):
    got = queries.QUERIES["op11_interleaving"](spark, SMOKE).collect()
    for shard in range(8):
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots)))
