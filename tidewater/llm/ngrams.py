"""Language-model scores from an Elias-Fano n-gram trie (order 2).

p(w | v) = a(w | v) + b(v) * p(w), with a(w | v) = c(v w) / (c(v) + MU), b(v) = MU / (c(v) + MU)
and p(w) = (c(w) + 1) / (N + V + 1): Dirichlet smoothing, which sums to one over the V known tokens
and one unknown. A document starts in the context of the end token.

Counting and scoring go through the batch table: every batch asks the word shards for the counts
and numbers of its distinct words, then the pair shards for a(w | v) of its distinct pairs. A pair
shard merges the counts of all batches into a trie: contexts and their pointers as Elias-Fano
sequences, successors as one more, made monotone by adding each context's last prefix sum to
the next one's, and 8-bit log probabilities, all memory-mapped from a task-local file while the
shard answers. A pair is found by the successor search inside its context's range.

Shards are cut by the hash of the pair, not of the context, so a context that a third of all
words follow is spread evenly; nothing is pruned.

Defined results: a null or empty text is the end token alone; a row without id is learnt from
and not held out; repeated rows count each time; without training rows every token is unknown
and has probability one; an empty table gives no rows; further columns are ignored.
A text longer than a batch is a batch of its own.
"""

from __future__ import annotations

import os
import tempfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batchtable import answer, ask, by_shard, load, meet, pack, shards, unpack, write_batches
from .graph import settle
from .textkit import mix, words

MU = 20.0
FOLDS, HELD_OUT = 7, 2
BATCH_BYTES = 4_000_000
# Codes of probabilities: 0 for absent, up to FINE in steps of STEP of log10 (down to 1e-6), then in
# steps of COARSE. The last code, 10 ** -21.5, is below 1 over any count of 64 bits.
STEP, FINE, COARSE = 1 / 32, 193, 1 / 4
_U = np.uint64
_END = _U(0x0123456789ABCDEF)


class EliasFano:
    """Non-decreasing integers: low bits packed, high parts in unary with counts per word."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray,
                 ones: np.ndarray) -> None:
        self.n, self.low_bits, self.low, self.high, self.ones = n, low_bits, low, high, ones
        self.zeros = np.arange(len(ones), dtype=np.int64) * 64 - ones

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        v = values.astype(_U)
        part = v & _U((1 << bits) - 1)
        at = np.arange(n, dtype=_U) * _U(bits)
        low = np.zeros(n * bits // 64 + 2, _U)
        word, shift = (at >> _U(6)).astype(np.int64), at & _U(63)
        np.bitwise_or.at(low, word, part << shift)
        spill = (shift + _U(bits)) > _U(64)
        np.bitwise_or.at(low, word[spill] + 1, part[spill] >> (_U(64) - shift[spill]))
        place = (v >> _U(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros((int(place[-1]) if n else 0) // 64 + 2, _U)
        np.bitwise_or.at(high, place >> 6, _U(1) << (place & 63).astype(_U))
        ones = np.zeros(len(high) + 1, np.int64)
        np.cumsum(np.bitwise_count(high), out=ones[1:])
        return cls(n, bits, low, high, ones)

    def arrays(self) -> list[np.ndarray]:
        return [np.array([self.n, self.low_bits], np.int64), self.low, self.high, self.ones]

    @classmethod
    def of(cls, arrays: list[np.ndarray]) -> EliasFano:
        return cls(int(arrays[0][0]), int(arrays[0][1]), *arrays[1:])

    def _in_word(self, bits: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Place of the k-th set bit of each word, by halving."""
        place = np.zeros(len(bits), np.int64)
        left = k.astype(np.int64).copy()
        for half in (32, 16, 8, 4, 2, 1):
            piece = (bits >> place.astype(_U)) & _U((1 << half) - 1)
            below = np.bitwise_count(piece).astype(np.int64)
            up = left >= below
            left[up] -= below[up]
            place[up] += half
        return place

    def _select(self, counts: np.ndarray, k: np.ndarray, flip: bool) -> np.ndarray:
        word = np.searchsorted(counts, k, "right") - 1
        bits = self.high[word]
        return word * 64 + self._in_word(~bits if flip else bits, k - counts[word])

    def _low(self, i: np.ndarray) -> np.ndarray:
        at = i.astype(_U) * _U(self.low_bits)
        word, shift = (at >> _U(6)).astype(np.int64), at & _U(63)
        both = self.low[word] >> shift
        over = shift > 0
        both[over] |= self.low[word[over] + 1] << (_U(64) - shift[over])
        return both & _U((1 << self.low_bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at some places."""
        high = self._select(self.ones, i, False) - i
        return ((high.astype(_U) << _U(self.low_bits)) | self._low(i)).astype(np.int64)

    def successor(self, x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """First place in [lo, hi) with a value of at least x (hi if there is none)."""
        x = x.astype(np.int64)
        high, low = x >> self.low_bits, (x & ((1 << self.low_bits) - 1)).astype(_U)
        last = int(self.zeros[-1])
        # values with a smaller high part stand before the zero that opens this one's bucket
        a = np.where(high > 0, self._select(self.zeros, np.clip(high - 1, 0, last - 1), True)
                     - (high - 1), 0)
        b = self._select(self.zeros, np.clip(high, 0, last - 1), True) - high
        a = np.where(high - 1 >= last, self.n, np.minimum(a, self.n))
        b = np.where(high >= last, self.n, np.minimum(b, self.n))
        a, b = np.clip(a, lo, hi), np.clip(b, lo, hi)
        while True:
            open_ = np.flatnonzero(a < b)
            if not len(open_):
                return a
            mid = (a[open_] + b[open_]) >> 1
            less = self._low(mid) < low[open_]
            a[open_[less]] = mid[less] + 1
            b[open_[~less]] = mid[~less]


class Trie:
    """Two levels: contexts with pointers, successors with quantised probabilities."""

    def __init__(self, contexts: EliasFano, pointers: EliasFano, successors: EliasFano,
                 codes: np.ndarray) -> None:
        self.contexts, self.pointers = contexts, pointers
        self.successors, self.codes = successors, codes

    @classmethod
    def build(cls, context: np.ndarray, word: np.ndarray, codes: np.ndarray) -> Trie:
        """From pairs sorted by context and word, each once."""
        new = np.ones(len(context), bool)
        new[1:] = context[1:] != context[:-1]
        start = np.flatnonzero(new)
        ends = np.append(start[1:], len(context))
        # each range goes on from the last sum of the range before
        base = np.append(0, np.cumsum(word[ends - 1]))[:-1] if len(start) else start
        run = np.cumsum(new) - 1
        return cls(EliasFano.build(context[start]), EliasFano.build(np.append(start, len(context))),
                   EliasFano.build(word + base[run] if len(word) else word), codes)

    def save(self, path: str) -> None:
        arrays = [*self.contexts.arrays(), *self.pointers.arrays(), *self.successors.arrays(),
                  self.codes]
        head = np.array([x for a in arrays for x in (len(a), ord(a.dtype.char))], np.int64)
        with open(path, "wb") as f:
            f.write(head.tobytes())
            for a in arrays:
                f.write(a.tobytes() + b"\0" * (-a.nbytes % 8))

    @classmethod
    def open(cls, path: str) -> Trie:
        """Levels as memory maps of a saved trie."""
        raw = np.memmap(path, np.uint8, "r")
        head = raw[:26 * 8].view(np.int64)
        at, out = 26 * 8, []
        for n, kind in zip(head[::2].tolist(), head[1::2].tolist()):
            size = n * np.dtype(chr(kind)).itemsize
            out.append(raw[at:at + size].view(chr(kind)))
            at += size + -size % 8
        return cls(EliasFano.of(out[0:4]), EliasFano.of(out[4:8]), EliasFano.of(out[8:12]), out[12])

    def find(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Codes of pairs, 0 for those that the trie lacks."""
        out = np.zeros(len(context), np.uint8)
        n = self.contexts.n
        if not n or not len(context):
            return out
        zero = np.zeros(len(context), np.int64)
        k = self.contexts.successor(context, zero, zero + n)
        ok = np.flatnonzero(k < n)
        ok = ok[self.contexts.get(k[ok]) == context[ok]]
        lo, hi = self.pointers.get(k[ok]), self.pointers.get(k[ok] + 1)
        base = np.where(lo > 0, self.successors.get(np.maximum(lo - 1, 0)), 0)
        at = self.successors.successor(base + word[ok], lo, hi)
        hit = at < hi
        hit[hit] = self.successors.get(at[hit]) == (base + word[ok])[hit]
        out[ok[hit]] = self.codes[at[hit]]
        return out


def quantise(a: np.ndarray) -> np.ndarray:
    """Codes of probabilities, rounded down so that no context's mass exceeds one."""
    size = -np.log10(a)
    fine = np.ceil(size / STEP - 1e-9) + 1
    coarse = FINE + np.ceil((size - (FINE - 1) * STEP) / COARSE - 1e-9)
    return np.where(fine <= FINE, np.maximum(fine, 1), coarse).astype(np.uint8)


def dequantise(codes: np.ndarray) -> np.ndarray:
    q = codes.astype(float)
    size = np.where(q <= FINE, (q - 1) * STEP, (FINE - 1) * STEP + (q - FINE) * COARSE)
    return np.where(q > 0, 10.0 ** -size, 0.0)


def _held(ids: list) -> np.ndarray:
    return np.array([d is not None and zlib.crc32(str(d).encode()) % FOLDS == HELD_OUT for d in ids],
                    bool)


def _tokens(row: dict):
    """Ids and hold-out flags of a batch's documents, token hashes (words, then the end), and
    token offsets per document."""
    docs = load(row["docs"])
    text, parts, counts = docs.column("text"), [], []
    size = np.append(0, np.cumsum([len(t or "") for t in text.to_pylist()]))
    at = 0
    while at < len(text):  # hash a few hundred kB at a time
        to = max(at + 1, int(np.searchsorted(size, size[at] + 500_000, "right")) - 1)
        w = words(text.slice(at, to - at))
        parts.append(np.insert(w.hashes(lower=True), w.offsets[1:], _END))
        counts.append(np.diff(w.offsets) + 1)
        at = to
    ids = docs.column("doc_id").to_pylist()
    return ids, _held(ids), np.concatenate(parts), np.append(0, np.cumsum(np.concatenate(counts)))


def _ask_words(n: int):
    def make(row: dict) -> Iterator[tuple[int, bytes]]:
        _, held, token, off = _tokens(row)
        key, place = np.unique(token, return_inverse=True)
        learnt = np.repeat(~held, np.diff(off))
        count = np.bincount(place[learnt], minlength=len(key))
        for shard, at in by_shard(key, n):
            yield shard, pack(key[at], count[at].astype(np.uint32))

    return make


def _count_words(n: int):
    """Reply: number and training count of each word; note: distinct and all training tokens."""

    def reply(shard: int, messages: list[bytes]):
        parts = [unpack(m) for m in messages]
        key, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        count = np.zeros(len(key), np.int64)
        np.add.at(count, place, np.concatenate([p[1] for p in parts]))
        # numbers by count, so that frequent words have small ones
        number = np.empty(len(key), np.int64)
        number[np.argsort(-count, kind="stable")] = np.arange(len(key))
        number = number * n + shard
        cuts = np.cumsum([len(p[0]) for p in parts])[:-1]
        return ([pack(number[p], count[p]) for p in np.split(place, cuts)],
                [int((count > 0).sum()), int(count.sum())])

    return reply


def _numbered(row: dict, n: int):
    """Tokens of a batch as word numbers and training counts."""
    ids, held, token, off = _tokens(row)
    key, place = np.unique(token, return_inverse=True)
    number, count = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
    got = {a["shard"]: a["message"] for a in row["words"] or []}
    for shard, at in by_shard(key, n):
        number[at], count[at] = unpack(got[shard])
    return ids, held, off, number, count, place.ravel()


def _pairs(row: dict, n: int):
    """Distinct pairs of a batch in the order of their numbers (index of both words among the
    batch's own), which pair each token ends, and the pairs' shard keys."""
    ids, held, off, number, count, word = _numbered(row, n)
    end = int(word[off[1] - 1]) if len(off) > 1 else 0
    before = np.empty(len(word), np.int64)
    before[1:] = word[:-1]
    before[off[:-1]] = end
    rank = np.empty(len(number), np.int64)
    order = np.argsort(number)
    rank[order] = np.arange(len(number))
    pair, place = np.unique((rank[before] << 32) | rank[word], return_inverse=True)
    first, second = order[pair >> 32], order[pair & 0xFFFFFFFF]
    key = mix(number[first].astype(_U) * _U(0x9E3779B97F4A7C15) + number[second].astype(_U))
    return ids, held, off, count, word, number, first, second, place.ravel(), key


def _ask_pairs(n: int):
    def make(row: dict) -> Iterator[tuple[int, bytes]]:
        _, held, off, count, _, number, first, second, place, key = _pairs(row, n)
        learnt = np.repeat(~held, np.diff(off))
        seen = np.bincount(place[learnt], minlength=len(first)).astype(np.uint32)
        for shard, at in by_shard(key, n):
            one = first[at]
            new = np.ones(len(one), bool)
            new[1:] = one[1:] != one[:-1]
            start = np.flatnonzero(new)
            yield shard, pack(
                np.diff(number[one[start]], prepend=0).astype(np.uint32 if (number < 2**31).all()
                                                              else np.int64),
                np.diff(np.append(start, len(one))).astype(np.uint32),
                count[one[start]].astype(np.uint32 if (count < 2**32).all() else np.int64),
                number[second[at]].astype(np.uint32 if (number < 2**32).all() else np.int64),
                seen[at])

    return make


def _score_pairs(mu: float):
    """Reply of a pair shard: codes of each message's pairs, found in the trie of all."""

    def reply(_shard: int, messages: list[bytes]) -> list[bytes]:
        parts = [unpack(m) for m in messages]
        context = [np.repeat(np.cumsum(p[0].astype(np.int64)), p[1]) for p in parts]
        whole = np.concatenate([np.repeat(p[2].astype(np.int64), p[1]) for p in parts])
        word = np.concatenate([p[3].astype(np.int64) for p in parts])
        seen = np.concatenate([p[4].astype(np.int64) for p in parts])
        flat = np.concatenate(context)
        known = np.flatnonzero(seen)
        order = known[np.lexsort((word[known], flat[known]))]
        c, w = flat[order], word[order]
        new = np.ones(len(order), bool)
        new[1:] = (c[1:] != c[:-1]) | (w[1:] != w[:-1])
        first = np.flatnonzero(new)
        total = np.add.reduceat(seen[order], first) if len(first) else first
        codes = quantise(total / (whole[order][first] + mu))
        with tempfile.TemporaryDirectory() as folder:
            path = os.path.join(folder, "trie")
            Trie.build(c[first], w[first], codes).save(path)
            trie = Trie.open(path)
            return [pack(trie.find(f, p[3].astype(np.int64))) for f, p in zip(context, parts)]

    return reply


def score(docs: DataFrame, mu: float = MU) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document,
    learnt from the documents outside the held-out fold."""
    table = write_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"),
                          "ngrams-batches", BATCH_BYTES)
    n = shards(table)
    named = settle(answer(ask(table, _ask_words(n)), n, _count_words(n), noted=True),
                   "ngrams-words")
    sums = named.where("note IS NOT NULL").select(
        F.sum(F.col("note")[0]).alias("v"), F.sum(F.col("note")[1]).alias("n")).first()
    distinct, total = sums["v"] or 0, sums["n"] or 0
    pairs = settle(answer(ask(meet(table, words=named), _ask_pairs(n)), n, _score_pairs(mu)),
                   "ngrams-pairs")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows:
            for row in part.to_pylist():
                ids, held, off, count, word, _, first, second, place, key = _pairs(row, n)
                code = np.zeros(len(first), np.uint8)
                got = {a["shard"]: a["message"] for a in row["pairs"] or []}
                for shard, at in by_shard(key, n):
                    code[at] = unpack(got[shard])[0]
                single = (count + 1) / (total + distinct + 1)
                back = mu / (count[first] + mu)
                pair = np.log10(dequantise(code) + back * single[second])
                base = np.log10(single)
                known = np.append(0, np.cumsum(count[word] > 0))
                fold = lambda x: np.add.reduceat(x, off[:-1]) if len(ids) else x
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(ids, pa.int64()), "held_out": pa.array(held, pa.bool_()),
                    "n_tokens": pa.array(np.diff(off), pa.int64()),
                    "n_known": pa.array(known[off[1:]] - known[off[:-1]], pa.int64()),
                    "train_tokens": pa.array([total] * len(ids), pa.int64()),
                    "base_score": pa.array(fold(base[word]), pa.float64()),
                    "score": pa.array(fold(pair[place]), pa.float64())})

    return meet(table, words=named, pairs=pairs).mapInArrow(
        run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
        "base_score double, score double")
