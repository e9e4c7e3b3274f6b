"""Cuts word windows that an earlier document already has, by suffix automata.

A window of ``WINDOW`` words is removed if its word sequence also starts in a document with a
smaller id. Equal windows have the same minimizer (the smallest hash among their runs of
``ANCHOR`` words), so everything that can match a window meets at its minimizer's shard:

1. Every batch of documents asks the shards for its minimizers; those that occur in one
   document only answer nothing, and their windows cannot repeat.
2. For each remaining minimizer occurrence the batch sends its windows (a run of at most
   ``WINDOW - ANCHOR + 1``, as one word sequence) with the document id. In the shard equal
   sequences are one reference. Where a minimizer has several sequences, they are streamed in
   the order of their smallest id through a suffix automaton of the earlier ones: matching
   statistics of at least ``WINDOW`` words mark the windows that an earlier document has.
3. A minimizer with more than ``HOT_RUNS`` occurrences (a phrase of many documents between
   different words) is not compared in one place: its windows go out one by one, each to the
   shard of the hash of all its words, as one entry per batch and distinct window with the
   batch's smallest id. Equal windows meet there as well, and no shard holds the phrase.
4. Marks go back to the batches; overlapping windows form maximal spans, which are cut.

The automata are those of the shard's own references and live in the shard's task: they are not
broadcast, because the references of a corpus grow with it.

Defined results: null, empty and blank texts have no words; a document does not cut itself, nor
do repeated rows of one id; rows without id neither cut nor are cut; an empty table gives no
rows; further columns are ignored (kept by ``cut_repeats``). A text longer than a batch is a
batch of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame

from .batchtable import answer, ask, by_shard, load, meet, pack, shards, unpack, write_batches
from .graph import settle
from .textkit import Words, gram_hashes, inside, mix, words

WINDOW = 13
ANCHOR = 6
HOT_RUNS = 1000
_U = np.uint64
_MULT = _U(0x9E3779B97F4A7C15)


class SuffixAutomaton:
    """Automaton of all factors of some word sequences."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.size = [0]

    def _clone(self, at: int, sym, to: int) -> int:
        """Splits off the part of state ``to`` that is reached from ``at`` and its suffixes."""
        nxt, link = self.next, self.link
        new = len(nxt)
        nxt.append(dict(nxt[to]))
        link.append(link[to])
        self.size.append(self.size[at] + 1)
        link[to] = new
        while at != -1 and nxt[at].get(sym) == to:
            nxt[at][sym] = new
            at = link[at]
        return new

    def add(self, sequence) -> None:
        """Adds a sequence and all its factors."""
        nxt, link, size = self.next, self.link, self.size
        last = 0
        for sym in sequence:
            to = nxt[last].get(sym)
            if to is not None:
                last = to if size[to] == size[last] + 1 else self._clone(last, sym, to)
                continue
            new = len(nxt)
            nxt.append({})
            link.append(0)
            size.append(size[last] + 1)
            at = last
            while at != -1 and sym not in nxt[at]:
                nxt[at][sym] = new
                at = link[at]
            if at != -1:
                to = nxt[at][sym]
                link[new] = to if size[to] == size[at] + 1 else self._clone(at, sym, to)
            last = new

    def statistics(self, sequence) -> Iterator[int]:
        """Length of the longest factor that ends at each place of a sequence."""
        nxt, link, size = self.next, self.link, self.size
        state = length = 0
        for sym in sequence:
            while state and sym not in nxt[state]:
                state = link[state]
                length = size[state]
            to = nxt[state].get(sym)
            if to is None:
                length = 0
            else:
                state, length = to, length + 1
            yield length


def _runs(w: Words, hashes: np.ndarray, known: np.ndarray, window: int, anchor: int):
    """Minimizer runs of a batch: hash of the minimizer, document, first window and number of
    windows of each run. Only documents with an id (``known``) have any."""
    starts = inside(w.offsets, window)
    doc = w.doc_of()
    starts = starts[known[doc[starts]]]
    if not len(starts):
        none = np.zeros(0, np.int64)
        return np.zeros(0, _U), none, none, none
    grams = gram_hashes(hashes, anchor)
    view = sliding_window_view(grams, window - anchor + 1)[starts]
    place = starts + view.argmin(axis=1)
    new = np.ones(len(starts), bool)
    new[1:] = (place[1:] != place[:-1]) | (doc[starts[1:]] != doc[starts[:-1]])
    first = np.flatnonzero(new)
    return (grams[place[first]], doc[starts[first]], starts[first],
            np.diff(np.append(first, len(starts))))


def _batch(row: dict, window: int, anchor: int):
    docs = load(row["docs"])
    w = words(docs.column("text"))
    ids = docs.column("doc_id").cast(pa.int64())
    known = np.asarray(ids.is_valid())
    h = w.hashes()
    return docs, w, h, ids.fill_null(0).to_numpy(), _runs(w, h, known, window, anchor)


def _ask_minimizers(n: int, window: int, anchor: int):
    def make(row: dict) -> Iterator[tuple[int, bytes]]:
        _, _, _, _, (key, doc, _, _) = _batch(row, window, anchor)
        order = np.lexsort((doc, key))
        key, doc = key[order], doc[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(key)) - 1
        if len(key):
            key, many, runs = key[first], doc[first] != doc[last], last - first + 1
            # number of occurrences, and whether they are in several documents
            seen = (np.minimum(runs, 0x7FFF) << 1 | many).astype(np.uint16)
            for shard, at in by_shard(key, n):
                yield shard, pack(key[at], seen[at])

    return make


def _shared(limit: int):
    """Reply: which minimizers of each message occur in more than one document, and which of
    those have more than ``limit`` occurrences (left out where there are none)."""

    def reply(_shard: int, messages: list[bytes]) -> list[bytes | None]:
        parts = [unpack(m) for m in messages]
        keys, place, count = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True,
                                       return_counts=True)
        seen = np.concatenate([p[1] for p in parts])
        hit = count > 1
        hit[place[seen & 1 > 0]] = True
        hot = hit & (np.bincount(place, seen >> 1, len(keys)) > limit)
        out = []
        for at in np.split(place, np.cumsum([len(p[0]) for p in parts])[:-1]):
            flags = [np.packbits(f[at]) for f in (hit, hot) if f[at].any()]
            out.append(pack(*flags) if flags else None)
        return out

    return reply


def _open_runs(row: dict, key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs whose minimizer is shared and not hot, and those whose minimizer is hot, from the
    shards' answers."""
    uniq = np.unique(key)
    flags = np.zeros((2, len(uniq)), bool)
    got = {a["shard"]: a["message"] for a in row["shared"] or []}
    for shard, at in by_shard(uniq, n):
        if shard in got:
            for flag, bits in zip(flags, unpack(got[shard])):
                flag[at] = np.unpackbits(bits, count=len(at)).astype(bool)
    hit, hot = flags[:, np.searchsorted(uniq, key)]
    return np.flatnonzero(hit & ~hot), np.flatnonzero(hot)


def _single_windows(h: np.ndarray, ids: np.ndarray, runs, own: np.ndarray, window: int):
    """Windows of the runs ``own`` one by one: minimizer, hash and smallest id of each distinct
    window of the batch, and of every window which of those it is, its id and its place."""
    key, doc, start, count = (x[own] for x in runs)
    at = np.repeat(start - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
    key, ids = np.repeat(key, count), np.repeat(ids[doc], count)
    text = h[at]
    for j in range(1, window):
        text = mix(text * _MULT + h[at + j])
    order = np.lexsort((ids, key, text))
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(text[order]) != 0) | (np.diff(key[order]) != 0)
    first, place = order[new], np.empty(len(at), np.int64)
    place[order] = np.cumsum(new) - 1
    return key[first], text[first], ids[first], place, ids, at


def _ask_windows(n: int, window: int, anchor: int):
    def make(row: dict) -> Iterator[tuple[int, bytes]]:
        _, _, h, ids, runs = _batch(row, window, anchor)
        own, hot = _open_runs(row, runs[0], n)
        messages: dict[int, list[np.ndarray]] = dict(sequences(h, ids, runs, own))
        if len(hot):
            key, text, least, *_ = _single_windows(h, ids, runs, hot, window)
            for shard, at in by_shard(text, n):
                messages.setdefault(shard, []).extend([key[at], text[at], least[at]])
        for shard, arrays in messages.items():
            yield shard, pack(*arrays)

    def sequences(h, ids, runs, own) -> Iterator[tuple[int, list[np.ndarray]]]:
        if not len(own):
            return
        key, doc, start, count = (x[own] for x in runs)
        size = count + window - 1
        # equal sequences of the batch are sent once
        prefix = np.zeros(len(own), _U)
        for j in range(int(size.max())):
            live = j < size
            prefix[live] = mix(prefix[live] * _MULT + h[start[live] + j])
        for shard, at in by_shard(key, n):
            _, first, piece = np.unique(np.stack([key[at], prefix[at]], 1), axis=0,
                                        return_index=True, return_inverse=True)
            some = at[first]
            index = np.repeat(start[some] - np.append(0, np.cumsum(size[some])[:-1]), size[some]) \
                + np.arange(int(size[some].sum()))
            vocab, word = np.unique(h[index], return_inverse=True)
            yield shard, [key[some], prefix[some], size[some].astype(np.uint8), vocab,
                          word.ravel().astype(np.uint32), piece.ravel().astype(np.uint32),
                          ids[doc[at]]]

    return make


_NO_RUNS = [np.zeros(0, t) for t in (_U, _U, np.uint8, _U, np.uint32, np.uint32, np.int64)]
_NO_WINDOWS = [np.zeros(0, t) for t in (_U, _U, np.int64)]


def _marks(window: int):
    """Reply of a shard: two bytes per run, bit j set if its window j has an earlier document,
    and one bit per single window, set if another batch has it with a smaller id."""

    def reply(_shard: int, messages: list[bytes]) -> list[bytes | None]:
        arrays = [unpack(m) for m in messages]
        runs = sequences([a[:7] if len(a) > 3 else _NO_RUNS for a in arrays])
        single = windows([a[-3:] if len(a) != 7 else _NO_WINDOWS for a in arrays])
        return [pack(r, np.packbits(s)) if r.any() or s.any() else None
                for r, s in zip(runs, single)]

    def windows(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
        key, text, least = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((least, key, text))
        new = np.ones(len(key), bool)
        new[1:] = (np.diff(text[order]) != 0) | (np.diff(key[order]) != 0)
        earlier = np.empty(len(key), bool)
        earlier[order] = least[order] > least[order][new][np.cumsum(new) - 1]
        return np.split(earlier, np.cumsum([len(p[0]) for p in parts])[:-1])

    def sequences(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
        key = np.concatenate([p[0] for p in parts])
        text = np.concatenate([p[1] for p in parts])
        size = np.concatenate([p[2] for p in parts]).astype(np.int64)
        flow = np.concatenate([p[3][p[4]] for p in parts])
        begin = np.cumsum(size) - size
        base = np.cumsum([0] + [len(p[0]) for p in parts])
        piece = np.concatenate([p[5].astype(np.int64) + b for p, b in zip(parts, base)])
        ids = np.concatenate([p[6] for p in parts])
        # sequences of all batches: one number per distinct (minimizer, sequence)
        pairs = np.empty(len(key), [("k", _U), ("t", _U)])
        pairs["k"], pairs["t"] = key, text
        uniq, first, number = np.unique(pairs, return_index=True, return_inverse=True)
        number = number.ravel()
        least = np.full(len(uniq), np.iinfo(np.int64).max)
        np.minimum.at(least, number[piece], ids)
        marks = np.zeros(len(uniq), np.uint16)  # for the document with the smallest id
        order = np.lexsort((least, uniq["k"]))
        group = uniq["k"][order]
        cuts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        ends = np.append(cuts[1:], len(group))
        for a, b in zip(cuts[ends - cuts > 1].tolist(), ends[ends - cuts > 1].tolist()):
            tree, waiting, last = SuffixAutomaton(), [], None
            for u in order[a:b].tolist():
                at = first[u]
                seq = flow[begin[at]:begin[at] + size[at]].tolist()
                if least[u] != last:  # only documents with smaller ids are references
                    for s in waiting:
                        tree.add(s)
                    waiting, last = [], least[u]
                found = 0
                for j, length in enumerate(tree.statistics(seq)):
                    if length >= window:
                        found |= 1 << (j - window + 1)
                marks[u] = found
                waiting.append(seq)
        run = number[piece]
        out = np.where(ids > least[run], np.uint16(0xFFFF), marks[run])
        return np.split(out, np.cumsum([len(p[6]) for p in parts])[:-1])

    return reply


def _removed(row: dict, n: int, window: int, anchor: int):
    """Batch, its words and the flags of the words to remove."""
    docs, w, h, ids, (key, _, start, count) = batch = _batch(row, window, anchor)
    total = int(w.offsets[-1])
    edges = np.zeros(total + 1, np.int64)
    got = {a["shard"]: unpack(a["message"]) for a in row["marks"] or []}
    own, hot = _open_runs(row, key, n)
    if len(hot):
        _, text, least, place, ids, at = _single_windows(h, ids, batch[-1], hot, window)
        earlier = np.zeros(len(text), bool)
        for shard, some in by_shard(text, n):
            if shard in got:
                earlier[some] = np.unpackbits(got[shard][1], count=len(some)).astype(bool)
        at = at[earlier[place] | (ids > least[place])]
        np.add.at(edges, at, 1)
        np.add.at(edges, at + window, -1)
    for shard, at in by_shard(key[own], n):
        if shard not in got:
            continue
        mark = got[shard][0]
        runs = own[at]
        for j in range(window - anchor + 1):
            hit = runs[(j < count[runs]) & ((mark >> np.uint16(j)) & 1 > 0)]
            np.add.at(edges, start[hit] + j, 1)
            np.add.at(edges, start[hit] + j + window, -1)
    return docs, w, np.cumsum(edges[:-1]) > 0


def _marked(docs: DataFrame, window: int, anchor: int) -> tuple[DataFrame, int]:
    """Batch table with the answers of both rounds."""
    table = write_batches(docs, "substrings-batches")
    n = shards(table)
    shared = settle(answer(ask(table, _ask_minimizers(n, window, anchor)), n, _shared(HOT_RUNS)),
                    "substrings-shared")
    marks = settle(answer(ask(meet(table, shared=shared), _ask_windows(n, window, anchor)), n,
                          _marks(window)), "substrings-marks")
    return meet(table, shared=shared, marks=marks), n


def repeated_words(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (kept words joined by one space)."""
    table, n = _marked(docs.select("doc_id", "text"), window, anchor)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows:
            for row in part.to_pylist():
                batch, w, gone = _removed(row, n, window, anchor)
                sums = np.append(0, np.cumsum(gone))
                removed = sums[w.offsets[1:]] - sums[w.offsets[:-1]]
                digests = []
                for k, text in enumerate(batch.column("text").to_pylist()):
                    own = (text or "").encode().split()
                    if removed[k]:
                        own = compress(own, (~gone[w.offsets[k]:w.offsets[k + 1]]).tolist())
                    digests.append(hashlib.sha256(b" ".join(own)).hexdigest())
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id").cast(pa.int64()),
                    "n_words": pa.array(np.diff(w.offsets), pa.int64()),
                    "n_removed": pa.array(removed, pa.int64()),
                    "kept_sha256": pa.array(digests, pa.string())})

    return table.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def cut_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """Documents without the repeated spans, all columns kept. A span goes with the blanks after
    it; other texts stay as they are. ``n_chars``, where the table has it, follows the text."""
    names = docs.columns
    table, n = _marked(docs, window, anchor)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows:
            for row in part.to_pylist():
                batch, w, gone = _removed(row, n, window, anchor)
                texts = batch.column("text").to_pylist()
                size = np.cumsum([0] + [len((t or "").encode()) for t in texts])
                sums = np.append(0, np.cumsum(gone))
                changed = np.flatnonzero(sums[w.offsets[1:]] > sums[w.offsets[:-1]])
                for k in changed.tolist():
                    a, b = w.offsets[k], w.offsets[k + 1]
                    raw = texts[k].encode()
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone[a:b], [0]])))
                    kept, at = [], 0
                    for x, y in zip(edge[::2], edge[1::2]):
                        kept.append(raw[at:w.start[a + x] - size[k]])
                        at = w.start[a + y] - size[k] if a + y < b else len(raw)
                    texts[k] = b"".join([*kept, raw[at:]]).decode()
                cols = []
                for name in names:
                    col = batch.column(name)
                    if name == "text":
                        col = pa.array(texts, pa.string())
                    elif name == "n_chars":
                        new = col.to_pylist()
                        for k in changed.tolist():
                            new[k] = len(texts[k])
                        col = pa.array(new, col.type)
                    cols.append(col)
                yield pa.RecordBatch.from_arrays(cols, names)

    return table.mapInArrow(run, docs.schema)
