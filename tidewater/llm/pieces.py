"""Tokenizer pieces of whole batches of texts.

A BPE tokenizer first cuts a text into pieces (a word, a number, a run of signs, ...) and then
merges inside each piece, so equal pieces have equal ids. Here the cutting is done on the code
points of a whole Arrow batch with array operations, each piece is looked up in a bounded hash
table of the Python worker, and only pieces that it does not hold are really encoded.

The table's key is a 64-bit hash, the length, and the first three code points, so pieces of up
to three characters are compared exactly. A full table is emptied; nothing is dropped from a
result by that, the pieces are just encoded again.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import numpy as np

from .textkit import mix, span_hashes

UNKNOWN, LETTER, NUMBER, SPACE, OTHER = 255, 0, 1, 2, 3
_U = np.uint64


class CharClasses:
    """Class of each code point as the tokenizers library's own pattern engine sees it; asked
    for lazily, for the characters that really occur."""

    def __init__(self) -> None:
        from tokenizers import Regex, normalizers, pre_tokenizers
        self._split = [(k, pre_tokenizers.Split(Regex(p), "removed"))
                       for k, p in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s"))]
        self._lower = normalizers.Lowercase()
        self.table = np.full(0x110000, UNKNOWN, np.uint8)
        self.lower = np.arange(0x110000, dtype=np.uint32)

    def of(self, points: np.ndarray) -> np.ndarray:
        kinds = self.table[points]
        if (kinds == UNKNOWN).any():
            chars = [chr(c) for c in np.unique(points[kinds == UNKNOWN])]
            text = "".join(chars)
            found = dict.fromkeys(chars, OTHER)
            for kind, split in self._split:
                kept: set[str] = set()
                for part, _ in split.pre_tokenize_str(text):
                    kept.update(part)
                found.update({c: kind for c in chars if c not in kept})
            for c, kind in found.items():
                self.table[ord(c)] = kind
                low = self._lower.normalize_str(c)
                self.lower[ord(c)] = ord(low) if len(low) == 1 else ord(c)
            kinds = self.table[points]
        return kinds


_CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


def cut(points: np.ndarray, kinds: np.ndarray, bounds: np.ndarray, clip: bool):
    """Start and end of every piece. ``bounds``: offsets of the texts in ``points``.

    ``clip=False``: ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``;
    ``clip=True``: ``'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+``, the rest dropped.
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, bool)  # a text begins here
    edge[bounds] = True
    change = edge[:n].copy()
    change[1:] |= kinds[1:] != kinds[:-1]
    run = np.flatnonzero(change)
    run_end = np.append(run[1:], n)
    kind, length = kinds[run], run_end - run
    if clip:
        starts = change & (kinds != SPACE)
        starts |= kinds == NUMBER
    else:
        starts = change.copy()
        solid = kind != SPACE
        before = np.maximum(run - 1, 0)
        glued = solid & ~edge[run] & (points[before] == 32)
        starts[run[glued]] = False
        starts[run[glued] - 1] = True
        # a run of blanks before a word leaves its last one apart
        blank = ~solid & ~edge[run_end]
        starts[run_end[blank] - 1] = True
    quote = (points[run] == 39) & (kind == OTHER) & (length == 1)
    if not clip:
        quote &= ~glued
    at = run[quote]
    at = at[~edge[at + 1]]
    if len(at):
        at = at[kinds[at + 1] == LETTER]
    # a contraction ends inside or at the end of the run of letters after the quote
    pad = np.append(points, [0, 0, 0])
    near = np.append(kinds, [OTHER] * 3)
    for tail in _CONTRACTIONS:
        hit = at[pad[at + 1] == ord(tail[0])]
        if len(tail) == 2:
            hit = hit[(pad[hit + 2] == ord(tail[1])) & ~edge[np.minimum(hit + 2, n)]]
        to = hit + 1 + len(tail)
        starts[hit + 1] = False
        going = to[(to < n)]
        going = going[~edge[going]]
        going = going[near[going] == LETTER]
        starts[going] = True
    start = np.flatnonzero(starts)
    if clip:
        # an end is the next start, or the first blank or text end before it
        stop = np.append(np.flatnonzero(starts | edge[:n] | (kinds == SPACE)), n)
        return start, stop[np.searchsorted(stop, start, "right")]
    return start, np.append(start[1:], n)


Encode = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]


def listed(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Lists of ids as flat ids and counts."""
    counts = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter((x for one in ids for x in one), np.uint32, int(counts.sum())), counts


class PieceTable:
    """Open-addressing table from pieces to ids, all lookups of a batch at once. ``encode``
    gives the ids of some pieces in a row, and how many each piece has."""

    def __init__(self, encode: Encode, slots: int = 1 << 20,
                 most: int = 600_000) -> None:
        self.encode, self.slots, self.most = encode, slots, most
        self.clear()

    def clear(self) -> None:
        self.key = np.zeros(self.slots, _U)
        self.head = np.zeros(self.slots, _U)
        self.entry = np.full(self.slots, -1, np.int32)
        self.n = 0
        self.first = np.zeros(1 << 16, np.int64)
        self.count = np.zeros(1 << 16, np.int32)
        self.pool = np.zeros(1 << 18, np.uint32)
        self.used = 0

    def _find(self, key: np.ndarray, head: np.ndarray) -> np.ndarray:
        mask = self.slots - 1
        slot = (key & _U(mask)).astype(np.int64)
        found = self.entry[slot]
        wrong = np.flatnonzero((found >= 0) & ((self.key[slot] != key) | (self.head[slot] != head)))
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & mask
            s = slot[wrong]
            found[wrong] = self.entry[s]
            wrong = wrong[(found[wrong] >= 0) & ((self.key[s] != key[wrong]) | (self.head[s] != head[wrong]))]
        return found

    def _add(self, keys: np.ndarray, heads: np.ndarray, flat: np.ndarray,
             counts: np.ndarray) -> None:
        new = len(counts)
        while self.n + new > len(self.first):
            self.first = np.append(self.first, np.zeros_like(self.first))
            self.count = np.append(self.count, np.zeros_like(self.count))
        while self.used + len(flat) > len(self.pool):
            self.pool = np.append(self.pool, np.zeros_like(self.pool))
        self.first[self.n:self.n + new] = self.used + np.cumsum(counts) - counts
        self.count[self.n:self.n + new] = counts
        self.pool[self.used:self.used + len(flat)] = flat
        mask, todo = self.slots - 1, np.arange(new)
        slot = (keys & _U(mask)).astype(np.int64)
        while len(todo):  # of several that want a free slot the first one gets it
            free = self.entry[slot[todo]] < 0
            want = todo[free]
            _, who = np.unique(slot[want], return_index=True)
            won = want[who]
            self.entry[slot[won]] = self.n + won
            self.key[slot[won]], self.head[slot[won]] = keys[won], heads[won]
            left = np.ones(new, bool)
            left[won] = False
            todo = todo[left[todo]]
            slot[todo] = (slot[todo] + 1) & mask
        self.n += new
        self.used += len(flat)

    def ids(self, points: np.ndarray, text: str, start: np.ndarray, end: np.ndarray):
        """Ids of all pieces in order, and how many each piece has."""
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        codes = mix((points.astype(_U) + _U(1)) * _U(0xD6E8FEB86659FD93))
        key = span_hashes(codes, start, end)
        pad = np.append(points, [0, 0]).astype(_U)
        size = end - start
        head = (pad[start] | (np.where(size > 1, pad[start + 1], 0).astype(_U) << _U(21))
                | (np.where(size > 2, pad[start + 2], 0).astype(_U) << _U(42)))
        got = self._find(key, head)
        if (got < 0).any():
            miss = np.flatnonzero(got < 0)
            _, who = np.unique(key[miss] ^ mix(head[miss]), return_index=True)
            who = miss[who]
            if self.n + len(who) > self.most:
                self.clear()
                if len(who) < self.most:
                    return self.ids(points, text, start, end)
                while len(who) * 2 > self.slots:  # one batch with very many pieces
                    self.slots *= 2
                    self.most *= 2
                self.clear()
            pairs = zip(start[who].tolist(), end[who].tolist())
            self._add(key[who], head[who], *self.encode([text[a:b] for a, b in pairs]))
            got = self._find(key, head)
        count = self.count[got].astype(np.int64)
        at = np.cumsum(count) - count
        index = np.repeat(self.first[got] - at, count) + np.arange(int(count.sum()))
        return self.pool[index], count


class Encoder:
    """Ids of whole texts, as the tokenizers library gives them for one of its JSON files."""

    def __init__(self, path: str, clip: bool, encode: Encode,
                 special: dict[str, int], slow: Callable[[str], list[int]]) -> None:
        self.classes = CharClasses()
        self.clip, self.special, self.slow = clip, special, slow
        self.table = PieceTable(encode)

    def _plain(self, text: str) -> bool:
        """Whether the array path gives the library's result for this text."""
        if any(s in text for s in self.special):
            return False
        return not self.clip or text.isascii() or (
            "İ" not in text and unicodedata.is_normalized("NFC", text))

    def ids(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and id offsets per text."""
        texts = [t or "" for t in texts]
        odd = {i: self.slow(t) for i, t in enumerate(texts) if not self._plain(t)}
        for i in odd:
            texts[i] = ""
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        bounds = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in texts], out=bounds[1:])
        kinds = self.classes.of(points)
        if self.clip:
            points = self.classes.lower[points]
            joined = points.tobytes().decode("utf-32-le", "surrogatepass")
            kinds = self.classes.of(points)
        start, end = cut(points, kinds, bounds, self.clip)
        ids, count = self.table.ids(points, joined, start, end)
        sums = np.zeros(len(count) + 1, np.int64)
        np.cumsum(count, out=sums[1:])
        offsets = sums[np.searchsorted(start, bounds)]
        if odd:
            parts = [odd.get(i, ids[offsets[i]:offsets[i + 1]]) for i in range(len(texts))]
            ids = np.concatenate([np.asarray(p, np.uint32) for p in parts])
            np.cumsum([len(p) for p in parts], out=offsets[1:])
        return ids, offsets


_ENCODERS: dict[str, Encoder] = {}


def byte_level(path: str) -> Encoder:
    """Encoder of a byte-level BPE file (one per Python worker): the tokenizers library encodes
    the pieces that the table lacks, and whole texts with special tokens."""
    if path not in _ENCODERS:
        from tokenizers import Tokenizer
        library = Tokenizer.from_file(path)
        library.no_truncation()
        library.no_padding()
        special = {t.content: i for i, t in library.get_added_tokens_decoder().items()}

        def encode(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
            got = library.encode(parts, is_pretokenized=True, add_special_tokens=False)
            return np.array(got.ids, np.uint32), np.bincount(
                np.array(got.word_ids, np.int64), minlength=len(parts))

        _ENCODERS[path] = Encoder(path, False, encode, special,
                                  lambda t: library.encode(t, add_special_tokens=False).ids)
    return _ENCODERS[path]
