"""BPE encoding by backtracking, decoding by an offset table.

Encoder: an Aho-Corasick automaton over all reachable tokens finds every token that begins at
every position of a piece in one pass. The encoder takes the longest one, keeps it only if the
token before it and it are compatible (plain BPE would leave that border alone), else tries the
next shorter one, and steps back when none is left. A position found dead is never tried again,
so a piece takes linear time, and the result is exactly that of running the merges.

Decoder: all token strings lie in one byte array with an offset table; decoding gathers slices.

Defined results: a null or empty text has no ids and decodes to an empty text; repeated rows
are encoded one by one; an empty table gives no rows; further columns are ignored. A very long
text is encoded whole by the task that has its row.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .pieces import Encoder, listed
from .textkit import batches, prepare


def byte_symbols() -> dict[str, int]:
    """The visible character that stands for each byte in byte-level vocabularies."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Merges of a BPE file as tables over symbol strings: a byte is chr(byte), the last byte
    of a word chr(256 + byte) where the file marks word ends."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, self.suffix = spec["model"], spec["model"].get("end_of_word_suffix") or ""
        vocab, table = model["vocab"], byte_symbols()
        self.tokens = {i: t for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens |= {i: t for t, i in self.special.items()}
        self.rank, self.split, self.pair = {}, {}, {}
        for r, m in enumerate(model["merges"]):
            a, b = (vocab[x] for x in (m if isinstance(m, list) else m.split(" ")))
            made = vocab[m[0] + m[1]] if isinstance(m, list) else vocab[m.replace(" ", "", 1)]
            self.pair[a, b] = (r, made)
            if made not in self.split:
                self.split[made], self.rank[made] = (a, b), r
        self.symbols = {}
        for text, i in vocab.items():
            ended = bool(self.suffix) and text.endswith(self.suffix) and text != self.suffix
            body = [table[c] for c in (text[: -len(self.suffix)] if ended else text)]
            if ended:
                body[-1] += 256
            self.symbols["".join(map(chr, body))] = i
        self.base = {s: i for s, i in self.symbols.items() if len(s) == 1}

    def merge(self, symbols: str) -> list[int]:
        """Plain BPE: applies the best-ranked merge until none is left."""
        ids = [self.base[s] for s in symbols]
        while len(ids) > 1:
            best = min((self.pair.get(p, (1 << 60, 0)) for p in zip(ids, ids[1:])))
            if best[0] == 1 << 60:
                break
            out, k = [], 0
            while k < len(ids):
                if k + 1 < len(ids) and self.pair.get((ids[k], ids[k + 1])) == best:
                    out.append(best[1])
                    k += 2
                else:
                    out.append(ids[k])
                    k += 1
            ids = out
        return ids

    def word(self, piece: str) -> str:
        """Symbols of a piece of text."""
        raw = piece.encode("utf-8", "surrogatepass")
        if self.suffix and raw:
            return raw[:-1].decode("latin-1") + chr(256 + raw[-1])
        return raw.decode("latin-1")


class Backtracker:
    """Exact BPE of pieces by longest matches with backtracking."""

    def __init__(self, vocab: Vocabulary, most_pairs: int = 1_000_000) -> None:
        self.vocab, self.most_pairs = vocab, most_pairs
        self.matcher = ahocorasick.Automaton()
        self.reachable = {s: i for s, i in vocab.symbols.items() if vocab.merge(s) == [i]}
        for s, i in self.reachable.items():
            self.matcher.add_word(s, (i, len(s)))
        self.matcher.make_automaton()
        self.known: dict[tuple[int, int], bool] = {}

    def compatible(self, left: int, right: int) -> bool:
        """Whether plain BPE leaves the border between two tokens alone: walking back the
        merges that made the two sides, latest first, no pair that touches across the border
        may have a merge earlier than the step that was just undone."""
        key = (left, right)
        if key in self.known:
            return self.known[key]
        pair, split, rank = self.vocab.pair, self.vocab.split, self.vocab.rank
        a, b, limit = left, right, 1 << 60
        fine = True
        while True:
            step = pair.get((a, b))
            if step is not None and step[0] < limit:
                fine = False
                break
            ra, rb = rank.get(a, -1), rank.get(b, -1)
            if ra < 0 and rb < 0:
                break
            # Of equal ranks the left one was merged first, so the right one is undone first.
            if ra > rb:
                a, limit = split[a][1], ra
            else:
                b, limit = split[b][0], rb + 1
        if len(self.known) >= self.most_pairs:
            self.known.clear()
        self.known[key] = fine
        return fine

    def encode(self, piece: str) -> list[int]:
        symbols = self.vocab.word(piece)
        whole = self.reachable.get(symbols)
        if whole is not None:
            return [whole]
        n = len(symbols)
        found: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, token in self.matcher.iter(symbols):
            found[end + 1 - token[1]].append(token)  # shorter ones come first
        alive = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        left: list[int] = []  # of each chosen token: matches of its position not tried yet
        at, todo, compatible = 0, len(found[0]), self.compatible
        while at < n:
            options, last = found[at], out[-1] if out else -1
            while todo:
                todo -= 1
                token, size = options[todo]
                if alive[at + size] and (last < 0 or compatible(last, token)):
                    out.append(token)
                    left.append(todo)
                    at += size
                    todo = len(found[at]) if at < n else 0
                    break
            else:
                if not out:
                    raise ValueError(f"no encoding of {piece!r}")
                alive[at] = 0
                todo = left.pop()
                token = out.pop()
                at -= self.size(token)
        return out

    def size(self, token: int) -> int:
        if not hasattr(self, "_sizes"):
            self._sizes = {i: len(s) for s, i in self.vocab.symbols.items()}
        return self._sizes[token]


class Decoder:
    """Text of ids: token bytes in one array, found by an offset table. Files without a
    decoder separate tokens by one blank; byte-level ones join the bytes."""

    def __init__(self, path: str, vocab: Vocabulary) -> None:
        with open(path, encoding="utf-8") as f:
            kind = (json.load(f).get("decoder") or {}).get("type")
        table = byte_symbols()
        self.gap = b"" if kind == "ByteLevel" else b" "
        special = set(vocab.special.values())
        parts = []
        for i in range(max(vocab.tokens) + 1):
            t = vocab.tokens.get(i, "")
            raw = bytes(table[c] for c in t) if kind == "ByteLevel" and i not in special \
                else t.encode("utf-8")
            parts.append(raw + self.gap)
        self.blob = np.frombuffer(b"".join(parts), np.uint8)
        self.offsets = np.zeros(len(parts) + 1, np.int64)
        np.cumsum([len(p) for p in parts], out=self.offsets[1:])

    def raw(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids in a row, and the byte offset of each id."""
        size = self.offsets[ids.astype(np.int64) + 1] - self.offsets[ids]
        ends = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(size, out=ends[1:])
        index = np.repeat(self.offsets[ids] - ends[:-1], size) + np.arange(int(ends[-1]))
        return self.blob[index], ends

    def texts(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """UTF-8 of each document of a batch (ids ``offsets[i]`` to ``offsets[i + 1]``)."""
        raw, ends = self.raw(ids)
        cut = len(self.gap)
        out = []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            one = raw[ends[a]:ends[b] - cut].tobytes() if b > a else b""
            out.append(one if cut else one.decode("utf-8", "replace").encode("utf-8"))
        return out


_MADE: dict[str, tuple[Encoder, Decoder]] = {}


def codec(path: str) -> tuple[Encoder, Decoder]:
    """Encoder and decoder of a tokenizer file, once per Python worker."""
    if path not in _MADE:
        from tokenizers import Tokenizer
        library = Tokenizer.from_file(path)
        library.no_truncation()
        library.no_padding()
        vocab = Vocabulary(path)
        walker = Backtracker(vocab)
        clip = library.decoder is None  # word-level file: lower case, white space dropped
        _MADE[path] = (
            Encoder(path, clip, lambda ps: listed([walker.encode(p) for p in ps]), vocab.special,
                    lambda t: library.encode(t, add_special_tokens=False).ids),
            Decoder(path, vocab))
    return _MADE[path]


def encode_documents(docs: DataFrame, path: str, with_text: bool = False) -> DataFrame:
    """Ids of every text and the text that they decode to. Returns doc_id, ids (uint32 little
    endian, binary), n_tokens, decoded (UTF-8, binary), or digests of both columns."""
    prepare(docs.sparkSession)
    schema = "doc_id long, n_tokens long, " + (
        "ids binary, decoded binary" if with_text else "ids_sha256 string, decoded_sha256 string")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = codec(path)
        for batch in batches(rows, 300_000):
            ids, off = encoder.ids(batch.column(1).to_pylist())
            texts = decoder.texts(ids, off)
            raw = [ids[a:b].astype("<u4").tobytes() for a, b in zip(off[:-1], off[1:])]
            if not with_text:
                raw = [hashlib.sha256(x).hexdigest() for x in raw]
                texts = [hashlib.sha256(x).hexdigest() for x in texts]
            names = ["ids", "decoded"] if with_text else ["ids_sha256", "decoded_sha256"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(np.diff(off), pa.int64()),
                 pa.array(raw), pa.array(texts)], ["doc_id", "n_tokens", *names])

    return docs.select("doc_id", "text").mapInArrow(run, schema)
