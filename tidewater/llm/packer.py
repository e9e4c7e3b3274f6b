"""Packs token sequences by vector bin packing.

A piece has three sizes: tokens, segments (one) and loss-bearing tokens; a sequence has a limit
on each. Documents are first cut into whole sequences; of what remains, the piece with the
largest dot product between its sizes and the room left goes next into the open sequence. When
nothing fits whole, the largest piece is cut to fill the room exactly. Each task packs the
documents of its input partition, so nothing is shuffled; at its end the last open sequence is
cut at powers of two, which need no padding.

Defined results: a null or empty text is one end id; repeated rows are packed one by one; a
null id stays null; an empty table gives no rows; further columns are ignored.
Very long texts are encoded whole and cut into as many sequences as they fill.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .pieces import byte_level
from .textkit import batches, prepare

SEQUENCE = 2048
MAX_SEGMENTS = 64
MAX_LOSS = 2048
END_ID = 1
SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long, loss_tokens long")


class Packer:
    """Open sequence and pool of left-over pieces of one task. A piece is (item, start,
    length, loss); pieces come out as (item, start, length, loss, sequence, offset)."""

    def __init__(self, tokens: int, segments: int, loss: int, first_sequence: int = 0) -> None:
        if min(tokens, segments, loss) < 1:
            raise ValueError("limits must be positive")
        self.limit = np.array([tokens, segments, loss], float)
        self.tokens = tokens
        self.pool: list[list[tuple]] = [[] for _ in range(tokens + 1)]  # by length
        self.filled = np.zeros(tokens + 1, bool)
        self.least = np.zeros(tokens + 1)  # smallest loss among the pieces of a length
        self.total = self.added = 0
        self.sequence = first_sequence
        self.lengths = np.arange(tokens + 1, dtype=float)

    def add(self, piece: tuple) -> None:
        size, loss = piece[2], piece[3]
        self.added += 1
        heapq.heappush(self.pool[size], (loss, self.added, piece))
        self._note(size)
        self.total += size

    def _note(self, size: int) -> None:
        heap = self.pool[size]
        self.filled[size] = bool(heap)
        self.least[size] = heap[0][0] if heap else 0

    def _take(self, size: int) -> tuple:
        """The piece of a length that bears the least loss."""
        piece = heapq.heappop(self.pool[size])[2]
        self._note(size)
        self.total -= size
        return piece

    def sequences(self, finish: bool = False) -> Iterator[tuple]:
        """Fills sequences while the pool holds enough tokens (to the last one if ``finish``)."""
        while self.total >= self.tokens or (finish and self.total):
            room, got, offset = self.limit.copy(), [], 0
            while room[0] > 0 and room[1] > 0 and self.total:
                fits = self.filled & (self.lengths <= room[0]) & (self.least <= room[2])
                if fits.any():
                    share = room / self.limit
                    score = (share[0] * self.lengths / self.limit[0] + share[1] / self.limit[1]
                             + share[2] * self.least / self.limit[2])
                    piece = self._take(int(np.argmax(np.where(fits, score, -1.0))))
                else:
                    size = int(np.flatnonzero(self.filled)[-1])
                    whole = self._take(size)
                    keep = int(min(room[0], size))
                    # loss lies at the end of a piece's tokens
                    early = int(max(0, whole[3] - (size - keep)))
                    if early > room[2]:
                        keep = int(size - whole[3] + room[2])
                        early = int(room[2])
                    if keep <= 0:
                        self.add(whole)
                        break
                    piece = (whole[0], whole[1], keep, early)
                    if keep < size:
                        self.add((whole[0], whole[1] + keep, size - keep, whole[3] - early))
                got.append((*piece, offset))
                offset += piece[2]
                room -= (piece[2], 1, piece[3])
            yield from self._close(got, offset)

    def _close(self, got: list[tuple], size: int) -> Iterator[tuple]:
        """Writes a sequence; an underfull one is cut at its largest power of two."""
        if size == self.tokens or size & (size - 1) == 0:
            for item, start, length, loss, offset in got:
                yield item, start, length, loss, self.sequence, offset
            self.sequence += 1
            return
        cut, rest, moved = 1 << (size.bit_length() - 1), [], 0
        kept = []
        for item, start, length, loss, offset in got:
            head = min(max(cut - offset, 0), length)
            early = max(0, loss - (length - head))
            if head:
                kept.append((item, start, head, early, offset))
            if head < length:
                rest.append((item, start + head, length - head, loss - early, moved))
                moved += length - head
        yield from self._close(kept, cut)
        yield from self._close(rest, moved)


def pack_documents(docs: DataFrame, path: str | None = None, end_id: int = END_ID, tokens: int = SEQUENCE,
                   segments: int = MAX_SEGMENTS, loss: int = MAX_LOSS) -> DataFrame:
    """Pieces of all documents with their place. Every id of a document but its first one
    bears loss. Sequence ids are the partition number times 2 ** 32 plus a running number."""
    if path is None:
        import public_tokenizers as P
        path = P.path("byte_bpe_50k.json")
    prepare(docs.sparkSession)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_level(path)
        packer = Packer(tokens, segments, loss, TaskContext.get().partitionId() << 32)
        whole = min(tokens, loss)  # pieces cut off long documents fill a sequence alone

        def out(pieces: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*pieces)) if pieces else [[]] * 6
            info = cols[0]
            crc = [zlib.crc32(ids[s - lo:s - lo + n]) for (_, _, ids, lo), s, n in
                   zip(info, cols[1], cols[2])]
            arrays = [[x[0] for x in info], cols[1], cols[2], crc, [x[1] for x in info],
                      cols[4], cols[5], cols[3]]
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()) for a in arrays], names)

        for batch in batches(rows, 300_000):
            ids, off = encoder.ids(batch.column(1).to_pylist())
            ready: list[tuple] = []
            for k, doc_id in enumerate(batch.column(0).to_pylist()):
                own = np.append(ids[off[k]:off[k + 1]], np.uint32(end_id)).astype("<u4")
                n, at = len(own), 0
                while n - at >= whole:
                    info = (doc_id, n, own[at:at + whole], at)
                    ready.append((info, at, whole, whole - (at == 0), packer.sequence, 0))
                    if whole < tokens and whole & (whole - 1):  # not a power of two: to the pool
                        ready.pop()
                        packer.add((info, at, whole, whole - (at == 0)))
                    else:
                        packer.sequence += 1
                    at += whole
                if at < n:
                    packer.add(((doc_id, n, own[at:].copy(), at), at, n - at,
                                n - at - (at == 0)))
            ready += packer.sequences()
            yield out(ready)
        yield out(list(packer.sequences(finish=True)))

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
