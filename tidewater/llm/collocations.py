"""Phrase collocations from an FM-index per shard over word ids.

Texts are split into pieces at sentence marks and line breaks, pieces into words. A task cuts
its documents into shards of one language each and writes their word ids and vocabularies.
Word counts are summed over all shards; a phrase is no more frequent than its words, so words
below the least count become piece ends, and the others get numbers that hold in all shards.

Each shard then gets a bidirectional FM-index: suffixes of its words and of the reversed ones in
order of their first ``depth`` words, the word before each (the transform), and sorted occurrences
of each word in it. An interval of the index and its mirror are one phrase. All intervals of a
length are extended by one word at once, in turn to the right (through the mirror) and to the
left (through the index): the symbols inside an interval give the new counts, the number of
smaller symbols moves one interval, a rank query the other. Counts are summed across shards, so
nothing is pruned by what one shard knows.

Scores compare a phrase with the two parts of each cut; arithmetic is decimal and exact. A
phrase is dropped inside a longer candidate that holds at least half of its occurrences: the
counts of its one-word left and right extensions decide it, as no longer phrase is more frequent.

Defined results: a null or empty text has no words; a null language is ``und``; repeated rows
count each time; long texts are read whole (a text beyond ``SHARD_BYTES`` makes a shard of its
own); ties are broken as the ranking says; an empty table or one without frequent phrases gives
no rows; columns beyond the text and language are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .batchtable import pack, unpack
from .graph import settle
from .textkit import batches, prepare, text_bytes

DEPTH, MIN_COUNT, TOP = 3, 10, 2000
SHARD_BYTES, HELD = 4_000_000, 3  # a task holds texts of at most so many shards
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STOP = np.zeros(256, bool)  # ends a piece
_STOP[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_GAP = _STOP.copy()  # ends a word
_GAP[[0x20, 0x09]] = True


def tokens(column: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Word ids (from 1; 0 between pieces) of a shard's texts, its words, and their counts."""
    data, off = text_bytes(column)
    solid = ~_GAP[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    some = off[:-1] < off[1:]  # texts meet without a space
    first[off[:-1][some]] = solid[off[:-1][some]]
    last[off[1:][some] - 1] = solid[off[1:][some] - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    piece = (np.searchsorted(np.flatnonzero(_STOP[data]), starts)
             + np.searchsorted(off, starts, "right"))
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    joined = _LOWER[data[solid]]
    del first, last, solid, ends
    kinds = pa.LargeStringArray.from_buffers(
        len(starts), pa.py_buffer(offsets), pa.py_buffer(joined)).dictionary_encode()
    code = kinds.indices.to_numpy().astype(np.int32) + 1
    ids = np.insert(code, np.flatnonzero(np.diff(piece)) + 1, 0)
    count = np.bincount(code, minlength=len(kinds.dictionary) + 1)[1:]
    return ids, kinds.dictionary.to_pylist(), count


class FMIndex:
    """Suffixes of ``text`` (0 parts pieces and stands at both ends) in order of their first
    ``depth`` symbols, with rank queries on the symbols before them."""

    def __init__(self, text: np.ndarray, depth: int) -> None:
        n = self.n = len(text)
        order, rank = np.argsort(text, kind="stable"), text.astype(np.int64)
        for j in range(1, depth):
            key = rank * n + np.roll(text, -j)
            order = np.argsort(key, kind="stable")
            new = np.ones(n, np.int64)
            new[1:] = np.diff(key[order]) != 0
            rank[order] = np.cumsum(new) - 1
            del key, new
        self.before = text[order - 1]
        del order, rank
        self.start = np.zeros(int(text.max()) + 2, np.int64)  # of the suffixes of each symbol
        np.cumsum(np.bincount(text), out=self.start[1:])
        self.places = np.argsort(self.before, kind="stable")
        self.places += self.before[self.places].astype(np.int64) * (n + 1)

    def step(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the interval of symbol + phrase starts, from where the phrase's does."""
        return np.searchsorted(self.places, symbol * (self.n + 1) + at)


class Bidirectional:
    """An FM-index and its mirror; phrases of a length are the rows of a level."""

    def __init__(self, text: np.ndarray, depth: int) -> None:
        self.index, self.mirror = FMIndex(text, depth), FMIndex(text[::-1], depth)

    def words(self) -> dict:
        """All phrases of one word."""
        start = self.index.start
        word = np.flatnonzero(np.diff(start))[1:]
        size = start[word + 1] - start[word]
        return {"at": start[word], "mirrored": start[word], "size": size, "words": word[:, None]}

    def extend(self, level: dict, left: bool) -> dict:
        """All phrases one word longer."""
        index = self.index if left else self.mirror
        here, there = ("at", "mirrored") if left else ("mirrored", "at")
        size, symbols = level["size"], int(index.start.size)
        row = np.repeat(level[here] - np.cumsum(size) + size, size)
        row += np.arange(len(row))
        key = np.repeat(np.arange(len(size)) * symbols, size)
        key += index.before[row]
        del row
        key.sort()
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else key
        count = np.diff(np.append(first, len(key)))
        phrase, symbol = key[first] // symbols, key[first] % symbols
        # symbols inside the interval that are smaller, piece ends among them
        smaller = first - (np.cumsum(size) - size)[phrase]
        some = symbol > 0
        phrase, symbol, count, smaller = (x[some] for x in (phrase, symbol, count, smaller))
        pair = (symbol[:, None], level["words"][phrase])
        return {here: index.step(symbol, level[here][phrase]),
                there: level[there][phrase] + smaller, "size": count,
                "words": np.hstack(pair if left else pair[::-1])}


def _shards(docs: DataFrame, limit: int) -> DataFrame:
    """(shard, lang, ids, words, counts) of texts of one language each, written."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size: dict[str, int] = {}
        number = TaskContext.get().partitionId() << 32

        def out(lang: str) -> pa.RecordBatch:
            nonlocal number
            ids, names, count = tokens(pa.chunked_array(held.pop(lang)).combine_chunks())
            size.pop(lang)
            number += 1
            return pa.RecordBatch.from_pydict({
                "shard": pa.array([number], pa.int64()), "lang": pa.array([lang]),
                "ids": pa.array([pack(ids)], pa.binary()),
                "words": pa.array([names], pa.list_(pa.string())),
                "counts": pa.array([count], pa.list_(pa.int64()))})

        for batch in batches(rows, limit):
            lang = batch.column(0)
            for one in pc.unique(lang).to_pylist():
                part = batch.column(1).filter(pc.equal(lang, one)).cast(pa.large_string())
                held.setdefault(one, []).append(part)
                size[one] = size.get(one, 0) + part.nbytes
                if size[one] >= limit:
                    yield out(one)
            while sum(size.values()) > HELD * limit:
                yield out(max(size, key=size.get))
        for one in list(held):
            yield out(one)

    return settle(docs.mapInArrow(
        run, "shard long, lang string, ids binary, words array<string>, counts array<long>"),
        "phrases-shards")


def _gram_rows(depth: int, bits: int):
    """Phrases of two words and more of each shard. Their words' numbers of ``bits`` bits (0 for
    none) are packed into as few columns as hold them."""
    per = 63 // bits
    names = [f"k{i}" for i in range(-(-depth // per))]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for raw, known in zip(batch.column(0), batch.column(1)):
                ids = unpack(raw.as_py())[0]
                local = known.values.field(0).to_numpy()
                number = known.values.field(1).to_numpy()
                order = np.argsort(number)
                seen = np.zeros(int(ids.max(initial=0)) + 2, np.int64)
                seen[local[order]] = np.arange(1, len(order) + 1)
                number = np.append(0, number[order])
                text = np.concatenate([[0], seen[ids], [0]]).astype(np.int32)
                text = text[np.append(True, (text[1:] > 0) | (text[:-1] > 0))]
                index = Bidirectional(text, depth)
                level = index.words()
                for length in range(2, depth + 1):
                    level = index.extend(level, left=length % 2 == 1)
                    words, size = number[level["words"]], level["size"]
                    for at in range(0, len(size), 200_000):
                        to = slice(at, at + 200_000)
                        part = words[to]
                        cols = {k: pa.array(sum(part[:, i] << (bits * (i - c * per)) for i in range(
                            c * per, min((c + 1) * per, length))) + np.zeros(len(part), np.int64))
                            for c, k in enumerate(names)}
                        yield pa.RecordBatch.from_pydict(cols | {"n": pa.array(size[to])})

    number = lambda i: F.shiftright(f"k{i // per}", bits * (i % per)).bitwiseAND(
        F.lit((1 << bits) - 1)).alias(f"w{i + 1}")
    return run, names, [number(i) for i in range(depth)]


def _cut(depth: int, start: int, end: int) -> list:
    """Key columns of a part of a phrase: its words, filled up with zeros."""
    return [F.col(f"w{i + 1}") for i in range(start, end)] + [
        F.lit(0).cast("long")] * (depth - (end - start))


def mine(docs: DataFrame, depth: int = DEPTH, min_count: int = MIN_COUNT, text_col: str = "text",
         lang_col: str = "lang", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """All candidates: lang, phrase, length, a, l, r, n, score, left_max and right_max (counts of
    the most frequent phrases one word longer to the left and right), dropped."""
    prepare(docs.sparkSession)
    shards = _shards(docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
                                 F.coalesce(F.col(text_col), F.lit("")).alias("text")), shard_bytes)
    entries = shards.select("shard", "lang", F.posexplode(F.arrays_zip("words", "counts"))).select(
        "shard", "lang", (F.col("pos") + 1).alias("local"), F.col("col.words").alias("word"),
        F.col("col.counts").alias("c"))
    totals = shards.select("lang", F.aggregate("counts", F.lit(0).cast("long"),
                                               lambda x, y: x + y).alias("c")).groupBy("lang").agg(
        F.sum("c").alias("n"))
    words = settle(entries.groupBy("lang", "word").agg(F.sum("c").alias("f"))
                   .where(F.col("f") >= min_count)
                   .withColumn("id", F.monotonically_increasing_id()), "phrases-words")
    # small numbers from the rows' places in the written partitions, which are alike in size
    tasks = (words.agg(F.max(F.shiftright("id", 33))).first()[0] or 0) + 1
    words = words.select("lang", "word", "f", F.expr(
        f"(id & {(1 << 33) - 1}L) * {tasks}L + shiftright(id, 33) + 1").alias("number"))
    bits = max((words.agg(F.max("number")).first()[0] or 0).bit_length(), 1)
    known = (entries.join(words, ["lang", "word"])
             .groupBy("shard").agg(F.collect_list(F.struct("local", "number")).alias("known")))
    run, packed, numbers = _gram_rows(depth, bits)
    keys = [f"w{i}" for i in range(1, depth + 1)]
    # a shard's rows are counts already, so they are dealt at once: a hash table before the
    # exchange would find hardly an equal key and take the memory of the index
    grams = settle(shards.select("shard", "ids").join(known, "shard").select("ids", "known")
                   .mapInArrow(run, ", ".join(f"{k} long" for k in packed) + ", n long")
                   .repartition(*packed).groupBy(*packed).agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)
                   .select(*numbers, "n"), "phrases-grams")
    zero = F.lit(0).cast("long")
    parts = grams.union(words.select("number", *[zero] * (depth - 1), "f")).select(
        F.struct(*keys).alias("part"), F.col("n").alias("f"))
    key = lambda cols: F.struct(*[c.alias(w) for c, w in zip(cols, keys)])
    # every cut of every candidate, with the counts of both parts
    cuts, longer = [], []
    for length in range(2, depth + 1):
        own = grams.where((F.col(f"w{length}") > 0) & (
            F.col(f"w{length + 1}") == 0 if length < depth else F.lit(True)))
        for k in range(1, length):
            cuts.append(own.select(F.struct(*keys).alias("gram"), F.col("n").alias("a"),
                                   F.lit(length).alias("length"), F.lit(k).alias("k"),
                                   key(_cut(depth, 0, k)).alias("head"),
                                   key(_cut(depth, k, length)).alias("tail")))
        for side, (start, end) in {"left": (1, length), "right": (0, length - 1)}.items():
            longer.append(own.select(key(_cut(depth, start, end)).alias("gram"),
                                     F.when(F.lit(side == "left"), F.col("n")).alias("left"),
                                     F.when(F.lit(side == "right"), F.col("n")).alias("right")))
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    cut = cuts[0]
    for one in cuts[1:]:
        cut = cut.union(one)
    scored = (cut.join(parts.select(F.col("part").alias("head"), F.col("f").alias("l")), "head")
              .join(parts.select(F.col("part").alias("tail"), F.col("f").alias("r")), "tail")
              .withColumn("a2", (whole("a") * whole("a") * F.lit(1000000)).cast("decimal(38,0)"))
              .withColumn("lr", (whole("l") * whole("r")).cast("decimal(38,0)"))
              .withColumn("score", F.expr("a2 div lr"))
              .groupBy("gram", "a", "length")
              .agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")))
    ext = longer[0]
    for one in longer[1:]:
        ext = ext.union(one)
    ext = ext.groupBy("gram").agg(F.max("left").alias("left_max"), F.max("right").alias("right_max"))
    found = scored.join(ext, "gram", "left").select(
        "*", F.coalesce(F.greatest("left_max", "right_max") * 100 >= F.col("a") * 50,
                        F.lit(False)).alias("dropped"), "gram.*")
    for i in range(1, depth + 1):
        found = found.join(words.select(F.col("number").alias(f"w{i}"), F.col("word").alias(f"t{i}"),
                                        *([F.col("lang")] if i == 1 else [])),
                           f"w{i}", "inner" if i < 3 else "left")
    return found.join(totals, "lang").select(
        "lang", F.concat_ws(" ", *[f"t{i}" for i in range(1, depth + 1)]).alias("phrase"), "length",
        "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n",
        F.col("cut.score").alias("score"), "left_max", "right_max", "dropped")


def top(found: DataFrame, limit: int = TOP) -> DataFrame:
    """The first phrases of each language by score, count and phrase: lang, rank, phrase, a, l, r,
    n, score. Each task keeps no more than ``limit`` rows of a language before the exchange."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (found.where("NOT dropped").withColumn("rank", F.row_number().over(order))
            .where(F.col("rank") <= limit)
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n",
                    "score"))
