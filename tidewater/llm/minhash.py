"""Near-duplicate documents by SuperMinHash.

1. Every text becomes a set of hashed word shingles and a SuperMinHash signature: each element
   visits the signature's places in its own random order, offering rank + noise, so ranks are
   correlated between places and the estimate varies less than with independent hashes. Ranks
   are done level by level for a whole batch; a document stops when no higher rank can matter.
2. Equal sets are one class, represented by the smallest id; copies are never paired.
3. Classes that share a band of the signature meet in buckets. First every class is checked
   against the smallest class it meets; then, only in buckets that still hold several
   components, members of the smaller ones are compared with all others, in blocks and without
   making a row of a pair.
4. A link is confirmed on the full sets (intersection and union of shingle hashes), links are
   grouped by union-find.

Two stages may miss a link: a pair at the threshold shares no band with probability
(1 - s^4)^32, 5e-8 at 0.8, and a signature estimate below ``PLAUSIBLE`` (over five standard
deviations). Nothing is capped: all other pairs of different components are tested.

Defined results: null, empty and blank texts have no shingles, link with nothing and stay;
texts with fewer words than a shingle have one; repeated rows are one class; a row without id
takes part in no link and stays; an empty table gives no rows; further columns are ignored
(kept by ``drop_near_duplicates``). Very long texts are signed and compared with all their
shingles, by the task that has their row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components, discard, settle
from .textkit import Words, batches, gram_hashes, inside, mix, prepare, words

PLACES, BANDS = 128, 32
ROWS = PLACES // BANDS
PLAUSIBLE = 0.6
BLOCK = 1024
_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)


def shingles(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted per text, and their offsets."""
    h = w.hashes(lower=True)
    count = np.diff(w.offsets)
    starts = inside(w.offsets, n)
    grams = gram_hashes(h, n)[starts] if len(starts) else np.zeros(0, _U)
    doc = w.doc_of()
    docs = doc[starts]
    for k in range(1, n):  # short texts: all words as one
        own = np.flatnonzero(count == k)
        if len(own):
            at = w.offsets[own]
            one = h[at] + _U(k)
            for j in range(1, k):
                one = mix(one * _STEP + h[at + j])
            grams, docs = np.append(grams, mix(one)), np.append(docs, own)
    order = np.lexsort((grams, docs))
    grams, docs = grams[order], docs[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (docs[1:] != docs[:-1])
    grams, docs = grams[new], docs[new]
    return grams, np.searchsorted(docs, np.arange(len(count) + 1))


def signatures(grams: np.ndarray, off: np.ndarray, places: int = PLACES) -> np.ndarray:
    """SuperMinHash of each set: a rank in the top byte, noise below it."""
    n = len(off) - 1
    doc = np.repeat(np.arange(n), np.diff(off))
    sig = np.full(n * places, ~_U(0), _U)
    seed, row, order = mix(grams ^ _STEP), doc, None
    for level in range(places):
        if not len(seed):
            break
        with np.errstate(over="ignore"):
            draw = mix(seed + _STEP * _U(2 * level + 1))
            noise = mix(seed + _STEP * _U(2 * level + 2)) >> _U(8)
        k = level + ((draw >> _U(32)) * _U(places - level) >> _U(32)).astype(np.int64)
        if order is None:
            place = k
        else:
            at = np.arange(len(seed))
            place = order[at, k].astype(np.int64)
            order[at, k] = order[:, level]
        np.minimum.at(sig, row * places + place, (_U(level) << _U(56)) | noise)
        # a document is done when no place can still be improved by a higher rank
        open_docs = (sig.reshape(n, places).max(axis=1) >> _U(56)) > level
        keep = open_docs[row]
        if order is None:
            order = np.tile(np.arange(places, dtype=np.uint8), (int(keep.sum()), 1))
            order[np.arange(len(order)), k[keep]] = 0
        else:
            order = order[keep]
        seed, row = seed[keep], row[keep]
    return sig.reshape(n, places)


def _signed(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles, two digests of the set, band hashes, one byte per place."""
    prepare(docs.sparkSession)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(parts, 1_000_000):
            grams, off = shingles(words(batch.column(1)), n)
            size = np.diff(off)
            sums = np.zeros((2, len(grams) + 1), _U)
            np.cumsum(mix(grams + _U(1)), out=sums[0, 1:])
            np.cumsum(mix(grams ^ _U(0x5BF0363546A5C1E7)), out=sums[1, 1:])
            digest = (sums[:, off[1:]] - sums[:, off[:-1]]).view(np.int64)
            sig = signatures(grams, off)
            bands = np.zeros((len(sig), BANDS), _U)
            for r in range(ROWS):
                bands = mix(bands * _STEP + sig[:, r::ROWS] + _U(r + 1))
            small = (mix(sig) & _U(255)).astype(np.uint8)
            flat = pa.array(bands.view(np.int64).reshape(-1))
            ends = pa.array(np.arange(len(sig) + 1, dtype=np.int32) * BANDS)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0).cast(pa.int64()), "n_shingles": pa.array(size, pa.int64()),
                "h1": pa.array(digest[0]), "h2": pa.array(digest[1]),
                "bands": pa.ListArray.from_arrays(ends, flat),
                "small": pa.array([s.tobytes() for s in small], pa.binary())})

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>, small binary")


def _texts(docs: DataFrame, active: DataFrame) -> DataFrame:
    """(rep, z): compressed text of the classes that take part in a pair."""
    rows = (docs.select(F.col("doc_id").alias("rep"), "text").join(active, "rep"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", 1)
        for batch in parts:
            raw = [(t or "").encode() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({
                "rep": batch.column(0), "size": pa.array([len(r) for r in raw], pa.int32()),
                "z": pa.array([codec.compress(r, asbytes=True) for r in raw], pa.binary())})

    return rows.select("rep", "text").mapInArrow(run, "rep long, size int, z binary")


def _confirm(pairs: DataFrame, texts: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(a, b, linked) of pairs (a, b): den * |A n B| >= num * |A u B| on the full sets.

    The right side's text goes once to each salted group of at most BLOCK left sides, so a
    side with very many partners is spread over tasks and no text is sent per pair."""
    groups = pairs.groupBy("b").agg(F.count("*").alias("c")).select(
        "b", F.ceil(F.col("c") / BLOCK).cast("int").alias("salts"))
    left = (pairs.join(groups, "b")
            .select("b", F.pmod(F.xxhash64("a"), "salts").cast("int").alias("salt"),
                    F.lit(1).alias("role"), F.col("a").alias("rep")))
    right = groups.select("b", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"),
                          F.lit(0).alias("role"), F.col("b").alias("rep"))
    rows = (left.unionByName(right).join(texts, "rep")
            .repartition("b", "salt").sortWithinPartitions("b", "salt", "role"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, hub = pa.Codec("zstd", 1), np.zeros(0, _U)
        for batch in parts:
            raw = [codec.decompress(z, s, asbytes=True) for z, s in
                   zip(batch.column(4).to_pylist(), batch.column(3).to_pylist())]
            grams, off = shingles(words(pa.array(raw, pa.binary()).cast(pa.string())), n)
            a, b, ok = [], [], []
            for k, (role, one, other) in enumerate(zip(
                    batch.column(2).to_pylist(), batch.column(0).to_pylist(),
                    batch.column(1).to_pylist())):
                own = grams[off[k]:off[k + 1]]
                if role == 0:
                    hub = own
                    continue
                at = np.searchsorted(hub, own)
                both = int((hub[np.minimum(at, len(hub) - 1)] == own).sum()) if len(hub) else 0
                a.append(one)
                b.append(other)
                ok.append(den * both >= num * (len(hub) + len(own) - both))
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()),
                                              "b": pa.array(b, pa.int64()),
                                              "linked": pa.array(ok, pa.bool_())})

    return rows.select("rep", "b", "role", "size", "z").mapInArrow(
        run, "a long, b long, linked boolean")


def _open_buckets(buckets: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of the buckets that still hold several components (bucket, band, rep, comp, c: the
    component's members in the bucket), and per bucket its main component and the number of
    blocks for the others (na) and for all members (nb). Of buckets with the same members only
    the one of the first band is kept."""
    rows = buckets.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select(
        "bucket", "band", "rep", F.coalesce("comp", "rep").alias("comp"))
    sizes = rows.groupBy("bucket", "band", "comp").agg(
        F.count("*").alias("c"), F.bit_xor(F.xxhash64("rep")).alias("x"),
        F.bit_xor(F.xxhash64("rep", F.lit(7))).alias("y"))
    several = (sizes.groupBy("bucket", "band").agg(
        F.sum("c").alias("members"), F.count("*").alias("comps"), F.bit_xor("x").alias("x"),
        F.bit_xor("y").alias("y"), F.max(F.struct("c", "comp")).alias("top")).where("comps > 1"))
    once = several.groupBy("members", "x", "y").agg(
        F.min(F.struct("band", "bucket", "top")).alias("b"))
    open_ = settle(once.select(
        F.col("b.bucket").alias("bucket"), F.col("b.top.comp").alias("main"),
        F.ceil(F.col("members") / BLOCK).cast("int").alias("nb"),
        F.ceil((F.col("members") - F.col("b.top.c")) / BLOCK).cast("int").alias("na")),
        "minhash-open")
    return (rows.join(open_, "bucket").join(sizes.select("bucket", "comp", "c"), ["bucket", "comp"]),
            open_)


def _cross_links(dealt: DataFrame, own: DataFrame, texts: DataFrame, n: int, num: int,
                 den: int) -> DataFrame:
    """(a, b): confirmed links between components that share a bucket, from the rows of
    ``_open_buckets``.

    The members of all but the main component of a bucket are compared with every member, in
    blocks of BLOCK rows, so no bucket is one task's work and no pair becomes a row: a pair is
    judged in the first band that both share; one whose signatures agree in ``PLAUSIBLE`` of the
    places is confirmed on the full sets at once, and per left side and component one link is
    returned."""
    dealt = dealt.join(own.select("rep", "small", "bands"), "rep").join(texts, "rep")
    mine = lambda k: F.pmod(F.xxhash64("rep"), k).cast("int")
    part = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    cols = ["rep", "comp", "c", "band", "small", "bands", "size", "z"]
    left = dealt.where("comp <> main").select(
        "bucket", mine("na").alias("x"), part("nb").alias("y"), F.lit(0).alias("role"), *cols)
    right = dealt.select("bucket", part("na").alias("x"), mine("nb").alias("y"),
                         F.lit(1).alias("role"), *cols)
    both = (left.unionByName(right).repartition("bucket", "x", "y")
            .sortWithinPartitions("bucket", "x", "y", "role"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        held: list[dict] = []  # left sides of the current group
        key = None
        for batch in parts:
            group = [batch.column(i).to_numpy() for i in range(4)]
            rep, comp, c, band = (batch.column(i).to_numpy() for i in range(4, 8))
            sig = np.frombuffer(b"".join(batch.column(8).to_pylist()), np.uint8).reshape(-1, PLACES)
            bands = np.asarray(batch.column(9).flatten()).reshape(-1, BANDS)
            size, z = batch.column(10).to_pylist(), batch.column(11).to_pylist()
            change = np.ones(len(rep), bool)
            change[1:] = np.logical_or.reduce([g[1:] != g[:-1] for g in group])
            bounds = np.append(np.flatnonzero(change), len(rep))
            todo: list[tuple[dict, np.ndarray]] = []
            for i, j in zip(bounds[:-1], bounds[1:]):
                now = tuple(g[i] for g in group[:3])
                if now != key:
                    key, held = now, []
                if group[3][i] == 0:
                    held += [{"rep": rep[k], "comp": comp[k], "c": c[k], "sig": sig[k],
                              "bands": bands[k], "size": size[k], "z": z[k]} for k in range(i, j)]
                    continue
                for one in held:
                    # each pair once: from the smaller component to the larger one
                    up = (c[i:j] > one["c"]) | ((c[i:j] == one["c"]) & (comp[i:j] > one["comp"]))
                    hit = i + np.flatnonzero(up)
                    hit = hit[(sig[hit] == one["sig"]).mean(axis=1) >= PLAUSIBLE]
                    before = bands[hit, :band[i]] == one["bands"][:band[i]]
                    hit = hit[~before.any(axis=1)]
                    if len(hit):
                        todo.append((one, hit))
            a, b = [], []
            if todo:
                # sets of all rows that some pair needs, at once
                need = np.unique(np.concatenate([h for _, h in todo]))
                fresh = list({id(o): o for o, _ in todo if "set" not in o}.values())
                raw = [codec.decompress(z[k], size[k], asbytes=True) for k in need.tolist()]
                raw += [codec.decompress(o["z"], o["size"], asbytes=True) for o in fresh]
                grams, off = shingles(words(pa.array(raw, pa.binary()).cast(pa.string())), n)
                for k, o in enumerate(fresh):
                    o["set"] = grams[off[len(need) + k]:off[len(need) + k + 1]]
                for one, hit in todo:
                    at = np.searchsorted(need, hit)
                    count = off[at + 1] - off[at]
                    ends = np.append(0, np.cumsum(count))
                    flat = grams[np.repeat(off[at] - ends[:-1], count) + np.arange(ends[-1])]
                    place = np.minimum(np.searchsorted(one["set"], flat), len(one["set"]) - 1)
                    same = np.append(0, np.cumsum(one["set"][place] == flat))
                    shared = same[ends[1:]] - same[ends[:-1]]
                    ok = hit[den * shared >= num * (count + len(one["set"]) - shared)]
                    _, first = np.unique(comp[ok], return_index=True)
                    a += [one["rep"]] * len(first)
                    b += rep[ok[first]].tolist()
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return both.select("bucket", "x", "y", "role", *cols).mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest linked id, itself included), kept.

    Documents are linked if 100 * |A n B| >= percent * |A u B| over shingles of ``shingle``
    words (A-Z in lower case)."""
    return _grouped(docs, shingle, percent)[0]


def _grouped(docs: DataFrame, shingle: int, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """The result of ``near_duplicates`` and the written tables that it reads."""
    signed = settle(_signed(docs, shingle), "minhash-signed")
    known = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = known.groupBy("n_shingles", "h1", "h2").agg(F.min("doc_id").alias("rep"))
    member = settle(known.select("doc_id", "n_shingles", "h1", "h2")
                    .join(classes, ["n_shingles", "h1", "h2"]).select("doc_id", "rep").distinct(),
                    "minhash-members")
    reps = member.where("doc_id = rep").select("rep")
    own = settle(known.join(reps, known.doc_id == reps.rep).dropDuplicates(["rep"])
                 .select("rep", "small", "bands"), "minhash-reps")
    rows = own.select("rep", F.posexplode("bands").alias("band", "h")).select(
        "rep", "band", F.xxhash64("band", "h").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.min("rep").alias("hub"), F.max("rep").alias("last")).where(
        "hub < last")
    buckets = settle(rows.join(shared.select("bucket", "hub"), "bucket"), "minhash-buckets")
    active = buckets.select("rep").distinct()
    texts = settle(_texts(docs, active).dropDuplicates(["rep"]), "minhash-texts")

    pairs = (buckets.where("hub < rep").groupBy(F.col("rep").alias("a"))
             .agg(F.min("hub").alias("b")))
    first = settle(_confirm(pairs, texts, shingle, percent, 100).where("linked").select("a", "b"),
                   "minhash-links")
    labels = components(first)
    dealt, open_ = _open_buckets(buckets, labels)
    cross = settle(_cross_links(dealt, own, texts, shingle, percent, 100), "minhash-cross")
    discard(member, own, buckets, texts, first, open_)
    before, labels = labels, components(cross, labels)
    discard(cross, before)

    named = (signed.select("doc_id", "n_shingles", "h1", "h2")
             .join(classes, ["n_shingles", "h1", "h2"], "left")
             .join(labels.withColumnRenamed("node", "rep"), "rep", "left"))
    comp = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("comp", "rep", "doc_id"))
    out = named.select("doc_id", "n_shingles", comp.alias("component_id"),
                       F.col("doc_id").eqNullSafe(comp).alias("kept"))
    return out, [signed, labels]


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """Documents that are the first of their group, all columns kept; of repeated rows of one
    id the one with the smallest text (null first), then the smallest other columns as JSON, stays;
    rows without id all stay."""
    found, spent = _grouped(docs, shingle, percent)
    kept = settle(found.where("kept AND doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.count("*").alias("_copies")), "minhash-kept")
    discard(*spent)
    name = "_copies"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    out = docs.join(kept.select("doc_id", F.col("_copies").alias(name)), "doc_id")
    if not kept.where("_copies > 1").isEmpty():
        columns = [F.col(f"`{c}`") for c in docs.columns]
        once = (out.where(F.col(name) > 1).groupBy("doc_id").agg(F.min_by(
            F.struct(*columns), F.struct("text", F.to_json(F.struct(*columns)))).alias("_row"))
            .select("_row.*"))
        out = out.where(F.col(name) == 1).drop(name).unionByName(once)
    return out.select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))
