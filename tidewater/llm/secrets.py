"""Secret scan in native column expressions.

Three fixed patterns give the base spans. On top, candidate strings (runs of key characters)
are scanned with a sliding window: the counts of its characters are carried along, changed by the
one character that leaves and the one that enters, and so is its Shannon entropy, which is held
against a limit that depends on the candidate's character class. Known harmless shapes are suppressed by an allow list.
Spans are code points, the end exclusive.

Match positions come from one split and one extraction per pattern: the lengths of the pieces
between matches and of the matches, summed up. Texts without a match pay one search only.

Defined results: a null or empty text has no spans (and stays null when redacted); repeated
rows are scanned one by one; spans with equal starts are ordered by kind; an empty table gives
no rows; further columns are kept by ``redact`` and ignored by ``scan``. Very long texts and
candidates are scanned whole; the patterns need no stack per character.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ["assign", "access", "hex", "entropy"]
# kind -> (pattern, group whose length counts, least length). Runs of one class of characters
# match as a whole, so their least length is part of the pattern.
BASE = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
               r"([A-Za-z0-9+/_.=-]+)", 1, 12),
    "access": (r"AKIA[A-Z0-9]{14,}", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),
}
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
# The characters of candidates; a window's counts are packed into longs, five bits for each.
ALPHABET = string.ascii_letters + string.digits + "+/_-="
PER_LONG = 12
# class -> (pattern, window (under 32), least entropy in bits); the first that fits counts.
CLASSES = [
    ("hex", r"^[0-9a-fA-F]+$", 16, 3.0),
    ("alnum", r"^[A-Za-z0-9]+$", 20, 3.7),
    ("base64", r"^.*$", 20, 3.8),
]
# Shapes that are never secrets.
ALLOW = [
    r"^[0-9_+/-]+$",                                                     # numbers, rules
    r"^[A-Za-z_+/=-]+$",                                                 # words without digits
    r"^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$",             # UUIDs
    r"(?i:example|sample|dummy|placeholder|xxxx)",                       # documentation keys
    # paths, identifiers; possessive, so that thousands of parts need no stack
    r"^[A-Za-z]++(?:[_/-][A-Za-z0-9]{1,8}+)++$",
]
MASK = "[SECRET]"


def _spans(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """Array of (start, ord, end, kind) of one pattern's matches."""
    pat = F.lit(pattern)
    found = F.arrays_zip(
        F.split(text, pattern, -1).alias("p"),
        F.regexp_extract_all(text, pat, F.lit(0)).alias("m"),
        F.regexp_extract_all(text, pat, F.lit(group)).alias("g"))
    order = F.lit(KINDS.index(kind))
    empty = F.array().cast("array<struct<start:int,ord:int,end:int,kind:string>>")
    walk = F.aggregate(
        found, F.struct(F.lit(0).alias("at"), empty.alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["p"]) + F.coalesce(F.length(x["m"]), F.lit(0))).alias("at"),
            F.when(F.length(x["g"]) >= least, F.concat(acc["out"], F.array(F.struct(
                (acc["at"] + F.length(x["p"])).alias("start"), order.alias("ord"),
                (acc["at"] + F.length(x["p"]) + F.length(x["m"])).alias("end"),
                F.lit(kind).alias("kind"))))).otherwise(acc["out"]).alias("out")),
        lambda acc: acc["out"])
    return F.when(text.rlike(pattern), walk).otherwise(empty)


def _entropy_spans(text: Column) -> Column:
    """Array of (start, ord, end, kind) of candidate parts with a window of high entropy."""
    cands = F.filter(_spans(text, "entropy", CANDIDATE, 0, 20), lambda c: ~_any_rlike(
        F.substring(text, c["start"] + 1, c["end"] - c["start"]), ALLOW))
    return F.filter(F.transform(cands, lambda c: _scan(
        F.substring(text, c["start"] + 1, c["end"] - c["start"]), c)),
        lambda s: s["end"] > s["start"])


def _any_rlike(value: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | value.rlike(p)
    return out


def _long(code: Column) -> Column:
    """Which of the packed longs holds a character's count."""
    return F.call_function("div", code, F.lit(PER_LONG)).cast("int")


def _shift(code: Column) -> Column:
    return code % PER_LONG * 5


def _scan(value: Column, cand: Column) -> Column:
    """From the first to the last hot window of a candidate, as a span of the text."""
    f = lambda n: n * math.log2(n) if n else 0.0
    # what the n-th copy of a character adds to the window's sum of n * log2(n)
    gain = F.array(*[F.lit(f(n) - f(n - 1) if n else 0.0) for n in range(
        max(c[2] for c in CLASSES) + 1)])

    def by_class(pick) -> Column:
        out = None
        for _, pattern, window, least in reversed(CLASSES):
            v = F.lit(pick(window, least))
            out = v if out is None else F.when(value.rlike(pattern), v).otherwise(out)
        return out

    window = by_class(lambda w, h: w)
    most = by_class(lambda w, h: w * (math.log2(w) - h) + 1e-9)
    setup = F.struct(
        F.transform(F.split(value, ""), lambda c: F.position(c, F.lit(ALPHABET)) - 1).alias("ch"),
        window.alias("w"), most.alias("most"))

    def one(env: Column) -> Column:
        ch, w = env["ch"], env["w"]
        # per place: the character that enters and, from the first full window on, the one that
        # leaves, each with the long that holds its count and the shift of the count in it
        moves = F.transform(F.sequence(F.lit(1), F.size(ch)), lambda i: F.struct(
            i.alias("i"), F.element_at(ch, i).alias("new"),
            F.when(i > w, F.element_at(ch, F.greatest(i - w, F.lit(1)))).otherwise(F.lit(-1))
            .alias("gone")))
        moves = F.transform(moves, lambda x: F.struct(
            x["i"].alias("i"), (x["new"] == x["gone"]).cast("int").alias("same"),
            _long(x["new"]).alias("nl"), _shift(x["new"]).alias("ns"),
            F.when(x["gone"] < 0, F.lit(-1)).otherwise(_long(x["gone"])).alias("gl"),
            F.greatest(_shift(x["gone"]), F.lit(0)).alias("gs")))
        bit = lambda shift: F.call_function("shiftleft", F.lit(1).cast("long"), shift)

        def count(acc: Column, place: Column, shift: Column) -> Column:
            return F.call_function("shiftright", F.get(acc["c"], place), shift).bitwiseAND(31)

        def step(acc: Column, x: Column) -> Column:
            hot = (x["i"] > w) & (acc["s"] <= env["most"])  # of the window that ends before i
            n_out = F.coalesce(count(acc, x["gl"], x["gs"]), F.lit(0))
            n_in = count(acc, x["nl"], x["ns"]) + 1 - x["same"]
            return F.struct(
                (acc["s"] - F.get(gain, n_out.cast("int")) + F.get(gain, n_in.cast("int"))).alias("s"),
                F.when(hot & (acc["a"] == 0), x["i"] - w).otherwise(acc["a"]).alias("a"),
                F.when(hot, x["i"] - 1).otherwise(acc["b"]).alias("b"),
                F.transform(acc["c"], lambda y, k: y
                            + F.when(k == x["nl"], bit(x["ns"])).otherwise(F.lit(0).cast("long"))
                            - F.when(k == x["gl"], bit(x["gs"])).otherwise(F.lit(0).cast("long")))
                .alias("c"))

        zero = F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("a"), F.lit(0).alias("b"), F.array(*[
            F.lit(0).cast("long")] * (-(-len(ALPHABET) // PER_LONG))).alias("c"))
        n = F.size(ch)
        # the last window has no step after it
        return F.aggregate(
            moves, zero, step,
            lambda acc: F.struct(
                F.when((acc["s"] <= env["most"]) & (n >= w) & (acc["a"] == 0), n - w + 1)
                .otherwise(acc["a"]).alias("a"),
                F.when((acc["s"] <= env["most"]) & (n >= w), n).otherwise(acc["b"]).alias("b")))

    hot = F.element_at(F.transform(F.array(setup), one), 1)
    start = cand["start"] + F.greatest(hot["a"] - 1, F.lit(0))
    end = F.when(hot["a"] > 0, cand["start"] + hot["b"]).otherwise(start)
    return F.struct(start.alias("start"), F.lit(KINDS.index("entropy")).alias("ord"),
                    end.alias("end"), F.lit("entropy").alias("kind"))


def _with_spans(docs: DataFrame, text: Column) -> DataFrame:
    """Adds ``_base`` and ``_all``: sorted base spans, and those with the added ones."""
    kinds = docs.select("*", text.alias("_t"))
    kinds = kinds.select("*", *[_spans(F.col("_t"), k, *v).alias(f"_{k}") for k, v in BASE.items()],
                         _entropy_spans(F.col("_t")).alias("_e"))
    base = kinds.select("*", F.sort_array(F.concat(*[f"_{k}" for k in BASE])).alias("_base"))
    added = F.filter("_e", lambda e: ~F.exists("_base", lambda b: (b["start"] <= e["start"])
                                               & (e["end"] <= b["end"])))
    return base.select("*", F.sort_array(F.concat("_base", added)).alias("_all"))


def _joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, number of base spans per kind, sorted spans (arrays of start, ord, end, kind)."""
    work = _with_spans(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")),
                       F.col("text"))
    return work.select("doc_id", *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in BASE],
                       F.col("_base").alias("base_spans"), F.col("_all").alias("spans"))


def digests(found: DataFrame) -> DataFrame:
    """Spans as text: the digest of the base ones and all of them."""
    return found.select("doc_id", *[f"n_{k}" for k in BASE],
                        F.sha2(_joined("base_spans"), 256).alias("base_sha256"),
                        _joined("spans").alias("spans"))


def redact(docs: DataFrame, mask: str = MASK) -> DataFrame:
    """Documents with every span replaced by the mask; overlapping spans become one mask.
    ``n_chars``, where the table has it, follows the text."""
    names = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"))
    work = _with_spans(packed, F.coalesce(F.col("_row.text"), F.lit("")))
    joined = F.aggregate(
        "_all", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] >= acc["at"], F.concat(
                acc["out"], F.substring(F.col("_t"), acc["at"] + 1, s["start"] - acc["at"]),
                F.lit(mask))).otherwise(acc["out"]).alias("out")),
        lambda acc: F.concat(acc["out"], F.substring(F.col("_t"), acc["at"] + 1,
                                                     F.length("_t"))))
    clean = F.when(F.size("_all") > 0, joined).otherwise(F.col("_row.text"))
    out = work.select("_row", clean.alias("_clean"))
    return out.select(*[
        F.col("_clean").alias(c) if c == "text" else
        F.when(F.col("_clean") != F.col("_row.text"), F.length("_clean")).otherwise(
            F.col("_row.n_chars")).cast(docs.schema[c].dataType).alias(c) if c == "n_chars"
        else F.col(f"_row.`{c}`").alias(c) for c in names])
