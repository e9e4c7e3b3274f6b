"""Quality rules as a bitmask ledger (native column expressions only).

Every rule is evaluated once per document; the ledger keeps the measurements and one long
whose bit *i* says that rule *i* failed. Policies are versioned sets of rules: applying one is
a bitwise AND on the ledger, and an ablation (what would a policy keep without one of its
rules?) needs only the counts per distinct mask, so neither reads a text again.

Defined results: a null text is an empty text; an empty text has zero words and fails
``few_words``; repeated rows are judged one by one; an empty table gives an empty ledger;
further columns of the input (also ones named like a measurement) are not carried, only the
id column is. Very long texts are judged whole, by the task that has their row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WS = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[^#*$%&|<>]+"
WINDOW = 8

# name -> condition of failure over the measurements; the position is the bit.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 20"),
    ("repeated_words", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "100 * n_symbols > 50 * n_words"),
    ("shouting", "100 * n_upper > 60 * word_chars"),
    ("duplicate_lines", "n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines"),
    ("long_words", "word_chars > 18 * n_words"),
]
# version -> rules in force. ``base`` is part of every later version.
POLICIES: dict[str, list[str]] = {
    "base": ["few_words", "repeated_words"],
    "v1": ["few_words", "repeated_words", "symbols", "shouting"],
    "v2": ["few_words", "repeated_words", "symbols", "shouting", "duplicate_lines",
           "long_words"],
}
CURRENT = "v2"


def policy_mask(version: str) -> int:
    """The bits of the rules that a policy version enforces."""
    names = [n for n, _ in RULES]
    return sum(1 << names.index(r) for r in POLICIES[version])




def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measurements per document: n_words, word_chars, n_symbols, n_lines, n_dup_lines,
    n_repeat_words, n_upper. No shuffle: everything is an expression over one row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("_t"))
    words = base.select(
        "doc_id", "_t",
        F.array_remove(F.split("_t", WS), "").alias("_w"),
        F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_l"),
    )
    hashed = words.select(
        "doc_id", F.size("_w").cast("long").alias("n_words"),
        F.length(F.regexp_replace("_t", WS, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_t", SYMBOLS, "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("_t", r"\P{Lu}+", "")).cast("long").alias("n_upper"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.transform("_w", lambda w: F.xxhash64(w)).alias("_h1"),
    )
    h1 = hashed
    for step, name in ((1, "_h2"), (2, "_h4"), (4, "_h8")):
        prev = {"_h2": "_h1", "_h4": "_h2", "_h8": "_h4"}[name]
        keep = [c for c in h1.columns if c != prev]
        h1 = h1.select(*keep, F.zip_with(
            F.col(prev), F.slice(F.col(prev), F.lit(step + 1), F.size(prev)),
            lambda a, b: F.xxhash64(a, b)).alias(name))
    keep = [c for c in h1.columns if c != "_h8"]
    windows = h1.select(*keep, F.when(
        F.col("n_words") >= WINDOW,
        F.slice("_h8", F.lit(1), (F.col("n_words") - (WINDOW - 1)).cast("int")),
    ).alias("_h"))
    # Only texts with a repeated window pay for the sort that finds its positions.
    sorted_ = windows.select(*keep, F.when(
        F.size(F.array_distinct("_h")) < F.size("_h"),
        F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    ).alias("_s"))
    equal_next = sorted_.select(*keep, "_s", F.zip_with(
        "_s", F.slice("_s", F.lit(2), F.size("_s")),
        lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))).alias("_n"))
    flagged = equal_next.select(*keep, F.zip_with(
        "_s", F.zip_with("_n", F.concat(F.array(F.lit(False)),
                                        F.slice("_n", F.lit(1), F.size("_n") - 1)),
                         lambda a, b: a | b),
        lambda s, f: F.when(f, s["i"])).alias("_f"))
    positions = flagged.select(*keep, F.sort_array(
        F.filter("_f", lambda i: i.isNotNull())).alias("_p"))
    covered = F.aggregate(
        F.zip_with("_p", F.slice("_p", F.lit(2), F.size("_p")),
                   lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW)))),
        F.lit(0), lambda acc, x: acc + x)
    return positions.select(*keep, F.coalesce(covered, F.lit(0)).cast("long")
                            .alias("n_repeat_words"))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``measure`` plus ``fail_bits``: bit i is set when rule i of ``RULES`` failed."""
    bits = None
    for i, (_name, cond) in enumerate(RULES):
        bit = F.when(F.expr(cond), F.lit(1 << i)).otherwise(F.lit(0)).cast("long")
        bits = bit if bits is None else bits.bitwiseOR(bit)
    return measure(docs, id_col, text_col).withColumn("fail_bits", bits)


def apply_policy(book: DataFrame, version: str = CURRENT) -> DataFrame:
    """Adds ``base_failed``, ``kept`` and the policy version to a ledger."""
    fails = lambda v: F.col("fail_bits").bitwiseAND(F.lit(policy_mask(v)).cast("long")) != 0
    return book.select("*", fails("base").alias("base_failed"), (~fails(version)).alias("kept"),
                       F.lit(version).alias("policy"))


def ablations(book: DataFrame) -> DataFrame:
    """Per policy and rule: documents kept in force, and kept if that rule were dropped.

    The ledger is reduced to counts per mask first (at most 2 ** rules rows), so the
    policies are applied to a bounded table."""
    names = [n for n, _ in RULES]
    cases = [(v, r, policy_mask(v), policy_mask(v) & ~(1 << names.index(r)))
             for v in POLICIES for r in POLICIES[v]]
    case = F.explode(F.array(*[F.struct(
        F.lit(v).alias("policy"), F.lit(r).alias("rule"), F.lit(m).cast("long").alias("m"),
        F.lit(w).cast("long").alias("w")) for v, r, m, w in cases])).alias("c")
    masks = book.groupBy("fail_bits").agg(F.count("*").alias("n"))
    passed = lambda f: F.sum(F.when(
        F.col("fail_bits").bitwiseAND(F.col(f"c.{f}")) == 0, F.col("n")).otherwise(0))
    return (masks.select("fail_bits", "n", case)
            .groupBy(F.col("c.policy").alias("policy"), F.col("c.rule").alias("rule"))
            .agg(F.sum("n").alias("n_docs"), passed("m").alias("n_kept"),
                 passed("w").alias("n_kept_without_rule")))
