"""Registered queries of the pipeline operators; each applies one operator, with production
parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(key: str, sql: str | None = None):
    def deco(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLE_SQL[key] = sql.strip()
        return fn
    return deco


OP10_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS txt FROM documents),
w AS (SELECT doc_id, txt,
        list_filter(regexp_split_to_array(txt, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
        list_filter(string_split(txt, chr(10)),
                    lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
      FROM t),
m AS (SELECT doc_id, ws, len(ws) AS n_words,
        length(regexp_replace(txt, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
        length(regexp_replace(txt, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
        length(regexp_replace(txt, '\P{Lu}+', '', 'g')) AS n_upper,
        len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines
      FROM w),
p AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 7), ' ') AS g
      FROM (SELECT doc_id, ws, unnest(range(1, n_words - 6)) AS i FROM m WHERE n_words >= 8)),
f AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM p)
      WHERE c > 1),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM f, range(0, 8) AS x(k) GROUP BY doc_id),
a AS (SELECT m.*, coalesce(r.n, 0) AS n_repeat_words FROM m LEFT JOIN r USING (doc_id)),
b AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM a)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
  CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT (base_failed OR 100 * n_symbols > 50 * n_words OR 100 * n_upper > 60 * word_chars
       OR (n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines)
       OR word_chars > 18 * n_words) AS kept
FROM b
"""


@register("op10_quality_rules", OP10_SQL)
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import rules
    book = rules.apply_policy(rules.ledger(table(spark, sf_dir, "documents")))
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                       "n_repeat_words", "base_failed", "kept")


@register("op1_bpe")
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    from . import bpe
    return bpe.encode_documents(table(spark, sf_dir, "documents"), P.path("word_bpe_49k.json"))


@register("op6_packing")
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import packer
    return packer.pack_documents(table(spark, sf_dir, "documents"))


@register("op7_token_files")
def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    from ..session import scratch_path
    from . import tokenfile
    target = scratch_path(spark, "tokens")
    tokenfile.write_tokens(table(spark, sf_dir, "documents"), target,
                           P.path("byte_bpe_50k.json"))
    return tokenfile.read_tokens(spark, target)


@register("op3_secrets")
def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import secrets
    return secrets.digests(secrets.scan(table(spark, sf_dir, "documents")))


@register("op9_quality_classifier")
def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import fm
    docs = table(spark, sf_dir, "documents")
    return fm.score(docs, fm.fit(docs, table(spark, sf_dir, "labels")))


OP4_SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 3), ' ') AS g
       FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM t
             WHERE len(ws) > 0)),
n AS (SELECT doc_id, COUNT(*) AS n FROM sh GROUP BY 1),
cm AS (SELECT a.doc_id AS a, b.doc_id AS b, COUNT(*) AS c FROM sh a JOIN sh b USING (g)
         WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM cm JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
          WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS r FROM t
          UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.r = links.a)
SELECT t.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, t.doc_id = m.component_id AS kept
FROM t JOIN (SELECT a, min(r) AS component_id FROM reach GROUP BY 1) m ON m.a = t.doc_id
LEFT JOIN n ON n.doc_id = t.doc_id
"""


@register("op4_near_duplicates", OP4_SQL)
def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import minhash
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4)


OP5_SQL = r"""
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(
             coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
p AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 12), ' ') AS g
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM t WHERE len(ws) >= 13)),
f AS (SELECT g, min(doc_id) AS d FROM p GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, i + k AS j FROM p JOIN f USING (g), range(0, 13) AS x(k)
         WHERE f.d < p.doc_id),
w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM t),
kept AS (SELECT w.doc_id, string_agg(word, ' ' ORDER BY w.j) AS txt, COUNT(*) AS n
         FROM w LEFT JOIN gone ON gone.doc_id = w.doc_id AND gone.j = w.j
         WHERE gone.j IS NULL GROUP BY 1)
SELECT t.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
       CAST(len(ws) - coalesce(kept.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.txt, '')) AS kept_sha256
FROM t LEFT JOIN kept USING (doc_id)
"""


@register("op5_substring_dedup", OP5_SQL)
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import substrings
    return substrings.repeated_words(table(spark, sf_dir, "documents"))


@register("op2_nearest_neighbours")
def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from . import ann
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20)


@register("op8_ngram_scores")
def op8_ngram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import ngrams
    return ngrams.score(table(spark, sf_dir, "documents"))


# CRC-32 in SQL: the table follows from the polynomial, the bytes from the hexadecimal form.
CRC_SQL = r"""
crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k:
      CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c
    FROM range(256) AS r(i)))"""


def crc_sql(text: str) -> str:
    """SQL of the unsigned CRC-32 of a text's UTF-8 bytes (needs ``crc_table`` in scope)."""
    bytes_ = (f"list_transform(range(strlen({text})), lambda i: "
              f"CAST('0x' || substr(hex(encode({text})), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))")
    return (f"xor(list_reduce(list_prepend(4294967295, {bytes_}), lambda c, b: "
            "xor(c // 256, t[CAST(xor(c % 256, b) + 1 AS BIGINT)])), 4294967295)")


OP11_SQL = rf"""
WITH {CRC_SQL.strip()},
b AS (SELECT doc_id, source, coalesce(text, '') AS txt,
        CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size,
        md5('interleave-1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS mix FROM documents),
s AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY mix, doc_id) - 1 AS r,
        count(*) OVER (PARTITION BY source) AS n FROM b),
p AS (SELECT *, row_number() OVER (ORDER BY (r + 0.5::DOUBLE) / n, source NULLS FIRST, mix, doc_id)
        - 1 AS pos, count(*) OVER () AS total FROM s)
SELECT doc_id, size, CAST({crc_sql("txt")} AS BIGINT) AS text_crc32, 'rows' AS law,
  CAST(pos * 8 // total AS INTEGER) AS shard,
  CAST(pos - ((pos * 8 // total) * total + 7) // 8 AS BIGINT) AS slot,
  CAST(NULL AS INTEGER) AS grown_shard
FROM p, crc_table
"""


@register("op11_interleaving", OP11_SQL)
def op11_interleaving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 8 shards by the law ``rows``."""
    from pyspark.sql import functions as F

    from . import interleave
    placed = interleave.interleave(table(spark, sf_dir, "documents"), shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


OP12_SQL = r"""
WITH p AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, regexp_split_to_array(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[.,;:!?\x0A-\x0D]') AS ps FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(x, '[\x20\x09]+'), lambda y: y <> '') AS ws
      FROM (SELECT lang, unnest(ps) AS x FROM p)),
g AS (SELECT lang, m, array_to_string(list_slice(ws, i, i + m - 1), ' ') AS g, ws[i] AS w1,
             array_to_string(list_slice(ws, i + 1, i + m - 1), ' ') AS suffix,
             array_to_string(list_slice(ws, i, i + m - 2), ' ') AS prefix, ws[i + m - 1] AS wm
      FROM (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i
            FROM w, range(1, 4) AS r(m) WHERE len(ws) >= m)),
f AS (SELECT lang, m, g, any_value(w1) AS w1, any_value(suffix) AS suffix,
             any_value(prefix) AS prefix, any_value(wm) AS wm, count(*) AS a FROM g GROUP BY 1, 2, 3),
n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY 1),
c AS (SELECT * FROM f WHERE m >= 2 AND a >= 10),
cuts AS (SELECT c.lang, c.m, c.g, c.a, 1 AS k, x.a AS l, y.a AS r FROM c
           JOIN f x ON x.lang = c.lang AND x.g = c.w1 JOIN f y ON y.lang = c.lang AND y.g = c.suffix
         UNION ALL
         SELECT c.lang, c.m, c.g, c.a, 2, x.a, y.a FROM c
           JOIN f x ON x.lang = c.lang AND x.g = c.prefix JOIN f y ON y.lang = c.lang AND y.g = c.wm
         WHERE c.m = 3),
s AS (SELECT *, CAST(1000000::HUGEINT * a * a // (CAST(l AS HUGEINT) * r) AS BIGINT) AS score
      FROM cuts),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
inside AS (SELECT lang, prefix AS g, a FROM c WHERE m = 3
           UNION ALL SELECT lang, suffix, a FROM c WHERE m = 3),
big AS (SELECT lang, g, max(a) AS a FROM inside GROUP BY 1, 2),
kept AS (SELECT best.* FROM best LEFT JOIN big ON big.lang = best.lang AND big.g = best.g
         WHERE big.a IS NULL OR 100 * big.a < 50 * best.a),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank FROM kept)
SELECT lang, CAST(rank AS BIGINT) AS rank, g AS phrase, CAST(a AS BIGINT) AS a,
       CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, score
FROM o JOIN n USING (lang) WHERE rank <= 2000
"""


@register("op12_collocations", OP12_SQL)
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import collocations
    return collocations.top(collocations.mine(table(spark, sf_dir, "documents")))


OP13_SQL = rf"""
WITH {CRC_SQL.strip()},
t0 AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'),
              lambda x: x <> '') AS ws, CAST(doc_id AS VARCHAR) AS id FROM documents),
t1 AS (SELECT doc_id, ws, len(ws) AS n, CAST({crc_sql("id")} AS BIGINT) AS h FROM t0, crc_table),
t2 AS (SELECT doc_id, ws, n, h, h // 10 AS g, CASE WHEN n > 0 THEN (h // 10) % n END AS a FROM t1),
t3 AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM t2),
d AS (SELECT doc_id, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i:
               ws[CASE WHEN i >= a THEN a + (i - a) % p ELSE i END + 1]) ELSE ws END AS ws, n
      FROM t3),
w AS (SELECT doc_id, unnest(ws) AS w, unnest(range(n)) AS i FROM d),
e AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM w x JOIN w y
        ON x.doc_id = y.doc_id AND x.w = y.w AND y.i > x.i),
s AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS isle FROM e),
c AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS len FROM s GROUP BY doc_id, q, isle
      HAVING count(*) + q >= greatest(24, 3 * q)),
r AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c z WHERE z.doc_id = c.doc_id AND z.q < c.q
        AND z.s <= c.s AND z.s + z.len >= c.s + c.len)),
best AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY
           CAST(len AS DOUBLE) / q DESC, s, q) = 1),
runs AS (SELECT doc_id, count(*) AS n_runs,
           string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS txt
         FROM r GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + len)) AS i FROM r),
kept AS (SELECT w.doc_id, string_agg(w.w, ' ' ORDER BY w.i) AS txt FROM w
         ANTI JOIN gone ON gone.doc_id = w.doc_id AND gone.i = w.i GROUP BY w.doc_id)
SELECT d.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(best.s AS BIGINT) AS start,
  CAST(best.len AS BIGINT) AS length, CAST(best.q AS BIGINT) AS period,
  CAST(1000 * best.len // best.q AS BIGINT) AS exponent_milli,
  sha256(coalesce(runs.txt, '')) AS runs_sha256, sha256(coalesce(kept.txt, '')) AS collapsed_sha256
FROM d LEFT JOIN best USING (doc_id) LEFT JOIN runs USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def with_periods(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` with the periodic ends that the query's contract prescribes for a
    tenth of the documents."""
    from pyspark.sql import functions as F

    words = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("ws"))
    marks = (chosen.withColumn("n", F.size("ws")).withColumn("g", F.expr("h div 10"))
             .withColumn("a", F.expr("CASE WHEN n > 0 THEN g % n END"))
             .withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)")))
    return marks.select("doc_id", F.expr(
        "CASE WHEN a IS NULL THEN text ELSE array_join(transform(sequence(0, n - 1), i -> "
        "ws[int(IF(i >= a, a + (i - a) % p, i))]), ' ') END").alias("text"))


@register("op13_periodic_runs", OP13_SQL)
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from . import periodic
    found = periodic.find_runs(with_periods(table(spark, sf_dir, "documents")))
    line = lambda x: F.concat(F.concat_ws(
        ",", *[x[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))
    best = found.withColumn("best", periodic.best_run())
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"),
        F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
