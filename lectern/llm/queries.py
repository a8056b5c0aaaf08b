"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    grades, language, mixing, packing, parity_join, resampling, rules, suffix_tree, suffixes, toxicity,
    tries, variants, windows,
)
from .features import held_out

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Callable) -> Callable:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# --- 1 --------------------------------------------------------------------------

TOXIC = 0.3


@query("op1_toxicity")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    lexicons, _, classifier = toxicity.train(docs, labels(spark, sf_dir), ~held_out())
    return toxicity.score(docs, lexicons, classifier).select(
        F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "score",
        F.when(F.col("score") >= TOXIC, 1).otherwise(0).alias("predicted"))


# --- 2 --------------------------------------------------------------------------

MIX_POWER, MIX_SEED = 0.5, 20
_MIX_SQL = f"""
WITH s AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
r AS (
  SELECT source, (SELECT sum(n) FROM s)::DOUBLE
         * (pow(n::DOUBLE, {MIX_POWER}) / (SELECT sum(pow(n::DOUBLE, {MIX_POWER})) FROM s)) / n AS rate
  FROM s
), c AS (
  SELECT source, greatest(ceil(rate / {mixing.STEP}), 1)::BIGINT AS parts,
         rate / greatest(ceil(rate / {mixing.STEP}), 1) AS mean
  FROM r
), f AS (
  SELECT source, parts, k, sum(exp(-mean + k * ln(mean) - lgamma(k + 1)))
         OVER (PARTITION BY source ORDER BY k) AS cdf
  FROM c, (SELECT unnest(range(0, {mixing.TERMS})) AS k)
), t AS (SELECT source, parts, list(cdf ORDER BY k) AS cdf FROM f GROUP BY source, parts),
d AS (
  SELECT doc_id, text, lang, d.source, n_chars, cdf, parts,
         coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, ''))) AS who
  FROM documents d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), u AS (
  SELECT *, list_sum(list_transform(range(1, parts + 1), lambda p: len(list_filter(cdf, lambda x:
      x <= (('0x' || substr(md5('{MIX_SEED}:' || who || ':' || p), 1, {mixing.DIGITS}))::BIGINT + 0.5)
           / {16**mixing.DIGITS}.0)))) AS n
  FROM d
), e AS (SELECT *, unnest(range(0, n::BIGINT)) AS k FROM u)
SELECT doc_id, text, lang, source, n_chars, CAST(k AS INTEGER) AS copy,
       substr(md5('place {MIX_SEED}:' || who || ':' || k), 1, 16) AS place
FROM e
"""


@query("op2_mix_sources", _MIX_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return mixing.mix(docs, mixing.temper(docs, MIX_POWER), seed=MIX_SEED)


# --- 3 --------------------------------------------------------------------------


@query("op3_suffix_array_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.dedup_bytes(documents(spark, sf_dir)).drop("spans").withColumnRenamed("id", "doc_id")


# --- 4 --------------------------------------------------------------------------


@query("op4_best_fit_packing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(
        documents(spark, sf_dir), tokenizer_path()).withColumnRenamed("id", "doc_id")


# --- 5 --------------------------------------------------------------------------


@query("op5_language_id")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    network = language.train(docs.select("doc_id", "text", "lang"), ~held_out())
    return language.identify(docs.select("doc_id", "text"), network).select(
        F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "lang_pred", "score")


# --- 6 --------------------------------------------------------------------------


@query("op6_ngram_jaccard_join")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join.components(documents(spark, sf_dir), 90, 100, 3).select(
        F.col("id").alias("doc_id"), "n_shingles", "component_id")


# --- 7 --------------------------------------------------------------------------


@query("op7_substring_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.dedup_windows(documents(spark, sf_dir)).drop("spans").withColumnRenamed("id", "doc_id")


# --- 8 --------------------------------------------------------------------------


@query("op8_quality_classifier")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades of ``labels``: 0 poor, 1 good but toxic, 2 good; a text of grade 1 at least is selected."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    graded = labels(spark, sf_dir).select("doc_id", F.when(F.col("quality") == 0, 0).when(
        F.col("toxic") == 1, 1).otherwise(2).alias("rating"))
    model = grades.train(docs, graded, ~held_out(), grades=3)
    return grades.grade(docs, model, tail=1).select(
        F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "expected_grade",
        "tail_probability", "selected")


# --- 9 --------------------------------------------------------------------------

_EXACT_SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC) = 1 AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""


@query("op9_exact_dedup", _EXACT_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.groups(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


# --- 10 -------------------------------------------------------------------------

_PHRASES = " OR ".join(f"contains(lower(x), '{p}')" for p in rules.BOILERPLATE)
_RULES_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)),
                     lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
  FROM documents
), g AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), r AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1
), c AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
  FROM r, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id
), m AS (
  SELECT d.doc_id, t, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '{rules.NOT_SYMBOL}', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words,
         list_filter(l, lambda x:
           length(regexp_replace(x, '{rules.NOT_SYMBOL}', '', 'g')) > length(x) * {rules.SYMBOL_SHARE}
           OR regexp_matches(x, '{rules.NAVIGATION}')
           OR (length(x) >= {rules.CAPITALS} AND x = upper(x) AND x <> lower(x))
           OR (NOT regexp_matches(x, '{rules.SENTENCE_MARK}')
               AND len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+')) >= {rules.LONG_LINE})
           OR {_PHRASES}) AS bad
  FROM d LEFT JOIN c ON c.doc_id = d.doc_id
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         length(regexp_replace(array_to_string(bad, ''), '[\\x20\\x09-\\x0D]+', '', 'g')) AS lost
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND lost <= word_chars * {rules.MAX_LOSS} AS kept,
       CAST(len(bad) AS BIGINT) AS n_lines_removed
FROM b
"""


@query("op10_quality_rules", _RULES_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.judge(documents(spark, sf_dir).select("doc_id", "text"))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
              "base_failed", "kept", "n_lines_removed")
    return judged.select("doc_id", *[F.col(f"quality.{c}").alias(c) for c in counts])


# --- 11 -------------------------------------------------------------------------


@query("op11_suffix_tree_scores")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return suffix_tree.lm_scores(docs, ~held_out(of=7)).select(
        F.col("id").alias("doc_id"), held_out("id", of=7).alias("held_out"), "n_tokens", "n_known",
        "train_tokens", "base_score", "score")


# --- 12 -------------------------------------------------------------------------

# CRC-32 in SQL: its table of 256 remainders by rule, and the checksum of bytes given in hexadecimal
_CRC_TABLE = """
tab AS (
  SELECT list(list_reduce(list_concat([i], range(0, 8)), lambda a, b:
    CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) AS t
  FROM (SELECT unnest(range(0, 256)) AS i)
)"""
_CRC = """xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(0, length(h) // 2),
      lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
      lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])))"""
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_VARIANTS_SQL = f"""
WITH RECURSIVE {_CRC_TABLE}, o AS (
  SELECT doc_id, {_LOWER.format('run')} AS run
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents)
), c AS (
  SELECT run, {_CRC} AS h FROM (SELECT run, hex(encode(doc_id || ':' || run)) AS h FROM o), tab
), w AS MATERIALIZED (
  SELECT word, count(*) AS n FROM (
    SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2)
           ELSE run END AS word FROM c)
  WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2
), k AS (
  SELECT word, n, substr(word, 1, i) || substr(word, i + 2) AS less,
         substr(word, 1, i) || '_' || substr(word, i + 2) AS gap
  FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM w)
), near AS (
  SELECT a.word, b.word AS other, b.n AS m FROM k a JOIN k b ON a.gap = b.gap AND a.word <> b.word
  UNION SELECT k.word, w.word, w.n FROM k JOIN w ON k.less = w.word
  UNION SELECT w.word, k.word, k.n FROM k JOIN w ON k.less = w.word
), best AS (
  SELECT word, count(*) AS n_near, max(m) AS m, arg_min(other, (-m, encode(other))) AS other FROM near GROUP BY word
), f AS (
  SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * n THEN other END AS form,
         CASE WHEN m >= 10 * n THEN m END AS form_n
  FROM w LEFT JOIN best ON best.word = w.word
), r AS (
  SELECT word, word AS root FROM f WHERE form IS NULL
  UNION ALL SELECT f.word, r.root FROM f JOIN r ON f.form = r.word
)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN r ON r.word = f.word
"""


@query("op12_spelling_variants", _VARIANTS_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variant_forms(documents(spark, sf_dir).select("doc_id", "text"), slip=31)


# --- 13 -------------------------------------------------------------------------

_TARGET_WORDS = f"regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_RESAMPLING_SQL = f"""
WITH {_CRC_TABLE}, d AS (SELECT doc_id, {_TARGET_WORDS} AS w FROM documents),
o AS (SELECT doc_id, unnest(w) AS w FROM d),
q AS (SELECT unnest({_TARGET_WORDS}) AS w FROM benchmark),
v AS MATERIALIZED (
  SELECT w, {_CRC} % 10000 AS b
  FROM (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM o UNION SELECT w FROM q)), tab
), s AS (SELECT b, count(*) AS n FROM o JOIN v USING (w) GROUP BY b),
t AS (SELECT b, count(*) AS n FROM q JOIN v USING (w) GROUP BY b),
x AS (
  SELECT a.b, coalesce(s.n, 0) AS s, coalesce(t.n, 0) AS t,
         sum(coalesce(s.n, 0)) OVER () AS all_s, sum(coalesce(t.n, 0)) OVER () AS all_t
  FROM (SELECT unnest(range(0, 10000)) AS b) a LEFT JOIN s ON s.b = a.b LEFT JOIN t ON t.b = a.b
), g AS (
  SELECT b, floor(1000 * ln(((t + 1)::DOUBLE * (all_s + 10000)::DOUBLE)
                            / ((s + 1)::DOUBLE * (all_t + 10000)::DOUBLE)))::BIGINT AS gain FROM x
), p AS (SELECT doc_id, sum(gain)::BIGINT AS weight FROM o JOIN v USING (w) JOIN g USING (b) GROUP BY doc_id),
r AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln(
           (('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT + 0.5) / 4294967296)))::BIGINT AS score
  FROM d LEFT JOIN p ON p.doc_id = d.doc_id
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND k <= 10 * n // 100 THEN k END AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS k,
             count(*) FILTER (n_features >= 20) OVER () AS n FROM r)
"""


@query("op13_target_resampling", _RESAMPLING_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return resampling.resample(documents(spark, sf_dir).select("doc_id", "text"), target).select(
        F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")
