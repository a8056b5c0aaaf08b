"""Inputs of the registered queries, derived from the given tables.

Every fixture exists twice: as a DataFrame and as a SQL common table expression.
Both use whole tables and whole texts. Times are integer milliseconds until the
API edge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.operators import scan
from lectern.operators.stage import stage


def undealt(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table as it lies, for what takes a little of each row."""
    return spark.read.parquet(f"{sf}/{name}.parquet")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    rows = undealt(spark, sf, name)
    if name != "documents":
        return rows
    # texts are dealt by document at once, which what follows would do with their lines: windows
    # over the lines of a document find them together
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return rows.repartition(parts, "doc_id")


# ------------------------------------------------------------------ segments


def segments(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of every document as timed segments, 400 ms a word.

    The window runs over the lines of one document, that is, of one cell.
    """
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("source_id"), "text")
    lines = docs.select("source_id", F.posexplode(F.split("text", "\n")).alias("seq", "line"))
    lines = lines.select(
        "source_id", "seq", F.trim("line").alias("text"),
        F.regexp_count("line", F.lit(r"[^\s]+")).alias("nw"),
    ).where(F.col("text") != "")
    upto = W.partitionBy("source_id").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    timed = lines.withColumn("start_ms", 400 * F.coalesce(F.sum("nw").over(upto), F.lit(0)))
    pause = F.when((F.col("seq") % 5 == 0) & (F.col("nw") >= 5), 1000).otherwise(0)
    timed = timed.withColumn("end_ms", F.col("start_ms") + 400 * F.col("nw") - pause)
    return timed.select(
        "source_id", "seq", "text",
        (F.col("start_ms") / F.lit(1000.0)).alias("start"),
        (F.col("end_ms") / F.lit(1000.0)).alias("end"),
        "nw", "start_ms", "end_ms",
    )


SEGMENTS = r"""
lines AS (
  SELECT doc_id AS source_id, CAST(pos - 1 AS INTEGER) AS seq, trim(line, ' ') AS text,
         CAST(len(regexp_extract_all(line, '[^\s]+')) AS INTEGER) AS nw
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
               generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)
  WHERE trim(line, ' ') <> ''),
timed AS (
  SELECT *, CAST(400 * coalesce(sum(nw) OVER (PARTITION BY source_id ORDER BY seq
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_ms FROM lines),
segments AS (
  SELECT source_id, seq, text, nw, start_ms,
         start_ms + 400 * nw - CASE WHEN seq % 5 = 0 AND nw >= 5 THEN 1000 ELSE 0 END AS end_ms,
         CAST(start_ms AS DOUBLE) / 1000 AS start,
         CAST(start_ms + 400 * nw - CASE WHEN seq % 5 = 0 AND nw >= 5 THEN 1000 ELSE 0 END
              AS DOUBLE) / 1000 AS "end"
  FROM timed)"""


def worn_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Segments whose case or punctuation is lost in some sources."""
    rows = segments(spark, sf)
    text = F.when(F.col("source_id") % 3 == 0, F.lower("text")).otherwise(F.col("text"))
    text = F.when(
        F.col("source_id") % 6 == 0, F.regexp_replace(text, "[.!?]", "")
    ).otherwise(text)
    return rows.withColumn("text", text)


WORN = SEGMENTS + r""",
worn AS (
  SELECT source_id, seq, start, "end", start_ms, end_ms, nw,
    CASE WHEN source_id % 6 = 0 THEN regexp_replace(lower(text), '[.!?]', '', 'g')
         WHEN source_id % 3 = 0 THEN lower(text) ELSE text END AS text
  FROM segments)"""


def marks(spark: SparkSession, sf: str, rows: DataFrame | None = None) -> DataFrame:
    """Candidate topic marks: every line of twelve words or more opens one."""
    rows = segments(spark, sf) if rows is None else rows
    return rows.where("nw >= 12").select(
        "source_id", "seq", F.col("start").alias("ts"),
        F.concat(F.lit("T"), F.col("seq").cast("string")).alias("title"),
    )


def study_tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Segments, marks and sources from one written copy of the segments."""
    rows = stage(segments(spark, sf))
    return rows, marks(spark, sf, rows), sources(spark, sf, rows)


MARKS = SEGMENTS + r""",
marks AS (
  SELECT source_id, seq, start AS ts, start_ms AS ts_ms, 'T' || CAST(seq AS VARCHAR) AS title
  FROM segments WHERE nw >= 12)"""


def sources(spark: SparkSession, sf: str, rows: DataFrame | None = None) -> DataFrame:
    """One row per source with a title and its end."""
    rows = segments(spark, sf) if rows is None else rows
    return rows.groupBy("source_id").agg(
        F.concat(F.lit("Doc "), F.col("source_id").cast("string")).alias("title"),
        F.max_by("end", "seq").alias("end_of_source"),
        F.max_by("end", "seq").alias("duration"),
    )


SOURCES = r"""
sources AS (
  SELECT source_id, 'Doc ' || CAST(source_id AS VARCHAR) AS title,
         max_by("end", seq) AS end_of_source, max_by("end", seq) AS duration
  FROM segments GROUP BY source_id)"""


# -------------------------------------------------------------------- terms

TERM_EXPR = """CASE seq % 3 WHEN 0 THEN translate(upper(replace(split_part(text, ' ', 1), 'ß', 'ss')), 'I', 'İ')
       WHEN 1 THEN lower(split_part(text, ' ', 1)) ELSE split_part(text, ' ', 1) END"""


def terms(spark: SparkSession, sf: str, rows: DataFrame | None = None) -> DataFrame:
    """First word of every line as a term, in changing case, Turkish letters included."""
    rows = segments(spark, sf) if rows is None else rows
    return rows.selectExpr(
        "source_id", "seq AS pos", f"{TERM_EXPR} AS term", "'d' || CAST(seq AS STRING) AS definition"
    )


TERMS = SEGMENTS + f""",
terms AS (
  SELECT source_id, seq AS pos, {TERM_EXPR} AS term, 'd' || CAST(seq AS STRING) AS definition
  FROM segments)"""

# --------------------------------------------------------------------- jobs

_K = "o_orderkey"
_TXT = f"CAST({_K} AS STRING)"
ERROR_TEXT = f"""CASE {_K} % 11
  WHEN 0 THEN 'Groq 502 Bad Gateway' WHEN 1 THEN 'groq: transkripsiyon başarısız'
  WHEN 2 THEN 'HTTP 429 Too Many Requests' WHEN 3 THEN 'Kota doldu'
  WHEN 4 THEN 'youtube says: are you a bot?' WHEN 5 THEN 'Postprocessing: Conversion failed'
  WHEN 6 THEN 'yt-dlp: unable to download' WHEN 7 THEN 'Kaynakta ses akışı yok'
  WHEN 8 THEN 'ffprobe exited with 1' WHEN 9 THEN 'Hiçbir sayfadan güvenilir metin çıkmadı'
  ELSE 'disk ' || o_orderpriority END"""
JOB_COLUMNS = [
    f"'j' || {_TXT} AS id",
    f"""CASE {_K} % 6 WHEN 0 THEN 'done' WHEN 1 THEN 'running' WHEN 2 THEN 'queued'
        WHEN 3 THEN 'waiting' WHEN 4 THEN 'error' ELSE 'done' END AS status""",
    f"""CASE {_K} % 6 WHEN 0 THEN 'done' WHEN 1 THEN 'transcribe' WHEN 2 THEN 'queued'
        WHEN 3 THEN 'awaiting_download' WHEN 4 THEN 'error' ELSE 'done' END AS stage""",
    f"'https://' || lower(c_mktsegment) || '.example.org/v/' || {_TXT} AS source",
    f"CASE WHEN {_K} % 2 = 0 THEN 'https://example.org/w?v=' || {_TXT} END AS origin_url",
    f"""CASE {_K} % 7 WHEN 0 THEN 'playlist — Tüm hali'
        WHEN 1 THEN c_name || ' — Part 3 (60-90dk)' WHEN 2 THEN 'Video'
        WHEN 3 THEN c_name || ': a/b?  x' WHEN 4 THEN ''
        WHEN 5 THEN 'Ders — ' || c_mktsegment || ' — Tüm hali' ELSE c_name END AS title""",
    f"""CASE {_K} % 4 WHEN 0 THEN 'groq' WHEN 1 THEN 'openrouter' WHEN 2 THEN 'anthropic'
        ELSE 'gemini' END AS provider""",
    f"""CASE WHEN {_K} % 7 = 0 THEN NULL WHEN {_K} % 11 = 0 THEN '' ELSE c_mktsegment
        END AS collection""",
    f"CASE WHEN {_K} % 6 = 4 THEN {ERROR_TEXT} END AS error",
    f"""CASE WHEN {_K} % 5 = 0
        THEN '{{"is_combined":true,"topics":["' || c_mktsegment || '","t'
             || CAST({_K} % 3 AS STRING) || '"]}}'
        ELSE '{{"part_of":"j' || CAST({_K} - {_K} % 5 AS STRING) || '","topics":["t'
             || CAST({_K} % 4 AS STRING) || '","","' || c_mktsegment || '"]}}' END AS meta""",
    f"CASE WHEN {_K} % 3 = 0 THEN 'https://ref.example/' || c_name END AS referer",
    f"CASE WHEN {_K} % 3 = 1 THEN 'yerel' END AS transkript",
    f"{_K} AS k",
]


def jobs(spark: SparkSession, sf: str) -> DataFrame:
    """One job per order; every fifth is a parent of the four after it."""
    orders, customers = table(spark, sf, "orders"), table(spark, sf, "customer")
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    created = "o_orderdate + make_dt_interval(0, 0, 0, o_orderkey)"
    return joined.selectExpr(
        *JOB_COLUMNS, f"CAST({created} AS TIMESTAMP_NTZ) AS created_at",
        f"CAST({created} AS TIMESTAMP_NTZ) AS updated_at",
    )


JOBS = f"""
jobs AS (
  SELECT {', '.join(JOB_COLUMNS)}, o_orderdate + to_seconds(o_orderkey) AS created_at,
         o_orderdate + to_seconds(o_orderkey) AS updated_at
  FROM orders JOIN customer ON o_custkey = c_custkey)"""

_OWNER = f"'j' || CAST(CASE WHEN {_K} % 17 = 0 THEN {_K} + 20000000 ELSE {_K} END AS STRING)"


def files(spark: SparkSession, sf: str) -> DataFrame:
    """Four stored files per order; some belong to jobs nobody knows."""
    return table(spark, sf, "orders").selectExpr(
        f"{_OWNER} AS o", f"{_K} AS k",
        "explode(array('.md', '.transcript.txt', '_frames', '_pages')) AS s",
    ).selectExpr("o || s AS name", "CAST(1000 + k % 977 + length(s) AS BIGINT) AS bytes")


FILES = f"""
files AS (
  SELECT o || s AS name, CAST(1000 + k % 977 + length(s) AS BIGINT) AS bytes
  FROM (SELECT {_OWNER} AS o, {_K} AS k,
               unnest(['.md', '.transcript.txt', '_frames', '_pages']) AS s FROM orders))"""


def note_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Jobs that have a note: those of orders over 50,000."""
    return table(spark, sf, "orders").where("o_totalprice > 50000").selectExpr(
        f"'j' || {_TXT} AS id", f"'# Note {{}}' || {_TXT} || ' \n\n## Detaylı Özet\n\nx' AS markdown"
    )


NOTES = f"""
notes AS (
  SELECT 'j' || {_TXT} AS id,
         '# Note {{}}' || {_TXT} || ' ' || chr(10) || chr(10) || '## Detaylı Özet' || chr(10) || chr(10) || 'x' AS markdown
  FROM orders WHERE o_totalprice > 50000)"""

# ------------------------------------------------------------------- events


def events(spark: SparkSession, sf: str) -> DataFrame:
    """Events with their time as whole microseconds and seconds."""
    rows = table(spark, sf, "events")
    us = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"
    return rows.selectExpr(
        "event_id", "user_id", "event_type", "value", f"{us} AS us", f"{us} div 1000000 AS seconds",
        "CAST(ts AS TIMESTAMP) AS ts",
    )


EVENTS = """
ev AS (
  SELECT event_id, user_id, event_type, value, epoch_us(ts) AS us,
         epoch_us(ts) // 1000000 AS seconds, ts FROM events)"""


def silence_log(spark: SparkSession, sf: str) -> DataFrame:
    """Detector lines: some events open a silence, some close one, the rest is noise."""
    rows = events(spark, sf)
    begun = rows.groupBy("user_id").agg(F.min("seconds").alias("first"))
    cut = rows.withColumn("_block", scan.block_of(F.col("seconds"), 86_400))
    at = scan.number_rows(cut, ["user_id"], ["us", "event_id"], "_block", "line_no")
    return at.join(begun, "user_id").selectExpr(
        "user_id AS source_id", "CAST(line_no AS INT) AS line_no", f"{_SILENCE} AS line"
    )


_AT = "CAST((seconds - first) {div} 600 AS STRING)"
_SILENCE = f"""CASE WHEN event_type IN ('error', 'signup') THEN '[x] silence_start: ' || {_AT.format(div='div')}
  WHEN event_type = 'click' THEN '[x] silence_end: ' || {_AT.format(div='div')} || ' | silence_duration: 2'
  ELSE 'frame=' || CAST(event_id AS STRING) END"""

SILENCE_LOG = EVENTS + f""",
silence_log AS (
  SELECT user_id AS source_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) - 1 AS INTEGER) AS line_no,
    {_SILENCE.replace(' div ', ' // ')} AS line
  FROM (SELECT *, min(seconds) OVER (PARTITION BY user_id) AS first FROM ev)),
kept_lines AS (
  SELECT source_id, line_no,
    TRY_CAST(nullif(regexp_extract(line, 'silence_start:\\s*(-?[\\d.]+)', 1), '') AS DOUBLE) AS s,
    TRY_CAST(nullif(regexp_extract(line, 'silence_end:\\s*([\\d.]+)', 1), '') AS DOUBLE) AS e
  FROM silence_log),
silences AS (
  SELECT source_id, greatest(s, 0.0) AS start,
         CASE WHEN n = 0 THEN CAST('Infinity' AS DOUBLE) ELSE next_e END AS "end"
  FROM (SELECT *, lead(e) OVER w AS next_e,
               count(*) OVER (PARTITION BY source_id ORDER BY line_no
                              ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS n
        FROM kept_lines WHERE s IS NOT NULL OR e IS NOT NULL
        WINDOW w AS (PARTITION BY source_id ORDER BY line_no))
  WHERE s IS NOT NULL AND (n = 0 OR next_e IS NOT NULL))"""

# -------------------------------------------------------------------- words

_CONF = """(source_id * 37 + frame_idx * 53 + widx * 11 + rotation * 7) % 101
           - CASE WHEN widx % 9 = 0 THEN 200 ELSE 0 END"""


def ocr_words(spark: SparkSession, sf: str) -> DataFrame:
    """Every line as a screen, every token a word, read at four angles."""
    lines = segments(spark, sf).select("source_id", F.col("seq").alias("frame_idx"), "text")
    words = lines.select(
        "source_id", "frame_idx", F.posexplode(F.split("text", " ")).alias("widx", "word")
    ).withColumn("rotation", F.explode(F.array(*[F.lit(r) for r in (0, 90, 180, 270)])))
    return words.withColumn("conf", F.expr(f"CAST({_CONF} AS INT)"))


WORDS = SEGMENTS + f""",
words AS (
  SELECT source_id, frame_idx, widx, word, rotation, CAST({_CONF} AS INTEGER) AS conf
  FROM (SELECT source_id, seq AS frame_idx, unnest(string_split(text, ' ')) AS word,
               generate_subscripts(string_split(text, ' '), 1) - 1 AS widx FROM segments)
  CROSS JOIN (SELECT unnest([0, 90, 180, 270]) AS rotation)),
reads AS (
  SELECT source_id, frame_idx, rotation,
         coalesce(string_agg(trim(word), ' ' ORDER BY widx)
           FILTER (WHERE conf >= 0 AND trim(word) <> ''), '') AS text,
         CAST(median(conf) FILTER (WHERE conf >= 0 AND trim(word) <> '') AS DOUBLE) AS conf
  FROM words GROUP BY ALL),
ranked AS (
  SELECT r.*, b.conf AS base FROM reads r
  JOIN reads b ON b.source_id = r.source_id AND b.frame_idx = r.frame_idx AND b.rotation = 0),
best AS (
  SELECT source_id, frame_idx, text, conf, rotation FROM (
    SELECT *, row_number() OVER (PARTITION BY source_id, frame_idx
      ORDER BY conf DESC NULLS LAST, rotation) AS rn
    FROM ranked WHERE rotation = 0 OR base < 60) WHERE rn = 1),
frames AS (
  SELECT b.source_id, b.frame_idx, s.start AS ts,
         CASE WHEN conf < 60 THEN '' ELSE b.text END AS text,
         round_even(conf, 1) AS conf, rotation, conf < 60 AS quarantined,
         'f/' || CAST(b.source_id AS VARCHAR) || '_' || CAST(b.frame_idx AS VARCHAR) || '.jpg' AS path
  FROM best b JOIN segments s ON s.source_id = b.source_id AND s.seq = b.frame_idx
  WHERE conf IS NOT NULL AND length(b.text) >= 15)"""
