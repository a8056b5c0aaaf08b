"""Sources, sinks and choices between producers."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.operators import pages as pages_ops
from lectern.operators.stage import stage
from lectern.plans import notes as notes_plan
from lectern.sources import captions, documents, jobs as jobs_source, sinks, speech

from . import fixtures as fx
from .q_scalars import ts_sql
from .q_screen import PAGES, gated
from .registry import cte, query


def caption_bodies(spark, sf):
    """Caption files: text in two pieces, rolling repeats, events without text."""
    rows = fx.segments(spark, sf)
    half = F.expr("CAST(length(text) div 2 AS INT)")
    pieces = F.array(
        F.struct(F.substr("text", F.lit(1), half).alias("utf8")),
        F.struct(F.substr("text", half + 1).alias("utf8")),
    )
    event = F.struct(
        F.col("start_ms").alias("tStartMs"), (F.col("end_ms") - F.col("start_ms")).alias("dDurationMs"),
        F.when(F.expr("seq % 9 <> 0"), pieces).alias("segs"),
    )
    repeat = F.struct(F.col("start_ms").alias("tStartMs"), F.lit(1).alias("aAppend"), pieces.alias("segs"))
    both = F.when(
        F.expr("seq % 4 = 0"), F.concat(F.to_json(event), F.lit(","), F.to_json(repeat))
    ).otherwise(F.to_json(event))
    listed = F.sort_array(F.collect_list(F.struct("seq", both.alias("e"))))
    return rows.groupBy("source_id").agg(
        F.concat(
            F.lit('{"wireMagic":"pb3","events":['),
            F.array_join(F.transform(listed, lambda c: c["e"]), ","), F.lit("]}"),
        ).alias("body")
    )


@query("a1_read_captions", cte(fx.SEGMENTS) + r"""
SELECT source_id, start, start + CAST(end_ms - start_ms AS DOUBLE) / 1000 AS "end",
       trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM segments WHERE seq % 9 <> 0""")
def a1(spark, sf):
    return captions.parse_captions(caption_bodies(spark, sf)).select("source_id", "start", "end", "text")


@query("a1_caption_errors", cte(fx.SEGMENTS) + """
SELECT source_id, 'Altyazı dosyası boş çözümlendi.' AS error FROM segments GROUP BY source_id
HAVING count(*) FILTER (WHERE seq % 9 <> 0) = 0""")
def a1e(spark, sf):
    bodies = stage(caption_bodies(spark, sf))
    return captions.caption_errors(bodies, captions.parse_captions(bodies))


@query("a2_write_captions", cte(fx.SEGMENTS) + """
SELECT source_id, CAST(0 AS BIGINT) AS piece, '{"events":[' || string_agg('{"tStartMs":' || CAST(CAST(trunc(start * 1000) AS BIGINT) AS VARCHAR)
  || ',"dDurationMs":' || CAST(CAST(trunc(greatest(0, "end" - start) * 1000) AS BIGINT) AS VARCHAR)
  || ',"segs":[{"utf8":' || CAST(to_json(text) AS VARCHAR) || '}]}', ',' ORDER BY start, seq) || ']}' AS body
FROM segments GROUP BY source_id""")
def a2(spark, sf):
    return captions.caption_json(fx.segments(spark, sf))


# ---------------------------------------------------------------- speech chunks

CHUNKS = """
cut AS (SELECT *, start_ms // 60000 AS chunk_idx FROM segments),
chunks AS (SELECT source_id, unnest(range(n + 1)) AS chunk_idx FROM (SELECT source_id, max(chunk_idx) AS n FROM cut GROUP BY source_id)),
offsets AS (
  SELECT source_id, chunk_idx, CASE WHEN source_id % 10 = 3 THEN chunk_idx * 600.0::DOUBLE ELSE chunk_idx * 60.0::DOUBLE END AS "offset" FROM chunks)"""


def chunks(spark, sf):
    cut = fx.segments(spark, sf).withColumn("chunk_idx", F.expr("start_ms div 60000"))
    count = cut.groupBy("source_id").agg(F.max("chunk_idx").alias("n"))
    return count.select(
        "source_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n"))).alias("chunk_idx")
    )


def listing(spark, sf):
    """Chunk lists: noise lines everywhere, unreadable starts in some sources."""
    rows = chunks(spark, sf)
    line = F.expr(
        "concat('c_', chunk_idx, '.flac,', CASE WHEN source_id % 10 = 3 AND chunk_idx = 0 THEN 'x' ELSE CAST(chunk_idx * 60.0D AS STRING) END, ',', chunk_idx * 60 + 60)"
    )
    good = rows.select("source_id", (F.col("chunk_idx") * 2).alias("line_no"), line.alias("line"))
    noise = rows.select("source_id", (F.col("chunk_idx") * 2 + 1).alias("line_no"), F.lit("# x").alias("line"))
    return good.unionByName(noise)


@query("a4_chunk_offsets", cte(fx.SEGMENTS, CHUNKS) + "SELECT * FROM offsets")
def a4(spark, sf):
    return speech.chunk_offsets(listing(spark, sf), chunks(spark, sf))


def payloads(spark, sf):
    cut = fx.segments(spark, sf).withColumn("chunk_idx", F.expr("start_ms div 60000"))
    local = F.struct(
        ((F.col("start_ms") - F.col("chunk_idx") * 60000) / 1000).alias("start"),
        ((F.col("end_ms") - F.col("chunk_idx") * 60000) / 1000).alias("end"),
        F.concat(F.lit("  "), "text").alias("text"),
    )
    cells = F.sort_array(F.collect_list(F.struct("seq", local.alias("s"))))
    return cut.groupBy("source_id", "chunk_idx").agg(
        F.to_json(F.struct(F.transform(cells, lambda c: c["s"]).alias("segments"))).alias("body")
    )


@query("a3_asr_segments", cte(fx.SEGMENTS, CHUNKS) + """
SELECT source_id, chunk_idx, CAST(row_number() OVER (PARTITION BY source_id, chunk_idx ORDER BY seq) - 1 AS INTEGER) AS pos,
  CAST(start_ms - chunk_idx * 60000 AS DOUBLE) / 1000 + "offset" AS start,
  CAST(end_ms - chunk_idx * 60000 AS DOUBLE) / 1000 + "offset" AS "end", text
FROM cut JOIN offsets USING (source_id, chunk_idx)""")
def a3(spark, sf):
    offsets = speech.chunk_offsets(listing(spark, sf), chunks(spark, sf))
    return speech.asr_segments(payloads(spark, sf), offsets)


@query("d14_merge_payloads", cte(fx.SEGMENTS, CHUNKS) + """
SELECT source_id, chunk_idx,
  CASE WHEN (source_id + chunk_idx) % 4 <> 0 THEN 'p' || CAST(chunk_idx AS VARCHAR) WHEN source_id % 3 <> 0 THEN 'f' || CAST(chunk_idx AS VARCHAR) END AS body,
  CASE WHEN (source_id + chunk_idx) % 4 <> 0 THEN 'primary' WHEN source_id % 3 <> 0 THEN 'fallback' END AS producer
FROM chunks""")
def d14(spark, sf):
    rows = chunks(spark, sf)
    primary = rows.withColumn(
        "body", F.expr("CASE WHEN (source_id + chunk_idx) % 4 <> 0 THEN concat('p', chunk_idx) END")
    )
    spare = rows.withColumn(
        "body", F.expr("CASE WHEN source_id % 3 <> 0 THEN concat('f', chunk_idx) END")
    )
    return speech.merge_payloads(primary, spare)


# --------------------------------------------------------------------- documents

HEADED = r"""
raw AS (SELECT doc_id AS source_id, unnest(string_split(text, chr(10))) AS line,
               generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
headed AS (SELECT source_id, i, CASE WHEN source_id % 2 = 0 AND i % 7 = 0 THEN '## ' || line ELSE line END AS line FROM raw),
opened AS (
  SELECT *, regexp_matches(line, '^#{1,2}\s') AND coalesce(sum(CASE WHEN trim(line) <> '' THEN 1 ELSE 0 END) OVER (
    PARTITION BY source_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0 AS opens FROM headed),
cut AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY i) AS b FROM opened),
blocks AS (
  SELECT source_id, b, regexp_replace(string_agg(line, chr(10) ORDER BY i), '^\s+|\s+$', '', 'g') AS text FROM cut GROUP BY ALL),
filled AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY b) AS number, count(*) OVER (PARTITION BY source_id) AS n FROM blocks WHERE text <> ''),
whole AS (
  SELECT source_id, regexp_replace(string_agg(line, chr(10) ORDER BY i), '^\s+|\s+$', '', 'g') AS text FROM headed GROUP BY source_id),
text_blocks AS (
  SELECT source_id, CAST(number AS INTEGER) AS number, text FROM filled WHERE n > 1
  UNION ALL
  SELECT source_id, CAST(i + 1 AS INTEGER), substr(text, i * 2500 + 1, 2500) FROM (
    SELECT source_id, text, unnest(range(CASE WHEN length(text) > 3000 THEN (length(text) + 2499) // 2500 ELSE 1 END)) AS i
    FROM whole WHERE text <> '' AND source_id NOT IN (SELECT source_id FROM filled WHERE n > 1))
  WHERE trim(substr(text, CASE WHEN length(text) > 3000 THEN i * 2500 + 1 ELSE 1 END, CASE WHEN length(text) > 3000 THEN 2500 ELSE 3000 END)) <> '')"""


def headed(spark, sf):
    lines = F.transform(
        F.split("text", "\n"),
        lambda line, i: F.when(
            (F.col("doc_id") % 2 == 0) & (i % 7 == 0), F.concat(F.lit("## "), line)
        ).otherwise(line),
    )
    return fx.table(spark, sf, "documents").select(
        F.col("doc_id").alias("source_id"), F.array_join(lines, "\n").alias("text")
    )


@query("a5_read_text_blocks", cte(HEADED).replace("substr(text, i * 2500 + 1, 2500) FROM", "CASE WHEN length(text) > 3000 THEN substr(text, i * 2500 + 1, 2500) ELSE text END FROM") + """
SELECT source_id, number, text, 'metin-katmani' AS source, false AS quarantined FROM text_blocks""")
def a5(spark, sf):
    return documents.read_text_blocks(headed(spark, sf))


# ----------------------------------------------------------------- transcripts out

@query("a8_write_transcripts", cte(fx.SEGMENTS) + f"""
SELECT source_id, start, CAST(seq AS BIGINT) AS seq, '[' || {ts_sql('start')} || '] ' || text AS line FROM segments""")
def a8(spark, sf):
    lines = sinks.transcript_lines(fx.segments(spark, sf))
    return lines.select("source_id", "ord.start", F.col("ord.seq").cast("long").alias("seq"), "line")


@query("a8_plain_transcripts", cte(fx.SEGMENTS, fx.SOURCES) + """
SELECT source_id, CAST(seq AS BIGINT) AS seq, text AS line FROM segments
UNION ALL SELECT source_id, -2, '# ' || title FROM sources UNION ALL SELECT source_id, -1, '' FROM sources""")
def a8p(spark, sf):
    lines = sinks.transcript_lines(fx.segments(spark, sf), fx.sources(spark, sf))
    return lines.select("source_id", "ord.seq", "line")


@query("a12_truncation_banner", cte(fx.SEGMENTS, PAGES) + """
SELECT source_id, CASE WHEN total > 30 THEN 'only 30 of ' || CAST(total AS VARCHAR) || chr(10) || chr(10) ELSE '' END || 'note ' || CAST(source_id AS VARCHAR) AS text
FROM (SELECT source_id, count(*) AS total FROM gated GROUP BY source_id)""")
def a12(spark, sf):
    cover = pages_ops.page_coverage(gated(spark, sf), 30)
    made = cover.select("source_id", F.concat(F.lit("note "), "source_id").alias("text"))
    return notes_plan.with_truncation_banner(made, cover, "only {processed} of {total}")


# --------------------------------------------------------------------------- jobs

@query("a14_read_jobs", cte(fx.JOBS) + """
SELECT id, status, title, json_extract_string(meta, '$.part_of') AS part_of, json_extract_string(meta, '$.topics[0]') AS topic,
       CAST(json_extract(meta, '$.is_combined') AS BOOLEAN) AS is_combined FROM jobs""")
def a14(spark, sf):
    parsed = jobs_source.parse_jobs(fx.jobs(spark, sf))
    return parsed.select(
        "id", "status", "title", F.try_variant_get("meta", "$.part_of", "string").alias("part_of"),
        F.try_variant_get("meta", "$.topics[0]", "string").alias("topic"),
        F.try_variant_get("meta", "$.is_combined", "boolean").alias("is_combined"),
    )


@query("a15_read_evolving", cte(fx.JOBS) + """
SELECT id, status, title, CAST(NULL AS VARCHAR) AS provider, CAST(NULL AS INTEGER) AS audio_only FROM jobs""")
def a15(spark, sf):
    old = fx.jobs(spark, sf).select("id", "title", "status")
    schema = T.StructType(
        [T.StructField(n, T.StringType()) for n in ("id", "status", "title", "provider")]
        + [T.StructField("audio_only", T.IntegerType())]
    )
    return jobs_source.evolve(old, schema)


_INFO = """CASE WHEN k % 3 = 0 THEN ' ' ELSE 'Info ' || id END AS title, CASE WHEN k % 4 = 0 THEN NULL ELSE 'https://page/' || id END AS webpage_url,
  CAST(CASE WHEN k % 5 = 0 THEN 0 ELSE k % 9000 END AS DOUBLE) AS duration, CAST(77 + k % 10 AS DOUBLE) AS measured, CASE WHEN k % 2 = 0 THEN 'ch' END AS uploader"""


@query("a16_normalise_sources", cte(fx.JOBS, f"infos AS (SELECT id, {_INFO} FROM jobs)") + """
SELECT j.id AS source_id, coalesce(nullif(trim(j.title), ''), nullif(trim(i.title), ''), j.source) AS title,
  coalesce(nullif(trim(j.origin_url), ''), nullif(trim(i.webpage_url), ''), j.source) AS url,
  coalesce(nullif(i.duration, 0), i.measured) AS duration, i.uploader
FROM jobs j LEFT JOIN infos i ON i.id = j.id""")
def a16(spark, sf):
    rows = fx.jobs(spark, sf)
    return jobs_source.normalise_sources(rows, rows.selectExpr("id", *_split(_INFO)))


def _split(columns: str) -> list[str]:
    """Select items of a comma list, keeping commas inside brackets."""
    out, depth, start = [], 0, 0
    for i, ch in enumerate(columns):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            out.append(columns[start:i])
            start = i + 1
    return [*out, columns[start:]]


# ------------------------------------------------------------------ caption tracks

_MANUAL = """CASE doc_id % 6 WHEN 0 THEN {a}(lang) WHEN 1 THEN {a}('xx', lang || '-Kg4hpM-Q4eM', lang || '-GB')
  WHEN 2 THEN {a}('zz') WHEN 4 THEN {a}(lang || '-BR', lang || '-AT') WHEN 5 THEN {a}('zz', lang, 'tr-TR') END"""
_AUTO = """CASE doc_id % 4 WHEN 0 THEN {a}(lang, 'tr') WHEN 1 THEN {a}('tr') WHEN 2 THEN {a}(lang || '-orig') END"""
_PREFS = """CASE WHEN doc_id % 3 = 0 THEN {a}('tr', 'en') WHEN doc_id % 10 <> 9 THEN {a}(lang) END"""
_ORIGINAL = "CASE WHEN doc_id % 10 <> 9 THEN lang END"


def tracks(spark, sf):
    docs = fx.table(spark, sf, "documents")
    tables = [
        docs.select(
            F.col("doc_id").alias("source_id"), F.lit(kind).alias("kind"),
            F.posexplode(F.expr(expr.format(a="array"))).alias("pos", "lang"),
        )
        for kind, expr in (("manual", _MANUAL), ("auto", _AUTO))
    ]
    return tables[0].unionByName(tables[1])


def prefs(spark, sf):
    docs = fx.table(spark, sf, "documents")
    listed = docs.select(
        F.col("doc_id").alias("source_id"), F.expr(_ORIGINAL).alias("original"),
        F.posexplode_outer(F.expr(_PREFS.format(a="array"))).alias("pos", "lang"),
    )
    return listed


@query("d10_choose_track", cte(f"""
tracks AS (
  SELECT doc_id AS source_id, kind, unnest(langs) AS lang, generate_subscripts(langs, 1) AS pos FROM (
    SELECT doc_id, 'manual' AS kind, {_MANUAL.format(a='list_value')} AS langs FROM documents
    UNION ALL SELECT doc_id, 'auto', {_AUTO.format(a='list_value')} FROM documents)),
prefs AS (SELECT doc_id AS source_id, unnest(l) AS want, generate_subscripts(l, 1) AS pref FROM (SELECT doc_id, {_PREFS.format(a='list_value')} AS l FROM documents)),
options AS (
  SELECT t.source_id, t.lang, false AS is_auto, p.pref, t.lang <> p.want AS inexact, t.pos FROM tracks t JOIN prefs p
    ON p.source_id = t.source_id AND split_part(t.lang, '-', 1) = split_part(p.want, '-', 1) WHERE t.kind = 'manual'
  UNION ALL
  SELECT t.source_id, t.lang, true, 0, t.lang <> d.o, t.pos FROM tracks t JOIN (SELECT doc_id, {_ORIGINAL} AS o FROM documents) d
    ON d.doc_id = t.source_id AND split_part(t.lang, '-', 1) = split_part(d.o, '-', 1) WHERE t.kind = 'auto')""") + """
SELECT source_id, lang, is_auto FROM (
  SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY is_auto, pref, inexact, length(lang), pos) AS rn FROM options) WHERE rn = 1""")
def d10(spark, sf):
    return captions.choose_track(tracks(spark, sf), prefs(spark, sf))
