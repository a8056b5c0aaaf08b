"""Rendered notes, piece by piece."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lectern.operators import parts, screen, sections
from lectern.operators.stage import shared_folder, stage
from lectern.plans import notes, study
from lectern.sources import sinks, textfiles

from . import fixtures as fx
from .q_packing import STUDY, TIME_PARTS, assigned, time_parts
from .q_scalars import KEY_SQL, ts_sql
from .q_screen import PAGES, _FRAME_SECTION, frames, gated
from .registry import cte, query

NL = "chr(10)"
KEY_LIST = KEY_SQL.replace("array_to_string(", "", 1).rsplit(", ',')", 1)[0]
_URL = "CASE WHEN source_id % 2 = 0 THEN 'https://v.example.org/w?v=' || CAST(source_id AS STRING) END"
_UPLOADER = "CASE WHEN source_id % 3 = 0 THEN 'Ch' END"


def _link(seconds: str) -> str:
    stamp = f"'`' || {ts_sql(seconds)} || '`'"
    return (
        f"CASE WHEN url IS NULL THEN {stamp} ELSE '[' || {stamp} || '](' || url || '&t=' || "
        f"CAST(CAST(floor({seconds}) AS BIGINT) AS VARCHAR) || 's)' END"
    )


def words(spark, sf, rows=None):
    """Every line, in order: bullets and steps of the notes."""
    rows = fx.segments(spark, sf) if rows is None else rows
    return rows.select("source_id", F.col("seq").alias("pos"), F.col("text").alias("bullet"))


def learning(spark, sf, rows=None):
    cells = F.sort_array(F.collect_list(F.struct("pos", "bullet")))
    listed = words(spark, sf, rows).groupBy("source_id").agg(F.transform(cells, lambda c: c["bullet"]).alias("steps"))
    return listed.select(
        "source_id", "steps", F.array().cast("array<string>").alias("actions"),
        F.array(F.struct(F.lit("Neden?").alias("soru"), F.element_at("steps", 1).alias("cevap"))).alias("quiz"),
        F.when(F.col("source_id") % 2 == 0, "araştır").otherwise("").alias("deepen_prompt"),
    )


def note_sources(spark, sf, rows=None):
    return fx.sources(spark, sf, rows).withColumn("url", F.expr(_URL)).withColumn("uploader", F.expr(_UPLOADER))


def glossary(spark, sf, rows=None):
    return fx.terms(spark, sf, rows).select("source_id", "pos", "term", "definition")


_MARKS_ONLY = fx.MARKS.replace(fx.SEGMENTS + ",", "").strip()
NOTE_BASE = f"""
firsts AS (SELECT source_id, seq AS pos, text AS bullet FROM segments),
terms AS (SELECT source_id, seq AS pos, {fx.TERM_EXPR} AS term, 'd' || CAST(seq AS STRING) AS definition FROM segments),
info AS (SELECT *, {_URL} AS url, {_UPLOADER} AS uploader FROM sources)"""
SHARED_PIECES = f"""
SELECT source_id, 0 AS block, 0.0::DOUBLE AS at, string_agg('- ' || bullet, {NL} ORDER BY pos) AS text FROM firsts GROUP BY source_id
UNION ALL SELECT source_id, 0, 1.0, {NL} || '## Detaylı Özet' || {NL} FROM sources
UNION ALL SELECT source_id, 2, -1.0, '## Terimler' || {NL} FROM sources
UNION ALL SELECT source_id, 2, 0.0, string_agg('- **' || term || '** — ' || definition, {NL} ORDER BY {KEY_LIST}, pos) FROM terms GROUP BY source_id
UNION ALL SELECT source_id, 2, 1.0, '' FROM sources"""
LEARNING_PIECES = f"""
UNION ALL SELECT source_id, 3, 0.0, '## Adım adım uygula' || {NL} || {NL} || string_agg(CAST(n AS VARCHAR) || '. ' || bullet, {NL} ORDER BY pos) || {NL}
  FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY pos) AS n FROM firsts) GROUP BY source_id
UNION ALL SELECT source_id, 5, 0.0, '## Kendini test et' || {NL} || {NL} || '- **Neden?**' || {NL} || '  <sub>Cevap: ' || min_by(bullet, pos) || '</sub>' || {NL} FROM firsts GROUP BY source_id
UNION ALL SELECT source_id, 6, 0.0, '## Daha derine — araştırma prompt''u' || {NL} || {NL} || 'Bunu ChatGPT ya da Claude''a olduğu gibi yapıştır:' || {NL} || {NL} || '```' || {NL} || 'araştır' || {NL} || '```' || {NL} FROM sources WHERE source_id % 2 = 0"""


A9_SQL = cte(fx.WORDS, _MARKS_ONLY, *STUDY[1:], _FRAME_SECTION, NOTE_BASE, f"""
shown AS (
  SELECT f.*, s.sec_start, url FROM frames f JOIN open_spans s ON s.source_id = f.source_id AND f.ts >= s.lo AND f.ts < s.hi
  JOIN (SELECT source_id AS sid, url FROM info) i ON i.sid = f.source_id),
pictures AS (
  SELECT source_id, sec_start, string_agg('![Ekran ' || {ts_sql('ts')} || '](' || path || ')' || {NL} || '<sub>' || {_link('ts')} ||
    CASE WHEN quarantined THEN ' bu ekranı okuyamadım (güven medyanı ' || CAST(conf AS VARCHAR) || ', 4 açı denendi). Metnini özete katmadım — işte görüntüsü, sen bak.</sub>'
    ELSE ' ekran görüntüsü' || CASE WHEN rotation <> 0 THEN ', ' || CAST(rotation AS VARCHAR) || '° döndürülerek okundu' ELSE '' END || '</sub>' END || {NL}, {NL} ORDER BY ts, frame_idx) AS pics
  FROM shown GROUP BY source_id, sec_start),
bodies AS (
  SELECT source_id, sec_start, max(sec_title) AS title, min(start) AS first, min_by(text, seq) AS summary,
    string_agg('- ' || {_link('start')} || ' ' || text, {NL} ORDER BY start, seq) AS bullets, max(url) AS url
  FROM assigned JOIN (SELECT source_id, url FROM info) USING (source_id) GROUP BY source_id, sec_start)""", recursive=True) + f"""
SELECT source_id, 0 AS block, -2.0::DOUBLE AS at, '# ' || title || {NL} || {NL} || 'Süre: ' || {ts_sql('duration')}
  || coalesce(' · Kanal: ' || uploader, '') || coalesce(' · [Kaynak](' || url || ')', '') || {NL} || {NL} || '## TL;DR' || {NL} AS text FROM info
UNION ALL {SHARED_PIECES}{LEARNING_PIECES}
UNION ALL SELECT b.source_id, 1, b.sec_start, '### ' || {_link('first')} || ' ' || title || {NL} || {NL} || summary || {NL} || coalesce({NL} || bullets, '') || {NL} || coalesce({NL} || pics, '')
  FROM bodies b LEFT JOIN pictures p USING (source_id, sec_start)
UNION ALL SELECT s.source_id, 8, 0.0, '---' || {NL} || {NL} || '<sub>Otomatik üretildi · ' || CAST(n AS VARCHAR) || ' bölüm · eleştirmen geçişi ' || CAST(s.source_id % 4 AS VARCHAR) || ' eksik madde ekledi'
  || coalesce(' · ' || CAST(f AS VARCHAR) || ' slayt OCR ile okundu', '') || '</sub>' || {NL}
  FROM sources s LEFT JOIN (SELECT source_id, count(*) AS n FROM bodies GROUP BY source_id) USING (source_id)
  LEFT JOIN (SELECT source_id, count(*) AS f FROM shown GROUP BY source_id) USING (source_id)"""


def timed_lines(spark, sf):
    """Lines of the notes of timed sources."""
    rows = assigned(spark, sf)
    table = stage(sections.section_table(rows).join(study.first_line_notes(rows), ["source_id", "sec_start"]))
    points = rows.select(
        "source_id", "sec_start", F.col("start").alias("ts"), "seq", F.lit(0).alias("added"), "text"
    )
    shown = stage(screen.frames_to_sections(stage(frames(spark, sf)), table))
    srcs = stage(note_sources(spark, sf))
    return notes.render_timed(
        srcs, table, points, words(spark, sf), glossary(spark, sf), learning(spark, sf), shown,
        srcs.select("source_id", (F.col("source_id") % 4).alias("critic_added")),
    )


@query("a9_render_timed", A9_SQL)
def a9(spark, sf):
    return notes.note_pieces(timed_lines(spark, sf))


@query("a9_note_files", f"""
SELECT 'notes/' || source_id || '.md' AS path, sha256(string_agg(text, {NL} ORDER BY block, "at") || {NL}) AS content
FROM ({A9_SQL}) GROUP BY source_id""")
def a9f(spark, sf):
    """Notes of timed sources written as files, line rows from many tasks, and read back."""
    folder = f"{shared_folder(spark)}/notes-{uuid.uuid4().hex}"
    lines = timed_lines(spark, sf).withColumn("id", F.col("source_id").cast("string"))
    layout = lines.select("id").distinct().select("id", F.concat(F.lit("notes/"), "id", F.lit(".md")).alias("path"))
    written = sinks.write_library(layout, lines.select("id", "ord", "line"), folder)
    return textfiles.file_digests(written, folder).select("path", "content")


@query("a10_render_paged", cte(fx.SEGMENTS, fx.SOURCES, PAGES, NOTE_BASE, """
counted AS (SELECT source_id, count(*) AS n, count(*) FILTER (WHERE NOT quarantined AND trim(text) <> '') AS r, count(*) FILTER (WHERE quarantined) AS q, count(*) FILTER (WHERE trim(text) <> '') AS s FROM gated GROUP BY source_id)""") + f"""
SELECT source_id, 0 AS block, -2.0::DOUBLE AS at, '# ' || title || {NL} || {NL} || CAST(n AS VARCHAR) || ' sayfa · ' || CAST(r AS VARCHAR) || ' okundu' || {NL} || {NL} || '## TL;DR' || {NL} AS text
FROM sources JOIN counted USING (source_id)
UNION ALL {SHARED_PIECES}{LEARNING_PIECES}
UNION ALL SELECT source_id, 1, number, '### s. ' || CAST(number AS VARCHAR) || ' · T' || CAST(number AS VARCHAR) || {NL} || {NL} || text || {NL} || {NL} || '- `s. ' || CAST(number AS VARCHAR) || '` ' || text || {NL} FROM gated WHERE trim(text) <> ''
UNION ALL SELECT source_id, 7, -1.0, '## Okuyamadığım sayfalar' || {NL} || {NL} || 'Bu sayfaların metnini özete katmadım. Kanıtı önünde — sen bak.' || {NL} FROM counted WHERE q > 0
UNION ALL SELECT source_id, 7, number, CASE WHEN number % 2 = 0 THEN '![Sayfa ' || CAST(number AS VARCHAR) || '](p/' || CAST(number AS VARCHAR) || '.jpg)' || {NL} ELSE '' END
  || '<sub>`s. ' || CAST(number AS VARCHAR) || '` okunamadı (güven medyanı ' || coalesce(CAST(conf AS VARCHAR), 'None') || ', 4 açı denendi).</sub>' || {NL} FROM gated WHERE quarantined
UNION ALL SELECT source_id, 8, 0.0, '---' || {NL} || {NL} || '<sub>Otomatik üretildi · ' || CAST(n AS VARCHAR) || ' sayfa · ' || CAST(r AS VARCHAR) || ' okundu · ' || CAST(s AS VARCHAR) || ' bölüm · eleştirmen 0 madde ekledi'
  || CASE WHEN q > 0 THEN ' · ' || CAST(q AS VARCHAR) || ' sayfa karantinada' ELSE '' END || '</sub>' || {NL} FROM counted""")
def a10(spark, sf):
    rows = stage(fx.segments(spark, sf))
    pages = stage(gated(spark, sf, rows).withColumn(
        "img_rel", F.expr("CASE WHEN number % 2 = 0 THEN concat('p/', number, '.jpg') END")
    ))
    readable = pages.where(F.trim("text") != "").select(
        "source_id", F.col("number").cast("double").alias("sec_start"), F.col("number").cast("double").alias("start"),
        F.concat(F.lit("T"), "number").alias("title"), F.col("text").alias("summary"),
    )
    points = readable.select(
        "source_id", "sec_start", F.col("start").alias("ts"), F.lit(0).alias("seq"), F.lit(0).alias("added"),
        F.col("summary").alias("text"),
    )
    lines = notes.render_paged(
        stage(note_sources(spark, sf, rows)), pages, readable, points, words(spark, sf, rows),
        glossary(spark, sf, rows), learning(spark, sf, rows),
    )
    return notes.note_pieces(lines)


@query("a11_render_combined", cte(fx.SEGMENTS, fx.SOURCES, TIME_PARTS, f"""
titled AS (SELECT source_id, part, title, title || ' — Part ' || CAST(part + 1 AS VARCHAR) || ' (' || CAST(CAST(floor(part_start / 60) AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(floor((part_start + part_len) / 60) AS BIGINT) AS VARCHAR) || 'dk)' AS part_title
  FROM parts JOIN sources USING (source_id)),
rows_of AS (SELECT s.*, p.part FROM segments s JOIN parts p ON p.source_id = s.source_id AND s.start >= p.part_start AND s.start < p.part_end),
good AS (SELECT t.*, bullets, titles FROM titled t JOIN (SELECT source_id, part, string_agg('- ' || text, {NL} ORDER BY seq) AS bullets,
  string_agg('T' || CAST(seq AS VARCHAR), ' · ' ORDER BY start) AS titles FROM rows_of GROUP BY ALL) USING (source_id, part)),
bad AS (SELECT * FROM titled ANTI JOIN rows_of USING (source_id, part))""") + f"""
SELECT source_id, 0 AS block, 0.0::DOUBLE AS at, '# ' || max(title) || ' — Tüm hali' || {NL} || {NL} || CAST(count(*) AS VARCHAR) || ' parça · her parçanın kendi ayrıntılı özeti ayrı girdide.' || {NL} AS text FROM titled GROUP BY source_id
UNION ALL SELECT source_id, 1, part, '## ' || part_title || {NL} || {NL} || bullets || coalesce({NL} || {NL} || '_Bölümler:_ ' || titles, '') || {NL} FROM good
UNION ALL SELECT DISTINCT source_id, 2, -1.0, '## İşlenemeyen parçalar' || {NL} || {NL} || 'Bu parçalar tamamlanamadı (sebebi yanlarında); tek tek ''tekrar dene'' ile denenebilir.' || {NL} FROM bad
UNION ALL SELECT source_id, 2, part, '- **' || part_title || '** — Bu parçada altyazı segmenti yok (boş aralık).' FROM bad
UNION ALL SELECT DISTINCT source_id, 3, 0.0, '' FROM bad""")
def a11(spark, sf):
    planned = stage(time_parts(spark, sf))
    titled = stage(parts.titled_time_parts(planned, fx.sources(spark, sf)))
    rows = stage(parts.assign_parts(fx.segments(spark, sf), planned))
    keys = ["source_id", "part"]
    names = titled.select(*keys, "part_title")
    failures = parts.empty_parts(planned, rows).join(names, keys)
    parents = titled.groupBy("source_id").agg(F.max("title").alias("title"), F.max("parts").alias("parts"))
    bullets = rows.select(*keys, F.col("seq").alias("pos"), F.col("text").alias("bullet"))
    titles = rows.select(*keys, F.col("start").alias("sec_start"), F.concat(F.lit("T"), "seq").alias("title"))
    lines = notes.render_combined(
        parents, names.join(rows.select(*keys).distinct(), keys), bullets, titles, failures
    )
    return notes.note_pieces(lines)
