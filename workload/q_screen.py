"""Screen captures and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import hashes, intervals, ledger, pages, parts, screen, sections
from lectern.operators.stage import stage
from lectern.sources import silence

from . import fixtures as fx
from .q_packing import BOUNDARY, BOUNDARY_WALK, NUMBERED, SPANS, STUDY, assigned
from .q_scalars import ts_sql
from .registry import cte, query


def silences(spark, sf):
    return silence.silence_windows(fx.silence_log(spark, sf))


@query("a7_silence_windows", cte(fx.SILENCE_LOG) + 'SELECT source_id, start, "end" FROM silences')
def a7(spark, sf):
    return silences(spark, sf)


@query("c5_ocr_read", cte(fx.WORDS) + "SELECT source_id, frame_idx, rotation, text, conf FROM reads")
def c5(spark, sf):
    return screen.ocr_read(fx.ocr_words(spark, sf))


@query("c6_best_rotation", cte(fx.WORDS) + "SELECT source_id, frame_idx, text, conf, rotation FROM best")
def c6(spark, sf):
    return screen.read_frames(fx.ocr_words(spark, sf))


def frames(spark, sf):
    """Quarantine-checked screens with their time and image path."""
    reads = screen.quarantine_frames(screen.read_frames(fx.ocr_words(spark, sf)))
    times = fx.segments(spark, sf).select(
        "source_id", F.col("seq").alias("frame_idx"), F.col("start").alias("ts")
    )
    path = F.concat(
        F.lit("f/"), F.col("source_id").cast("string"), F.lit("_"),
        F.col("frame_idx").cast("string"), F.lit(".jpg"),
    )
    return reads.join(times, ["source_id", "frame_idx"]).withColumn("path", path)


@query("c7_quarantine_frames", cte(fx.WORDS) + "SELECT * FROM frames")
def c7(spark, sf):
    return frames(spark, sf)


IN_SILENCE = """
flagged AS (
  SELECT f.*, EXISTS (SELECT 1 FROM silences s WHERE s.source_id = f.source_id AND f.ts BETWEEN s.start AND s."end") AS in_silence
  FROM frames f)"""


@query("d5_flag_silence", cte(fx.WORDS, fx.SILENCE_LOG, IN_SILENCE) + "SELECT source_id, frame_idx, ts, in_silence FROM flagged")
def d5(spark, sf):
    out = screen.flag_silence(stage(frames(spark, sf)), stage(silences(spark, sf)))
    return out.select("source_id", "frame_idx", "ts", "in_silence")


@query("d5_coalesced_silences", cte(fx.SILENCE_LOG) + """
SELECT source_id, min(start) AS start, max("end") AS "end" FROM (
  SELECT *, sum(CASE WHEN start <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY source_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS stretch FROM (
    SELECT *, max("end") OVER (PARTITION BY source_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
    FROM (SELECT source_id, start, "end" + 30 AS "end" FROM silences)))
GROUP BY source_id, stretch""")
def d5c(spark, sf):
    """Silences with half a minute of margin, as disjoint stretches."""
    wide = silences(spark, sf).withColumn("end", F.col("end") + 30)
    return intervals.coalesced(stage(wide), ["source_id"], "start", "end")


def flagged(spark, sf):
    """Screens with the silence flag, written once."""
    return stage(screen.flag_silence(stage(frames(spark, sf)), stage(silences(spark, sf))))


@query("e3_screen_ledger", cte(fx.WORDS, fx.SILENCE_LOG, IN_SILENCE) + """
SELECT source_id, count(*) FILTER (WHERE NOT quarantined) AS frames_used,
  count(*) FILTER (WHERE NOT quarantined AND in_silence) AS frames_from_silence,
  count(*) FILTER (WHERE quarantined) AS frames_quarantined FROM flagged GROUP BY source_id""")
def e3(spark, sf):
    return ledger.screen_ledger(flagged(spark, sf))


@query("e3_screen_evidence", cte(fx.WORDS) + "SELECT source_id, frame_idx, ts, conf, path FROM frames WHERE quarantined")
def e3e(spark, sf):
    return ledger.screen_evidence(frames(spark, sf))


@query("f8_sampling_grid", cte(fx.SEGMENTS, fx.SILENCE_LOG) + """
SELECT source_id, frame_idx, ts FROM (
  SELECT *, ts % 5.0 AS off FROM (
    SELECT s.source_id, s.seq AS frame_idx, l.source_id IS NOT NULL AS dense,
           s.seq * CASE WHEN l.source_id IS NULL THEN 5.0::DOUBLE ELSE 5.0::DOUBLE / 3 END AS ts
    FROM segments s LEFT JOIN (SELECT DISTINCT source_id FROM silences) l USING (source_id))) t
WHERE NOT dense OR off < 5.0::DOUBLE / 3 / 2 OR 5.0 - off < 5.0::DOUBLE / 3 / 2
   OR EXISTS (SELECT 1 FROM silences x WHERE x.source_id = t.source_id AND t.ts BETWEEN x.start AND x."end")""")
def f8(spark, sf):
    samples = fx.segments(spark, sf).select("source_id", F.col("seq").alias("frame_idx"))
    return screen.sampling_grid(samples, stage(silences(spark, sf))).select("source_id", "frame_idx", "ts")


CAP = 20


@query("f9_cap_frames", cte(fx.WORDS, fx.SILENCE_LOG, IN_SILENCE) + f"""
SELECT source_id, frame_idx FROM (
  SELECT *, row_number() OVER (PARTITION BY source_id, slot ORDER BY NOT in_silence, pos) AS rn FROM (
    SELECT p.*, b.slot FROM (
      SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY frame_idx) - 1 AS pos,
             count(*) OVER (PARTITION BY source_id) AS total FROM flagged) p
    LEFT JOIN (SELECT unnest(range({CAP})) AS slot) b
      ON p.total > {CAP} AND p.pos >= CAST(floor(b.slot * (p.total / {CAP}::DOUBLE)) AS BIGINT)
         AND p.pos < CAST(floor((b.slot + 1) * (p.total / {CAP}::DOUBLE)) AS BIGINT)))
WHERE slot IS NULL OR rn = 1""")
def f9(spark, sf):
    return screen.cap_frames(flagged(spark, sf), CAP).select("source_id", "frame_idx")


HASHES = """
shots AS (
  SELECT vec_id % 10 AS source_id, vec_id // 10 AS frame_idx,
    CAST(CASE WHEN embedding[64] > 0 THEN b - 9223372036854775808 ELSE b END AS BIGINT) AS h
  FROM (SELECT *, list_sum(list_transform(range(63), lambda i: CASE WHEN embedding[i + 1] > 0 THEN 1::HUGEINT << i ELSE 0::HUGEINT END)) AS b FROM embeddings)),
steps AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY frame_idx) AS rn FROM shots),
greedy AS (
  SELECT source_id, frame_idx, h, rn, [h] AS kept, true AS keep FROM steps WHERE rn = 1
  UNION ALL
  SELECT n.source_id, n.frame_idx, n.h, n.rn,
    CASE WHEN len(list_filter(k.kept, lambda x: bit_count(xor(x, n.h)) <= 5)) = 0 THEN list_append(k.kept, n.h) ELSE k.kept END,
    len(list_filter(k.kept, lambda x: bit_count(xor(x, n.h)) <= 5)) = 0
  FROM greedy k JOIN steps n ON n.source_id = k.source_id AND n.rn = k.rn + 1)"""


def shots(spark, sf):
    bits = " + ".join(
        f"CASE WHEN embedding[{i}] > 0 THEN shiftleft(1L, {i}) ELSE 0L END" for i in range(64)
    )
    return fx.table(spark, sf, "embeddings").selectExpr(
        "vec_id % 10 AS source_id", "vec_id div 10 AS frame_idx", f"{bits} AS h"
    )


@query("f7_dedupe_hashes", cte(HASHES, recursive=True) + "SELECT source_id, frame_idx, h FROM greedy WHERE keep")
def f7(spark, sf):
    return hashes.dedupe_hashes(shots(spark, sf), distance=5, bits=64)


_FRAME_SECTION = """
spans AS (
  SELECT source_id, sec_start, min_by(start, seq) AS lo, max_by("end", seq) AS hi FROM assigned GROUP BY ALL),
open_spans AS (
  SELECT source_id, sec_start, lo, CASE WHEN lo = max(lo) OVER (PARTITION BY source_id) THEN CAST('Infinity' AS DOUBLE) ELSE hi END AS hi FROM spans)"""


@query("d1_frames_to_sections", cte(fx.WORDS, *[x for x in STUDY if x != fx.MARKS], _FRAME_SECTION, recursive=True).replace(
    "timed AS (", "timed AS (", 1).replace("sources AS (", fx.MARKS.replace(fx.SEGMENTS + ",", "").strip() + ",\nsources AS (", 1) + """
SELECT f.source_id, f.frame_idx, s.sec_start FROM frames f JOIN open_spans s ON s.source_id = f.source_id AND f.ts >= s.lo AND f.ts < s.hi""")
def d1(spark, sf):
    table = stage(sections.section_table(assigned(spark, sf)))
    out = screen.frames_to_sections(stage(frames(spark, sf)), table)
    return out.select("source_id", "frame_idx", "sec_start")


@query("c10_screen_text", cte(fx.WORDS, *[x for x in STUDY if x != fx.MARKS], _FRAME_SECTION, recursive=True).replace(
    "sources AS (", fx.MARKS.replace(fx.SEGMENTS + ",", "").strip() + ",\nsources AS (", 1) + f"""
SELECT f.source_id, s.sec_start, string_agg('[' || {ts_sql('f.ts')} || ' ekran]' || chr(10) || f.text, chr(10) || chr(10) ORDER BY f.ts, f.frame_idx) AS screen
FROM frames f JOIN open_spans s ON s.source_id = f.source_id AND f.ts >= s.lo AND f.ts < s.hi
WHERE NOT f.quarantined AND f.text <> '' GROUP BY f.source_id, s.sec_start""")
def c10(spark, sf):
    table = stage(sections.section_table(assigned(spark, sf)))
    placed = screen.frames_to_sections(stage(frames(spark, sf)), table)
    return screen.screen_text(placed, ["source_id", "sec_start"])


PIECE = 400


@query("c10_screen_pieces", cte(fx.WORDS, *[x for x in STUDY if x != fx.MARKS], _FRAME_SECTION, recursive=True).replace(
    "sources AS (", fx.MARKS.replace(fx.SEGMENTS + ",", "").strip() + ",\nsources AS (", 1) + f"""
SELECT source_id, sec_start, before // {PIECE} AS piece, string_agg(entry, chr(10) || chr(10) ORDER BY ts, frame_idx) AS screen FROM (
  SELECT *, CAST(coalesce(sum(length(entry) + 2) OVER (PARTITION BY source_id, sec_start ORDER BY ts, frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM (SELECT f.source_id, s.sec_start, f.ts, f.frame_idx, '[' || {ts_sql('f.ts')} || ' ekran]' || chr(10) || f.text AS entry
    FROM frames f JOIN open_spans s ON s.source_id = f.source_id AND f.ts >= s.lo AND f.ts < s.hi
    WHERE NOT f.quarantined AND f.text <> ''))
GROUP BY ALL""")
def c10p(spark, sf):
    table = stage(sections.section_table(assigned(spark, sf)))
    placed = stage(screen.frames_to_sections(stage(frames(spark, sf)), table))
    return screen.screen_pieces(placed, ["source_id", "sec_start"], PIECE)


@query("d2_frames_to_windows", cte(fx.WORDS, NUMBERED, BOUNDARY_WALK, SPANS, recursive=True) + """
SELECT f.source_id, f.frame_idx, w.window_id FROM frames f JOIN spans w ON w.source_id = f.source_id AND f.ts >= w.first_start AND f.ts < w.last_end""")
def d2(spark, sf):
    windowed = sections.boundary_windows(fx.segments(spark, sf), BOUNDARY)
    out = screen.frames_to_windows(stage(frames(spark, sf)), stage(sections.window_table(windowed)))
    return out.select("source_id", "frame_idx", "window_id")


# ----------------------------------------------------------------- pages

PAGES = r"""
page_inputs AS (
  SELECT source_id, CAST(seq + 1 AS INTEGER) AS number,
    CASE (source_id + seq) % 6 WHEN 0 THEN '  ' WHEN 1 THEN regexp_replace(text, '[aeiouéèêöüäóíAEIOUÉÈÊÖÜÄÓÍ]', '', 'g') ELSE text END AS text_layer,
    text AS ocr_text,
    CASE WHEN (source_id + seq) % 13 <> 0 THEN CAST((source_id * 7 + seq * 29) % 101 AS DOUBLE) END AS ocr_conf
  FROM segments),
rated AS (
  SELECT *, trim(text_layer) AS layer,
    CASE WHEN len(w) >= 20 THEN CAST(len(list_filter(w, lambda t:
      length(regexp_replace(t, '[^aeıioöuüAEIİOÖUÜ]', '', 'g')) >= 1 AND length(t) <= 22
      AND CAST(length(regexp_replace(t, '[^aeıioöuüAEIİOÖUÜ]', '', 'g')) AS DOUBLE) / length(t) BETWEEN 0.15 AND 0.75)) AS DOUBLE) / len(w) END AS ratio
  FROM (SELECT *, regexp_extract_all(trim(text_layer), '\p{L}{2,}') AS w FROM page_inputs)),
judged AS (SELECT *, length(layer) >= 40 AND (ratio IS NULL OR ratio >= 0.5) AS good, coalesce(ocr_conf < 60, true) AS bad FROM rated),
gated AS (
  SELECT source_id, number, CASE WHEN good THEN layer WHEN bad THEN '' ELSE ocr_text END AS text,
    CASE WHEN good THEN 'metin-katmani' ELSE 'ocr' END AS source,
    CASE WHEN NOT good THEN round_even(ocr_conf, 1) END AS conf,
    NOT good AND bad AS quarantined, round_even(ratio, 3) AS word_ratio
  FROM judged)"""


def page_inputs(spark, sf, rows=None):
    rows = fx.segments(spark, sf) if rows is None else rows
    return rows.selectExpr(
        "source_id", "CAST(seq + 1 AS INT) AS number",
        "CASE (source_id + seq) % 6 WHEN 0 THEN '  ' WHEN 1 THEN translate(text, 'aeiouéèêöüäóíAEIOUÉÈÊÖÜÄÓÍ', '') ELSE text END AS text_layer",
        "text AS ocr_text",
        "CASE WHEN (source_id + seq) % 13 <> 0 THEN CAST((source_id * 7 + seq * 29) % 101 AS DOUBLE) END AS ocr_conf",
    )


def gated(spark, sf, rows=None):
    return pages.gate_pages(page_inputs(spark, sf, rows))


@query("c8_gate_pages", cte(fx.SEGMENTS, PAGES) + "SELECT * FROM gated")
def c8(spark, sf):
    return gated(spark, sf)


@query("c9_cap_pages", cte(fx.SEGMENTS, PAGES) + "SELECT source_id, number, text FROM gated WHERE number <= 30")
def c9(spark, sf):
    return pages.cap_pages(gated(spark, sf), 30).select("source_id", "number", "text")


@query("c9_page_coverage", cte(fx.SEGMENTS, PAGES) + """
SELECT source_id, count(*) AS total, count(*) FILTER (WHERE number <= 30) AS processed, count(*) FILTER (WHERE number <= 30) < count(*) AS truncated
FROM gated GROUP BY source_id""")
def c9c(spark, sf):
    return pages.page_coverage(gated(spark, sf), 30)


@query("a6_pages_to_segments", cte(fx.SEGMENTS, PAGES) + """
SELECT source_id, CAST(number AS BIGINT) AS seq, CAST(number AS DOUBLE) AS start, CAST(number AS DOUBLE) + 1 AS "end", text
FROM gated WHERE trim(text) <> ''""")
def a6(spark, sf):
    return pages.pages_to_segments(gated(spark, sf))


@query("e4_page_ledger", cte(fx.SEGMENTS, PAGES) + """
SELECT source_id, count(*) AS pages, count(*) FILTER (WHERE NOT quarantined AND trim(text) <> '') AS pages_read,
  count(*) FILTER (WHERE source = 'metin-katmani') AS pages_text_layer,
  count(*) FILTER (WHERE source = 'ocr' AND NOT quarantined) AS pages_ocr,
  count(*) FILTER (WHERE quarantined) AS pages_quarantined, min(word_ratio) AS min_word_ratio
FROM gated GROUP BY source_id""")
def e4(spark, sf):
    return pages.page_ledger(gated(spark, sf))


PAGE_PARTS = """
sized AS (
  SELECT source_id, (n + p - 1) // p AS per FROM (
    SELECT source_id, count(*) AS n, CAST(round_even(count(*) / 5.0, 0) AS BIGINT) AS p FROM gated GROUP BY source_id) WHERE p >= 2),
parted AS (
  SELECT g.*, (row_number() OVER (PARTITION BY source_id ORDER BY number) - 1) // per AS part FROM gated g JOIN sized USING (source_id))"""


@query("f12_plan_page_parts", cte(fx.SEGMENTS, PAGES, PAGE_PARTS) + "SELECT source_id, number, part FROM parted")
def f12(spark, sf):
    return parts.plan_page_parts(gated(spark, sf), 5).select("source_id", "number", "part")


@query("f12_page_part_table", cte(fx.SEGMENTS, fx.SOURCES, PAGES, PAGE_PARTS) + """
SELECT source_id, part, first_page, last_page, pages,
  title || ' — Part ' || CAST(part + 1 AS VARCHAR) || ' (s.' || CAST(first_page AS VARCHAR) || '-' || CAST(last_page AS VARCHAR) || ')' AS part_title,
  CASE WHEN readable = 0 THEN 'Bu parçada okunabilir sayfa yok (taranmış/karantina).' END AS error
FROM (SELECT source_id, part, min(number) AS first_page, max(number) AS last_page, count(*) AS pages, count(*) FILTER (WHERE trim(text) <> '') AS readable
      FROM parted GROUP BY ALL) JOIN sources USING (source_id)""")
def f12t(spark, sf):
    return parts.page_part_table(parts.plan_page_parts(gated(spark, sf), 5), fx.sources(spark, sf))


@query("e9_text_volume", cte(fx.SEGMENTS, PAGES) + r"""
SELECT source_id, CAST(sum(len(regexp_extract_all(text, '[^\s]+'))) AS BIGINT) AS words, count(*) AS blocks FROM gated GROUP BY source_id""")
def e9(spark, sf):
    return pages.text_volume(gated(spark, sf))
