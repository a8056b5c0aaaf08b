"""Windows, sections and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import parts, requests, sections, transcripts
from lectern.operators.stage import stage
from lectern.plans import study

from . import fixtures as fx
from .q_scalars import ts_sql
from .registry import cte, query

BOUNDARY, SECTION, REPAIR = 2000, 1500, 1500

NUMBERED = """
numbered AS (
  SELECT source_id, seq, length(text) AS len, "end",
         regexp_matches(text, '[.!?]\\s*$') AS stop,
         lead(start) OVER (PARTITION BY source_id ORDER BY seq) AS next_start,
         row_number() OVER (PARTITION BY source_id ORDER BY seq) AS rn FROM segments)"""

BOUNDARY_WALK = f"""
walk AS (
  SELECT source_id, seq, rn, len + 12 AS size, 0 AS w FROM numbered WHERE rn = 1
  UNION ALL
  SELECT n.source_id, n.seq, n.rn, CASE WHEN k.size >= {BOUNDARY} THEN 0 ELSE k.size END + n.len + 12,
         k.w + CASE WHEN k.size >= {BOUNDARY} THEN 1 ELSE 0 END
  FROM walk k JOIN numbered n ON n.source_id = k.source_id AND n.rn = k.rn + 1),
tails AS (
  SELECT source_id, max_by(w, rn) AS w, max_by(size, rn) AS size FROM walk GROUP BY source_id),
windows AS (
  SELECT k.source_id, k.seq, CAST(k.w - CASE WHEN t.w = k.w AND t.w > 0 AND t.size < {BOUNDARY // 3} THEN 1 ELSE 0 END AS BIGINT) AS window_id
  FROM walk k JOIN tails t USING (source_id))"""


@query("f1_boundary_windows", cte(fx.SEGMENTS, NUMBERED, BOUNDARY_WALK, recursive=True) + "SELECT * FROM windows")
def f1(spark, sf):
    windowed = sections.boundary_windows(fx.segments(spark, sf), BOUNDARY)
    return windowed.select("source_id", "seq", "window_id")


_CUT = f"""(k.size >= {REPAIR} AND (k.stop OR coalesce(k.next_start - k."end" > 0.8, true) OR k.size > {REPAIR} * 1.5))"""
REPAIR_WALK = f"""
walk AS (
  SELECT source_id, seq, rn, stop, next_start, "end", len + 12 AS size, 0 AS w FROM numbered WHERE rn = 1
  UNION ALL
  SELECT n.source_id, n.seq, n.rn, n.stop, n.next_start, n."end",
         CASE WHEN {_CUT} THEN 0 ELSE k.size END + n.len + 12, k.w + CASE WHEN {_CUT} THEN 1 ELSE 0 END
  FROM walk k JOIN numbered n ON n.source_id = k.source_id AND n.rn = k.rn + 1),
windows AS (SELECT source_id, seq, CAST(w AS BIGINT) AS window_id FROM walk)"""


@query("f2_repair_windows", cte(fx.SEGMENTS, NUMBERED, REPAIR_WALK, recursive=True) + "SELECT * FROM windows")
def f2(spark, sf):
    windowed = sections.repair_windows(fx.segments(spark, sf), REPAIR)
    return windowed.select("source_id", "seq", "window_id")


THIN = """
ordered_marks AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY ts, seq) AS rn FROM marks),
thin_walk AS (
  SELECT source_id, seq, ts, title, rn, ts AS last_kept, true AS kept FROM ordered_marks WHERE rn = 1
  UNION ALL
  SELECT n.source_id, n.seq, n.ts, n.title, n.rn,
         CASE WHEN n.ts - k.last_kept < 45 THEN k.last_kept ELSE n.ts END, n.ts - k.last_kept >= 45
  FROM thin_walk k JOIN ordered_marks n ON n.source_id = k.source_id AND n.rn = k.rn + 1),
kept_marks AS (SELECT source_id, seq, ts, title FROM thin_walk WHERE kept)"""


@query("f5_thin_marks", cte(fx.MARKS, THIN, recursive=True) + "SELECT * FROM kept_marks")
def f5(spark, sf):
    return sections.thin_marks(fx.marks(spark, sf))


SKELETON = """
skeleton AS (
  SELECT source_id, title, sec_start,
    coalesce(lead(sec_start) OVER (PARTITION BY source_id ORDER BY sec_start), end_of_source + 1) AS sec_end
  FROM (
    SELECT source_id, title, ts AS sec_start FROM kept_marks
    UNION ALL
    SELECT s.source_id, CASE WHEN f.ts IS NULL THEN s.title ELSE 'Giriş' END, 0.0
    FROM sources s LEFT JOIN (SELECT source_id, min(ts) AS ts FROM kept_marks GROUP BY source_id) f USING (source_id)
    WHERE f.ts IS NULL OR f.ts > 0)
  JOIN (SELECT source_id, end_of_source FROM sources) USING (source_id))"""
SECTIONED = """
assigned AS (
  SELECT s.source_id, s.seq, s.start, s."end", s.text, s.nw, k.sec_start, k.title AS sec_title
  FROM segments s JOIN skeleton k ON k.source_id = s.source_id AND s.start >= k.sec_start AND s.start < k.sec_end)"""
STUDY = [fx.MARKS, fx.SOURCES, THIN, SKELETON, SECTIONED]


@query("f6_section_skeleton", cte(*STUDY, recursive=True) + "SELECT source_id, title, sec_start, sec_end FROM skeleton")
def f6(spark, sf):
    return sections.section_skeleton(
        sections.thin_marks(fx.marks(spark, sf)), fx.sources(spark, sf)
    )


def assigned(spark, sf):
    """Segments with their section, written once."""
    return stage(study.sectioned(*fx.study_tables(spark, sf)))


@query("d3_assign_sections", cte(*STUDY, recursive=True) + """
SELECT source_id, sec_start, max(sec_title) AS title, min_by(start, seq) AS start, max_by("end", seq) AS "end", count(*) AS segments
FROM assigned GROUP BY source_id, sec_start""")
def d3(spark, sf):
    return sections.section_table(assigned(spark, sf))


@query("d3_section_rows", cte(*STUDY, recursive=True) + "SELECT source_id, seq, sec_start, sec_title FROM assigned")
def d3r(spark, sf):
    return assigned(spark, sf).select("source_id", "seq", "sec_start", "sec_title")


_LINE = f"length('[' || {ts_sql('start')} || '] ' || text)"
SPLIT = f"""
big AS (
  SELECT source_id, sec_start FROM assigned GROUP BY ALL HAVING sum({_LINE}) + count(*) - 1 > {SECTION}),
big_rows AS (
  SELECT *, length(text) + 12 AS cost, row_number() OVER (PARTITION BY source_id, sec_start ORDER BY seq) AS rn
  FROM assigned SEMI JOIN big USING (source_id, sec_start)),
split_walk AS (
  SELECT source_id, sec_start, seq, rn, cost AS size, 0 AS p FROM big_rows WHERE rn = 1
  UNION ALL
  SELECT n.source_id, n.sec_start, n.seq, n.rn,
    CASE WHEN k.size + n.cost > {SECTION} THEN n.cost ELSE k.size + n.cost END,
    k.p + CASE WHEN k.size + n.cost > {SECTION} THEN 1 ELSE 0 END
  FROM split_walk k JOIN big_rows n ON n.source_id = k.source_id AND n.sec_start = k.sec_start AND n.rn = k.rn + 1),
split_rows AS (
  SELECT a.source_id, a.seq, a.start, a."end", a.text, nw, CAST(w.p AS BIGINT) AS part_no,
    CASE WHEN w.p > 0 THEN min(a.start) OVER (PARTITION BY a.source_id, a.sec_start, w.p) ELSE a.sec_start END AS sec_start,
    a.sec_title || CASE WHEN w.p IS NULL THEN '' ELSE ' (' || CAST(w.p + 1 AS VARCHAR) || '. kısım)' END AS sec_title
  FROM assigned a LEFT JOIN split_walk w USING (source_id, sec_start, seq))"""


@query("f3_split_oversized", cte(*STUDY, SPLIT, recursive=True) + "SELECT source_id, seq, sec_start, part_no, sec_title FROM split_rows")
def f3(spark, sf):
    split = sections.split_oversized(assigned(spark, sf), SECTION)
    return split.select("source_id", "seq", "sec_start", "part_no", "sec_title")


PACK = f"""
blocks AS (SELECT source_id, CAST(seq AS BIGINT) AS seq, text AS block FROM segments),
big AS (SELECT source_id FROM blocks GROUP BY source_id HAVING sum(length(block)) + 2 * (count(*) - 1) > {SECTION}),
big_rows AS (
  SELECT source_id, seq, length(block) + 2 AS cost, row_number() OVER (PARTITION BY source_id ORDER BY seq) AS rn
  FROM blocks SEMI JOIN big USING (source_id)),
pack_walk AS (
  SELECT source_id, seq, rn, cost AS size, 0 AS b FROM big_rows WHERE rn = 1
  UNION ALL
  SELECT n.source_id, n.seq, n.rn, CASE WHEN k.size + n.cost > {SECTION} THEN n.cost ELSE k.size + n.cost END,
    k.b + CASE WHEN k.size + n.cost > {SECTION} THEN 1 ELSE 0 END
  FROM pack_walk k JOIN big_rows n ON n.source_id = k.source_id AND n.rn = k.rn + 1),
packed AS (
  SELECT x.source_id, x.seq, x.block, CAST(coalesce(w.b, 0) AS BIGINT) AS batch
  FROM blocks x LEFT JOIN pack_walk w USING (source_id, seq))"""


def blocks(spark, sf):
    return fx.segments(spark, sf).select(
        "source_id", F.col("seq").cast("long").alias("seq"), F.col("text").alias("block")
    )


@query("f4_pack_blocks", cte(fx.SEGMENTS, PACK, recursive=True) + "SELECT source_id, seq, batch FROM packed")
def f4(spark, sf):
    return requests.pack_blocks(blocks(spark, sf), SECTION).select("source_id", "seq", "batch")


SPANS = f"""
spans AS (
  SELECT source_id, window_id, min_by(start, seq) AS first_start, max_by("end", seq) AS last_end, count(*) AS segments
  FROM segments JOIN windows USING (source_id, seq) GROUP BY ALL),
shifted AS (
  SELECT source_id, window_id, seq, start + CASE seq % 3 WHEN 0 THEN 0 WHEN 1 THEN 30 ELSE -20 END AS ts
  FROM segments JOIN windows USING (source_id, seq))"""


@query("c11_valid_marks", cte(fx.SEGMENTS, fx.SOURCES, NUMBERED, BOUNDARY_WALK, SPANS, recursive=True) + """
SELECT m.source_id, m.window_id, m.seq, m.ts FROM shifted m JOIN spans USING (source_id, window_id) JOIN sources USING (source_id)
WHERE ts BETWEEN first_start AND last_end AND ts < end_of_source""")
def c11(spark, sf):
    windowed = sections.boundary_windows(fx.segments(spark, sf), BOUNDARY)
    shift = F.expr("CASE seq % 3 WHEN 0 THEN 0 WHEN 1 THEN 30 ELSE -20 END")
    marks = windowed.select(
        "source_id", "window_id", "seq", (F.col("start") + shift).alias("ts")
    )
    ends = transcripts.source_ends(fx.segments(spark, sf))
    return sections.valid_marks(marks, sections.window_table(windowed), ends)


# ----------------------------------------------------------------- parts

PART = 60.0
TIME_PARTS = f"""
planned AS (
  SELECT source_id, CAST(round_even(duration / {PART}, 0) AS INTEGER) AS parts, duration FROM sources),
parts AS (
  SELECT source_id, parts, part, duration / parts AS part_len, part * (duration / parts) AS part_start,
         part * (duration / parts) + duration / parts AS part_end
  FROM (SELECT *, unnest(range(parts))::INTEGER AS part FROM planned WHERE parts >= 2))"""


def time_parts(spark, sf):
    return parts.plan_time_parts(fx.sources(spark, sf), PART)


@query("f11_plan_time_parts", cte(fx.SEGMENTS, fx.SOURCES, TIME_PARTS) + "SELECT * FROM parts")
def f11(spark, sf):
    return time_parts(spark, sf)


@query("f11_plan_chunks", cte(fx.SEGMENTS, fx.SOURCES) + f"""
SELECT source_id, parts, part, duration / parts AS part_len, part * (duration / parts) AS part_start,
       part * (duration / parts) + duration / parts AS part_end
FROM (SELECT *, unnest(range(parts))::INTEGER AS part FROM (
  SELECT source_id, duration, greatest(1, CAST(round_even(duration / {PART}, 0) AS INTEGER)) AS parts FROM sources))""")
def f11c(spark, sf):
    return parts.plan_time_parts(fx.sources(spark, sf), PART, at_least=1)


@query("d4_assign_parts", cte(fx.SEGMENTS, fx.SOURCES, TIME_PARTS) + """
SELECT s.source_id, s.seq, p.part FROM segments s JOIN parts p ON p.source_id = s.source_id AND s.start >= p.part_start AND s.start < p.part_end""")
def d4(spark, sf):
    rows = parts.assign_parts(fx.segments(spark, sf), time_parts(spark, sf))
    return rows.select("source_id", "seq", "part")


@query("d4_empty_parts", cte(fx.SEGMENTS, fx.SOURCES, TIME_PARTS) + """
SELECT source_id, part, 'Bu parçada altyazı segmenti yok (boş aralık).' AS error FROM parts p
WHERE NOT EXISTS (SELECT 1 FROM segments s WHERE s.source_id = p.source_id AND s.nw >= 12 AND s.start >= p.part_start AND s.start < p.part_end)""")
def d4e(spark, sf):
    planned = time_parts(spark, sf)
    rows = parts.assign_parts(fx.segments(spark, sf).where("nw >= 12"), planned)
    return parts.empty_parts(planned, rows)


@query("d4_part_titles", cte(fx.SEGMENTS, fx.SOURCES, TIME_PARTS) + """
SELECT source_id, part, title || ' — Part ' || CAST(part + 1 AS VARCHAR) || ' (' || CAST(CAST(floor(part_start / 60) AS BIGINT) AS VARCHAR)
   || '-' || CAST(CAST(floor((part_start + part_len) / 60) AS BIGINT) AS VARCHAR) || 'dk)' AS part_title
FROM parts JOIN sources USING (source_id)""")
def d4t(spark, sf):
    titled = parts.titled_time_parts(time_parts(spark, sf), fx.sources(spark, sf))
    return titled.select("source_id", "part", "part_title")


@query("d4_unassigned_rows", cte(fx.SEGMENTS, "sources AS (SELECT source_id, max_by(\"end\", seq) / 2 AS duration FROM segments GROUP BY source_id)", TIME_PARTS) + """
SELECT s.source_id, s.seq FROM segments s WHERE EXISTS (SELECT 1 FROM parts p WHERE p.source_id = s.source_id)
AND NOT EXISTS (SELECT 1 FROM parts p WHERE p.source_id = s.source_id AND s.start >= p.part_start AND s.start < p.part_end)""")
def d4u(spark, sf):
    """A declared duration of half the real one leaves the rest outside every part."""
    short = fx.sources(spark, sf).withColumn("duration", F.col("duration") / 2)
    planned = parts.plan_time_parts(short, PART)
    return parts.unassigned_rows(fx.segments(spark, sf), planned).select("source_id", "seq")


@query("f15_number_parts", cte(fx.SEGMENTS) + """
SELECT source_id, seq, row_number() OVER (PARTITION BY source_id ORDER BY start, seq) - 1 AS number FROM segments""")
def f15(spark, sf):
    from lectern.operators import parts

    return parts.number_parts(fx.segments(spark, sf)).select("source_id", "seq", "number")


@query("flagship_compression", cte(*STUDY, recursive=True) + f"""
SELECT source_id, title, ts, words_in, words_out, round_even(CAST(words_in AS DOUBLE) / words_out, 1) AS ratio,
  CASE WHEN words_in < words_out THEN 'expansion' WHEN words_in >= 30 * words_out THEN 'high' WHEN words_in >= 12 * words_out THEN 'medium' ELSE 'low' END AS tier
FROM (SELECT source_id, max(sec_title) AS title, {ts_sql('min(start)')} AS ts,
        CAST(sum(nw + 1) AS BIGINT) AS words_in, CAST(min_by(nw, seq) AS BIGINT) AS words_out
      FROM assigned GROUP BY source_id, sec_start)
WHERE words_out > 0 AND words_in >= 120""")
def flagship(spark, sf):
    return study.compression_report(*fx.study_tables(spark, sf))
