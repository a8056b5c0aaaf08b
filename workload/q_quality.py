"""Quality measures, segments and their assembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import quality, transcripts

from . import fixtures as fx
from .q_scalars import ts_sql
from .registry import cte, query

MEASURES = """
measures AS (
  SELECT source_id,
    CASE WHEN w > 0 THEN CAST(m * 100 AS DOUBLE) / w ELSE 0.0 END AS punct_density,
    coalesce(CAST(u AS DOUBLE) / nullif(n, 0), 1.0) AS caps_ratio
  FROM (SELECT source_id, sum(len(regexp_extract_all(text, '[.!?]'))) AS m,
          sum(len(regexp_extract_all(text, '[^\\s]+'))) AS w,
          count(*) FILTER (WHERE regexp_matches(text, '\\p{L}')) AS n,
          count(*) FILTER (WHERE regexp_matches(regexp_extract(text, '\\p{L}'), '\\p{Lu}')) AS u
        FROM worn GROUP BY source_id))"""


@query("c1_punct_density", cte(fx.WORN, MEASURES) + "SELECT source_id, punct_density FROM measures")
def c1(spark, sf):
    return quality.punct_density(fx.worn_segments(spark, sf))


@query("c2_caps_ratio", cte(fx.WORN, MEASURES) + "SELECT source_id, caps_ratio FROM measures")
def c2(spark, sf):
    return quality.caps_ratio(fx.worn_segments(spark, sf))


@query("c3_needs_repair", cte(fx.WORN, MEASURES) + """
SELECT source_id, punct_density, caps_ratio, punct_density < 1.0 OR caps_ratio < 0.15 AS needs_repair FROM measures""")
def c3(spark, sf):
    return quality.needs_repair(fx.worn_segments(spark, sf))


@query("e12_quality_profile", cte(fx.WORN, MEASURES) + """
SELECT source_id, round_even(punct_density, 1) AS punct, round_even(caps_ratio, 2) AS caps,
       punct_density < 1.0 OR caps_ratio < 0.15 AS repaired FROM measures""")
def e12(spark, sf):
    return quality.quality_profile(fx.worn_segments(spark, sf))


@query("e12_quality_histogram", cte(fx.WORN, MEASURES) + """
SELECT bin, count(*) AS sources FROM (
  SELECT CASE WHEN caps < 0 THEN 0 WHEN caps >= 1 THEN 11 ELSE CAST(floor(caps * 10) AS BIGINT) + 1 END AS bin
  FROM (SELECT round_even(caps_ratio, 2) AS caps FROM measures)) GROUP BY bin""")
def e12h(spark, sf):
    return quality.quality_histogram(
        quality.quality_profile(fx.worn_segments(spark, sf)), "caps", 0.0, 1.0, 10
    )


@query("e12_quality_sketches", cte(fx.SEGMENTS) + """
SELECT lang, measure, share, count(*) AS n, true AS within
FROM segments JOIN (SELECT doc_id AS source_id, lang FROM documents) USING (source_id),
  (SELECT unnest(['words', 'chars']) AS measure), (SELECT unnest([0.05, 0.25, 0.5, 0.75, 0.95]::DOUBLE[]) AS share)
GROUP BY lang, measure, share""")
def e12s(spark, sf):
    """Quantiles of line lengths by language, from sketches of the sources, held against the exact ranks."""
    measures, shares = ["words", "chars"], [0.05, 0.25, 0.5, 0.75, 0.95]
    lines = fx.segments(spark, sf).select("source_id", F.col("nw").alias("words"), F.length("text").alias("chars"))
    langs = fx.table(spark, sf, "documents").select(F.col("doc_id").alias("source_id"), "lang")
    per_source = quality.measure_sketches(lines, ["source_id"], measures).join(langs, "source_id")
    found = quality.sketch_quantiles(
        quality.merged_sketches(per_source, ["lang"], measures), ["lang"], measures, shares)
    # each value's exact rank: the shares of lines below it and up to it
    rows = lines.join(langs, "source_id").select("lang", F.explode(F.map_from_arrays(
        F.array(*[F.lit(m) for m in measures]), F.array(*[F.col(m).cast("double") for m in measures]))).alias("measure", "x"))
    counts = rows.groupBy("lang", "measure", "x").agg(F.count(F.lit(1)).alias("c"))
    ranks = found.alias("f").join(counts.alias("r"), F.col("f.lang").eqNullSafe(F.col("r.lang")) & (
        F.col("f.measure") == F.col("r.measure"))).groupBy("f.lang", "f.measure", "n", "share").agg(
        F.sum(F.when(F.col("x") < F.col("value"), F.col("c")).otherwise(0)).alias("below"),
        F.sum(F.when(F.col("x") <= F.col("value"), F.col("c")).otherwise(0)).alias("upto"))
    slack = 3 * quality.RANK_ERROR * F.col("n")
    at = F.col("share") * F.col("n")
    return ranks.select("lang", "measure", "share", "n",
                        ((F.col("below") - slack <= at) & (at <= F.col("upto") + slack)).alias("within"))


# Repairs: a model that rewrites every window; some windows it shortens too much,
# and short lines it drops, so some windows get nothing. Windows are blocks of consecutive lines.
_WINDOW = "seq // 6"
REPAIRED = """
rewin AS (SELECT *, seq // 6 AS window_id FROM worn),
repaired AS (
  SELECT source_id, window_id, seq, start,
    CASE WHEN (source_id + window_id) % 4 = 1 THEN split_part(text, ' ', 1) ELSE upper(replace(text, 'ß', 'ss')) END AS text
  FROM rewin WHERE nw >= 6)"""


def repairs(spark, sf):
    """(windowed originals, candidate repairs)."""
    windowed = fx.worn_segments(spark, sf).withColumn("window_id", F.expr("CAST(seq div 6 AS BIGINT)"))
    made = windowed.where("nw >= 6").withColumn(
        "text",
        F.expr("CASE WHEN (source_id + window_id) % 4 = 1 THEN split_part(text, ' ', 1) ELSE upper(replace(text, 'ß', 'ss')) END"),
    )
    return windowed, made.select("source_id", "window_id", "seq", "start", "end", "text")


_WC = r"len(regexp_extract_all({}, '[^\s]+'))"
ACCEPTED = f"""
accepted AS (
  SELECT b.source_id, b.window_id, b.last_end FROM
    (SELECT source_id, window_id, sum({_WC.format('text')}) AS w, max_by("end", seq) AS last_end FROM rewin GROUP BY ALL) b
    JOIN (SELECT source_id, window_id, sum({_WC.format('text')}) AS w FROM repaired GROUP BY ALL) a USING (source_id, window_id)
  WHERE b.w = 0 OR CAST(a.w AS DOUBLE) / b.w >= 0.6)"""


@query("c4_accept_repairs", cte(fx.WORN, REPAIRED, ACCEPTED) + """
SELECT source_id, CAST(window_id AS BIGINT) AS window_id, seq, start, "end", text, 'original' AS origin
FROM rewin ANTI JOIN accepted USING (source_id, window_id)
UNION ALL
SELECT source_id, window_id, seq, start,
  coalesce(lead(start) OVER (PARTITION BY source_id, window_id ORDER BY start, seq), last_end), text, 'repaired'
FROM repaired JOIN accepted USING (source_id, window_id)""")
def c4(spark, sf):
    return quality.accept_repairs(*repairs(spark, sf))


@query("f10_close_ends", cte(fx.WORN, REPAIRED) + """
SELECT r.source_id, CAST(r.window_id AS BIGINT) AS window_id, r.seq, r.start, r.text,
  coalesce(lead(r.start) OVER (PARTITION BY r.source_id, r.window_id ORDER BY r.start, r.seq), last_end) AS "end"
FROM repaired r JOIN (SELECT source_id, window_id, max_by("end", seq) AS last_end FROM rewin GROUP BY ALL) w
USING (source_id, window_id)""")
def f10(spark, sf):
    from lectern.operators.sections import close_ends

    windowed, made = repairs(spark, sf)
    ends = windowed.groupBy("source_id", "window_id").agg(F.max_by("end", "seq").alias("last_end"))
    return close_ends(made, ends)


@query("e11_assemble_text", cte(fx.SEGMENTS) + f"""
SELECT source_id, CAST(seq // 4096 AS BIGINT) AS piece,
       string_agg('[' || {ts_sql('start')} || '] ' || text, chr(10) ORDER BY start, seq) AS text
FROM segments GROUP BY source_id, seq // 4096""")
def e11(spark, sf):
    return transcripts.transcript_pieces(fx.segments(spark, sf))


@query("c17_require_segments", cte(fx.SEGMENTS) + """
SELECT doc_id AS source_id, 'Transkript boş döndü — ses kanalı sessiz olabilir.' AS error
FROM documents WHERE doc_id NOT IN (SELECT source_id FROM segments WHERE nw >= 12)""")
def c17(spark, sf):
    every = fx.table(spark, sf, "documents").select(F.col("doc_id").alias("source_id"))
    return transcripts.require_segments(every, fx.segments(spark, sf).where("nw >= 12"))


@query("g3_sort_segments", cte(fx.SEGMENTS) + "SELECT source_id, seq, start FROM segments ORDER BY source_id, start, seq")
def g3(spark, sf):
    return transcripts.sort_segments(fx.segments(spark, sf)).select("source_id", "seq", "start")


_PRODUCERS = """
sidecar AS (SELECT source_id, seq, CASE WHEN source_id % 5 = 0 THEN 'side ' || text ELSE ' ' END AS text FROM segments),
tracks AS (SELECT source_id, seq, CASE WHEN source_id % 15 = 3 THEN '  ' WHEN source_id % 3 = 0 THEN 'track ' || text ELSE '' END AS text FROM segments),
asr AS (SELECT source_id, seq, text FROM segments)"""


@query("c16_choose_transcript", cte(fx.SEGMENTS, _PRODUCERS) + """
SELECT source_id, seq, text, 'sidecar' AS producer FROM sidecar WHERE trim(text) <> ''
UNION ALL SELECT source_id, seq, text, 'track' FROM tracks WHERE source_id % 5 <> 0 AND trim(text) <> ''
UNION ALL SELECT source_id, seq, text, 'asr' FROM asr WHERE source_id % 5 <> 0 AND (source_id % 3 <> 0 OR source_id % 15 = 3)""")
def c16(spark, sf):
    asr = fx.segments(spark, sf).select("source_id", "seq", "text")
    side = asr.withColumn(
        "text", F.expr("CASE WHEN source_id % 5 = 0 THEN 'side ' || text ELSE ' ' END")
    )
    track = asr.withColumn(
        "text",
        F.expr("CASE WHEN source_id % 15 = 3 THEN '  ' WHEN source_id % 3 = 0 THEN 'track ' || text ELSE '' END"),
    )
    return transcripts.choose_transcript({"sidecar": side, "track": track, "asr": asr})
