"""Model requests and responses, ledgers built from them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from lectern.functions.timecode import fmt_ts
from lectern.operators import ledger, requests, responses, scan, sections
from lectern.operators.stage import stage
from lectern.plans import study

from . import fixtures as fx
from .q_packing import (
    BOUNDARY, BOUNDARY_WALK, NUMBERED, PACK, REPAIR, REPAIR_WALK, SECTION, STUDY, assigned, blocks,
)
from .q_scalars import ts_sql
from .registry import cte, query

LINES = f"'[' || {ts_sql('start')} || '] ' || text"


# ------------------------------------------------------------------- requests

@query("m1_boundary_requests", cte(fx.SEGMENTS, fx.SOURCES, NUMBERED, BOUNDARY_WALK, recursive=True) + f"""
SELECT source_id, window_id, 'Video başlığı: ' || max(title) || chr(10) || chr(10) || 'Transkript parçası:' || chr(10) || chr(10)
  || string_agg({LINES}, chr(10) ORDER BY seq) AS "user"
FROM segments JOIN windows USING (source_id, seq) JOIN sources USING (source_id) GROUP BY source_id, window_id""")
def m1(spark, sf):
    rows = stage(fx.segments(spark, sf))
    return requests.boundary_requests(sections.boundary_windows(rows, BOUNDARY), fx.sources(spark, sf, rows))


@query("m2_section_requests", cte(*STUDY, recursive=True) + f"""
SELECT source_id, sec_start, 'Bölüm başlığı: ' || max(sec_title) || chr(10) || chr(10) || 'Transkript:' || chr(10) || chr(10)
  || string_agg({LINES}, chr(10) ORDER BY start, seq)
  || CASE WHEN max(sec_title) LIKE 'T%' THEN chr(10) || chr(10) || '---' || chr(10) || chr(10) || 'EKRAN METNİ (OCR):' || chr(10) || chr(10) || 'S' || CAST(source_id AS VARCHAR) ELSE '' END AS "user"
FROM assigned GROUP BY source_id, sec_start""")
def m2(spark, sf):
    rows = assigned(spark, sf)
    shown = rows.where("sec_title LIKE 'T%'").select("source_id", "sec_start").distinct().withColumn(
        "screen", F.concat(F.lit("S"), "source_id")
    )
    return requests.section_requests(rows, shown)


@query("m3_critic_requests", cte(*STUDY, recursive=True) + f"""
SELECT source_id, sec_start, 'BÖLÜM TRANSKRİPTİ:' || chr(10) || chr(10) || string_agg({LINES}, chr(10) ORDER BY start, seq)
  || chr(10) || chr(10) || '---' || chr(10) || chr(10) || 'TASLAK ÖZET:' || chr(10) || chr(10) || min_by(text, seq)
  || coalesce(chr(10) || string_agg('- ' || {LINES}, chr(10) ORDER BY start, seq) FILTER (WHERE nw >= 12), '') AS "user"
FROM assigned GROUP BY source_id, sec_start""")
def m3(spark, sf):
    rows = assigned(spark, sf)
    points = rows.where("nw >= 12").select(
        "source_id", "sec_start", F.col("start").alias("ts"), "seq", "text"
    )
    drafts = requests.section_drafts(study.first_line_notes(rows), points)
    return requests.critic_requests(rows, drafts)


@query("m4_repair_requests", cte(fx.SEGMENTS, NUMBERED, REPAIR_WALK, recursive=True) + f"""
SELECT source_id, window_id, 'TRANSKRİPT:' || chr(10) || chr(10) || string_agg({LINES}, chr(10) ORDER BY seq)
  || CASE WHEN window_id = 0 THEN chr(10) || chr(10) || '---' || chr(10) || chr(10) || 'EKRAN METNİ (terim ve özel isim düzeltmek için):' || chr(10) || chr(10) || 'S' || CAST(source_id AS VARCHAR) ELSE '' END AS "user"
FROM segments JOIN windows USING (source_id, seq) GROUP BY source_id, window_id""")
def m4(spark, sf):
    windowed = stage(sections.repair_windows(fx.segments(spark, sf), REPAIR))
    shown = windowed.where("window_id = 0").select("source_id", "window_id").distinct().withColumn(
        "screen", F.concat(F.lit("S"), "source_id")
    )
    return requests.repair_requests(windowed, shown)


@query("m5_synthesis_requests", cte(fx.SEGMENTS, PACK, recursive=True) + """
SELECT source_id, batch, string_agg(block, chr(10) || chr(10) ORDER BY seq) AS "user" FROM packed GROUP BY source_id, batch""")
def m5(spark, sf):
    return requests.synthesis_requests(requests.pack_blocks(blocks(spark, sf), SECTION))


@query("m5_synthesis_blocks", cte(fx.SEGMENTS) + f"""
SELECT source_id, seq, '## [' || {ts_sql('start')} || '] T' || CAST(seq AS VARCHAR) || chr(10) || text AS block FROM segments""")
def m5b(spark, sf):
    notes = fx.segments(spark, sf).select(
        "source_id", "seq", "start", F.concat(F.lit("T"), "seq").alias("title"), F.col("text").alias("summary")
    )
    return requests.synthesis_blocks(notes)


@query("m5_learning_requests", cte(fx.SEGMENTS) + f"""
SELECT source_id, substr(string_agg(text, chr(10) || chr(10) ORDER BY seq), 1, {SECTION}) AS "user",
  length(string_agg(text, chr(10) || chr(10) ORDER BY seq)) > {SECTION} AS cropped FROM segments GROUP BY source_id""")
def m5l(spark, sf):
    return requests.learning_requests(blocks(spark, sf), SECTION).select("source_id", "user", "cropped")


EXISTING = "existing AS (SELECT string_agg('- ' || collection, chr(10) ORDER BY last_used DESC) AS listing FROM (SELECT collection, max(created_at) AS last_used FROM jobs WHERE collection <> '' GROUP BY collection))"


@query("m6_collection_requests", cte(fx.JOBS, EXISTING) + """
SELECT id, 'MEVCUT KOLEKSİYONLAR:' || chr(10) || listing || chr(10) || chr(10) || 'YENİ İÇERİK:' || chr(10) || 'Başlık: ' || title || chr(10) || 'Konular: '
  || CASE WHEN k % 3 = 0 THEN '(yok)' ELSE 't' || CAST(k % 4 AS VARCHAR) || ', ' || provider END AS "user"
FROM jobs, existing""")
def m6(spark, sf):
    from lectern.operators import library

    rows = fx.jobs(spark, sf)
    listing = library.collections_by_recency(rows).groupBy().agg(
        F.array_join(F.transform(
            F.sort_array(F.collect_list(F.struct("last_used", "collection")), asc=False),
            lambda c: F.concat(F.lit("- "), c["collection"]),
        ), "\n").alias("listing")
    )
    topics = F.expr("CASE WHEN k % 3 = 0 THEN CAST(array() AS ARRAY<STRING>) ELSE array('t' || CAST(k % 4 AS STRING), provider) END")
    return requests.collection_requests(rows.withColumn("topics", topics), listing)


@query("m6_title_requests", cte(fx.SEGMENTS) + """
SELECT source_id AS id, 'BÖLÜM BAŞLIKLARI:' || chr(10)
  || array_to_string(list_transform(s, lambda x: '- ' || x), chr(10))
  || chr(10) || chr(10) || 'KONULAR: ' || array_to_string(list_transform(list_sort(list_transform(list_distinct(t), lambda x: {'p': list_position(t, x), 'v': x})), lambda x: x.v), ', ') AS "user"
FROM (SELECT source_id, list(text ORDER BY seq) AS s, list(lower(text) ORDER BY seq) AS t FROM segments GROUP BY source_id)""")
def m6t(spark, sf):
    def listed(line):
        cells = F.sort_array(F.collect_list(F.struct("seq", line.alias("w"))))
        return F.transform(cells, lambda c: c["w"])

    jobs = fx.segments(spark, sf).groupBy(F.col("source_id").alias("id")).agg(
        listed(F.col("text")).alias("section_titles"), listed(F.lower("text")).alias("topics")
    )
    return requests.title_requests(jobs).select("id", "user")


TURNS = """
qa AS (
  SELECT conv_id, turn, text AS question, CASE WHEN next_role = 'assistant' THEN next_text ELSE '' END AS answer FROM (
    SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  WHERE role = 'user'),
recent AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM qa) WHERE rn <= 2 AND answer <> ''),
history AS (SELECT conv_id, string_agg('K: ' || trim(question) || chr(10) || 'C: ' || trim(answer) || chr(10), '' ORDER BY turn) AS history FROM recent GROUP BY conv_id)"""


def turns(spark, sf):
    cut = fx.table(spark, sf, "conversations").withColumn("_block", scan.block_of(F.col("turn")))
    rows = scan.next_value(cut, ["conv_id"], ["turn"], "_block", {"role": "nr", "text": "nt"})
    return rows.where("role = 'user'").select(
        "conv_id", "turn", F.col("text").alias("question"),
        F.when(F.col("nr") == "assistant", F.col("nt")).otherwise("").alias("answer"),
    )


@query("f13_recent_turns", cte(TURNS) + "SELECT conv_id, history FROM history")
def f13(spark, sf):
    return requests.recent_turns(turns(spark, sf), 2)


@query("m7_question_requests", cte(TURNS) + """
SELECT doc_id AS id, length(body) > 48000 AS cropped,
  'BAŞLIK: Doc ' || CAST(doc_id AS VARCHAR) || chr(10) || chr(10) || 'TRANSKRİPT' || CASE WHEN length(body) > 48000 THEN ' (yalnızca ilk kısmı — tümü sığmadı)' ELSE '' END || ':' || chr(10)
  || substr(body, 1, 48000) || chr(10) || chr(10)
  || coalesce('ÖNCEKİ KONUŞMA (yalnızca soruyu anlamak için):' || chr(10) || history || chr(10), '') || 'SORU: ne?' AS "user"
FROM (SELECT doc_id, repeat(text, 20) AS body FROM documents) LEFT JOIN history ON conv_id = doc_id""")
def m7(spark, sf):
    docs = fx.table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.concat(F.lit("Doc "), "doc_id").alias("title"),
        F.repeat("text", 20).alias("transcript"), F.lit("ne?").alias("question"),
        F.lit("groq").alias("provider"),
    )
    history = requests.recent_turns(turns(spark, sf), 2).withColumnRenamed("conv_id", "id")
    limited = requests.with_limits(docs, requests.provider_windows(spark))
    out = requests.question_requests(limited.join(history, "id", "left"))
    return out.select("id", "cropped", "user")


ASKED = 1500


@query("m7_retrieved_questions", cte(fx.SEGMENTS, TURNS, f"""
asked AS (SELECT s.doc_id AS id, d.doc_id AS source_id, 'Doc ' || d.doc_id AS title, string_split(s.text, chr(10))[-1] AS question
  FROM documents s JOIN documents d ON d.doc_id = s.doc_id - s.doc_id % 3),
terms AS (SELECT source_id, seq, unnest(list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'))) AS term FROM segments),
rare AS (SELECT source_id, term, count(*) AS df FROM terms GROUP BY ALL),
sizes AS (SELECT source_id, count(*) AS n FROM segments GROUP BY source_id),
weights AS (
  SELECT id, q.source_id, q.term, CAST(floor(1000 * ln(n::DOUBLE / df)) AS BIGINT) AS w
  FROM (SELECT id, source_id, unnest(list_distinct(regexp_extract_all(lower(question), '[\\p{{L}}\\p{{N}}]+'))) AS term FROM asked) q
  JOIN rare USING (source_id, term) JOIN sizes USING (source_id)),
scores AS (SELECT id, seq, sum(w) AS score FROM terms JOIN weights USING (source_id, term) GROUP BY id, seq),
ranked AS (
  SELECT *, sum(length(line) + 1) OVER (PARTITION BY id ORDER BY score DESC, start, seq ROWS UNBOUNDED PRECEDING) AS upto FROM (
    SELECT a.id, s.start, s.seq, '[' || {ts_sql('start')} || '] ' || s.text AS line, coalesce(score, 0) AS score
    FROM asked a JOIN segments s USING (source_id) LEFT JOIN scores c ON c.id = a.id AND c.seq = s.seq)),
carried AS (SELECT id, string_agg(line, chr(10) ORDER BY start, seq) AS body, count(*) AS lines FROM ranked WHERE upto <= {ASKED} + 1 GROUP BY id)""") + """
SELECT a.id, a.source_id, coalesce(n, 0) - coalesce(lines, 0) AS left_out,
  'BAŞLIK: ' || title || chr(10) || chr(10) || 'TRANSKRİPT:' || chr(10) || coalesce(body, '') || chr(10) || chr(10)
  || coalesce('ÖNCEKİ KONUŞMA (yalnızca soruyu anlamak için):' || chr(10) || history || chr(10), '') || 'SORU: ' || question AS "user"
FROM asked a LEFT JOIN carried USING (id) LEFT JOIN sizes USING (source_id) LEFT JOIN history ON conv_id = a.id""")
def m7r(spark, sf):
    """Every document asks about a document: its last line is the question."""
    docs = fx.undealt(spark, sf, "documents")
    about = docs.select(F.col("doc_id").alias("source_id"))
    asked = docs.select(
        F.col("doc_id").alias("id"), F.expr("doc_id - doc_id % 3").alias("source_id"),
        F.concat(F.lit("Doc "), F.expr("doc_id - doc_id % 3")).alias("title"), F.element_at(F.split("text", "\n"), -1).alias("question"),
    ).join(about, "source_id", "left_semi")
    history = requests.recent_turns(turns(spark, sf), 2).withColumnRenamed("conv_id", "id")
    return requests.retrieved_question_requests(asked.join(history, "id", "left"), stage(fx.segments(spark, sf)), ASKED)


@query("d12_with_limits", cte(fx.JOBS) + """
SELECT id, CASE provider WHEN 'groq' THEN 6000 ELSE 120000 END AS boundary, CASE provider WHEN 'groq' THEN 8000 ELSE 40000 END AS section,
  CASE provider WHEN 'groq' THEN 4000 WHEN 'openrouter' THEN 10000 WHEN 'anthropic' THEN 40000 ELSE 20000 END AS repair FROM jobs""")
def d12(spark, sf):
    out = requests.with_limits(fx.jobs(spark, sf), requests.provider_windows(spark))
    return out.select("id", "boundary", "section", "repair")


_LIMITS = """CASE WHEN doc_id % 4 = 0 THEN NULL ELSE 2000 END AS tokens_per_minute,
  CASE WHEN doc_id % 3 = 0 THEN 900 END AS max_output"""


_BUDGET = "(CASE k.source_id % 4 WHEN 0 THEN 6000 ELSE 120000 END)"


@query("d12_windows_per_provider", cte(fx.SEGMENTS, NUMBERED, BOUNDARY_WALK.replace(f">= {BOUNDARY}", f">= {_BUDGET}").replace(f"< {BOUNDARY // 3}", f"< {_BUDGET} // 3"), recursive=True) + "SELECT source_id, seq, CASE WHEN source_id % 9 > 0 THEN window_id END AS window_id, CASE WHEN source_id % 9 = 0 THEN 'unknown provider: none' END AS error FROM segments LEFT JOIN windows USING (source_id, seq)")
def d12w(spark, sf):
    rows = stage(fx.segments(spark, sf).withColumn("provider", F.expr(
        "CASE WHEN source_id % 9 = 0 THEN NULL ELSE CASE source_id % 4 WHEN 0 THEN 'groq' WHEN 1 THEN 'openrouter' WHEN 2 THEN 'anthropic' ELSE 'gemini' END END"
    )))
    out = requests.per_provider(rows, "boundary", sections.boundary_windows)
    return out.select("source_id", "seq", "window_id", "error")


@query("m8_admit_requests", f"""
SELECT request_id, CAST(p AS BIGINT) AS prompt_tokens, CASE WHEN NOT (tokens_per_minute IS NOT NULL AND 1700 - p < 400)
    THEN CAST(least(max_tokens, CASE WHEN tokens_per_minute IS NULL THEN max_tokens ELSE 1700 - p END, coalesce(max_output, max_tokens)) AS BIGINT) END AS granted_tokens,
  CASE WHEN 1700 - p < 400 AND tokens_per_minute IS NOT NULL THEN 'input too large: ~' || CAST(p AS VARCHAR) || ' tokens of 2000' END AS reason
FROM (SELECT *, length(system) // 3 + length(user_text) // 3 AS p FROM (SELECT doc_id AS request_id, source AS system, text AS user_text, 1600 AS max_tokens, {_LIMITS} FROM documents))""")
def m8(spark, sf):
    rows = fx.table(spark, sf, "documents").selectExpr(
        "doc_id AS request_id", "source AS system", "text AS user",
        "1600 AS max_tokens", *_LIMITS.split(",\n"),
    )
    out = requests.admit_requests(rows)
    return out.select("request_id", "prompt_tokens", "granted_tokens", "reason")


# ------------------------------------------------------------------ responses

OK = "source_id % 11 <> 0 AND source_id % 7 <> 0"


def noisy(df, body, rid="source_id"):
    """Responses as they come: some failed, some cut off, some wrapped in prose."""
    r = F.col(rid)
    text = (
        F.when(r % 11 == 0, F.lit(None).cast("string"))
        .when(r % 7 == 0, F.substr(body, F.lit(1), F.length(body) - 1))
        .when(r % 5 == 0, F.concat(F.lit("Sure:\n```json\n"), body, F.lit("\n```")))
        .otherwise(body)
    )
    return df.select(
        F.col(rid).alias("source_id"), F.col(rid).alias("request_id"), text.alias("body"),
        F.when(r % 11 == 0, "timeout").alias("error"),
    )


def gathered(rows, item, *more):
    cells = F.sort_array(F.collect_list(F.struct("seq", item.alias("i"))))
    return rows.groupBy("source_id").agg(F.transform(cells, lambda c: c["i"]).alias("items"), *more)


def section_responses(spark, sf):
    rows = fx.segments(spark, sf)
    stamp = F.concat(F.lit("["), fmt_ts(F.col("start")), F.lit("]"))
    point = F.struct(stamp.alias("ts"), F.concat(F.lit(" "), "text", F.lit(" ")).alias("text"))
    term = F.struct(F.split_part("text", F.lit(" "), F.lit(1)).alias("term"), F.concat(F.lit("d"), "seq").alias("definition"))
    cells = F.sort_array(F.collect_list(F.struct("seq", point.alias("p"), term.alias("t"))))
    made = rows.groupBy("source_id").agg(cells.alias("c"), F.min_by("text", "seq").alias("s"))
    body = F.to_json(F.struct(
        F.concat(F.lit("  "), "s").alias("summary"),
        F.transform("c", lambda x: x["p"]).alias("points"), F.transform("c", lambda x: x["t"]).alias("terms"),
    ))
    return noisy(made, body)


@query("m9_decode_sections", cte(fx.SEGMENTS) + f"""
SELECT source_id, CASE WHEN {OK} THEN min_by(text, seq) END AS summary, CAST(CASE WHEN {OK} THEN count(*) ELSE 0 END AS INTEGER) AS points,
  CAST(CASE WHEN {OK} THEN count(*) ELSE 0 END AS INTEGER) AS terms FROM segments GROUP BY source_id""")
def m9(spark, sf):
    return responses.decode_sections(section_responses(spark, sf)).select("source_id", "summary", "points", "terms")


@query("m9_decode_points", cte(fx.SEGMENTS) + f"""
SELECT source_id, CAST(row_number() OVER (PARTITION BY source_id ORDER BY seq) - 1 AS INTEGER) AS pos, floor(start) AS ts, text FROM segments WHERE {OK}""")
def m9p(spark, sf):
    return responses.decode_points(section_responses(spark, sf)).select("source_id", "pos", "ts", "text")


@query("m9_decode_terms", cte(fx.SEGMENTS) + f"""
SELECT source_id, CAST(row_number() OVER (PARTITION BY source_id ORDER BY seq) - 1 AS INTEGER) AS pos, split_part(text, ' ', 1) AS term, 'd' || CAST(seq AS VARCHAR) AS definition FROM segments WHERE {OK}""")
def m9t(spark, sf):
    return responses.decode_terms(section_responses(spark, sf)).select("source_id", "pos", "term", "definition")


@query("m10_decode_marks", cte(fx.MARKS) + f"""
SELECT source_id, CAST(row_number() OVER (PARTITION BY source_id ORDER BY seq) - 1 AS INTEGER) AS pos, floor(ts) AS ts, title FROM marks WHERE {OK}""")
def m10(spark, sf):
    item = F.struct(F.concat(F.lit(" "), "title").alias("title"), fmt_ts(F.col("ts")).alias("start_ts"))
    made = gathered(fx.marks(spark, sf), item)
    body = F.to_json(F.struct(F.col("items").alias("sections")))
    return responses.decode_marks(noisy(made, body)).select("source_id", "pos", "ts", "title")


_KIND = "CASE (source_id + seq) % 8 WHEN 0 THEN 'sayı' WHEN 1 THEN 'isim' WHEN 2 THEN 'tanım' WHEN 3 THEN 'uyarı' WHEN 4 THEN 'istisna' WHEN 5 THEN 'adım' WHEN 6 THEN 'other' ELSE '' END"
_ORIGIN = "CASE seq % 3 WHEN 0 THEN 'ekran' WHEN 1 THEN 'konuşma' ELSE 'elsewhere' END"
_ITEM = "CASE WHEN seq % 10 = 9 THEN '  ' ELSE text END"
ITEMS = f"items AS (SELECT source_id, seq, start AS ts, {_ITEM} AS text, {_KIND} AS kind, {_ORIGIN} AS origin FROM segments)"
ADMITTED = """admitted AS (SELECT source_id, seq, ts, trim(text) AS text, CASE WHEN kind = 'other' THEN '' ELSE kind END AS kind,
  CASE WHEN origin = 'elsewhere' THEN '' ELSE origin END AS origin FROM items WHERE trim(text) <> '')"""


def items(spark, sf):
    return fx.segments(spark, sf).selectExpr(
        "source_id", "seq", "start AS ts", f"{_ITEM} AS text", f"{_KIND} AS kind", f"{_ORIGIN} AS origin"
    )


@query("m11_decode_critic", cte(fx.SEGMENTS, ITEMS, ADMITTED) + f"""
SELECT a.source_id, CAST(p.pos AS INTEGER) AS pos, floor(a.ts) AS ts, a.text, a.kind, a.origin FROM admitted a
JOIN (SELECT source_id, seq, row_number() OVER (PARTITION BY source_id ORDER BY seq) - 1 AS pos FROM items) p USING (source_id, seq) WHERE {OK}""")
def m11(spark, sf):
    item = F.struct(fmt_ts(F.col("ts")).alias("ts"), "text", F.col("kind").alias("tur"), F.col("origin").alias("kaynak"))
    body = F.to_json(F.struct(F.col("items").alias("missing")))
    out = responses.decode_critic(noisy(gathered(items(spark, sf), item), body))
    return out.select("source_id", "pos", "ts", "text", "kind", "origin")


@query("c13_admit_critic", cte(fx.SEGMENTS, ITEMS, ADMITTED) + "SELECT * FROM admitted")
def c13(spark, sf):
    return ledger.admit_critic(items(spark, sf))


@query("e1_critic_ledger", cte(fx.SEGMENTS, ITEMS, ADMITTED) + """
SELECT source_id, array_to_string(list_filter([
    CASE WHEN a > 0 THEN 'sayı=' || CAST(a AS VARCHAR) END, CASE WHEN b > 0 THEN 'isim=' || CAST(b AS VARCHAR) END, CASE WHEN c > 0 THEN 'tanım=' || CAST(c AS VARCHAR) END,
    CASE WHEN d > 0 THEN 'uyarı=' || CAST(d AS VARCHAR) END, CASE WHEN e > 0 THEN 'istisna=' || CAST(e AS VARCHAR) END, CASE WHEN f > 0 THEN 'adım=' || CAST(f AS VARCHAR) END], lambda x: x IS NOT NULL), ',') AS critic_types,
  s AS critic_from_screen, n AS critic_added
FROM (SELECT source_id, count(*) FILTER (WHERE kind = 'sayı') AS a, count(*) FILTER (WHERE kind = 'isim') AS b, count(*) FILTER (WHERE kind = 'tanım') AS c,
  count(*) FILTER (WHERE kind = 'uyarı') AS d, count(*) FILTER (WHERE kind = 'istisna') AS e, count(*) FILTER (WHERE kind = 'adım') AS f,
  count(*) FILTER (WHERE origin = 'ekran') AS s, count(*) AS n FROM admitted GROUP BY source_id)""")
def e1(spark, sf):
    out = ledger.critic_ledger(ledger.admit_critic(items(spark, sf)))
    text = F.transform(F.map_entries("critic_types"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return out.withColumn("critic_types", F.array_join(text, ","))


@query("m12_decode_repairs", cte(fx.SEGMENTS, ITEMS) + f"""
SELECT source_id, seq, start, text FROM (
  SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY seq) - 1 AS seq, floor(ts) AS start, trim(text) AS text FROM items) WHERE text <> '' AND {OK}""")
def m12(spark, sf):
    item = F.struct(fmt_ts(F.col("ts")).alias("ts"), "text")
    body = F.to_json(F.struct(F.col("items").alias("sentences")))
    out = responses.decode_repairs(noisy(gathered(items(spark, sf), item), body))
    return out.select("source_id", "seq", "start", "text")


@query("m13_decode_learning", cte(fx.SEGMENTS) + f"""
SELECT source_id, CASE WHEN {OK} AND source_id % 3 = 0 THEN 'kurs' ELSE 'genel' END AS learning_type, CASE WHEN {OK} AND source_id % 2 = 0 THEN 'podcast' ELSE 'genel' END AS tur,
  CASE WHEN {OK} THEN array_to_string(list_filter(w, lambda x: x <> ''), '|') ELSE '' END AS steps,
  CASE WHEN {OK} THEN array_to_string(list_filter(w, lambda x: x <> ''), '|') ELSE '' END AS topics,
  CAST(CASE WHEN {OK} THEN len(list_filter(w, lambda x: x <> '')) ELSE 0 END AS INTEGER) AS quiz,
  CASE WHEN {OK} THEN 'p ' || CAST(source_id AS VARCHAR) ELSE '' END AS deepen_prompt
FROM (SELECT source_id, list(text ORDER BY seq) AS w FROM segments GROUP BY source_id)""")
def m13(spark, sf):
    made = gathered(fx.segments(spark, sf), F.col("text"))
    r = F.col("source_id")
    spaced = F.transform("items", lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    body = F.to_json(F.struct(
        F.when(r % 3 == 0, "kurs").otherwise("odd").alias("type"), F.when(r % 2 == 0, "podcast").otherwise("x").alias("tur"),
        spaced.alias("steps"), F.array().cast("array<string>").alias("actions"),
        F.transform("items", lambda w: F.struct(w.alias("soru"), F.lit("a").alias("cevap"))).alias("quiz"),
        F.concat(F.lit(" p "), r.cast("string")).alias("deepen_prompt"), spaced.alias("topics"),
    ))
    out = responses.decode_learning(noisy(made, body))
    return out.select(
        "source_id", "learning_type", "tur", F.array_join("steps", "|").alias("steps"),
        F.array_join("topics", "|").alias("topics"), F.size("quiz").alias("quiz"), "deepen_prompt",
    )


@query("m14_decode_answers", f"""
SELECT source_id, NOT ({OK}) AS failed, CASE WHEN {OK} THEN source_id % 2 = 0 END AS found,
  CASE WHEN {OK} THEN CASE WHEN source_id % 3 <> 0 THEN 'A ' || lang ELSE '' END
  || CASE WHEN source_id % 4 = 0 THEN chr(10) || chr(10) || '(Not: kaynak bu sohbet için çok uzundu, yalnızca ilk kısmına bakabildim — cevap eksik olabilir.)'
          WHEN source_id % 3 = 0 THEN 'Bunu kaynakta bulamadım.' ELSE '' END END AS answer,
  CASE WHEN {OK} THEN '[00:01] ' || source ELSE '' END AS evidence
FROM (SELECT doc_id AS source_id, lang, source FROM documents)""")
def m14(spark, sf):
    docs = fx.table(spark, sf, "documents").withColumnRenamed("doc_id", "source_id")
    r = F.col("source_id")
    body = F.to_json(F.struct(
        (r % 2 == 0).alias("found"), F.when(r % 3 == 0, " ").otherwise(F.concat(F.lit(" A "), "lang", F.lit("\n"))).alias("answer"),
        F.array(F.lit(" "), F.concat(F.lit("[00:01] "), "source")).alias("kaynak"),
    ))
    replies = noisy(docs, body).withColumn("cropped", r % 4 == 0)
    return responses.decode_answers(replies).select(
        "source_id", "failed", "found", "answer", F.array_join("evidence", "|").alias("evidence")
    )


@query("m15_decode_labels", f"""
SELECT source_id, CASE WHEN ({OK}) AND source_id % 3 <> 0 THEN 'Kurs ' || lang ELSE 'old ' || source END AS new_title
FROM (SELECT doc_id AS source_id, lang, source FROM documents)""")
def m15(spark, sf):
    docs = fx.table(spark, sf, "documents").withColumnRenamed("doc_id", "source_id")
    title = F.when(F.col("source_id") % 3 == 0, ' " ').otherwise(F.concat(F.lit(' " Kurs '), "lang", F.lit('" ')))
    replies = noisy(docs, F.to_json(F.struct(title.alias("title"))))
    old = docs.select("source_id", F.concat(F.lit("old "), "source").alias("old"))
    return responses.decode_titles(replies.join(old, "source_id"), "old").select("source_id", "new_title")


@query("m15_decode_collections", f"""
SELECT source_id, CASE WHEN ({OK}) AND source_id % 3 <> 0 THEN 'C ' || lang END AS name FROM (SELECT doc_id AS source_id, lang, source FROM documents)""")
def m15c(spark, sf):
    docs = fx.table(spark, sf, "documents").withColumnRenamed("doc_id", "source_id")
    name = F.when(F.col("source_id") % 3 == 0, "  ").otherwise(F.concat(F.lit(" C "), "lang"))
    return responses.decode_collections(noisy(docs, F.to_json(F.struct(name.alias("collection"))))).select("source_id", "name")


@query("d11_with_responses", f"""
SELECT source_id AS request_id, NOT ({OK}) OR lang = 'de' AS failed FROM (SELECT doc_id AS source_id, lang FROM documents)""")
def d11(spark, sf):
    docs = fx.table(spark, sf, "documents").withColumnRenamed("doc_id", "source_id")
    replies = noisy(docs.where("lang <> 'de'"), F.to_json(F.struct("lang")))
    asked = docs.select(F.col("source_id").alias("request_id"))
    # every third request was answered twice: first in vain
    vain = replies.where("request_id % 3 = 0").withColumn("body", F.lit(None).cast("string")).withColumn(
        "error", F.lit("timeout"))
    return responses.with_responses(asked, vain.unionByName(replies)).select("request_id", "failed")


@query("d11_failed_requests", f"""
SELECT source_id AS request_id, CASE WHEN source_id % 11 = 0 AND lang <> 'de' THEN 'timeout' ELSE 'invalid or missing response' END AS error
FROM (SELECT doc_id AS source_id, lang FROM documents) WHERE NOT ({OK}) OR lang = 'de'""")
def d11f(spark, sf):
    docs = fx.table(spark, sf, "documents").withColumnRenamed("doc_id", "source_id")
    replies = noisy(docs.where("lang <> 'de'"), F.to_json(F.struct("lang")))
    return responses.failed_requests(docs.select(F.col("source_id").alias("request_id")), replies)


def word_counter(batches):
    """Stand-in scorer: answers with the number of words, fails on German."""
    for frame in batches:
        if (frame["system"] == "de").any():
            raise ValueError("no german")
        words = frame["user"].str.split().str.len().astype(str)
        yield pd.DataFrame({"request_id": frame["request_id"], "body": '{"n": ' + words + "}"})


@query("u1_score", r"""
SELECT doc_id AS request_id, CASE WHEN lang <> 'de' THEN '{"n": ' || CAST(len(regexp_extract_all(text, '[^\s]+')) AS VARCHAR) || '}' END AS body,
       CASE WHEN lang = 'de' THEN 'no german' END AS error FROM documents""")
def u1(spark, sf):
    asked = fx.table(spark, sf, "documents").select(
        F.col("doc_id").alias("request_id"), F.col("lang").alias("system"), F.col("text").alias("user"),
        F.lit(100).alias("max_tokens"),
    )
    return requests.score(asked, word_counter).select("request_id", "body", "error")


# --------------------------------------------------------------------- ledgers

@query("c12_measurable", """
SELECT l_orderkey, l_linenumber, CASE WHEN o > 0 AND i >= 120 THEN CAST(i AS DOUBLE) / o END AS ratio
FROM (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) * 10 AS i, CAST(l_partkey % 40 AS BIGINT) AS o FROM lineitem)""")
def c12(spark, sf):
    rows = fx.table(spark, sf, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "CAST(l_quantity AS BIGINT) * 10 AS words_in", "l_partkey % 40 AS words_out"
    )
    return ledger.measurable(rows).select("l_orderkey", "l_linenumber", "ratio")


@query("e2_section_compression", cte(*STUDY, recursive=True) + f"""
SELECT source_id, sec_start, max(sec_title) AS title, {ts_sql('min(start)')} AS ts, CAST(sum(nw + 1) AS BIGINT) AS words_in,
  CAST(min_by(nw, seq) + coalesce(sum(nw) FILTER (WHERE nw >= 12), 0) AS BIGINT) AS words_out,
  CAST(sum(nw + 1) AS DOUBLE) / (min_by(nw, seq) + coalesce(sum(nw) FILTER (WHERE nw >= 12), 0)) AS ratio
FROM assigned GROUP BY source_id, sec_start HAVING sum(nw + 1) >= 120""")
def e2(spark, sf):
    rows = assigned(spark, sf)
    points = rows.where("nw >= 12").select("source_id", "sec_start", "text")
    return ledger.section_compression(rows, study.first_line_notes(rows), points)


@query("f14_merge_points", cte(fx.SEGMENTS, ITEMS, ADMITTED) + """
SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY ts, added, seq) AS rank, text, added FROM (
  SELECT source_id, seq, start AS ts, text, 0 AS added FROM segments UNION ALL SELECT source_id, seq, ts, text, 1 FROM admitted)""")
def f14(spark, sf):
    points = fx.segments(spark, sf).select("source_id", F.lit(0.0).alias("sec_start"), F.col("start").alias("ts"), "text", "seq")
    critic = ledger.admit_critic(items(spark, sf)).withColumn("sec_start", F.lit(0.0))
    merged = ledger.merge_points(points, critic).withColumn("_block", scan.block_of(F.col("ts"), 600))
    out = scan.number_rows(merged, ["source_id"], ["ts", "added", "seq"], "_block", "rank", start=1)
    return out.select("source_id", "rank", "text", "added")


@query("g4_union_all", cte(fx.TERMS) + """
SELECT source_id, pos, term, definition FROM terms UNION ALL SELECT source_id, pos, 'S ' || term, definition FROM terms""")
def g4(spark, sf):
    terms = fx.terms(spark, sf)
    return ledger.union_terms(terms, terms.withColumn("term", F.concat(F.lit("S "), "term")))


@query("f16_merge_batches", cte(fx.SEGMENTS, PACK.replace("text AS block FROM segments", "'- ' || text AS block FROM (SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY seq) - 1 AS seq, text FROM segments)").replace(f"> {SECTION}", "> 400"), recursive=True) + """
SELECT source_id, batch, string_agg(block, chr(10) ORDER BY seq) AS "user" FROM packed GROUP BY source_id, batch""")
def f16(spark, sf):
    rows = fx.segments(spark, sf)
    bullets = rows.select(
        "source_id", F.expr("CAST(seq div 10 AS BIGINT)").alias("batch"), F.col("seq").alias("pos"),
        F.col("text").alias("bullet"),
    )
    glossary = fx.terms(spark, sf)
    return requests.merge_batches(bullets, glossary, 400)[0]


def synthesis_responses(spark, sf):
    cells = F.sort_array(F.collect_list(F.struct("seq", F.col("text").alias("w"))))
    made = fx.segments(spark, sf).groupBy("source_id").agg(F.transform(cells, lambda c: c["w"]).alias("w"))
    body = F.to_json(F.struct(
        F.concat(F.transform("w", lambda w: F.concat(F.lit(" "), w)), F.array(F.lit("  "))).alias("tldr"),
        F.transform("w", lambda w: F.struct(w.alias("term"), F.lit(" d ").alias("definition"))).alias("glossary"),
    ))
    return noisy(made, body)


@query("f16_decode_tldr", cte(fx.SEGMENTS) + f"""
SELECT source_id, CAST(row_number() OVER (PARTITION BY source_id ORDER BY seq) - 1 AS INTEGER) AS pos, text AS bullet FROM segments WHERE {OK}""")
def f16t(spark, sf):
    return responses.decode_tldr(synthesis_responses(spark, sf)).select("source_id", "pos", "bullet")


@query("f16_decode_glossary", cte(fx.SEGMENTS) + f"""
SELECT source_id, CAST(row_number() OVER (PARTITION BY source_id ORDER BY seq) - 1 AS INTEGER) AS pos, text AS term, 'd' AS definition FROM segments WHERE {OK}""")
def f16g(spark, sf):
    out = responses.decode_terms(synthesis_responses(spark, sf), "synthesis")
    return out.select("source_id", "pos", "term", "definition")
