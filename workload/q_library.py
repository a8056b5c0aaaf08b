"""Operations on the jobs table and its files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lectern.functions import naming
from lectern.operators import distinct, library, parts
from lectern.operators.stage import shared_folder, stage
from lectern.sources import sinks, textfiles

from . import fixtures as fx
from .q_scalars import GENERIC_SQL, KEY_SQL, SAFE_SQL
from .registry import cte, query


@query("g1_latest_jobs", cte(fx.JOBS) + "SELECT id, title FROM jobs ORDER BY created_at DESC LIMIT 50")
def g1(spark, sf):
    return library.latest_jobs(fx.jobs(spark, sf), 50).select("id", "title")


@query("c14_pending_jobs", cte(fx.JOBS) + "SELECT id, status FROM jobs WHERE status IN ('queued', 'running')")
def c14(spark, sf):
    return library.pending_jobs(fx.jobs(spark, sf)).select("id", "status")


@query("c15_awaiting_downloads", cte(fx.JOBS) + """
SELECT id, source, referer, transkript FROM jobs WHERE stage = 'awaiting_download' AND status = 'waiting'""")
def c15(spark, sf):
    return library.awaiting_downloads(fx.jobs(spark, sf))


@query("d9_unclaimed", cte(fx.JOBS) + """
SELECT id FROM jobs WHERE status IN ('queued', 'running') AND id NOT IN (SELECT id FROM jobs WHERE provider = 'groq')""")
def d9(spark, sf):
    rows = fx.jobs(spark, sf)
    return library.unclaimed(rows, rows.where("provider = 'groq'")).select("id")


@query("e5_collections_by_recency", cte(fx.JOBS) + """
SELECT collection, strftime(max(created_at), '%Y-%m-%d %H:%M:%S') AS last_used FROM jobs WHERE collection <> '' GROUP BY collection""")
def e5(spark, sf):
    out = library.collections_by_recency(fx.jobs(spark, sf))
    return out.select("collection", F.date_format("last_used", "yyyy-MM-dd HH:mm:ss").alias("last_used"))


_NAMED = "CASE k % 4 WHEN 0 THEN lower(coalesce(collection, 'x')) WHEN 1 THEN 'New ' || CAST(k % 7 AS STRING) WHEN 2 THEN collection END"


@query("d6_canonical_collection", cte(fx.JOBS, f"""
known AS (SELECT collection, max(created_at) AS last_used FROM jobs WHERE collection <> '' GROUP BY collection),
names AS (SELECT id, title, nullif({_NAMED}, '') AS name FROM jobs)""") + """
SELECT id, coalesce((SELECT max_by(collection, last_used) FROM known WHERE lower(collection) = lower(name)), name, trim(coalesce(title, ''))) AS collection
FROM names""")
def d6(spark, sf):
    rows = fx.jobs(spark, sf)
    names = rows.selectExpr("id", "title", f"nullif({_NAMED}, '') AS name")
    return library.canonical_collection(names, library.collections_by_recency(rows))


@query("d7_parts_of", cte(fx.JOBS) + """
SELECT p.id, j.id AS parent_id, j.title AS parent_title FROM jobs p JOIN jobs j
ON j.id = json_extract_string(p.meta, '$.part_of') AND json_extract_string(j.meta, '$.is_combined') = 'true'""")
def d7(spark, sf):
    return library.parts_of(fx.jobs(spark, sf)).select("id", "parent_id", "parent_title")


TOPICS = """
topic_rows AS (
  SELECT coalesce(json_extract_string(meta, '$.part_of'), id) AS parent_id, CASE WHEN json_extract_string(meta, '$.part_of') IS NULL THEN 1 ELSE 0 END AS stage,
    created_at, id, unnest(json_extract_string(meta, '$.topics[*]')) AS topic, generate_subscripts(json_extract_string(meta, '$.topics[*]'), 1) AS pos FROM jobs),
first_topics AS (
  SELECT *, row_number() OVER (PARTITION BY parent_id, topic ORDER BY stage, created_at DESC, id, pos) AS rn FROM topic_rows WHERE topic <> ''),
topics AS (
  SELECT parent_id, string_agg(topic, '|' ORDER BY stage, created_at DESC, id, pos) AS topics FROM (
    SELECT *, row_number() OVER (PARTITION BY parent_id ORDER BY stage, created_at DESC, id, pos) AS r FROM first_topics WHERE rn = 1) GROUP BY parent_id)"""


@query("e8_ordered_topics", cte(fx.JOBS, TOPICS) + "SELECT * FROM topics")
def e8(spark, sf):
    out = library.ordered_topics(fx.jobs(spark, sf))
    return out.select("parent_id", F.array_join("topics", "|").alias("topics"))


@query("g6_distinct_in_order", """
SELECT conv_id, array_to_string(list_transform(list_sort(list_transform(list_distinct(r), lambda x: {'p': list_position(r, x), 'v': x})), lambda s: s.v), ',') AS roles
FROM (SELECT conv_id, list(role ORDER BY turn) AS r FROM conversations GROUP BY conv_id)""")
def g6(spark, sf):
    rows = fx.table(spark, sf, "conversations")
    out = distinct.distinct_in_order(rows, "conv_id", "role", "turn")
    return out.groupBy("conv_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("first", "role"))), lambda c: c["role"]), ",").alias("roles")
    )


@query("l3_backfill_candidates", cte(fx.JOBS, TOPICS) + f"""
SELECT id, title, topics FROM jobs JOIN topics ON parent_id = id WHERE json_extract_string(meta, '$.is_combined') = 'true' AND {GENERIC_SQL}""")
def l3(spark, sf):
    return library.backfill_candidates(fx.jobs(spark, sf)).withColumn("topics", F.array_join("topics", "|"))


_RENAMED = """
renames AS (SELECT id AS parent_id, 'New ' || id AS base, CASE WHEN k % 2 = 0 THEN 'Shelf' END AS shelf FROM jobs WHERE json_extract_string(meta, '$.is_combined') = 'true' AND referer IS NOT NULL),
grouped AS (SELECT *, CASE WHEN json_extract_string(meta, '$.is_combined') = 'true' THEN id ELSE json_extract_string(meta, '$.part_of') END AS parent_id FROM jobs)"""


@query("l2_rename_group", cte(fx.JOBS, _RENAMED) + """
SELECT id, CASE WHEN base IS NULL THEN title WHEN id = parent_id THEN base || ' — Tüm hali'
   ELSE base || ' — ' || CASE WHEN strpos(title, ' — ') > 0 THEN regexp_extract(title, '^.* — (.*)$', 1) ELSE 'Part' END END AS title,
   coalesce(shelf, collection) AS collection
FROM grouped LEFT JOIN renames USING (parent_id)""")
def l2(spark, sf):
    rows = fx.jobs(spark, sf)
    renames = rows.where(library.meta_field("is_combined") == "true").where("referer IS NOT NULL").selectExpr(
        "id AS parent_id", "'New ' || id AS base", "CASE WHEN k % 2 = 0 THEN 'Shelf' END AS collection"
    )
    return library.rename_group(rows, renames).select("id", "title", "collection")


def patches(spark, sf):
    rows = fx.jobs(spark, sf)
    one = rows.selectExpr(
        "id", "1 AS seq", "created_at + make_dt_interval(0, 0, 0, 60) AS at",
        "map_concat(map('status', 'running'), CASE WHEN k % 3 = 0 THEN map('error', CAST(NULL AS STRING)) ELSE map() END) AS fields",
    )
    two = rows.where("provider <> 'openrouter'").selectExpr(
        "id", "2 AS seq", "created_at + make_dt_interval(0, 0, 0, 120) AS at",
        "map_concat(CASE WHEN k % 2 = 0 THEN map('status', 'done') ELSE map() END, CASE WHEN k % 5 = 0 THEN map('error', 'late') ELSE map() END) AS fields",
    )
    return one.unionByName(two)


PATCHED = """
SELECT id, CASE WHEN n2 AND k % 2 = 0 THEN 'done' ELSE 'running' END AS status,
  CASE WHEN n2 AND k % 5 = 0 THEN 'late' WHEN k % 3 = 0 THEN NULL ELSE error END AS error,
  strftime(created_at + to_seconds(CASE WHEN n2 THEN 120 ELSE 60 END), '%Y-%m-%d %H:%M:%S') AS updated_at
FROM (SELECT *, provider <> 'openrouter' AS n2 FROM jobs)"""


@query("l1_apply_patches", cte(fx.JOBS) + PATCHED)
def l1(spark, sf):
    out = library.apply_patches(fx.jobs(spark, sf), patches(spark, sf))
    return out.select("id", "status", "error", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated_at"))


@query("l4_attach_files", cte(fx.JOBS) + """
SELECT id, CASE WHEN h THEN 'queued' ELSE status END AS status, CASE WHEN h THEN 'queued' ELSE stage END AS stage,
  CASE WHEN h THEN '/up/' || id || '.mp4' ELSE source END AS source, CASE WHEN h THEN source ELSE origin_url END AS origin_url,
  CASE WHEN h THEN CASE WHEN k % 4 = 0 THEN NULL ELSE 'T ' || id END ELSE title END AS title
FROM (SELECT *, stage = 'awaiting_download' AND origin_url IS NULL AS h FROM jobs)""")
def l4(spark, sf):
    rows = fx.jobs(spark, sf)
    uploads = rows.where("origin_url IS NULL").selectExpr(
        "id", "'/up/' || id || '.mp4' AS path", "CASE WHEN k % 4 = 0 THEN '  ' ELSE ' T ' || id END AS title"
    )
    return library.attach_files(rows, uploads).select("id", "status", "stage", "source", "origin_url", "title")


@query("l5_set_collection", cte(fx.JOBS) + """
SELECT id, CASE WHEN referer IS NOT NULL THEN CASE WHEN k % 2 = 0 THEN 'Moved' END ELSE collection END AS collection FROM jobs""")
def l5(spark, sf):
    rows = fx.jobs(spark, sf)
    changes = rows.where("referer IS NOT NULL").selectExpr("id", "CASE WHEN k % 2 = 0 THEN ' Moved ' ELSE ' ' END AS collection")
    return library.set_collection(rows, changes).select("id", "collection")


@query("l6_result_envelope", cte(fx.JOBS, fx.NOTES) + """
SELECT id, CASE WHEN status = 'done' THEN '{"job_id":' || to_json(id) || ',"status":"done","title":' || coalesce(CAST(to_json(title) AS VARCHAR), 'null') || ',"markdown":' || coalesce(CAST(to_json(markdown) AS VARCHAR), 'null') || ',"meta":' || meta || '}'
   ELSE '{"job_id":' || to_json(id) || ',"status":"error","error":' || coalesce(CAST(to_json(error) AS VARCHAR), 'null') || '}' END AS payload,
   CASE WHEN status = 'done' THEN trim(regexp_replace(split_part(markdown, '## Detaylı Özet', 1), '\\s+$', '')) END AS excerpt
FROM jobs LEFT JOIN notes USING (id) WHERE status IN ('done', 'error')""")
def l6(spark, sf):
    return library.result_envelope(fx.jobs(spark, sf), fx.note_ids(spark, sf))


@query("l7_register_jobs", cte(fx.JOBS) + """
SELECT id, status, stage, title, updated_at = created_at AS fresh FROM jobs
UNION ALL SELECT 'n' || id, 'queued', 'queued', NULL, true FROM jobs WHERE status = 'error'""")
def l7(spark, sf):
    rows = fx.jobs(spark, sf)
    new = rows.where("status = 'error'").selectExpr("'n' || id AS id", "source", "provider", "created_at")
    return library.register_jobs(rows, new).selectExpr("id", "status", "stage", "title", "updated_at = created_at AS fresh")


@query("l7_remove_jobs", cte(fx.JOBS) + "SELECT id FROM jobs WHERE status <> 'error'")
def l7r(spark, sf):
    rows = fx.jobs(spark, sf)
    return library.remove_jobs(rows, rows.where("status = 'error'")).select("id")


@query("d13_ready_jobs", cte(fx.JOBS, fx.NOTES) + "SELECT id FROM jobs WHERE status = 'done' AND id IN (SELECT id FROM notes)")
def d13(spark, sf):
    return library.ready_jobs(fx.jobs(spark, sf), fx.note_ids(spark, sf)).select("id")


_OWNER = "CASE WHEN regexp_matches(name, '_(frames|pages)$') THEN regexp_replace(name, '_(frames|pages)$', '') ELSE split_part(name, '.', 1) END"


@query("d8_orphan_outputs", cte(fx.JOBS, fx.FILES) + f"""
SELECT name, bytes, owner FROM (SELECT *, {_OWNER} AS owner FROM files) WHERE owner NOT IN (SELECT id FROM jobs)""")
def d8(spark, sf):
    return library.orphan_outputs(fx.files(spark, sf), fx.jobs(spark, sf))


@query("g5_except_keys", cte(fx.JOBS, fx.FILES) + f"SELECT DISTINCT {_OWNER} AS owner FROM files EXCEPT SELECT id FROM jobs")
def g5(spark, sf):
    owners = fx.files(spark, sf).select(naming.owner_of(F.col("name")).alias("owner"))
    jobs = fx.jobs(spark, sf).select(F.col("id").alias("owner"))
    return library.keys_without(owners, jobs, "owner")


@query("e10_storage_report", cte(fx.JOBS, fx.FILES) + f"""
SELECT owner, bytes, files, names, status, status IS NULL AS orphan FROM (
  SELECT {_OWNER} AS owner, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) AS files, string_agg(name, '|' ORDER BY encode(name)) AS names FROM files GROUP BY 1) LEFT JOIN jobs ON id = owner""")
def e10(spark, sf):
    report = library.storage_report(fx.files(spark, sf), fx.jobs(spark, sf))
    return report.withColumn("names", F.array_join("names", "|"))


@query("e10_reclaimable_uploads", cte(fx.JOBS) + """
SELECT id AS owner, CAST(k + 10 AS BIGINT) AS bytes FROM jobs WHERE status = 'done'""")
def e10r(spark, sf):
    rows = fx.jobs(spark, sf)
    uploads = rows.selectExpr("id || '.mp4' AS name", "k AS bytes").unionByName(
        rows.selectExpr("id || '.subs.json3' AS name", "10L AS bytes")
    )
    return library.reclaimable_uploads(uploads, rows)


LAYOUT = f"""
placed AS (
  SELECT id, created_at, {SAFE_SQL.format(x="coalesce(nullif(collection, ''), 'atanmamis')", n=60)} AS folder,
         {SAFE_SQL.format(x="coalesce(nullif(title, ''), id)", n=80)} AS name
  FROM jobs WHERE status = 'done' AND id IN (SELECT id FROM notes)),
options AS (
  SELECT id, folder, unnest(CASE WHEN rn = 1 THEN [{{'step': 0, 'label': name}}] ELSE [
    {{'step': 1, 'label': name || ' (' || {SAFE_SQL.format(x="left(id, 6)", n=80)} || ')'}},
    {{'step': 2, 'label': name || ' (' || {SAFE_SQL.format(x="id", n=80)} || ')'}},
    {{'step': 3, 'label': name || ' (' || {SAFE_SQL.format(x="id", n=80)} || ' ' || left(sha256(folder || '/' || name || '/' || id), 16) || ')'}}
  ] END) AS o
  FROM (SELECT *, row_number() OVER (PARTITION BY folder, name ORDER BY created_at DESC, id DESC) AS rn FROM placed)),
claimed AS (SELECT id, folder, o.step, o.label, count(DISTINCT id) OVER (PARTITION BY folder, o.label) AS claims FROM options),
layout AS (
  SELECT id, folder, folder || '/' || min_by(label, step) || '.md' AS path
  FROM claimed WHERE step IN (0, 3) OR claims = 1 GROUP BY id, folder)"""


@query("a13_export_layout", cte(fx.JOBS, fx.NOTES, LAYOUT) + "SELECT id, folder, path FROM layout")
def a13(spark, sf):
    return library.export_layout(fx.jobs(spark, sf), fx.note_ids(spark, sf))


NOTE_LINES = """
note_lines AS (
  SELECT id, 0 AS head, pos AS ord, line FROM (
    SELECT id, unnest(string_split(markdown, chr(10))) AS line,
           generate_subscripts(string_split(markdown, chr(10)), 1) AS pos FROM notes)
  UNION ALL SELECT 'j' || l_orderkey, 1, l_linenumber, '- ' || l_returnflag || ' ' || l_linestatus FROM lineitem)"""


def note_lines(spark, sf):
    """Lines of the notes: their text, then one for each item of the order."""
    text = fx.note_ids(spark, sf).select(
        "id", F.lit(0).alias("head"), F.posexplode(F.split("markdown", "\n")).alias("pos", "line"))
    items = fx.table(spark, sf, "lineitem").selectExpr(
        "'j' || l_orderkey AS id", "1 AS head", "CAST(l_linenumber AS INT) AS pos",
        "'- ' || l_returnflag || ' ' || l_linestatus AS line")
    return text.unionByName(items).selectExpr("id", "struct(head, pos, line) AS ord", "line")


@query("a13_export_files", cte(fx.JOBS, fx.NOTES, LAYOUT, NOTE_LINES) + """
SELECT path, count(*) AS lines, sha256(string_agg(line || chr(10), '' ORDER BY head, ord, line)) AS content
FROM layout JOIN note_lines USING (id) GROUP BY path""")
def a13f(spark, sf):
    """Notes written as files and read back."""
    folder = f"{shared_folder(spark)}/library-{uuid.uuid4().hex}"
    layout = library.export_layout(fx.jobs(spark, sf), fx.note_ids(spark, sf))
    written = sinks.write_library(layout, note_lines(spark, sf), folder)
    return textfiles.file_digests(written, folder).select("path", "lines", "content")


ROLLUP = """
part_rows AS (
  SELECT json_extract_string(meta, '$.part_of') AS parent_id, k AS part, status <> 'error' AS ok,
    CASE k % 3 WHEN 0 THEN 'kurs' WHEN 1 THEN 'tutorial' ELSE 'gelisim' END AS learning_type, 'sunum' AS tur, 't' || CAST(k % 4 AS VARCHAR) AS topic
  FROM jobs WHERE json_extract_string(meta, '$.part_of') IS NOT NULL)"""


def part_rows(spark, sf):
    rows = fx.jobs(spark, sf).withColumn("parent_id", library.meta_field("part_of"))
    return rows.where("parent_id IS NOT NULL").selectExpr(
        "parent_id", "k AS part", "status <> 'error' AS ok",
        "CASE k % 3 WHEN 0 THEN 'kurs' WHEN 1 THEN 'tutorial' ELSE 'gelisim' END AS learning_type",
        "'sunum' AS tur", "array('t' || CAST(k % 4 AS STRING)) AS topics",
    )


@query("e6_parent_rollup", cte(fx.JOBS, ROLLUP) + """
SELECT parent_id, count(*) AS parts, count(*) FILTER (WHERE NOT ok) AS parts_failed,
  coalesce(min_by(learning_type, part) FILTER (WHERE ok), 'genel') AS learning_type, coalesce(min_by(tur, part) FILTER (WHERE ok), 'genel') AS tur,
  coalesce(min_by(topic, part) FILTER (WHERE ok), '') AS topics FROM part_rows GROUP BY parent_id""")
def e6(spark, sf):
    return parts.parent_rollup(part_rows(spark, sf)).withColumn("topics", F.array_join("topics", ","))


@query("e14_progress", cte(fx.JOBS, ROLLUP) + """
SELECT parent_id, CAST(count(*) FILTER (WHERE ok) AS VARCHAR) || '/' || CAST(count(*) AS VARCHAR) || ' parça bitti' AS stage,
  CAST(count(*) FILTER (WHERE ok) AS DOUBLE) / count(*) AS fraction FROM part_rows GROUP BY parent_id""")
def e14(spark, sf):
    return parts.progress(part_rows(spark, sf))


@query("e14_stage_fraction", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE CAST(l_linenumber AS DOUBLE) / l_quantity END AS fraction FROM lineitem""")
def e14s(spark, sf):
    stage_text = F.expr(
        "CASE l_linenumber % 3 WHEN 0 THEN 'segment' WHEN 1 THEN concat('pages:', l_linenumber, '/', CAST(l_quantity AS INT)) ELSE concat(l_linenumber, '/', CAST(l_quantity AS INT), ' parça bitti') END"
    )
    return fx.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", parts.stage_fraction(stage_text).alias("fraction")
    )


SYNTH = """synth AS (SELECT source_id, pos, term, 's' || definition AS definition FROM terms WHERE length(term) > 6)"""


@query("e7_merge_glossary", cte(fx.TERMS, SYNTH, f"""
both_terms AS (SELECT *, 0 AS stage, trim(replace(lower(term), chr(775), '')) AS key FROM terms UNION ALL SELECT *, 1, trim(replace(lower(term), chr(775), '')) FROM synth),
merged AS (SELECT source_id, key, max_by(term, stage * 1000000 + pos) AS term, max_by(definition, stage * 1000000 + pos) AS definition,
  min(stage * 1000000 + pos) AS first FROM both_terms GROUP BY ALL)""") + f"""
SELECT source_id, key, term, definition, CAST(first // 1000000 AS INTEGER) AS stage, CAST(first % 1000000 AS INTEGER) AS pos, {KEY_SQL} AS sort_key FROM merged""")
def e7(spark, sf):
    from lectern.operators import ledger

    terms = stage(fx.terms(spark, sf))
    synth = terms.where("length(term) > 6").selectExpr("source_id", "pos", "term", "'s' || definition AS definition")
    out = ledger.merge_glossary(terms, synth)
    return out.withColumn("sort_key", F.array_join(F.col("sort_key").cast("array<string>"), ","))


@query("g2_sort_terms", cte(fx.TERMS) + "SELECT source_id, pos, term FROM terms")
def g2(spark, sf):
    from lectern.operators import ledger

    return ledger.sort_terms(fx.terms(spark, sf)).select("source_id", "pos", "term")
