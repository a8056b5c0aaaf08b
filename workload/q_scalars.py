"""Scalar functions over whole columns of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import decode, naming, text, timecode

from . import fixtures as fx
from .registry import cte, query

def ts_sql(seconds: str) -> str:
    """SQL text of a time code; ``seconds`` is a SQL expression."""
    t = f"CAST(floor({seconds}) AS BIGINT)"

    def two(x: str) -> str:
        return f"CASE WHEN {x} < 10 THEN '0' ELSE '' END || CAST({x} AS VARCHAR)"

    return (
        f"(CASE WHEN {t} >= 3600 THEN {two(f'({t} // 3600)')} || ':' ELSE '' END || "
        f"{two(f'(({t} % 3600) // 60)')} || ':' || {two(f'({t} % 60)')})"
    )


@query("b1_fmt_ts", f"SELECT l_orderkey, l_linenumber, {ts_sql('l_extendedprice')} AS ts FROM lineitem")
def b1(spark, sf):
    return fx.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", timecode.fmt_ts(F.col("l_extendedprice")).alias("ts")
    )


_STAMP = "event_type || ' ' || CASE WHEN event_id % 4 = 0 THEN '' ELSE props END || CASE WHEN event_id % 3 = 0 THEN ' [' || CAST(user_id AS STRING) || ':' || CAST(event_id % 60 AS STRING) || '.5]' ELSE '' END"


@query("b2_parse_ts", f"""
SELECT event_id, CAST(coalesce(d[n], '0') AS DOUBLE) + CASE WHEN n >= 2 THEN 60 * CAST(d[n - 1] AS DOUBLE) ELSE 0 END
       + CASE WHEN n >= 3 THEN 3600 * CAST(d[n - 2] AS DOUBLE) ELSE 0 END AS seconds
FROM (SELECT event_id, d, len(d) AS n FROM
  (SELECT event_id, regexp_extract_all({_STAMP}, '\\d+') AS d FROM events))""")
def b2(spark, sf):
    return fx.table(spark, sf, "events").selectExpr("event_id", f"{_STAMP} AS s").select(
        "event_id", timecode.parse_ts(F.col("s")).alias("seconds")
    )


@query("b3_est_tokens", "SELECT doc_id, CAST(length(text) // 3 AS BIGINT) AS tokens FROM documents")
def b3(spark, sf):
    return fx.table(spark, sf, "documents").select(
        "doc_id", text.est_tokens(F.col("text")).alias("tokens")
    )


@query("b4_word_count", r"SELECT doc_id, CAST(len(regexp_extract_all(text, '[^\s]+')) AS BIGINT) AS words FROM documents")
def b4(spark, sf):
    return fx.table(spark, sf, "documents").select(
        "doc_id", text.word_count(F.col("text")).alias("words")
    )


@query("b5_real_word_ratio", r"""
SELECT doc_id, CASE WHEN len(w) >= 20 THEN CAST(len(list_filter(w, lambda t:
    length(regexp_replace(t, '[^aeıioöuüAEIİOÖUÜ]', '', 'g')) >= 1 AND length(t) <= 22
    AND CAST(length(regexp_replace(t, '[^aeıioöuüAEIİOÖUÜ]', '', 'g')) AS DOUBLE) / length(t) BETWEEN 0.15 AND 0.75
  )) AS DOUBLE) / len(w) END AS ratio
FROM (SELECT doc_id, regexp_extract_all(text, '\p{L}{2,}') AS w FROM documents)""")
def b5(spark, sf):
    return fx.table(spark, sf, "documents").select(
        "doc_id", text.real_word_ratio(F.col("text")).alias("ratio")
    )


@query("b6_glossary_key", cte(fx.TERMS) + """
SELECT source_id, pos, trim(replace(lower(term), chr(775), '')) AS key FROM terms""")
def b6(spark, sf):
    return fx.terms(spark, sf).select(
        "source_id", "pos", text.glossary_key(F.col("term")).alias("key")
    )


_LOWER = "trim(replace(lower(replace(replace(term, 'I', 'ı'), 'İ', 'i')), chr(775), ''))"


@query("b7_tr_lower", cte(fx.TERMS) + f"SELECT source_id, pos, {_LOWER} AS lowered FROM terms")
def b7(spark, sf):
    return fx.terms(spark, sf).select(
        "source_id", "pos", text.tr_lower(F.col("term")).alias("lowered")
    )


KEY_SQL = f"""array_to_string(list_transform(regexp_extract_all({_LOWER}, '.'), lambda c:
    CASE WHEN strpos('abcçdefgğhıijklmnoöprsştuüvyzqwx', c) > 0
         THEN strpos('abcçdefgğhıijklmnoöprsştuüvyzqwx', c) - 1 ELSE 32 END), ',')"""


@query("b8_tr_sort_key", cte(fx.TERMS) + f"SELECT source_id, pos, {KEY_SQL} AS sort_key FROM terms")
def b8(spark, sf):
    key = F.array_join(text.tr_sort_key(F.col("term")).cast("array<string>"), ",")
    return fx.terms(spark, sf).select("source_id", "pos", key.alias("sort_key"))


def link_sql(url: str, seconds: str, stamp: str) -> str:
    """SQL of a deep link for urls whose queries hold plain, distinct fields."""
    return f"""'[`' || {stamp} || '`](' || regexp_replace(regexp_replace({url}, '#.*$', ''), '\\?.*$', '')
      || '?' || CASE WHEN strpos({url}, '?') > 0 THEN regexp_extract({url}, '\\?([^#]*)', 1) || '&' ELSE '' END
      || 't=' || CAST({seconds} AS VARCHAR) || 's'
      || CASE WHEN strpos({url}, '#') > 0 THEN regexp_extract({url}, '(#.*)$', 1) ELSE '' END || ')'"""


@query("b9_deep_link", "SELECT page_id, " + link_sql("url", "page_id * 37", ts_sql("page_id * 37")) + " AS link FROM pages")
def b9(spark, sf):
    return fx.table(spark, sf, "pages").select(
        "page_id",
        timecode.deep_link(F.col("url"), (F.col("page_id") * 37).cast("double")).alias("link"),
    )


@query("b10_position_label", cte(fx.SEGMENTS) + "SELECT source_id, seq, 's. ' || CAST(seq + 1 AS VARCHAR) AS label FROM segments")
def b10(spark, sf):
    return fx.segments(spark, sf).select(
        "source_id", "seq", timecode.position_label((F.col("seq") + 1).cast("double"), "s.").alias("label")
    )


BASE_SQL = "trim(CASE WHEN strpos(title, ' — ') > 0 THEN regexp_extract(title, '^(.*) — ', 1) ELSE title END)"


@query("b11_base_title", cte(fx.JOBS) + f"SELECT id, {BASE_SQL} AS base FROM jobs")
def b11(spark, sf):
    return fx.jobs(spark, sf).select("id", naming.base_title(F.col("title")).alias("base"))


GENERIC_SQL = f"lower({BASE_SQL}) IN ('', 'playlist', 'index', 'master', 'chunklist', 'media', 'video', 'stream')"


@query("b12_is_generic_title", cte(fx.JOBS) + f"SELECT id, {GENERIC_SQL} AS generic FROM jobs")
def b12(spark, sf):
    return fx.jobs(spark, sf).select("id", naming.is_generic_title(F.col("title")).alias("generic"))


@query("b13_part_title", cte(fx.JOBS) + """
SELECT id, 'B — Part ' || CAST(k % 9 + 1 AS VARCHAR) || ' (' || CAST((k % 9) * 30 AS VARCHAR) || '-'
         || CAST((k % 9 + 1) * 30 AS VARCHAR) || 'dk)' AS part_title,
       'B — ' || CASE WHEN strpos(title, ' — ') > 0 THEN regexp_extract(title, '^.* — (.*)$', 1) ELSE 'Part' END AS retitled
FROM jobs""")
def b13(spark, sf):
    part = (F.col("k") % 9).cast("long")
    return fx.jobs(spark, sf).select(
        "id",
        naming.time_part_title(F.lit("B"), part, part * 1800.0, F.lit(1800.0)).alias("part_title"),
        naming.retitled_part(F.col("title"), F.lit("B")).alias("retitled"),
    )


SAFE_SQL = r"""coalesce(nullif(substr(trim(regexp_replace(regexp_replace(trim({x}), '[<>:"/\\|?*\x00-\x1f]', ' ', 'g'), '\s+', ' ', 'g')), 1, {n}), ''), 'adsiz')"""


@query("b14_safe_name", "SELECT page_id, " + SAFE_SQL.format(x="html", n=80) + " AS name, " + SAFE_SQL.format(x="url", n=20) + " AS short FROM pages")
def b14(spark, sf):
    return fx.table(spark, sf, "pages").select(
        "page_id", naming.safe_name(F.col("html")).alias("name"),
        naming.safe_name(F.col("url"), 20).alias("short"),
    )


@query("b15_owner_of", cte(fx.FILES) + r"""
SELECT name, CASE WHEN regexp_matches(name, '_(frames|pages)$') THEN regexp_replace(name, '_(frames|pages)$', '')
                  ELSE split_part(name, '.', 1) END AS owner,
       CASE WHEN name LIKE '%\_frames' ESCAPE '\' THEN left(name, length(name) - 7) ELSE split_part(name, '.', 1) END AS strict_owner
FROM files""")
def b15(spark, sf):
    return fx.files(spark, sf).select(
        "name", naming.owner_of(F.col("name")).alias("owner"),
        naming.owner_of(F.col("name"), strict=True).alias("strict_owner"),
    )


_MEDIA_URL = "CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN split_part(url, '?', 1) || '.M3U8?x=1' WHEN 2 THEN 'https://a.b-cdn.net/' || CAST(page_id AS STRING) ELSE 'file_' || CAST(page_id AS STRING) || '.mp4' END"
_DIRECT = "(regexp_matches(lower(split_part(u, '?', 1)), '\\.(m3u8|mp4|mkv|webm|mov|m4a|mp3|wav|ts)$') OR contains(lower(split_part(u, '?', 1)), 'b-cdn.net'))"


def _media(spark, sf):
    return fx.table(spark, sf, "pages").selectExpr("page_id", f"{_MEDIA_URL} AS u")


@query("b16_is_direct_media", f"SELECT page_id, {_DIRECT} AS direct FROM (SELECT page_id, {_MEDIA_URL} AS u FROM pages)")
def b16(spark, sf):
    return _media(spark, sf).select("page_id", naming.is_direct_media(F.col("u")).alias("direct"))


@query("b17_intake_route", f"""
SELECT page_id, CASE WHEN w THEN 'waiting' ELSE 'queued' END AS status,
       CASE WHEN w THEN 'awaiting_download' ELSE 'queued' END AS stage
FROM (SELECT page_id, regexp_matches(u, '^https?://') AND page_id % 5 <> 0 AND (page_id % 3 = 0 OR NOT {_DIRECT}) AS w
      FROM (SELECT page_id, {_MEDIA_URL} AS u FROM pages))""")
def b17(spark, sf):
    route = naming.intake_route(F.col("u"), F.col("page_id") % 5 != 0, F.col("page_id") % 3 == 0)
    return _media(spark, sf).select("page_id", route.alias("r")).select("page_id", "r.status", "r.stage")


@query("b18_explain_error", f"""
SELECT o_orderkey, CASE o_orderkey % 11 WHEN 0 THEN 'asr_5xx' WHEN 1 THEN 'asr_5xx' WHEN 2 THEN 'quota'
  WHEN 3 THEN 'quota' WHEN 4 THEN 'bot_block' WHEN 5 THEN 'postprocess' WHEN 6 THEN 'download'
  WHEN 7 THEN 'no_audio' WHEN 8 THEN 'media_tool' WHEN 9 THEN 'no_text' ELSE NULL END AS class
FROM orders""")
def b18(spark, sf):
    return fx.table(spark, sf, "orders").selectExpr("o_orderkey", f"{fx.ERROR_TEXT} AS m").select(
        "o_orderkey", naming.error_class(F.col("m")).alias("class")
    )


_BODY = """CASE event_id % 5 WHEN 0 THEN props WHEN 1 THEN 'Here: ' || props || ' done' WHEN 2 THEN '```json ' || props || ' ```'
  WHEN 3 THEN substr(props, 1, length(props) - 1) ELSE event_type END"""


@query("b19_salvage_json", f"""
SELECT event_id, CASE WHEN event_id % 5 < 3 THEN props END AS json FROM events""")
def b19(spark, sf):
    return fx.table(spark, sf, "events").selectExpr("event_id", f"{_BODY} AS b").select(
        "event_id", decode.salvage_json(F.col("b")).alias("json")
    )


@query("b20_coerce_enum", "SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE 'genel' END AS label FROM events")
def b20(spark, sf):
    return fx.table(spark, sf, "events").select(
        "event_id", text.coerce_enum(F.col("event_type"), ["click", "view"], "genel").alias("label")
    )


@query("b21_clean_strings", r"""
SELECT doc_id, coalesce(array_to_string(list_filter(list_transform(string_split(text, '.'), lambda s:
  regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')[1:4], '|'), '') AS topics FROM documents""")
def b21(spark, sf):
    items = text.clean_strings(F.split("text", r"\."), 4)
    return fx.table(spark, sf, "documents").select("doc_id", F.array_join(items, "|").alias("topics"))


@query("b22_compression_tier", """
SELECT l_orderkey, l_linenumber, CASE WHEN r < 1 THEN 'expansion' WHEN r >= 30 THEN 'high' WHEN r >= 12 THEN 'medium' ELSE 'low' END AS tier
FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 3 THEN l_discount * 9 ELSE l_quantity END AS r FROM lineitem)""")
def b22(spark, sf):
    ratio = F.when(F.col("l_linenumber") == 3, F.col("l_discount") * 9).otherwise(F.col("l_quantity"))
    return fx.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", naming.compression_tier(ratio).alias("tier")
    )


@query("b23_language_base", "SELECT doc_id, lang AS base FROM documents")
def b23(spark, sf):
    code = F.concat("lang", F.lit("-"), F.upper("source"))
    return fx.table(spark, sf, "documents").select("doc_id", naming.language_base(code).alias("base"))


@query("b24_budget_crop", "SELECT doc_id, left(text, 1500) AS body, length(text) > 1500 AS cropped FROM documents")
def b24(spark, sf):
    return fx.table(spark, sf, "documents").select(
        "doc_id", text.budget_crop(F.col("text"), 1500).alias("body"),
        text.was_cropped(F.col("text"), 1500).alias("cropped"),
    )
