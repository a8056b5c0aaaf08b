"""Decoding model responses, with the fallback each task prescribes.

A response table has ``request_id``, ``body`` and ``error``. Bodies are parsed with
the task's schema after salvage; anything unreadable decodes to NULL and takes the
fallback, so no request row is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import labels
from ..functions.decode import salvage_json
from ..functions.text import blank_to_null, clean_strings, coerce_enum, is_blank, strip
from ..functions.timecode import parse_ts

# The JSON contract of each task.
SCHEMAS = {
    "boundary": "sections array<struct<title string, start_ts string>>",
    "section": (
        "summary string, points array<struct<ts string, text string>>, "
        "terms array<struct<term string, definition string>>"
    ),
    "critic": "missing array<struct<ts string, text string, tur string, kaynak string>>",
    "repair": "sentences array<struct<ts string, text string>>",
    "synthesis": "tldr array<string>, glossary array<struct<term string, definition string>>",
    "learning": (
        "type string, tur string, steps array<string>, actions array<string>, "
        "quiz array<struct<soru string, cevap string>>, deepen_prompt string, "
        "topics array<string>"
    ),
    "answer": "found boolean, answer string, kaynak array<string>",
    "collection": "collection string, yeni boolean",
    "title": "title string",
}


def latest(responses: DataFrame) -> DataFrame:
    """One response per request: of retries the last ``attempt``, without one a readable reply."""
    attempt = F.col("attempt") if "attempt" in responses.columns else F.lit(0)
    order = F.struct(attempt.alias("n"), F.col("error").isNull().alias("ok"), F.col("body"), F.col("error"))
    return responses.groupBy("request_id").agg(F.max(order).alias("_r")).select(
        "request_id", "_r.body", "_r.error"
    )


def with_responses(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Every request with its response; ``failed`` marks a missing or unreadable one."""
    table = requests.join(latest(responses), "request_id", "left")
    readable = F.when(F.col("error").isNull(), salvage_json(F.col("body")))
    return table.withColumn("json", readable).withColumn("failed", F.col("json").isNull())


def parse(responses: DataFrame, task: str) -> DataFrame:
    """Add ``r``: the typed response, NULL when unreadable."""
    usable = F.when(F.col("error").isNull(), salvage_json(F.col("body")))
    return responses.withColumn("r", F.from_json(usable, SCHEMAS[task]))


def failed_requests(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Requests whose task cannot fall back (section, synthesis): source error rows."""
    return with_responses(requests, responses).where("failed").select(
        "request_id", F.coalesce("error", F.lit("invalid or missing response")).alias("error")
    )


def _keys(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in ("body", "error", "r", "json", "failed")]


def _items(responses: DataFrame, task: str, field: str) -> DataFrame:
    parsed = parse(responses, task)
    return parsed.select(
        *_keys(parsed), F.posexplode(F.col(f"r.{field}")).alias("pos", "item")
    )


def decode_points(responses: DataFrame) -> DataFrame:
    """Points of section responses: position, time and text."""
    items = _items(responses, "section", "points")
    return items.select(
        *_keys(responses), "pos", parse_ts(F.col("item.ts")).alias("ts"),
        strip(F.col("item.text")).alias("text"),
    )


def decode_terms(responses: DataFrame, task: str = "section") -> DataFrame:
    """Terms of section or synthesis responses."""
    items = _items(responses, task, "terms" if task == "section" else "glossary")
    return items.select(
        *_keys(responses), "pos", strip(F.col("item.term")).alias("term"),
        strip(F.col("item.definition")).alias("definition"),
    )


def decode_sections(responses: DataFrame) -> DataFrame:
    """Summary of each section response; NULL where the section failed."""
    parsed = parse(responses, "section")
    return parsed.select(
        *_keys(responses), strip(F.col("r.summary")).alias("summary"),
        F.coalesce(F.size("r.points"), F.lit(0)).alias("points"),
        F.coalesce(F.size("r.terms"), F.lit(0)).alias("terms"),
    )


def decode_marks(responses: DataFrame) -> DataFrame:
    """Topic marks of boundary responses, before the window check."""
    items = _items(responses, "boundary", "sections")
    return items.select(
        *_keys(responses), "pos", parse_ts(F.col("item.start_ts")).alias("ts"),
        strip(F.col("item.title")).alias("title"),
    )


def decode_critic(responses: DataFrame) -> DataFrame:
    """Critic items with text; labels outside the contract become blank."""
    items = _items(responses, "critic", "missing")
    return items.where(~is_blank(F.col("item.text"))).select(
        *_keys(responses), "pos", parse_ts(F.col("item.ts")).alias("ts"),
        strip(F.col("item.text")).alias("text"),
        coerce_enum(F.col("item.tur"), labels.CRITIC_KINDS).alias("kind"),
        coerce_enum(F.col("item.kaynak"), labels.CRITIC_ORIGINS).alias("origin"),
    )


def decode_repairs(responses: DataFrame) -> DataFrame:
    """Repaired segments; their ends are derived later from the next start."""
    items = _items(responses, "repair", "sentences")
    return items.where(~is_blank(F.col("item.text"))).select(
        *_keys(responses), F.col("pos").cast("long").alias("seq"),
        parse_ts(F.col("item.ts")).alias("start"), F.lit(0.0).alias("end"),
        strip(F.col("item.text")).alias("text"),
    )


def decode_tldr(responses: DataFrame) -> DataFrame:
    """Non-blank summary bullets of synthesis responses."""
    items = _items(responses, "synthesis", "tldr")
    return items.where(~is_blank(F.col("item"))).select(
        *_keys(responses), "pos", strip(F.col("item")).alias("bullet")
    )


def decode_learning(responses: DataFrame) -> DataFrame:
    """Learning block; empty where the response failed."""
    parsed = parse(responses, "learning")
    r = F.col("r")
    quiz = F.transform(
        F.filter(r["quiz"], lambda q: ~is_blank(q["soru"])),
        lambda q: F.struct(
            strip(q["soru"]).alias("soru"),
            strip(F.coalesce(q["cevap"], F.lit(""))).alias("cevap"),
        ),
    )
    return parsed.select(
        *_keys(responses),
        coerce_enum(r["type"], labels.LEARNING_TYPES, labels.DEFAULT_TYPE).alias("learning_type"),
        coerce_enum(r["tur"], labels.CONTENT_TYPES, labels.DEFAULT_TYPE).alias("tur"),
        clean_strings(r["steps"]).alias("steps"),
        clean_strings(r["actions"]).alias("actions"),
        F.coalesce(quiz, F.array().cast("array<struct<soru:string,cevap:string>>")).alias("quiz"),
        strip(F.coalesce(r["deepen_prompt"], F.lit(""))).alias("deepen_prompt"),
        clean_strings(r["topics"]).alias("topics"),
    )


def decode_answers(responses: DataFrame) -> DataFrame:
    """Answers with evidence; ``cropped`` (a request column) appends the notice.

    A request that failed is ``failed`` with its ``error``: its answer is NULL, which is
    not the same as an answer that was looked for and not found.
    """
    parsed = parse(responses, "answer")
    r = F.col("r")
    notice = F.when(F.col("cropped"), labels.CROP_NOTICE).otherwise("")
    answer = F.concat(strip(F.coalesce(r["answer"], F.lit(""))), notice)
    failed = r.isNull()
    return parsed.select(
        *_keys(responses),
        failed.alias("failed"),
        F.when(failed, F.coalesce("error", F.lit("invalid or missing response"))).alias("error"),
        F.when(~failed, F.coalesce(r["found"], F.lit(False))).alias("found"),
        F.when(~failed, F.when(answer == "", labels.NOT_FOUND_ANSWER).otherwise(answer))
        .alias("answer"),
        F.coalesce(
            F.filter(r["kaynak"], lambda k: ~is_blank(k)), F.array().cast("array<string>")
        ).alias("evidence"),
    )


def strip_quotes(text: Column) -> Column:
    """Strip, drop surrounding double quotes, strip again."""
    return strip(F.regexp_replace(strip(text), r'\A"+|"+\z', ""))


def decode_titles(responses: DataFrame, fallback: str) -> DataFrame:
    """Generated titles; blank or failed ones take the ``fallback`` column."""
    parsed = parse(responses, "title")
    title = F.nullif(strip_quotes(F.col("r.title")), F.lit(""))
    return parsed.select(*_keys(responses), F.coalesce(title, F.col(fallback)).alias("new_title"))


def decode_collections(responses: DataFrame) -> DataFrame:
    """Collection names as the model gave them; NULL when blank or failed."""
    parsed = parse(responses, "collection")
    return parsed.select(
        *_keys(responses), blank_to_null(F.col("r.collection")).alias("name")
    )
