"""Titles, file names, routing and error classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import labels
from .text import strip


def base_title(title: Column) -> Column:
    """Core of a title: the text before its last long-dash joint."""
    joint = labels.TITLE_JOINT
    text = F.coalesce(title, F.lit(""))
    head = F.regexp_extract(text, f"(?s)\\A(.*){joint}", 1)
    return strip(F.when(F.contains(text, F.lit(joint)), head).otherwise(text))


def is_generic_title(title: Column) -> Column:
    """Whether the core title says nothing about the content."""
    return F.lower(base_title(title)).isin(labels.GENERIC_TITLES)


def time_part_title(base: Column, part: Column, start: Column, length: Column) -> Column:
    """``base — Part i (a-bdk)`` with whole minutes; ``part`` counts from zero."""
    first = F.floor(start / 60).cast("long").cast("string")
    last = F.floor((start + length) / 60).cast("long").cast("string")
    return F.concat(
        base, F.lit(f"{labels.TITLE_JOINT}{labels.PART_WORD} "), (part + 1).cast("string"),
        F.lit(" ("), first, F.lit("-"), last, F.lit("dk)"),
    )


def page_part_title(base: Column, part: Column, first: Column, last: Column) -> Column:
    """``base — Part i (s.a-b)``; ``part`` counts from zero."""
    return F.concat(
        base, F.lit(f"{labels.TITLE_JOINT}{labels.PART_WORD} "), (part + 1).cast("string"),
        F.lit(" (s."), first.cast("string"), F.lit("-"), last.cast("string"), F.lit(")"),
    )


def whole_title(base: Column) -> Column:
    """Title of the combined document of a group."""
    return F.concat(base, F.lit(f"{labels.TITLE_JOINT}{labels.WHOLE_SUFFIX}"))


def retitled_part(title: Column, base: Column) -> Column:
    """New base, old suffix after the last joint; ``Part`` when there is none."""
    joint = labels.TITLE_JOINT
    text = F.coalesce(title, F.lit(""))
    suffix = F.when(
        F.contains(text, F.lit(joint)), F.substring_index(text, joint, -1)
    ).otherwise(F.lit(labels.PART_WORD))
    return F.concat(base, F.lit(joint), suffix)


def safe_name(name: Column, size: int = 80) -> Column:
    """A file-system safe name of at most ``size`` characters."""
    legal = F.regexp_replace(F.coalesce(name, F.lit("")), r'[<>:"/\\|?*\x00-\x1f]', " ")
    flat = strip(F.regexp_replace(legal, r"(?U)\s+", " "))
    cut = F.substring(flat, 1, size)
    return F.coalesce(F.nullif(cut, F.lit("")), F.lit(labels.UNNAMED))


def owner_of(name: Column, strict: bool = False) -> Column:
    """Job id a stored file belongs to.

    ``strict`` reproduces the published rule, which knows ``_frames`` only and so
    reports page-evidence folders as orphans; the default knows ``_pages`` too.
    """
    folders = r"_frames\z" if strict else r"_(frames|pages)\z"
    return F.when(
        F.regexp_like(name, F.lit(folders)), F.regexp_replace(name, folders, "")
    ).otherwise(F.substring_index(name, ".", 1))


def is_direct_media(url: Column) -> Column:
    """Whether a link can be fetched directly rather than through a page."""
    path = F.lower(F.substring_index(url, "?", 1))
    suffix = r"\.(" + "|".join(labels.MEDIA_SUFFIXES) + r")\z"
    return F.regexp_like(path, F.lit(suffix)) | F.contains(path, F.lit(labels.DIRECT_HOST))


def intake_route(url: Column, local_agent: Column, wants_local: Column) -> Column:
    """``(status, stage)`` a newly registered link starts in."""
    link = F.regexp_like(url, F.lit(r"\Ahttps?://"))
    waits = link & local_agent & (wants_local | ~is_direct_media(url))
    return F.when(
        waits,
        F.struct(F.lit("waiting").alias("status"), F.lit("awaiting_download").alias("stage")),
    ).otherwise(F.struct(F.lit("queued").alias("status"), F.lit("queued").alias("stage")))


# Ordered error signatures; the first matching class wins.
ERROR_RULES = [
    ("asr_5xx", r"(?s)(?=.*groq)(?=.*(502|503|500|transkrip))"),
    ("quota", r"429|rate limit|kota|quota|too many"),
    ("bot_block", r"(?s)sign in to confirm|(?=.*youtube)(?=.*bot)"),
    ("postprocess", r"postprocessing|conversion failed|audio conversion"),
    ("download", r"yt-dlp|unable to download|http error 4|forbidden"),
    ("no_audio", r"ses akışı yok|no audio"),
    ("media_tool", r"ffmpeg|ffprobe"),
    ("no_text", r"güvenilir metin çıkmadı|yalnızca başlık"),
]


def error_class(message: Column) -> Column:
    """Class of a failure message, NULL when nothing is recognised."""
    text = F.lower(message)
    chain = F
    for name, pattern in ERROR_RULES:
        chain = chain.when(F.regexp_like(text, F.lit(pattern)), F.lit(name))
    return chain


def language_base(code: Column) -> Column:
    """Language part of a regional code."""
    return F.substring_index(code, "-", 1)


def compression_tier(ratio: Column) -> Column:
    """Reading aid for a compression ratio; NULL stays NULL."""
    return (
        F.when(ratio.isNull(), F.lit(None).cast("string"))
        .when(ratio < 1, "expansion")
        .when(ratio >= 30, "high")
        .when(ratio >= 12, "medium")
        .otherwise("low")
    )
