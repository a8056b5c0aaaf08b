"""The model rounds of a study note, each a table in and a table out.

A round turns working tables into a request table and, once a scorer has answered,
the answers into the next working table. Requests are written between the two, so
a round can be scored elsewhere, repeated, or resumed after any failure.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ledger, requests, responses, sections
from ..operators.stage import stage, unstage
from ..operators.transcripts import source_ends

WINDOW = ["source_id", "window_id"]
SECTION = ["source_id", "sec_start"]


def request_table(
    work: DataFrame, task: str, keys: list[str], system: str = "", max_tokens: int = 16_000
) -> DataFrame:
    """Requests with an id made of the task and the keys of their unit of work."""
    parts = [F.lit(task), *[F.col(k).cast("string") for k in keys]]
    return stage(
        work.select(
            F.concat_ws("|", *parts).alias("request_id"), *keys, F.lit(task).alias("task"),
            F.lit(system).alias("system"), "user", F.lit(max_tokens).alias("max_tokens"),
        )
    )


def answered(asked: DataFrame, replies: DataFrame, keys: list[str]) -> DataFrame:
    """One reply per request with the keys of its unit of work; unanswered ones stay."""
    return asked.select("request_id", *keys).join(
        responses.latest(replies), "request_id", "left"
    )


def boundary_round(
    segments: DataFrame, sources: DataFrame, limit: int, system: str = ""
) -> tuple[DataFrame, DataFrame]:
    """Windowed segments and one boundary request per window."""
    windowed = stage(sections.boundary_windows(segments, limit))
    work = requests.boundary_requests(windowed, sources)
    return windowed, request_table(work, "boundary", WINDOW, system, 8_000)


def sectioned(
    windowed: DataFrame, sources: DataFrame, asked: DataFrame, replies: DataFrame,
    section_limit: int, min_gap: float = 45.0, spend: bool = False,
) -> DataFrame:
    """Segments with their section, from boundary replies.

    A failed window contributes no marks. Marks outside their window are dropped,
    close ones thinned, and sections beyond the budget split. With ``spend``, written
    copies of ``windowed``, ``asked`` and ``replies`` are removed once they are read.
    """
    marks = responses.decode_marks(answered(asked, replies, WINDOW)).select(
        *WINDOW, "ts", "title",
        (F.col("window_id") * 1_000_000 + F.col("pos")).alias("seq"),
    )
    ends = stage(source_ends(windowed))
    valid = sections.valid_marks(marks, sections.window_table(windowed), ends)
    kept = stage(sections.thin_marks(valid, min_gap))
    if spend:
        unstage(asked, replies)
    known = sources.select("source_id", "title").join(ends, "source_id")
    skeleton = stage(sections.section_skeleton(kept, known))
    assigned = stage(sections.assign_sections(windowed.drop("window_id"), skeleton))
    unstage(ends, kept, skeleton, *([windowed] if spend else []))
    split = stage(sections.split_oversized(assigned, section_limit))
    unstage(assigned)
    return split


def section_round(
    assigned: DataFrame, screen: DataFrame | None = None, system: str = ""
) -> DataFrame:
    """One note request per section."""
    return request_table(requests.section_requests(assigned, screen), "section", SECTION, system)


def critic_round(
    assigned: DataFrame, asked: DataFrame, replies: DataFrame,
    screen: DataFrame | None = None, system: str = "", spend: bool = False,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Section notes, their points, and one critic request per section.

    With ``spend``, written copies of ``asked``, ``replies`` and ``assigned`` are removed once
    they are read.
    """
    answers = stage(answered(asked, replies, SECTION))
    if spend:
        unstage(asked, replies)
    notes = responses.decode_sections(answers).where(F.col("summary").isNotNull())
    points = responses.decode_points(answers).withColumnRenamed("pos", "seq")
    # written, so that what was shuffled for the drafts is gone when they meet the lines
    drafts = stage(requests.section_drafts(notes.select(*SECTION, "summary"), points))
    criticised = request_table(requests.critic_requests(assigned, drafts, screen), "critic", SECTION, system)
    unstage(drafts, *([assigned] if spend else []))
    return notes, points, criticised


def audited(
    points: DataFrame, asked: DataFrame, replies: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Points with the critic's additions, and the critic ledger per source.

    A failed critic adds nothing and loses nothing.
    """
    items = stage(
        responses.decode_critic(answered(asked, replies, SECTION)).withColumnRenamed("pos", "seq")
    )
    return ledger.merge_points(points, items), ledger.critic_ledger(items)
