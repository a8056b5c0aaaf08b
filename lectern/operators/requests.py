"""Batch model requests: one row per unit of work, budget admission, scoring.

Prompts come from the caller. A request row is ``(request_id, source_id, ...,
system, user, max_tokens)``; text that was quarantined never reaches one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import labels
from ..functions.text import budget_crop, est_tokens, is_blank, strip, was_cropped
from ..functions.timecode import stamped_line
from . import scan
from .folds import Rule, assign_groups, group_rows
from .sections import window_table
from .stage import stage
from .transcripts import assemble_text, join_ordered

SECTION = ["source_id", "sec_start"]


def provider_windows(spark: SparkSession) -> DataFrame:
    """The provider limits as a small dimension."""
    rows = [(name, *limits) for name, limits in labels.PROVIDER_WINDOWS.items()]
    return spark.createDataFrame(rows, "provider string, boundary int, section int, repair int")


def with_limits(df: DataFrame, windows: DataFrame) -> DataFrame:
    """Attach the provider's limits; ``windows`` has one row per provider.

    No hint is given: the planner knows the size and broadcasts a small table.
    """
    return df.join(windows, "provider", "left")


def per_provider(
    rows: DataFrame, task: str, run: Callable[[DataFrame, int], DataFrame]
) -> DataFrame:
    """Run a packing operator with each provider's own budget and union the results.

    ``rows`` has a ``provider`` column; ``task`` is boundary, section or repair. There
    is one filtered pass for each distinct limit. Rows whose provider is NULL or not
    known come back unpacked with an ``error``, which is NULL everywhere else.
    """
    at = ("boundary", "section", "repair").index(task)
    by_limit: dict[int, list[str]] = {}
    for name, limits in labels.PROVIDER_WINDOWS.items():
        by_limit.setdefault(limits[at], []).append(name)
    known = F.col("provider").isin(list(labels.PROVIDER_WINDOWS))
    out = rows.where(~F.coalesce(known, F.lit(False))).withColumn(
        "error", F.concat(F.lit("unknown provider: "), F.coalesce("provider", F.lit("none")))
    )
    for limit, names in by_limit.items():
        packed = run(rows.where(F.col("provider").isin(names)), limit)
        out = out.unionByName(packed, allowMissingColumns=True)
    return out


def boundary_requests(windowed: DataFrame, sources: DataFrame) -> DataFrame:
    """One request per boundary window: title and window text."""
    windows = window_table(windowed).join(
        sources.select("source_id", "title"), "source_id", "left"
    )
    user = F.concat(
        F.lit("Video başlığı: "), F.coalesce("title", F.lit("")), F.lit("\n\nTranskript parçası:\n\n"),
        F.col("text"),
    )
    return windows.select("source_id", "window_id", user.alias("user"))


def _with_screen(df: DataFrame, screen: DataFrame | None, keys: list[str]) -> DataFrame:
    if screen is None:
        return df.withColumn("screen", F.lit(None).cast("string"))
    return df.join(screen, keys, "left")


def _block(heading: str, text: str):
    return F.when(F.col(text).isNotNull(), F.concat(F.lit(heading), F.col(text))).otherwise("")


def section_requests(assigned: DataFrame, screen: DataFrame | None = None) -> DataFrame:
    """One request per section: title, text and trusted screen text.

    ``screen`` has one row per section that has any frame.
    """
    texts = assemble_text(assigned, [*SECTION, "sec_title"])
    table = _with_screen(texts, screen, SECTION)
    user = F.concat(
        F.lit("Bölüm başlığı: "), F.col("sec_title"), F.lit("\n\nTranskript:\n\n"), F.col("text"),
        _block(labels.SCREEN_BLOCK, "screen"),
    )
    return table.select(*SECTION, user.alias("user"))


def _beside(rows: DataFrame, owners: DataFrame) -> DataFrame:
    """Each row of ``owners`` (section, _own) with the sorted ``_rows`` (section, _row) of its section.

    Both go through one shuffle. Grouping the rows and joining the groups would be two: the
    number that starts a section is brought into one form before a join, and so dealt anew.
    """
    named = F.col(SECTION[0]).isNotNull() & F.col(SECTION[1]).isNotNull()
    both = rows.where(named).unionByName(owners, allowMissingColumns=True)
    return both.groupBy(*SECTION).agg(
        F.sort_array(F.collect_list("_row")).alias("_rows"), F.collect_list("_own").alias("_owners")
    ).select(*SECTION, "_rows", F.explode("_owners").alias("_own"))


def section_drafts(notes: DataFrame, points: DataFrame) -> DataFrame:
    """Draft text per section: the summary and a stamped bullet per point."""
    bullet = F.concat(F.lit("- "), stamped_line(F.col("ts"), F.col("text")))
    rows = points.select(*SECTION, F.struct("ts", "seq", bullet.alias("line")).alias("_row"))
    listed = _beside(rows, notes.select(*SECTION, F.struct("summary").alias("_own")))
    bullets = F.when(F.size("_rows") > 0, F.array_join(F.transform("_rows", lambda r: r["line"]), "\n"))
    draft = F.concat_ws("\n", F.col("_own.summary"), bullets)
    return listed.select(*SECTION, draft.alias("draft"))


def critic_requests(
    assigned: DataFrame, drafts: DataFrame, screen: DataFrame | None = None
) -> DataFrame:
    """One request per section: source text, screen text and the draft note."""
    line = stamped_line(F.col("start"), F.col("text"))
    rows = assigned.select(*SECTION, F.struct("start", "seq", line.alias("line")).alias("_row"))
    found = _beside(rows, drafts.select(*SECTION, F.struct("draft").alias("_own"))).where(F.size("_rows") > 0)
    texts = found.select(
        *SECTION, F.array_join(F.transform("_rows", lambda r: r["line"]), "\n").alias("text"),
        F.col("_own.draft").alias("draft"))
    table = _with_screen(texts, screen, SECTION)
    user = F.concat(
        F.lit("BÖLÜM TRANSKRİPTİ:\n\n"), F.col("text"), _block(labels.SCREEN_BLOCK, "screen"),
        F.lit(labels.DRAFT_BLOCK), F.col("draft"),
    )
    return table.select(*SECTION, user.alias("user"))


def repair_requests(windowed: DataFrame, screen: DataFrame | None = None) -> DataFrame:
    """One request per repair window: stamped lines and trusted screen text."""
    keys = ["source_id", "window_id"]
    table = _with_screen(window_table(windowed), screen, keys)
    user = F.concat(
        F.lit("TRANSKRİPT:\n\n"), F.col("text"), _block(labels.REPAIR_SCREEN_BLOCK, "screen")
    )
    return table.select(*keys, user.alias("user"))


def pack_blocks(
    blocks: DataFrame, limit: int, keys: list[str] | None = None, seq: str = "seq",
    block_rows: int = scan.BLOCK_ROWS,
) -> DataFrame:
    """Blocks with their ``batch``: everything in one when it fits, else packed in order."""
    keys = keys or ["source_id"]
    size = F.length("block")
    over = (
        blocks.groupBy(*keys)
        .agg((F.sum(size) + 2 * (F.count(F.lit(1)) - 1)).alias("_chars"))
        .where(F.col("_chars") > limit)
        .select(*keys)
    )
    large = blocks.select(*keys, seq, (size + labels.BLOCK_SEPARATOR_CHARS).alias("cost")).join(
        over, keys, "left_semi"
    )
    pieces = group_rows(
        large, keys, seq, F.col("cost"), Rule("before", limit), block_rows=block_rows
    )
    placed = assign_groups(blocks, pieces, keys, seq, block_rows, how="left")
    return placed.withColumn("batch", F.coalesce("window_id", F.lit(0))).drop("window_id")


def synthesis_blocks(notes: DataFrame) -> DataFrame:
    """``## [time] title`` and summary of each section; ``notes`` has seq, start, title."""
    block = F.concat(
        F.lit("## "), stamped_line(F.col("start"), F.col("title")), F.lit("\n"), F.col("summary")
    )
    return notes.select("source_id", "seq", block.alias("block"))


def synthesis_requests(packed: DataFrame) -> DataFrame:
    """One request per batch of section blocks."""
    return packed.groupBy("source_id", "batch").agg(
        join_ordered(["seq"], F.col("block"), "\n\n").alias("user")
    )


def learning_requests(blocks: DataFrame, limit: int) -> DataFrame:
    """One request per source: section blocks up to the budget, cut at ``limit``.

    Only blocks whose separator or text begins inside the budget are joined, so the
    request is bounded whatever the length of the source; the cut equals cutting the
    whole text, and ``cropped`` says that there was one.
    """
    total = blocks.groupBy("source_id").agg(
        (F.sum(F.length("block") + 2) - 2 > limit).alias("cropped")
    )
    placed = scan.running_sum(
        blocks.withColumn("_block", scan.block_of(F.col("seq"))).withColumn(
            "_size", F.length("block") + 2
        ),
        ["source_id"], ["seq"], "_block", "_size", "_at", inclusive=False,
    ).where(F.col("_at") - 2 < limit)
    joined = placed.groupBy("source_id").agg(
        join_ordered(["seq"], F.col("block"), "\n\n").alias("_all")
    )
    return joined.join(total, "source_id").select(
        "source_id", budget_crop(F.col("_all"), limit).alias("user"), "cropped"
    )


def merge_batches(bullets: DataFrame, glossary: DataFrame, limit: int) -> tuple:
    """Second synthesis round: requests from the batches' bullets, and their terms.

    ``bullets`` has source_id, batch, pos and bullet. Intermediate terms are passed
    on after the final ones. Bullets are packed again should they not fit.
    """
    ordered = scan.number_rows(
        bullets.withColumn("_block", scan.block_of(F.col("batch"), 256)),
        ["source_id"], ["batch", "pos"], "_block", "seq",
    ).select("source_id", "seq", F.concat(F.lit("- "), F.col("bullet")).alias("block"))
    packed = pack_blocks(ordered, limit)
    requests = packed.groupBy("source_id", "batch").agg(
        join_ordered(["seq"], F.col("block"), "\n").alias("user")
    )
    return requests, glossary.withColumn("round", F.lit(1))


def collection_requests(jobs: DataFrame, existing: DataFrame) -> DataFrame:
    """Collection requests: known collections, title and topics.

    ``existing`` is a one-row table with the list text in ``listing``; ``jobs`` has
    title and a topics array of bounded size.
    """
    topics = F.array_join("topics", ", ")
    user = F.concat(
        F.lit("MEVCUT KOLEKSİYONLAR:\n"),
        F.coalesce(existing.select("listing").scalar(), F.lit(labels.NO_COLLECTIONS)),
        F.lit("\n\nYENİ İÇERİK:\nBaşlık: "), F.coalesce("title", F.lit("")),
        F.lit("\nKonular: "), F.when(topics == "", labels.NO_TOPICS).otherwise(topics),
    )
    return jobs.select("id", user.alias("user"))


def title_requests(
    jobs: DataFrame, max_sections: int | None = None, max_topics: int | None = None
) -> DataFrame:
    """Title requests from section titles and distinct topics.

    With limits, the first ones only; ``cropped`` says whether any were left out.
    """
    def first(column: str, n: int | None):
        return F.col(column) if n is None else F.slice(column, 1, n)

    sections = F.filter(first("section_titles", max_sections), lambda s: s != "")
    topics = F.array_join(F.array_distinct(first("topics", max_topics)), ", ")
    cropped = F.lit(False)
    for column, n in (("section_titles", max_sections), ("topics", max_topics)):
        if n is not None:
            cropped = cropped | (F.size(column) > n)
    user = F.concat(
        F.lit("BÖLÜM BAŞLIKLARI:\n"),
        F.array_join(F.transform(sections, lambda s: F.concat(F.lit("- "), s)), "\n"),
        F.lit("\n\nKONULAR: "), F.when(topics == "", labels.NO_TOPICS).otherwise(topics),
    )
    return jobs.select("id", user.alias("user"), cropped.alias("cropped"))


def recent_turns(turns: DataFrame, n: int = labels.HISTORY_TURNS) -> DataFrame:
    """History text per conversation: the last ``n`` turns, incomplete ones left out."""
    latest = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    kept = turns.withColumn("_rn", F.row_number().over(latest)).where(F.col("_rn") <= n)
    complete = kept.where(~is_blank(F.col("question")) & ~is_blank(F.col("answer")))
    line = F.concat(
        F.lit("K: "), strip(F.col("question")), F.lit("\nC: "), strip(F.col("answer")), F.lit("\n")
    )
    return complete.groupBy("conv_id").agg(join_ordered(["turn"], line, "").alias("history"))


def question_limit(section_window):
    """Transcript characters a question may carry."""
    return F.greatest(F.coalesce(section_window, F.lit(12_000)) * 6, F.lit(40_000))


def question_requests(questions: DataFrame) -> DataFrame:
    """Question requests with the crop flag.

    ``questions`` has title, transcript, question, history (may be NULL) and the
    provider's ``section`` window.
    """
    limit = question_limit(F.col("section"))
    cropped = was_cropped(F.col("transcript"), limit)
    history = F.when(
        F.coalesce(F.col("history"), F.lit("")) != "",
        F.concat(F.lit(labels.HISTORY_HEADER), F.col("history"), F.lit("\n")),
    ).otherwise("")
    user = F.concat(
        F.lit("BAŞLIK: "), F.coalesce("title", F.lit("")), F.lit("\n\nTRANSKRİPT"),
        F.when(cropped, labels.CROP_HEADER).otherwise(""), F.lit(":\n"),
        budget_crop(F.col("transcript"), limit), F.lit("\n\n"), history,
        F.lit("SORU: "), F.col("question"),
    )
    keep = [c for c in questions.columns if c not in ("transcript", "history", "section")]
    return questions.select(*keep, cropped.alias("cropped"), user.alias("user"))


LEAST_LINE = 10  # characters of the shortest line with its time stamp and line break


def _terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), 1))


def relevant_segments(questions: DataFrame, segments: DataFrame, limit: int) -> DataFrame:
    """(id, start, seq, line, score): the lines of its source that a question's request carries.

    ``questions`` has id, source_id and question. The words of all segments are an inverted
    index; a segment scores a thousand times the logarithm of how rare in its source each
    word is that it shares with the question. Lines are taken from the highest score down,
    earlier ones first among equals, while their characters are within ``limit``: a source
    that fits comes whole, of a longer one the lines that speak of the question. Of the index
    only the words asked of a source are kept, where the segment lies; lines are ranked by
    their lengths, and only the chosen ones take their text along.
    """
    asked = questions.select("id", "source_id", F.explode(_terms(F.col("question"))).alias("term"))
    wanted = asked.groupBy("source_id").agg(F.collect_set("term").alias("_wanted"))
    hits = F.array_intersect(_terms(F.col("text")), F.col("_wanted"))
    named = stage(segments.select("source_id", "seq", "text").join(wanted, "source_id").select(
        "source_id", "seq", F.explode(hits).alias("term")))
    rare = named.groupBy("source_id", "term").agg(F.count(F.lit(1)).alias("_df"))
    sizes = segments.groupBy("source_id").agg(F.count(F.lit(1)).alias("_n"))
    weights = asked.join(rare, ["source_id", "term"]).join(sizes, "source_id").select(
        "id", "source_id", "term", F.floor(1000 * F.log(F.col("_n") / F.col("_df"))).cast("long").alias("_w"))
    scores = named.join(weights, ["source_id", "term"]).groupBy("id", "source_id", "seq").agg(
        F.sum("_w").alias("_score"))
    line = stamped_line(F.col("start"), F.col("text"))
    same = F.xxhash64("start", "seq", line)
    sized = segments.select("source_id", "start", "seq", F.length(line).alias("_size"), same.alias("_same"))
    scored = questions.select("id", "source_id").join(sized, "source_id").join(
        scores, ["id", "source_id", "seq"], "left").select(
        "id", "source_id", "start", "seq", "_size", "_same", F.coalesce("_score", F.lit(0).cast("long")).alias("score"))
    order = Window.partitionBy("id").orderBy(F.desc("score"), "start", "seq")
    first = scored.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= limit // LEAST_LINE)
    upto = F.sum(F.col("_size") + 1).over(order.rowsBetween(Window.unboundedPreceding, 0))
    chosen = first.withColumn("_upto", upto).where(F.col("_upto") <= limit + 1).select(
        "id", "source_id", "start", "seq", "score", "_same")
    # equal rows are one text, given to each of them
    texts = segments.select("source_id", same.alias("_same"), line.alias("line")).groupBy(
        "source_id", "_same").agg(F.first("line").alias("line"))
    return chosen.join(texts, ["source_id", "_same"]).select("id", "start", "seq", "line", "score")


def retrieved_question_requests(questions: DataFrame, segments: DataFrame, limit: int) -> DataFrame:
    """Question requests whose transcript is chosen by relevance, in time order.

    ``questions`` has id, source_id, title, question and history (may be NULL).
    ``left_out`` counts the lines of the source that the request does not carry.
    """
    chosen = relevant_segments(questions, segments, limit).groupBy("id").agg(
        join_ordered(["start", "seq"], F.col("line"), "\n").alias("_text"), F.count(F.lit(1)).alias("_lines"))
    sizes = segments.groupBy("source_id").agg(F.count(F.lit(1)).alias("_n"))
    whole = questions.join(chosen, "id", "left").join(sizes, "source_id", "left")
    left_out = F.coalesce("_n", F.lit(0)) - F.coalesce("_lines", F.lit(0))
    history = F.when(
        F.coalesce(F.col("history"), F.lit("")) != "",
        F.concat(F.lit(labels.HISTORY_HEADER), F.col("history"), F.lit("\n")),
    ).otherwise("")
    user = F.concat(
        F.lit("BAŞLIK: "), F.coalesce("title", F.lit("")), F.lit("\n\nTRANSKRİPT:\n"),
        F.coalesce("_text", F.lit("")), F.lit("\n\n"), history, F.lit("SORU: "), F.col("question"),
    )
    return whole.select("id", "source_id", user.alias("user"), left_out.cast("long").alias("left_out"))


def admit_requests(requests: DataFrame) -> DataFrame:
    """Grant output tokens within the budget, or reject with the reason.

    ``tokens_per_minute`` (NULL when the provider has no such quota) limits input
    and output together; ``max_output`` (may be NULL) is the provider's own cap.
    """
    prompt = est_tokens(F.col("system")) + est_tokens(F.col("user"))
    allowed = F.floor(F.col("tokens_per_minute") * labels.QUOTA_SHARE).cast("long") - prompt
    rejected = F.coalesce(allowed < labels.MIN_OUTPUT_TOKENS, F.lit(False))
    granted = F.least("max_tokens", allowed, "max_output")
    return requests.withColumn("prompt_tokens", prompt).withColumn(
        "granted_tokens", F.when(~rejected, granted).cast("long")
    ).withColumn(
        "reason",
        F.when(rejected, F.concat(
            F.lit("input too large: ~"), prompt.cast("string"), F.lit(" tokens of "),
            F.col("tokens_per_minute").cast("string"),
        )),
    )


def score(
    requests: DataFrame, fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]],
    partitions: int | None = None, attempts: int = 3,
) -> DataFrame:
    """Run a caller's scorer over request batches: ``(request_id, body, error, attempts)``.

    ``fn`` maps an iterator of frames with request_id, system, user and max_tokens
    to frames with request_id and body. A batch that raises is retried row by row;
    a row that keeps failing becomes an error row. The job never fails for it. Requests
    are scored where they lie; with ``partitions`` they are dealt out first.
    """

    def call(frame: pd.DataFrame) -> dict:
        bodies = pd.concat(list(fn(iter([frame]))), ignore_index=True)
        return dict(zip(bodies["request_id"], bodies["body"]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows = []
            try:
                found = call(frame)
                rows = [
                    (i, found.get(i), None if i in found else "no response", 1)
                    for i in frame["request_id"]
                ]
            except Exception:  # noqa: BLE001 - the scorer is foreign code
                for k in range(len(frame)):
                    one = frame.iloc[k:k + 1]
                    rid, body, error, tries = one["request_id"].iloc[0], None, None, 1
                    while tries < attempts:
                        tries += 1
                        try:
                            body, error = call(one).get(rid), None
                            break
                        except Exception as exc:  # noqa: BLE001
                            error = str(exc)
                    if body is None and error is None:
                        error = "no response"
                    rows.append((rid, body, error, tries))
            yield pd.DataFrame(rows, columns=["request_id", "body", "error", "attempts"])

    slim = requests.select("request_id", "system", "user", "max_tokens")
    spread = slim.repartition(partitions) if partitions else slim
    kind = requests.schema["request_id"].dataType.simpleString()
    return spread.mapInPandas(
        run, f"request_id {kind}, body string, error string, attempts int"
    )
