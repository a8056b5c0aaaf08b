"""Transcript quality: measures, the repair decision and the acceptance guard."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import labels
from ..functions.text import first_letter_upper, sentence_marks, word_count
from .sections import close_ends


def quality_measures(segments: DataFrame) -> DataFrame:
    """Punctuation per hundred words and share of capital starts, one pass."""
    per_row = segments.select(
        "source_id",
        sentence_marks(F.col("text")).alias("_marks"),
        word_count(F.col("text")).alias("_words"),
        first_letter_upper(F.col("text")).cast("int").alias("_upper"),
    )
    return per_row.groupBy("source_id").agg(
        F.when(F.sum("_words") > 0, F.sum("_marks") * 100 / F.sum("_words"))
        .otherwise(F.lit(0.0)).alias("punct_density"),
        F.coalesce(F.sum("_upper") / F.nullif(F.count("_upper"), F.lit(0)), F.lit(1.0))
        .alias("caps_ratio"),
    )


def punct_density(segments: DataFrame) -> DataFrame:
    """Sentence-final marks per hundred words; detects missing punctuation only."""
    return quality_measures(segments).select("source_id", "punct_density")


def caps_ratio(segments: DataFrame) -> DataFrame:
    """Share of segments that start upper case; 1.0 when none has a letter."""
    return quality_measures(segments).select("source_id", "caps_ratio")


def needs_repair(
    segments: DataFrame, mode: str = "auto", min_punct: float = labels.MIN_PUNCT,
    min_caps: float = labels.MIN_CAPS,
) -> DataFrame:
    """Measures plus the decision, which ``off`` and ``always`` override."""
    measured = quality_measures(segments)
    poor = (F.col("punct_density") < min_punct) | (F.col("caps_ratio") < min_caps)
    decision = {"off": F.lit(False), "always": F.lit(True)}.get(mode, poor)
    return measured.withColumn("needs_repair", decision)


def quality_profile(segments: DataFrame) -> DataFrame:
    """Per source: rounded measures and whether it goes to repair."""
    return needs_repair(segments).select(
        "source_id",
        F.bround("punct_density", 1).alias("punct"),
        F.bround("caps_ratio", 2).alias("caps"),
        F.col("needs_repair").alias("repaired"),
    )


def quality_histogram(profile: DataFrame, column: str, low: float, high: float, bins: int):
    """Distribution of a measure, for calibrating thresholds."""
    bucket = F.width_bucket(F.col(column), F.lit(low), F.lit(high), F.lit(bins))
    return profile.groupBy(bucket.alias("bin")).agg(F.count(F.lit(1)).alias("sources"))


# Sketch size, and the share of rows by which a quantile's rank may be off (99 % of the time).
SKETCH_K, RANK_ERROR = 400, 0.007


def measure_sketches(rows: DataFrame, keys: list[str], measures: list[str], k: int = SKETCH_K) -> DataFrame:
    """One quantile sketch per group and measure: the whole distribution in a few kilobytes.

    Columns are named after the measures. NULL values are not counted; sketches are built
    in the tasks first, and ``merged_sketches`` rolls them up without the rows.
    """
    return rows.groupBy(*keys).agg(*[
        F.kll_sketch_agg_double(F.col(m).cast("double"), k).alias(m) for m in measures])


def merged_sketches(sketches: DataFrame, keys: list[str], measures: list[str], k: int = SKETCH_K) -> DataFrame:
    """Sketches of larger groups, from those of smaller ones."""
    return sketches.groupBy(*keys).agg(*[F.kll_merge_agg_double(m, k).alias(m) for m in measures])


def sketch_quantiles(sketches: DataFrame, keys: list[str], measures: list[str], shares: list[float]) -> DataFrame:
    """(keys, measure, n, share, value): each measure's value at each share of its rows."""
    one = lambda m: F.struct(
        F.lit(m).alias("measure"), F.kll_sketch_get_n_double(m).alias("n"), F.col(m).alias("sketch"))
    long = sketches.select(*keys, F.explode(F.array(*[one(m) for m in measures])).alias("s")).select(*keys, "s.*")
    wanted = F.array(*[F.lit(float(x)) for x in shares])
    values = F.arrays_zip(
        wanted.alias("share"), F.kll_sketch_get_quantile_double("sketch", wanted).alias("value"))
    return long.where(F.col("n") > 0).select(*keys, "measure", "n", F.explode(values).alias("v")).select(
        *keys, "measure", "n", "v.*")


def share_below(sketches: DataFrame, keys: list[str], measure: str, threshold: float) -> DataFrame:
    """(keys, n, share) of the rows that a threshold on ``measure`` would turn away."""
    n = F.kll_sketch_get_n_double(measure)
    rank = F.kll_sketch_get_rank_double(measure, F.lit(float(threshold)))
    return sketches.select(*keys, n.alias("n"), F.when(n > 0, rank).alias("share"))


def accept_repairs(
    windowed: DataFrame, repaired: DataFrame, min_words: float = labels.MIN_REPAIR_WORDS
) -> DataFrame:
    """Repaired segments where they keep enough words, else the originals.

    A window without repaired rows (failed or empty response) keeps its own rows,
    so nothing is lost either way. ``repaired`` has start, seq and text.
    """
    keys = ["source_id", "window_id"]
    before = windowed.groupBy(*keys).agg(
        F.sum(word_count(F.col("text"))).alias("_before"),
        F.max_by("end", "seq").alias("last_end"),
    )
    after = repaired.groupBy(*keys).agg(F.sum(word_count(F.col("text"))).alias("_after"))
    verdict = before.join(after, keys).select(
        *keys, "last_end",
        ((F.col("_before") == 0) | (F.col("_after") / F.nullif("_before", F.lit(0)) >= min_words))
        .alias("_ok"),
    )
    accepted = verdict.where("_ok").select(*keys, "last_end")
    fresh = close_ends(repaired.join(accepted.select(*keys), keys, "left_semi"), accepted)
    kept = windowed.join(accepted.select(*keys), keys, "left_anti")
    columns = [*keys, "seq", "start", "end", "text"]
    return (
        kept.select(*columns).withColumn("origin", F.lit("original"))
        .unionByName(fresh.select(*columns).withColumn("origin", F.lit("repaired")))
    )
