"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each
result as Parquet to the shared folder and reads it back as the next stage's docs. A stage
called with such docs removes what the stage before it has left in the shared folder.

Defined results: a null or empty text fails the quality rules; of equal texts the largest
identifier stays, null identifiers are the smallest, and of equal rows one stays; of near
copies the smallest identifier stays, null identifiers last; a null source is a source of
its own; texts of any length are taken whole; an empty table gives no rows. Columns of
any name are carried as far as mixing; packing returns its own.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import mixing, packing, parity_join, rules, tries
from lectern.llm.queries import MIX_POWER, MIX_SEED, tokenizer_path
from lectern.llm.textbytes import drop_scratch, scratch_mark, scratch_since, written

_left: list[str] = []  # written tables of the latest stage


def stage(work: Callable) -> Callable:
    """A stage that first removes the written tables of the one before it, whose result is ``docs``."""
    @wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_scratch(docs, _left)
        mark = scratch_mark()
        out = work(spark, docs, sf_dir)
        _left[:] = scratch_since(mark)
        return out

    return run_stage


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go; documents that fail the base rules or lose too much text go."""
    return rules.clean(docs)


@stage
def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for the case of A-Z, the row with the largest doc_id stays."""
    return tries.survivors(docs)


@stage
def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, Jaccard 0.8), the smallest doc_id stays."""
    return parity_join.one_of_each(docs, 80, 100, 5)


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn so that sources have tempered shares, and shuffled."""
    return mixing.mix(
        docs, mixing.temper(docs, MIX_POWER), seed=MIX_SEED, copy=None, place=None)


@stage
def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens with their places in the packed sequences."""
    return packing.pack_documents(docs, tokenizer_path()).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_dedup),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", best_fit_packing),
]

# Tokenising and best-fit packing cannot be said in SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, step in STAGES:
        docs = written(step(spark, docs, sf_dir))
    return docs
