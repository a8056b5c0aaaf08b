"""Mixing sources to target weights by Poisson replication.

A source with ``n`` of all rows and weight ``w`` gets the mean repetition rate
``total * w / n``. Each document turns a hash of its identifier and the seed into a
number in (0, 1) and inverts the Poisson distribution of its source's rate there: it is
repeated that many times, independently of every other document and of how the data are
partitioned. A rate above ``STEP`` is cut into equal parts with a hash each, whose draws
are summed, so that no rate underflows and no count is capped. The copies are then dealt
to random places: a hash of document and copy decides the partition and the order in it.

Everything is a DataFrame expression; the one exchange that carries texts is the shuffle
that the result is meant to have.

Defined results: a null source is a source of its own; a null identifier draws by its
text; equal rows draw equal counts; a source without a weight, or with a weight that is
null, negative or zero, is not drawn; an empty table gives no rows. Columns are carried
along; helper columns get names that the table does not have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import bound_to, fresh
from .textbytes import written

STEP = 16.0  # largest mean inverted at once
TERMS = 120  # terms of its distribution; what lies beyond is under 2**-53 for a mean of STEP
SOURCES_TO_BROADCAST = 10_000
DIGITS = 13  # hexadecimal digits of the hash behind a draw


def uniform(*parts: Column | str) -> Column:
    """A number strictly between 0 and 1 from a hash of the parts."""
    digits = F.substring(F.md5(F.concat_ws(":", *parts)), 1, DIGITS)
    whole = F.conv(digits, 16, 10).cast("long")
    return (whole.cast("double") + F.lit(0.5)) / F.lit(float(16**DIGITS))


def cumulative(mean: Column) -> Column:
    """The first ``TERMS`` values of the Poisson distribution function, summed from zero up."""
    start = F.struct(
        F.exp(-mean).alias("p"), F.exp(-mean).alias("sum"),
        F.array(F.exp(-mean)).alias("all"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k
        return F.struct(
            p.alias("p"), (acc["sum"] + p).alias("sum"),
            F.concat(acc["all"], F.array(acc["sum"] + p)).alias("all"))

    return F.aggregate(
        F.sequence(F.lit(1), F.lit(TERMS - 1)), start, step, lambda acc: acc["all"])


def rates(
    docs: DataFrame, weights: DataFrame, total: float | None = None, source: str = "source"
) -> DataFrame:
    """(source, n_rows, rate) of each source of ``docs``; ``weights`` has (source, weight).

    ``total`` is the expected number of rows of the mix, by default that of ``docs``.
    """
    counts = docs.groupBy(F.col(f"`{source}`").alias("source")).agg(F.count(F.lit(1)).alias("n_rows"))
    wanted = weights.where(F.col("weight") > 0).groupBy(F.col("source").alias("named")).agg(
        F.sum("weight").alias("weight"))
    here = counts.join(wanted, F.col("source").eqNullSafe(F.col("named"))).drop("named")
    whole = here.agg(F.sum("weight").alias("w")).scalar()
    rows = F.lit(float(total)) if total is not None else counts.agg(
        F.sum("n_rows").cast("double").alias("n")).scalar()
    return here.select(
        "source", "n_rows", (rows * (F.col("weight") / whole) / F.col("n_rows")).alias("rate"))


def temper(docs: DataFrame, power: float = 0.5, source: str = "source") -> DataFrame:
    """(source, weight) with each source's share of rows raised to ``power``."""
    return docs.groupBy(F.col(f"`{source}`").alias("source")).agg(
        F.pow(F.count(F.lit(1)).cast("double"), F.lit(power)).alias("weight"))


def mix(
    docs: DataFrame, weights: DataFrame, total: float | None = None, seed: int = 0,
    id_column: str = "doc_id", source: str = "source", text: str = "text",
    copy: str | None = "copy", place: str | None = "place", partitions: int | None = None,
) -> DataFrame:
    """Each document as often as its draw says, in globally shuffled order.

    ``copy`` (from 0) and ``place`` (the hash the order follows) are added unless None.
    """
    rate, cdf, key, n = (fresh(docs, c) for c in ("rate_", "cdf_", "key_", "n_"))
    number, spot = copy or fresh(docs, "copy_"), place or fresh(docs, "place_")
    for name in (copy, place):
        if name and fresh(docs, name) != name:
            raise ValueError(f"column {name} exists already; name another")
    table = written(rates(docs, weights, total, source).select(
        F.col("source").alias(key), F.col("rate").alias(rate)
    ).withColumn(n, F.greatest(F.ceil(F.col(rate) / STEP), F.lit(1)).cast("int"))
     .withColumn(cdf, cumulative(F.col(rate) / F.col(n))))
    # one row of about a kilobyte per source: broadcast where their number is checked to be small
    if table.count() <= SOURCES_TO_BROADCAST:
        table = F.broadcast(table)
    who = F.coalesce(F.col(f"`{id_column}`").cast("string"), F.md5(F.coalesce(F.col(f"`{text}`"), F.lit(""))))

    def draw(part: Column) -> Column:
        u = uniform(F.lit(str(seed)), who, part.cast("string"))
        return bound_to(u, lambda x: F.size(F.filter(F.col(cdf), lambda c: c <= x)))

    drawn = F.aggregate(
        F.sequence(F.lit(1), F.col(n)), F.lit(0), lambda acc, part: acc + draw(part))
    copies = (
        docs.join(table, F.col(f"`{source}`").eqNullSafe(F.col(key)))
        .withColumn(n, drawn).where(F.col(n) > 0)
        .withColumn(number, F.explode(F.sequence(F.lit(0), F.col(n) - 1)))
        .withColumn(spot, F.substring(
            F.md5(F.concat_ws(":", F.lit(f"place {seed}"), who, F.col(number))), 1, 16))
    )
    dealt = copies.repartition(spot) if partitions is None else copies.repartition(partitions, spot)
    kept = [c for c, made in ((number, copy), (spot, place)) if made]
    return dealt.sortWithinPartitions(spot).select(*[F.col(f"`{c}`") for c in docs.columns], *kept)
