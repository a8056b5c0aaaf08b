"""Ordered scans that stay parallel inside one very large key.

A window over a whole source puts that source into one task. Here a source is cut
into blocks of consecutive rows; one small row per block is aggregated (with
map-side combine), the carry between blocks is computed on those small rows, and
the detail rows are scanned block by block. The join on ``(key, block)`` and the
block window share one hash partitioning, so the detail is shuffled once.

``block`` must not decrease along the scan order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows of one source handled together; a lecture hour has about a thousand.
BLOCK_ROWS = 8192
# Seconds of one source handled together where order is by time.
BLOCK_SECONDS = 3600


def block_of(position: Column, rows: int = BLOCK_ROWS) -> Column:
    """Block number of a list position (or of a time, with ``rows`` in seconds)."""
    return F.floor(position / rows).cast("long")


def with_carry(
    df: DataFrame,
    keys: list[str],
    block: str,
    summaries: dict[str, Column],
    carries: dict[str, tuple[Column, str]],
) -> DataFrame:
    """Attach per-block carries to every row.

    ``summaries`` are aggregates of one block. ``carries`` maps a new column to an
    aggregate over those summaries and the side it reads: ``before`` (all earlier
    blocks) or ``after`` (all later blocks).
    """
    ordered = Window.partitionBy(*keys).orderBy(block)
    frames = {
        "before": ordered.rowsBetween(Window.unboundedPreceding, -1),
        "after": ordered.rowsBetween(1, Window.unboundedFollowing),
    }
    per_block = df.groupBy(*keys, block).agg(*[e.alias(n) for n, e in summaries.items()])
    carried = per_block.select(
        *keys, block, *[e.over(frames[side]).alias(n) for n, (e, side) in carries.items()]
    )
    return df.join(carried, [*keys, block])


def number_rows(
    df: DataFrame, keys: list[str], order: list[str], block: str, name: str, start: int = 0
) -> DataFrame:
    """Consecutive numbers per key along ``order``."""
    out = with_carry(
        df, keys, block, {"_n": F.count(F.lit(1))}, {"_seen": (F.sum("_n"), "before")}
    )
    inside = Window.partitionBy(*keys, block).orderBy(*order)
    number = F.row_number().over(inside) + F.coalesce("_seen", F.lit(0)) + (start - 1)
    return out.withColumn(name, number.cast("long")).drop("_seen")


def running_sum(
    df: DataFrame, keys: list[str], order: list[str], block: str, value: str, name: str,
    inclusive: bool = True,
) -> DataFrame:
    """Running total per key along ``order``, with or without the current row."""
    out = with_carry(df, keys, block, {"_s": F.sum(value)}, {"_seen": (F.sum("_s"), "before")})
    inside = (
        Window.partitionBy(*keys, block)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    total = F.coalesce(F.sum(value).over(inside), F.lit(0)) + F.coalesce("_seen", F.lit(0))
    return out.withColumn(name, total).drop("_seen")


def neighbour(
    df: DataFrame, keys: list[str], order: list[str], block: str, values: dict[str, str],
    ahead: bool,
) -> DataFrame:
    """Next (``ahead``) or previous row's values per key along ``order``.

    ``values`` maps existing columns to new names. Missing neighbours give NULL.
    """
    cells = F.struct(*[F.col(v).alias(v) for v in values])
    rank = F.struct(*[F.col(o) for o in order])
    edge = F.min_by(cells, rank) if ahead else F.max_by(cells, rank)
    pick = F.first if ahead else F.last
    out = with_carry(
        df, keys, block, {"_edge": edge}, {"_far": (pick("_edge"), "after" if ahead else "before")}
    )
    inside = Window.partitionBy(*keys, block).orderBy(*order)
    near = (F.lead if ahead else F.lag)(F.struct(cells.alias("c"))).over(inside)
    out = out.withColumn("_near", near)
    chosen = F.when(F.col("_near").isNotNull(), F.col("_near.c")).otherwise(F.col("_far"))
    for value, name in values.items():
        out = out.withColumn(name, chosen[value])
    return out.drop("_near", "_far")


def next_value(df, keys, order, block, values):
    """Values of the following row; see ``neighbour``."""
    return neighbour(df, keys, order, block, values, ahead=True)


def previous_value(df, keys, order, block, values):
    """Values of the preceding row; see ``neighbour``."""
    return neighbour(df, keys, order, block, values, ahead=False)


def running_max(
    rows: DataFrame, marks: DataFrame, keys: list[str], t: str, mark_t: str, cell: Column, name: str,
    block_seconds: float = BLOCK_SECONDS,
) -> DataFrame:
    """Each row with the largest ``cell`` of the marks of its key at or before its time.

    A cell that begins with the mark's time makes this an as-of join: the last mark wins,
    and of marks at one time the one whose cell is larger. Rows and marks are put on one
    timeline and cut into blocks of time; the largest cell of all earlier blocks is carried
    into each, so the rows are shuffled once, on key and block, and a long source is many
    tasks. NULL where no mark is early enough, and for rows without a time.
    """
    block = lambda c: F.coalesce(block_of(F.col(c), block_seconds), F.lit(-(1 << 62)))
    # columns of the rows travel under numbers, so that no name of the marks can clash
    own = [F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(rows.columns) if c not in keys]
    left = rows.select(
        *keys, block(t).alias("_block"), F.col(t).cast("double").alias("_t"), F.lit(1).alias("_kind"), *own)
    right = marks.select(
        *keys, block(mark_t).alias("_block"), F.col(mark_t).cast("double").alias("_t"), F.lit(0).alias("_kind"),
        cell.alias("_cell"))
    both = left.unionByName(right, allowMissingColumns=True)
    narrow = left.select(*keys, "_block").distinct().unionByName(
        right.select(*keys, "_block", "_cell"), allowMissingColumns=True)
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = narrow.groupBy(*keys, "_block").agg(F.max("_cell").alias("_cell")).select(
        *keys, "_block", F.max("_cell").over(earlier).alias("_carry"))
    inside = Window.partitionBy(*keys, "_block").orderBy("_t", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    here = F.max("_cell").over(inside)
    found = both.join(carried, [*keys, "_block"]).withColumn("_here", here).where("_kind = 1")
    timed = F.when(F.col("_t").isNotNull(), F.greatest("_here", "_carry"))
    numbers = {c: f"_c{i}" for i, c in enumerate(rows.columns) if c not in keys}
    return found.select(
        *[F.col(c) if c in keys else F.col(numbers[c]).alias(c) for c in rows.columns], timed.alias(name))
