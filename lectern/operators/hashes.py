"""Greedy removal of near-identical screens by hash distance.

A frame is kept when it is farther than ``distance`` bits from every frame kept
before it in the same source. Repeats of one hash are decided by its first frame,
so they are collapsed by an aggregate first, which removes still screens however
many there are. What is left is scanned in blocks of consecutive distinct hashes:
in a round the next block of every source at once loses the rows that are near a
frame kept in an earlier block, found by joining bands of bits, and the rest is
scanned in order. A source takes as many rounds as it has blocks, whatever chains
its hashes form; most have one. The result equals the sequential scan.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scan
from .stage import stage

# Distinct hashes of one source scanned together: 8 bytes each.
BLOCK = 32_768


def _greedy(distance: int, key: str, order: str, value: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept, used = np.empty(0, np.uint64), 0
        for frame in batches:
            opens = frame["_i"].to_numpy() == 1
            hashes = frame[value].to_numpy(np.int64).view(np.uint64)
            keep = np.zeros(len(frame), bool)
            for row, h in enumerate(hashes):
                if opens[row]:
                    kept, used = np.empty(64, np.uint64), 0
                near = np.bitwise_count(kept[:used] ^ h) <= distance
                if near.any():
                    continue
                if used == len(kept):
                    kept = np.concatenate([kept, np.empty(used, np.uint64)])
                kept[used] = h
                used, keep[row] = used + 1, True
            yield frame.loc[keep, [key, order, value]]

    return run


def _band_keys(distance: int, bits: int) -> Column:
    """Keys of which hashes within ``distance`` share one at least.

    With ``distance + 2`` bands at most ``distance`` can differ, so two agree; keys
    of two bands are far more selective than one.
    """
    bands = distance + 2
    edges = [round(i * bits / bands) for i in range(bands + 1)]
    cells = [F.shiftrightunsigned("h", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1))
             for lo, hi in zip(edges[:-1], edges[1:])]
    return F.array(*[F.xxhash64(F.lit(i * bands + j), cells[i], cells[j])
                     for i, j in combinations(range(bands), 2)])


def _near_kept(rows: DataFrame, kept: DataFrame, distance: int, bits: int) -> DataFrame:
    """(source_id, frame_idx) of the rows within ``distance`` of a kept frame of their source."""
    keys = F.explode(_band_keys(distance, bits)).alias("_key")
    left = rows.select("source_id", "frame_idx", "h", keys)
    right = kept.select(F.col("source_id").alias("_s"), F.col("h").alias("_h"), keys.alias("_k"))
    close = F.bit_count(F.col("h").bitwiseXOR(F.col("_h"))) <= distance
    return left.join(
        right, (F.col("source_id") == F.col("_s")) & (F.col("_key") == F.col("_k")) & close, "left_semi"
    ).select("source_id", "frame_idx").distinct()


def dedupe_hashes(
    frames: DataFrame, distance: int = 5, bits: int = 64, block: int = BLOCK,
) -> DataFrame:
    """Rows of ``frames`` (source_id, frame_idx, h, ...) that survive, in frame order."""
    keys = ["source_id", "frame_idx"]
    first = frames.groupBy("source_id", "h").agg(F.min("frame_idx").alias("frame_idx"))
    numbered = scan.number_rows(
        first.withColumn("_block", scan.block_of(F.col("frame_idx"))), ["source_id"], ["frame_idx"], "_block", "_n")
    nodes = stage(numbered.select(*keys, "h", F.floor(F.col("_n") / block).cast("long").alias("_round")))
    last = nodes.agg(F.max("_round")).first()[0] or 0
    order = Window.partitionBy("source_id").orderBy("frame_idx")
    schema = nodes.drop("_round").schema
    kept = None
    for turn in range(last + 1):
        rows = nodes.where(F.col("_round") == turn).drop("_round")
        if kept is not None:
            rows = rows.join(_near_kept(rows, kept, distance, bits), keys, "left_anti")
        fresh = rows.withColumn("_i", F.row_number().over(order)).mapInPandas(
            _greedy(distance, "source_id", "frame_idx", "h"), schema)
        kept = fresh if kept is None else kept.unionByName(fresh)
        if turn < last:
            kept = stage(kept)
    return frames.join(kept.select(*keys), keys, "left_semi")
