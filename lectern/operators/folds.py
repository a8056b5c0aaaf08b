"""Order-dependent packing whose rule for row k needs the decision for row k-1.

A fold here only ever needs one number of state: the size of the open group, or
the time of the last kept mark. That makes a block of rows a step function from
entry state to exit state, and step functions compose. Work therefore runs as a
prefix scan over a tree:

1. sources longer than one block: one task per block tabulates its step function;
2. upwards: the functions of ``FANOUT`` neighbours are composed into one, round by
   round, until a source has at most ``FANOUT`` of them;
3. downwards: each group is entered in the state its parent was given, which gives
   the entry states of its members;
4. every block is replayed from its entry state, streaming, one pass.

A group is one unit of work: a task reads ``FANOUT`` tables at a time however long
its source is, and the rounds grow with the logarithm of its length. Sources that
fit one block skip straight to step 4. Only ids, costs and flags cross into Python.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scan import BLOCK_ROWS
from .stage import stage


FANOUT = 64  # tables of neighbours that one unit of work reads


@dataclass(frozen=True)
class Rule:
    """When a new group starts.

    ``after``: the group closes after the row that reaches ``limit`` (where ``ok``
    is set, or the size exceeds ``hard``). ``before``: the group closes before the
    row that would exceed ``limit``. ``gap``: a row is kept when it lies at least
    ``limit`` after the last kept one (cost holds the time itself).

    ``merge_below``: a last group smaller than this joins the one before it.
    """

    mode: str
    limit: float
    hard: float | None = None
    merge_below: float = 0.0


class Block:
    """Consecutive rows of one source and where groups start in them.

    State is None when no group is open; otherwise the size of the open group, or
    for ``gap`` the time of the last kept row.
    """

    def __init__(self, rule: Rule, cost: np.ndarray, ok: np.ndarray):
        self.rule, self.n, self.cost, self.ok = rule, len(cost), cost, ok
        self.upto = np.cumsum(cost)
        self.total = float(self.upto[-1])
        self.used = self.upto - cost
        if rule.mode == "after":
            self.soft = np.flatnonzero(ok)
            self.soft_upto = self.upto[self.soft]

    def _next(self, used):
        """Start after a group that had ``-used`` in it when the block began.

        Takes one value or an array. Beyond the block means no further start.
        """
        rule = self.rule
        if rule.mode == "gap":
            return np.searchsorted(self.cost, used + rule.limit, side="left")
        if rule.mode == "before":
            return np.searchsorted(self.upto, used + rule.limit, side="right")
        k = np.searchsorted(self.soft_upto, used + rule.limit, side="left")
        at = np.append(self.soft, self.n)[k]
        if rule.hard is not None:
            at = np.minimum(at, np.searchsorted(self.upto, used + rule.hard, side="right"))
        return at + 1

    @cached_property
    def after(self) -> list[int]:
        """For every row, the start after the group that starts there."""
        if self.rule.mode == "gap":
            return self._next(self.cost).tolist()
        return np.maximum(self._next(self.used), np.arange(1, self.n + 1)).tolist()

    def starts(self, state: float | None) -> list[int]:
        """Rows where groups start when the block is entered in ``state``."""
        if state is None:
            at = 0
        else:
            at = int(self._next(state if self.rule.mode == "gap" else -state))
        found = []
        while at < self.n:
            found.append(at)
            at = self.after[at]
        return found

    @cached_property
    def leave(self) -> list[tuple[float | None, int]]:
        """Exit state and number of starts when a group starts at each row."""
        rule, after = self.rule, self.after
        tails = (self.cost if rule.mode == "gap" else self.total - self.used).tolist()
        out = [(None, 0)] * (self.n + 1)
        for i in range(self.n - 1, -1, -1):
            j = after[i]
            if j < self.n:
                state, count = out[j]
                out[i] = (state, count + 1)
            else:
                closed = rule.mode == "after" and j == self.n
                out[i] = (None if closed else tails[i], 1)
        return out

    def steps(self) -> list[tuple[float, float | None, int]]:
        """The step function: (least entry level, exit state, starts), highest first.

        The level of an open group is its size, or minus the time of the last kept
        row. Levels below every step meet no start in the block. Steps end once
        every possible level is covered, so their number is bounded by the rows
        within reach of ``limit``, not by the block.
        """
        rule, shift, floor = self.rule, 0, 1.0
        if rule.mode == "gap":
            levels, floor = rule.limit - self.cost, -float(self.cost[0])
        elif rule.mode == "before":
            levels = np.floor(rule.limit - self.upto) + 1
        else:
            levels, shift = np.where(self.ok, rule.limit - self.upto, np.inf), 1
            if rule.hard is not None:
                levels = np.minimum(levels, np.floor(rule.hard - self.upto) + 1)
        lowest = np.minimum.accumulate(levels)
        fresh = np.flatnonzero(levels < np.append(np.inf, lowest[:-1]))
        covered = np.flatnonzero(lowest <= floor)
        if len(covered):
            fresh = fresh[fresh <= covered[0]]
        return [(float(levels[i]), *self.leave[i + shift]) for i in fresh.tolist()]


def _groups(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Whole groups per batch: a frame and the offsets of its groups.

    ``_i`` numbers the rows of a group, so 1 opens one. Only an unfinished group,
    at most one block, is held between batches.
    """
    held = None
    for batch in batches:
        if len(batch) == 0:
            continue
        frame = batch if held is None else pd.concat([held, batch], ignore_index=True)
        opens = np.flatnonzero(frame["_i"].to_numpy() == 1)
        cut = int(opens[-1])
        if cut > 0:
            yield frame.iloc[:cut], np.append(opens[:-1], cut)
        held = frame.iloc[cut:].reset_index(drop=True)
    if held is not None:
        yield held, np.array([0, len(held)])


def _tabulate(rule: Rule, keys: list[str]):
    def run(batches):
        for frame, edges in _groups(batches):
            cost, ok = frame["_cost"].to_numpy(float), frame["_ok"].to_numpy(bool)
            rows = []
            for a, b in zip(edges[:-1], edges[1:]):
                block = Block(rule, cost[a:b], ok[a:b])
                fresh, count = block.leave[0]
                steps = block.steps()
                rows.append(
                    (fresh, count, block.total, [s[0] for s in steps],
                     [np.nan if s[1] is None else s[1] for s in steps], [s[2] for s in steps])
                )
            out = frame.iloc[edges[:-1]][[*keys, "_block"]].reset_index(drop=True)
            names = ["_exit", "_starts", "_total", "_levels", "_exits", "_counts"]
            yield pd.concat([out, pd.DataFrame(rows, columns=names)], axis=1)

    return run


class Steps:
    """The step function of consecutive blocks: what entering them in a state leads to.

    ``fresh``: (exit state, starts) without an open group; ``levels`` fall, and an entry
    level takes the exit and count of the first one at or under it; below them all no
    group starts and the state grows by ``total``, or stays for ``gap``.
    """

    def __init__(self, gap: bool, fresh, total, levels, exits, counts):
        self.gap, self.fresh, self.total = gap, fresh, total
        self.levels, self.exits, self.counts = levels, exits, counts

    def __call__(self, state: float | None) -> tuple[float | None, int]:
        """(exit state, starts) for an entry state."""
        if state is None:
            return self.fresh
        at = int(np.searchsorted(-self.levels, state if self.gap else -state, side="left"))
        if at < len(self.levels):
            exit_ = self.exits[at]
            return (None if np.isnan(exit_) else float(exit_)), int(self.counts[at])
        return (state if self.gap else state + self.total), 0

    def then(self, after: Steps) -> Steps:
        """This function followed by ``after``: one step function again.

        Entry levels that meet a start here are sent on from their exit; of the levels
        of ``after`` those stay that are only reached without a start here, shifted by
        what an open group gains on the way.
        """
        def on(state: float | None, starts: int) -> tuple[float | None, int]:
            out, more = after(state)
            return out, starts + more

        sent = [on(None if np.isnan(e) else float(e), int(c)) for e, c in zip(self.exits, self.counts)]
        shifted = after.levels if self.gap else after.levels - self.total
        lowest = self.levels[-1] if len(self.levels) else np.inf
        rest = shifted < lowest
        exits = [np.nan if e is None else e for e, _ in sent]
        return Steps(
            self.gap, on(*self.fresh), self.total + after.total,
            np.append(self.levels, shifted[rest]), np.append(exits, after.exits[rest]).astype(float),
            np.append([c for _, c in sent], after.counts[rest]).astype(np.int64))


TABLE = ("_exit", "_starts", "_total", "_levels", "_exits", "_counts")


def _steps(rule: Rule, frame: pd.DataFrame) -> Iterator[Steps]:
    for exit_, starts, total, levels, exits, counts in zip(*[frame[c] for c in TABLE]):
        fresh = (None if np.isnan(exit_) else float(exit_), int(starts))
        yield Steps(rule.mode == "gap", fresh, float(total), np.asarray(levels, float),
                    np.asarray(exits, float), np.asarray(counts, np.int64))


def _compose(rule: Rule, keys: list[str]):
    """One composed table per group of neighbours, in place of its members' tables."""
    def run(batches):
        for frame, edges in _groups(batches):
            whole = list(_steps(rule, frame))
            rows = []
            for a, b in zip(edges[:-1], edges[1:]):
                f = whole[a]
                for g in whole[a + 1: b]:
                    f = f.then(g)
                rows.append((np.nan if f.fresh[0] is None else f.fresh[0], f.fresh[1], f.total,
                             f.levels.tolist(), f.exits.tolist(), f.counts.tolist()))
            out = frame.iloc[edges[:-1]][[*keys, "_group"]].reset_index(drop=True)
            out = out.rename(columns={"_group": "_node"})
            yield pd.concat([out, pd.DataFrame(rows, columns=TABLE)], axis=1)

    return run


def _descend(rule: Rule, keys: list[str]):
    """Entry state, starts before and size ahead of each member of a group."""
    def run(batches):
        for frame, edges in _groups(batches):
            whole = list(_steps(rule, frame))
            entered, before, ahead = (frame[c].to_numpy(float) for c in ("_state", "_before", "_ahead"))
            states, seen, rest = np.empty(len(frame)), np.empty(len(frame), np.int64), np.empty(len(frame))
            for a, b in zip(edges[:-1], edges[1:]):
                state = None if np.isnan(entered[a]) else float(entered[a])
                count, left = int(before[a]), float(ahead[a]) + sum(f.total for f in whole[a:b])
                for i in range(a, b):
                    states[i], seen[i] = np.nan if state is None else state, count
                    left -= whole[i].total
                    rest[i] = left
                    state, starts = whole[i](state)
                    count += starts
            out = frame[[*keys, "_node"]].copy()
            out["_state"], out["_before"], out["_ahead"] = states, seen, rest
            yield out

    return run


def _replay(rule: Rule, keys: list[str], seq: str):
    def run(batches):
        for frame, edges in _groups(batches):
            cost, ok = frame["_cost"].to_numpy(float), frame["_ok"].to_numpy(bool)
            states, before = frame["_state"].to_numpy(float), frame["_before"].to_numpy(float)
            ahead = frame["_ahead"].to_numpy(float)
            first, last, number = [], [], []
            for a, b in zip(edges[:-1], edges[1:]):
                block = Block(rule, cost[a:b], ok[a:b])
                state = None if np.isnan(states[a]) else float(states[a])
                seen = 0 if np.isnan(before[a]) else int(before[a])
                rest = 0.0 if np.isnan(ahead[a]) else float(ahead[a])
                starts = block.starts(state)
                if rule.merge_below:
                    # a start is dropped when all that follows it is too small
                    if starts and (seen or len(starts) > 1):
                        i = starts[-1]
                        tail = block.total - (block.upto[i] - block.cost[i]) + rest
                        if tail < rule.merge_below:
                            starts = starts[:-1]
                    if state is not None and seen > 1:
                        if state + block.total + rest < rule.merge_below:
                            seen -= 1
                opens = starts if starts and starts[0] == 0 else [0, *starts]
                base = seen if opens is starts else seen - 1
                first.extend(a + i for i in opens)
                last.extend(a + i - 1 for i in [*opens[1:], b - a])
                number.extend(base + k for k in range(len(opens)))
            out = frame.iloc[first][[*keys, "_block"]].reset_index(drop=True)
            out["first_seq"] = frame[seq].to_numpy()[first]
            out["last_seq"] = frame[seq].to_numpy()[last]
            out["window_id"] = number
            yield out

    return run


def _keep(rule: Rule, columns: list[str]):
    def run(batches):
        for frame, edges in _groups(batches):
            cost, ok = frame["_cost"].to_numpy(float), frame["_ok"].to_numpy(bool)
            states = frame["_state"].to_numpy(float)
            kept = []
            for a, b in zip(edges[:-1], edges[1:]):
                state = None if np.isnan(states[a]) else float(states[a])
                kept.extend(a + i for i in Block(rule, cost[a:b], ok[a:b]).starts(state))
            yield frame.iloc[kept][columns]

    return run


def _numbered(df: DataFrame, part: list[str], order: list[str]) -> DataFrame:
    # The window fixes distribution and order for the Python stage that follows:
    # each partition streams whole groups, sorted, and adaptive execution may not
    # split a group.
    return df.withColumn("_i", F.row_number().over(Window.partitionBy(*part).orderBy(*order)))


def _entered(
    slim: DataFrame, keys: list[str], order: list[str], rule: Rule, fanout: int = FANOUT
) -> DataFrame:
    """Rows with the entry state of their block, grouped and ordered for replay."""
    types = {f.name: f for f in slim.schema.fields}
    key_fields = [types[k] for k in keys] + [T.StructField("_block", T.LongType())]
    node_fields = [*key_fields[:-1], T.StructField("_node", T.LongType())]
    number = [T.StructField(n, T.DoubleType()) for n in ("_exit", "_total")]
    cells = [
        number[0], T.StructField("_starts", T.LongType()), number[1],
        T.StructField("_levels", T.ArrayType(T.DoubleType())),
        T.StructField("_exits", T.ArrayType(T.DoubleType())),
        T.StructField("_counts", T.ArrayType(T.LongType()))]
    carry_schema = T.StructType(
        [*node_fields, T.StructField("_state", T.DoubleType()),
         T.StructField("_before", T.LongType()), T.StructField("_ahead", T.DoubleType())]
    )
    # Read three times below: a narrow written copy spares three passes over the text.
    slim = stage(slim)
    long_keys = (
        slim.groupBy(*keys)
        .agg(F.min("_block").alias("_a"), F.max("_block").alias("_b"))
        .where("_a < _b")
    )
    span = long_keys.agg(F.max(F.col("_b") - F.col("_a"))).first()[0]
    if span is None:  # every source is one block, entered without an open group
        alone = slim.withColumns({
            "_state": F.lit(None).cast("double"), "_before": F.lit(0).cast("long"), "_ahead": F.lit(0.0)})
        return _numbered(alone, [*keys, "_block"], order)
    core = slim.join(long_keys.select(*keys), keys, "left_semi")
    tables = _numbered(core, [*keys, "_block"], order).mapInPandas(
        _tabulate(rule, keys), T.StructType([*key_fields, *cells])
    )
    # blocks are numbered from the first of their source, so that groups close up
    first = long_keys.select(*keys, "_a")
    levels = [stage(tables.join(first, keys).select(
        *keys, (F.col("_block") - F.col("_a")).alias("_node"), *TABLE))]
    group = F.floor(F.col("_node") / fanout).cast("long")
    while span >= fanout:
        grouped = _numbered(levels[-1].withColumn("_group", group), [*keys, "_group"], ["_node"])
        levels.append(stage(grouped.mapInPandas(_compose(rule, keys), T.StructType([*node_fields, *cells]))))
        span //= fanout
    carry = None
    for level in reversed(levels):
        entered = level.withColumn("_group", group)
        if carry is None:
            entered = entered.withColumns({
                "_state": F.lit(None).cast("double"), "_before": F.lit(0).cast("long"), "_ahead": F.lit(0.0)})
        else:
            entered = entered.join(carry.withColumnRenamed("_node", "_group"), [*keys, "_group"])
        carry = _numbered(entered, [*keys, "_group"], ["_node"]).mapInPandas(_descend(rule, keys), carry_schema)
    carry = carry.join(first, keys).select(
        *keys, (F.col("_node") + F.col("_a")).alias("_block"), "_state", "_before", "_ahead")
    joined = slim.join(carry, [*keys, "_block"], "left")
    return _numbered(joined, [*keys, "_block"], order)


def group_rows(
    df: DataFrame, keys: list[str], seq: str, cost, rule: Rule, ok=None,
    block_rows: int = BLOCK_ROWS, fanout: int = FANOUT,
) -> DataFrame:
    """Pack rows in ``seq`` order: ``(keys, _block, first_seq, last_seq, window_id)``.

    A window that crosses blocks has one piece per block. ``cost`` must be whole
    numbers of at least one.
    """
    slim = df.select(
        *keys, seq, F.floor(F.col(seq) / block_rows).cast("long").alias("_block"),
        cost.cast("double").alias("_cost"),
        (F.lit(True) if ok is None else F.coalesce(ok, F.lit(False))).alias("_ok"),
    )
    types = {f.name: f for f in slim.schema.fields}
    schema = T.StructType(
        [*[types[k] for k in keys], T.StructField("_block", T.LongType()),
         T.StructField("first_seq", types[seq].dataType),
         T.StructField("last_seq", types[seq].dataType),
         T.StructField("window_id", T.LongType())]
    )
    return _entered(slim, keys, [seq], rule, fanout).mapInPandas(_replay(rule, keys, seq), schema)


def assign_groups(
    df: DataFrame, pieces: DataFrame, keys: list[str], seq: str, block_rows: int = BLOCK_ROWS,
    how: str = "inner", more: tuple[str, ...] = (),
) -> DataFrame:
    """Add ``window_id``, and ``more`` columns of the pieces, to every row by its position in the pieces.

    With ``how`` left, rows of keys that were not packed get NULL.
    """
    left = df.withColumn("_block", F.floor(F.col(seq) / block_rows).cast("long"))
    condition = F.col(seq).between(F.col("first_seq"), F.col("last_seq"))
    for c in [*keys, "_block"]:
        condition = condition & (F.col(f"l.{c}") == F.col(f"r.{c}"))
    return (
        left.alias("l")
        .join(pieces.alias("r"), condition, how)
        .select(*[F.col(f"l.{c}") for c in df.columns], "window_id", *more)
    )


def keep_spaced(
    df: DataFrame, keys: list[str], t: str, order: list[str], gap: float,
    block_seconds: float = 3600.0, fanout: int = FANOUT,
) -> DataFrame:
    """Rows at least ``gap`` after the last kept row of their key, in ``order``."""
    slim = df.withColumn("_block", F.floor(F.col(t) / block_seconds).cast("long"))
    slim = slim.withColumn("_cost", F.col(t).cast("double")).withColumn("_ok", F.lit(True))
    return _entered(slim, keys, order, Rule("gap", gap), fanout).mapInPandas(
        _keep(Rule("gap", gap), df.columns), df.schema
    )
