"""Packing against a plain loop: all block sizes, one huge source among small ones."""

import functools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import requests, sections
from lectern.operators.folds import Block, Rule, Steps, assign_groups, group_rows, keep_spaced


def plain(costs, oks, rule):
    out, window, size, empty = [], 0, 0, True
    for cost, ok in zip(costs, oks):
        if rule.mode == "before" and not empty and size + cost > rule.limit:
            window, size = window + 1, 0
        size, empty = size + cost, False
        out.append(window)
        if rule.mode == "after" and size >= rule.limit and (
            ok or (rule.hard is not None and size > rule.hard)
        ):
            window, size, empty = window + 1, 0, True
    if rule.merge_below and size and out and out[-1] > 0 and not empty and size < rule.merge_below:
        last = out[-1]
        out = [w - 1 if w == last else w for w in out]
    return out


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    data = []
    for source in range(12):
        # source 0 is hot: it holds more than a third of all rows
        for seq in range(3000 if source == 0 else rng.randint(1, 400)):
            data.append((source, seq, rng.choice([1, 3, 13, 40, 90, 400]), rng.random() < 0.3))
    df = spark.createDataFrame(data, "source_id int, seq int, cost int, ok boolean")
    return df.repartition(7), data


RULES = [
    Rule("after", 300, merge_below=100), Rule("after", 200, hard=300.0), Rule("after", 1000),
    Rule("before", 250), Rule("before", 50),
]


@pytest.mark.parametrize("rule", RULES, ids=str)
@pytest.mark.parametrize("block_rows,fanout", [(5, 3), (64, 64), (100_000, 64)])
def test_matches_loop(spark, rows, rule, block_rows, fanout):
    df, data = rows
    ok = F.col("ok") if rule.hard is not None else None
    pieces = group_rows(df, ["source_id"], "seq", F.col("cost"), rule, ok, block_rows, fanout)
    placed = assign_groups(df, pieces, ["source_id"], "seq", block_rows)
    got = {(r.source_id, r.seq): r.window_id for r in placed.collect()}
    assert len(got) == len(data)
    for source in {d[0] for d in data}:
        mine = [d for d in data if d[0] == source]
        oks = [d[3] if rule.hard is not None else True for d in mine]
        want = plain([d[2] for d in mine], oks, rule)
        assert [got[source, d[1]] for d in mine] == want


@pytest.mark.parametrize("block", [3.0, 50.0, 1e9])
def test_spaced_marks(spark, block):
    rng = random.Random(3)
    data = [(s, i, float(t)) for s in range(5)
            for i, t in enumerate(sorted(rng.randint(0, 2000) for _ in range(300 if s == 0 else 20)))]
    df = spark.createDataFrame(data, "source_id int, seq int, ts double")
    kept = keep_spaced(df.repartition(5), ["source_id"], "ts", ["ts", "seq"], 45.0, block, fanout=4)
    want = []
    for source in range(5):
        last = None
        for s, i, t in data:
            if s == source and (last is None or t - last >= 45):
                want.append((s, i))
                last = t
    assert sorted((r.source_id, r.seq) for r in kept.collect()) == sorted(want)


@pytest.mark.parametrize("rule", [*RULES, Rule("gap", 45.0)], ids=str)
def test_composed_steps_equal_steps_in_turn(rule):
    """Any bracketing of blocks is one function, for every entry state."""
    rng = random.Random(11)
    for _ in range(60):
        blocks, upto = [], 0.0
        for _ in range(rng.randint(2, 7)):
            n = rng.randint(1, 6)
            cost = [rng.choice([1, 3, 40, 90, 400]) for _ in range(n)]
            if rule.mode == "gap":
                cost = [upto := upto + rng.choice([0, 5, 30, 70]) for _ in range(n)]
            ok = [rule.hard is None or rng.random() < 0.4 for _ in range(n)]
            b = Block(rule, np.array(cost, float), np.array(ok))
            steps = b.steps()
            exits = [np.nan if s[1] is None else s[1] for s in steps]
            blocks.append(Steps(rule.mode == "gap", b.leave[0], b.total, np.array([s[0] for s in steps], float),
                                np.array(exits, float), np.array([s[2] for s in steps], np.int64)))
        cut = rng.randint(1, len(blocks) - 1)
        left = functools.reduce(Steps.then, blocks)
        parted = functools.reduce(Steps.then, blocks[:cut]).then(functools.reduce(Steps.then, blocks[cut:]))
        states = [None, *(float(rng.randint(1, 700)) for _ in range(25))]
        if rule.mode == "gap":
            states = [None, *(-float(rng.randint(0, 200)) for _ in range(25))]
        for state in states:
            want, seen = state, 0
            for f in blocks:
                want, more = f(want)
                seen += more
            assert left(state) == parted(state) == (want, seen)


def test_one_source_with_all_rows(spark):
    """Three rounds of composition: no unit of work reads more than the fanout of tables."""
    df = spark.range(20_000).selectExpr("1 AS source_id", "id AS seq", "CAST(1 + id * 7919 % 97 AS INT) AS cost")
    rule = Rule("after", 500, merge_below=200)
    pieces = group_rows(df, ["source_id"], "seq", F.col("cost"), rule, block_rows=16, fanout=8)
    placed = assign_groups(df, pieces, ["source_id"], "seq", 16).orderBy("seq").collect()
    assert [r.window_id for r in placed] == plain([1 + i * 7919 % 97 for i in range(20_000)], [True] * 20_000, rule)


def segs(spark, texts):
    data = [("a", i, 10.0 * i, 10.0 * i + 9, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(data, "source_id string, seq int, start double, end double, text string")


def test_split_titles_and_whole_sections(spark):
    rows = segs(spark, ["x" * 50] * 6).withColumn("sec_start", F.lit(0.0)).withColumn("sec_title", F.lit("T"))
    got = sections.split_oversized(rows, 130, block_rows=2).orderBy("seq").collect()
    assert [r.sec_title for r in got] == [f"T ({k}. kısım)" for k in (1, 1, 2, 2, 3, 3)]
    whole = sections.split_oversized(rows, 10_000).collect()
    assert {r.sec_title for r in whole} == {"T"} and all(r.part_no is None for r in whole)


def test_parts_have_keys_of_their_own(spark):
    """Parts that begin with their section, together, just before the next section, and at large times."""
    starts = [0.0] * 6 + [0.5] * 3 + [1.0000001] * 6 + [1.0000002] * 3 + [4e9] * 8
    rows = [("a", i, t, t + 1, "x" * 50, 0.0 if t < 1 else 1.0000001 if t < 1.0000002 else 1.0000002 if t < 2 else 4e9, "T")
            for i, t in enumerate(starts)]
    df = spark.createDataFrame(rows, "source_id string, seq int, start double, end double, text string, sec_start double, sec_title string")
    split = sections.split_oversized(df, 130, block_rows=4)
    table = sections.section_table(split)
    got = {r.seq: r for r in split.collect()}
    parts = {}
    for i, t in enumerate(starts):
        parts.setdefault((rows[i][5], got[i].part_no), set()).add(got[i].sec_start)
    assert all(len(v) == 1 for v in parts.values())
    keys = sorted((s, 0 if p is None else p) for s, p in parts)
    own = [next(iter(parts[k] if k in parts else parts[(k[0], None)])) for k in keys]
    assert own == sorted(own) and len(set(own)) == len(own) == table.count() == 3 + 2 + 3 + 2 + 4
    assert {got[0].sec_start, got[9].sec_start} == {0.0, 1.0000001}


def test_single_batch_when_joined_text_fits(spark):
    blocks = spark.createDataFrame([("a", i, "b" * 9) for i in range(3)], "source_id string, seq int, block string")
    # three blocks of nine and two separators are 31 characters
    assert {r.batch for r in requests.pack_blocks(blocks, 31).collect()} == {0}
    assert {r.batch for r in requests.pack_blocks(blocks, 30).collect()} == {0, 1}
