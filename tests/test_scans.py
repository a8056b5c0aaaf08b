"""Block scans and interval joins against plain Python."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from lectern.functions.text import strip_word
from lectern.operators import intervals, quality, scan, screen


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    data = [(k, i, rng.randint(0, 50)) for k in range(4) for i in range(500 if k == 0 else 9)]
    return spark.createDataFrame(data, "k int, pos int, v int").repartition(6), data


@pytest.mark.parametrize("size", [3, 10_000])
def test_scans(spark, rows, size):
    df, data = rows
    cut = df.withColumn("_block", scan.block_of(F.col("pos"), size))
    out = scan.number_rows(cut, ["k"], ["pos"], "_block", "n")
    out = scan.running_sum(out, ["k"], ["pos"], "_block", "v", "total")
    out = scan.next_value(out, ["k"], ["pos"], "_block", {"v": "ahead"})
    out = scan.previous_value(out, ["k"], ["pos"], "_block", {"v": "behind"})
    got = {(r.k, r.pos): (r.n, r.total, r.ahead, r.behind) for r in out.collect()}
    for k in range(4):
        mine = [d[2] for d in data if d[0] == k]
        for i, v in enumerate(mine):
            want = (i, sum(mine[: i + 1]), mine[i + 1] if i + 1 < len(mine) else None,
                    mine[i - 1] if i else None)
            assert got[k, i] == want


@pytest.mark.parametrize("width", [1.0, 7.0, 1e6])
def test_intervals(spark, width):
    rng = random.Random(2)
    points = [(k, i, rng.random() * 100) for k in range(3) for i in range(60)]
    points += [(0, 100 + i, float(i)) for i in range(50)]
    spans = []
    for k in range(3):
        for _ in range(6):
            lo = float(rng.randint(0, 90))
            spans.append((k, lo, rng.choice([lo + 10, lo + 1, float("inf"), lo])))
    p = spark.createDataFrame(points, "k int, i int, t double")
    s = spark.createDataFrame(spans, "k int, lo double, hi double")
    flagged = intervals.flag_inside(p, s, ["k"], "t", "lo", "hi", "inside", width)
    got = {(r.k, r.i): r.inside for r in flagged.collect()}
    assert len(got) == len(points)
    for k, i, t in points:
        assert got[k, i] == any(a == k and lo <= t <= hi for a, lo, hi in spans)
    joined = intervals.point_in_interval(p, s, ["k"], "t", "lo", "hi", "inner", False, width)
    want = sorted((k, i, lo, hi) for k, i, t in points for a, lo, hi in spans if a == k and lo <= t < hi)
    assert sorted((r.k, r.i, r.lo, r.hi) for r in joined.collect()) == want


@pytest.mark.parametrize("block", [1.0, 9.0, 1e9])
def test_as_of_carry(spark, block):
    """Marks at one time, rows before any mark, without a time, of a key without marks; clashing names."""
    rng = random.Random(6)
    rows = [(k, i, rng.choice([None, float(rng.randint(0, 60))]), "v") for k in range(4) for i in range(80 if k == 0 else 15)]
    marks = [(k, float(rng.randint(5, 60)), rng.randint(0, 9)) for k in range(3) for _ in range(30 if k == 0 else 3)]
    r = spark.createDataFrame(rows, "k int, i int, t double, v string").repartition(5)
    m = spark.createDataFrame(marks, "k int, at double, v int").repartition(3)
    got = scan.running_max(r, m, ["k"], "t", "at", F.struct("at", "v"), "mark", block)
    assert got.columns == ["k", "i", "t", "v", "mark"]
    seen = {(x.k, x.i): (x.mark and (x.mark.at, x.mark.v)) for x in got.collect()}
    assert len(seen) == len(rows)
    for k, i, t, _ in rows:
        want = max(((at, v) for j, at, v in marks if j == k and t is not None and at <= t), default=None)
        assert seen[k, i] == want


@pytest.mark.parametrize("block", [2.0, 11.0, 1e9])
def test_coalesced(spark, block):
    rng = random.Random(8)
    spans = []
    for k in range(3):
        for _ in range(60 if k == 0 else 5):
            lo = float(rng.randint(0, 300))
            spans.append((k, lo, rng.choice([lo, lo + 1, lo + 3, lo + 40]) if rng.random() < 0.9 else lo + 2))
    spans += [(2, 290.0, float("inf")), (2, None, 3.0), (2, 3.0, None)]
    df = spark.createDataFrame(spans, "k int, lo double, hi double").repartition(4)
    want = []
    for k in range(3):
        for lo, hi in sorted((lo, hi) for j, lo, hi in spans if j == k and lo is not None and hi is not None):
            if want and want[-1][0] == k and lo <= want[-1][2]:
                want[-1] = (k, want[-1][1], max(hi, want[-1][2]))
            else:
                want.append((k, lo, hi))
    got = intervals.coalesced(df, ["k"], "lo", "hi", block)
    assert sorted(tuple(x) for x in got.collect()) == want


def test_hot_source_is_many_tasks(spark):
    """One source with a hundred thousand silences: blocks are spread, the plan has no explode and no loop join."""
    rows = spark.range(40_000).selectExpr("1 AS k", "id AS i", "id * 1.0D AS t")
    spans = spark.range(100_000).selectExpr("1 AS k", "id * 0.4D AS lo", "id * 0.4D + (id % 7) * 0.05D AS hi")
    flagged = intervals.flag_inside(rows, spans, ["k"], "t", "lo", "hi", "inside", 60.0)
    plan = flagged._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "NestedLoop" not in plan
    assert "hashpartitioning(k" in plan and "_block" in plan.split("hashpartitioning(k")[1][:40]
    where = flagged.where("inside").select("t").repartition(1).collect()
    covered = lambda t: any(0.4 * j <= t <= 0.4 * j + (j % 7) * 0.05 for j in range(max(0, int(t / 0.4) - 1), int(t / 0.4) + 2))
    assert {r.t for r in where} >= {float(t) for t in range(0, 40_000, 97) if covered(float(t) - 1e-7) and covered(float(t) + 1e-7)}


def test_cap_frames_matches_rule(spark):
    rng = random.Random(5)
    for total in (20, 21, 37, 81, 199, 400):
        silent = [rng.random() < 0.2 for _ in range(total)]
        df = spark.createDataFrame([("a", i, s) for i, s in enumerate(silent)], "source_id string, frame_idx int, in_silence boolean")
        got = sorted(r.frame_idx for r in screen.cap_frames(df, 20, block_rows=16).collect())
        if total <= 20:
            want = list(range(total))
        else:
            step, want = total / 20, []
            for i in range(20):
                span = range(int(i * step), min(total, int((i + 1) * step)))
                want.append(next((j for j in span if silent[j]), span[0]))
        assert got == sorted(want)


def test_quality_sketches(spark):
    """Sketches of parts, rolled up, give ranks within the stated error; NULLs and empty groups."""
    rng = random.Random(3)
    data = [("a" if i % 3 else "b", i % 40, rng.gauss(50, 12)) for i in range(30_000)] + [("c", 1, None)]
    rows = spark.createDataFrame(data, "k string, part int, conf double").repartition(8)
    parts = quality.measure_sketches(rows, ["k", "part"], ["conf"])
    plan = parts._jdf.queryExecution().executedPlan().toString()
    assert "partial_kll" in plan.lower()
    whole = quality.merged_sketches(parts, ["k"], ["conf"])
    got = quality.sketch_quantiles(whole, ["k"], ["conf"], [0.01, 0.5, 0.9]).collect()
    assert {r.k for r in got} == {"a", "b"} and len(got) == 6
    for r in got:
        mine = [c for k, _, c in data if k == r.k]
        assert r.n == len(mine)
        assert abs(sum(c <= r.value for c in mine) / len(mine) - r.share) < 3 * quality.RANK_ERROR
    low = {r.k: (r.n, r.share) for r in quality.share_below(whole, ["k"], "conf", 60.0).collect()}
    assert low["c"] == (0, None)
    mine = [c for k, _, c in data if k == "a"]
    assert abs(low["a"][1] - sum(c < 60 for c in mine) / len(mine)) < 3 * quality.RANK_ERROR


def test_screen_pieces_joined_are_the_screen_text(spark):
    rng = random.Random(6)
    rows = [("a" if i % 4 else "b", 0.0, i, i * 37.5, "w" * rng.randint(0, 60), i % 9 == 0) for i in range(400)]
    df = spark.createDataFrame(rows, "source_id string, sec_start double, frame_idx int, ts double, text string, quarantined boolean").repartition(4)
    keys = ["source_id", "sec_start"]
    whole = {r.source_id: r.screen for r in screen.screen_text(df, keys).collect()}
    pieces = screen.screen_pieces(df, keys, 300).orderBy("source_id", "piece").collect()
    assert max(len(r.screen) for r in pieces) < 300 + 80 and len(pieces) > 40
    for k, text in whole.items():
        assert "\n\n".join(r.screen for r in pieces if r.source_id == k) == text


def test_frames_are_read_where_they_lie(spark):
    """Words of sources that lie together are not shuffled again; odd frames read as by ocr_read and best_rotation."""
    rng = random.Random(5)
    words = [(s, f, r, w, rng.choice(["a", " b ", " ", "cd", None]), rng.choice([-1, None, 20, 59, 60, 61, 90]))
             for s in range(3) for f in range(40) for r in rng.sample([0, 90, 180, 270, None], rng.randint(1, 5))
             for w in range(rng.randint(1, 6)) for _ in range(rng.choice([1, 1, 2]))]
    cells = spark.createDataFrame(words, "source_id int, frame_idx int, rotation int, widx int, word string, conf int")
    want = screen.best_rotation(screen.ocr_read(cells))
    got = screen.read_frames(cells)
    assert got.columns == ["source_id", "frame_idx", "text", "conf", "rotation"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.select(*got.columns).collect()), key=str)
    packed = cells.groupBy("source_id").agg(F.collect_list(F.struct(*[c for c in cells.columns if c != "source_id"])).alias("w"))
    near = screen.read_frames(packed.repartition(5, "source_id").select("source_id", F.inline("w")))
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") <= 2
    assert sorted(map(tuple, near.collect()), key=str) == sorted(map(tuple, got.collect()), key=str)


def test_words_are_stripped_once_before_they_are_gathered(spark):
    """Reads of odd words, and nothing is worked out row by row inside the aggregate."""
    space = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2003\u2028\u202f\u205f\u3000"
    odd = [None, "", " ", space, "a", " a", "a ", "a b", "\x7f", "\x00", "é", "\u3000é\xa0", "é!", "!é ", "~", "\u200b", "İ\x85", "😀", "\x85x", space + "w" + space]
    rows = [(k, r, w, word, (k * 7 + w * 13 + r) % 120 - 20 if (k + w) % 9 else None)
            for k, word in enumerate(odd) for r in (0, 90) for w, word in enumerate([word, "z", word, None][: 1 + k % 4])]
    words = spark.createDataFrame(rows, "source_id int, rotation int, widx int, word string, conf int").withColumn("frame_idx", F.lit(3)).repartition(4)
    one = spark.createDataFrame([(w,) for w in odd], "w string").select("w", strip_word(F.col("w")).alias("s")).collect()
    assert [r.s for r in one] == [None if w is None else w.strip(space) for w in odd]
    reads = screen.ocr_read(words)
    for read in (reads, screen.read_frames(words)):
        plan = read._jdf.queryExecution().optimizedPlan().toString()
        assert "collect_list(_word" in plan and plan.count("trim(") == 1
    got = {(r.source_id, r.rotation): (r.text, r.conf) for r in reads.collect()}
    assert len(got) == 2 * len(odd)
    for (k, r), read in got.items():
        mine = [(w, word.strip(space), c) for s, t, w, word, c in rows if (s, t) == (k, r) and c is not None and c >= 0 and word is not None and word.strip(space)]
        assert read == (" ".join(w for _, w, _ in sorted(mine)), statistics.median(c for *_, c in mine) if mine else None)
