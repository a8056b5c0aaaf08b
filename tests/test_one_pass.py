"""What is worked out or sent once: seen in the plan, with right rows."""

import time
from pathlib import Path

import pytest

from pyspark.sql import functions as F

from lectern.operators import pages, requests, screen, sections
from lectern.operators.stage import CLEANUP, shared_folder, stage, unstage
from lectern.plans import rounds
from workload import all_queries


@pytest.fixture()
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plan(df, kind="executedPlan"):
    return getattr(df._jdf.queryExecution(), kind)().toString()


def documents(spark, folder):
    rows = [(i, "\n".join(f"word{j} says something of line {j} in text {i}" for j in range(9))) for i in range(6)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_word_ratio_of_a_page_is_worked_out_once(spark):
    words = "okul kitap masa kalem " * 6
    rows = [(1, 1, words, "x", 90.0), (1, 2, "brt xkcd " * 20, "scanned text", 20.0), (1, 3, None, "scanned text", 70.0)]
    inputs = spark.createDataFrame(
        rows, "source_id long, number int, text_layer string, ocr_text string, ocr_conf double")
    out = pages.pages_to_segments(pages.gate_pages(inputs))
    assert plan(out, "optimizedPlan").count("regexp_extract_all") == 1
    assert [(r.seq, r.text) for r in out.orderBy("seq").collect()] == [(1, words.strip()), (3, "scanned text")]


def test_reads_of_frames_are_not_worked_out_again_where_they_are_tested(spark):
    words = [(1, f, turn, w, word, conf) for f, turn, conf in (
        (0, 0, 90), (1, 0, 20), (1, 180, 91), (2, 0, 20), (2, 90, 30), (3, 0, -1), (4, 90, 80), (5, None, 80))
        for w, word in enumerate(f"screen {f} at {turn}".split())]
    cells = spark.createDataFrame(
        words, "source_id long, frame_idx int, rotation int, widx int, word string, conf int")
    out = screen.quarantine_frames(screen.read_frames(cells), min_chars=5)
    optimized = plan(out, "optimizedPlan")
    assert optimized.count("array_distinct(") == 1 and optimized.count("sort_array(filter(") == 1
    assert sorted(map(tuple, out.select("frame_idx", "text", "conf", "rotation", "quarantined").collect())) == [
        (0, "screen 0 at 0", 90.0, 0, False), (1, "screen 1 at 180", 91.0, 180, False), (2, "", 30.0, 90, True)]


def test_boundary_requests_read_the_documents_once(spark, tmp_path):
    out = all_queries()[0]["m1_boundary_requests"](spark, documents(spark, tmp_path))
    assert not any("documents.parquet" in f for f in out.inputFiles())
    assert out.count() == 6


def test_sections_meet_their_drafts_in_one_shuffle_each(spark, no_broadcast):
    lines = spark.createDataFrame(
        [(1, 0.0, 1.0, 0, "b"), (1, 0.0, 0.5, 1, "a"), (2, 3.5, 4.0, 0, "c"), (3, 0.0, 0.0, 0, "no note")],
        "source_id long, sec_start double, start double, seq int, text string")
    points = lines.where("source_id = 1").withColumnRenamed("start", "ts")
    notes = spark.createDataFrame(
        [(1, 0.0, "s1"), (1, 0.0, "again"), (2, 3.5, None), (4, 0.0, "no lines"), (None, 0.0, "no source")],
        "source_id long, sec_start double, summary string")
    drafts = requests.section_drafts(notes, points)
    assert plan(drafts).count("Exchange hashpartitioning") == 1
    assert {(r.source_id, r.draft) for r in drafts.collect()} == {
        (1, "s1\n- [00:00] a\n- [00:01] b"), (1, "again\n- [00:00] a\n- [00:01] b"), (2, ""), (4, "no lines"),
        (None, "no source")}
    out = requests.critic_requests(lines, drafts)
    assert plan(out).count("Exchange hashpartitioning") == 2
    got = sorted((r.source_id, r.user) for r in out.collect())
    assert [g[0] for g in got] == [1, 1, 2]
    assert "[00:00] a\n[00:01] b" in got[0][1] and got[0][1].endswith("again\n- [00:00] a\n- [00:01] b")


def test_lines_are_ranked_without_their_texts(spark, no_broadcast):
    lines = spark.createDataFrame(
        [(1, 0, 0.0, "red apples"), (1, 1, 1.0, "green pears"), (1, 2, 2.0, "red cars"), (1, 2, 2.0, "red cars")],
        "source_id long, seq int, start double, text string")
    asked = spark.createDataFrame([(7, 1, "any cars?"), (8, 1, None)], "id long, source_id long, question string")
    out = requests.relevant_segments(asked, lines, 36)
    nodes = plan(out, "optimizedPlan").split("\n")
    depth = [len(x) - len(x.lstrip(" :+-")) for x in nodes]
    at = next(i for i, x in enumerate(nodes) if x.lstrip(" :+-").startswith("Window"))
    end = next((i for i in range(at + 1, len(nodes)) if depth[i] <= depth[at]), len(nodes))
    assert not any("AS line#" in x for x in nodes[at:end])
    assert sorted((r.id, r.seq, r.line) for r in out.collect()) == [
        (7, 2, "[00:02] red cars"), (7, 2, "[00:02] red cars"), (8, 0, "[00:00] red apples")]


def test_requests_are_scored_where_they_lie(spark):
    def echo(frames):
        for frame in frames:
            yield frame[["request_id"]].assign(body=frame["user"])

    asked = spark.range(5).select(
        F.col("id").cast("string").alias("request_id"), F.lit("").alias("system"), F.lit("u").alias("user"),
        F.lit(1).alias("max_tokens"))
    out = requests.score(asked, echo)
    assert "Exchange" not in plan(out)
    assert out.where("body = 'u' AND error IS NULL").count() == 5


def test_what_a_round_has_read_is_removed(spark):
    """Written copies go during the run, once they are read."""
    def scorer(frames):
        for frame in frames:
            yield frame[["request_id"]].assign(
                body='{"summary": "s", "points": [{"ts": "00:01", "text": "p"}], "missing": [{"ts": "00:02", "text": "m"}]}')

    folder = Path(shared_folder(spark).removeprefix("file:"))
    before = set(folder.glob("stage-*"))
    lines = stage(spark.createDataFrame(
        [(s, t, f"T{t}", t, int(t), "text") for s in range(3) for t in (0.0, 1.0)],
        "source_id long, sec_start double, sec_title string, start double, seq int, text string"))
    asked = rounds.section_round(lines)
    replies = stage(requests.score(asked, scorer))
    notes, points, criticised = rounds.critic_round(lines, asked, replies, spend=True)
    assert len(set(folder.glob("stage-*")) - before) == 2  # the answers and the critic's requests
    assert notes.count() == points.count() == criticised.count() == 6
    merged, _ = rounds.audited(points, criticised, stage(requests.score(criticised, scorer)))
    assert sorted((r.source_id, r.text, r.added) for r in merged.collect()) == sorted(
        (s, t, a) for s in range(3) for _ in range(2) for t, a in (("p", 0), ("m", 1)))
    unstage(criticised, lines, merged)
    assert len(set(folder.glob("stage-*")) - before) == 3


def test_shuffles_of_a_written_copy_are_removed(spark):
    env, new_id = spark.sparkContext._jvm.org.apache.spark.SparkEnv, spark.sparkContext._jsc.sc().newShuffleId
    before, first = spark.conf.get(CLEANUP, None), new_id()
    copy = stage(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    assert copy.count() == 7 and spark.conf.get(CLEANUP, None) == before
    mine = tuple(f"shuffle_{n}_" for n in range(first + 1, first + 2))
    files = env.get().blockManager().diskBlockManager()
    for _ in range(50):
        found = files.getAllFiles()
        left = [n for n in (found.apply(i).getName() for i in range(found.size())) if n.startswith(mine)]
        if not left:
            break
        time.sleep(0.2)
    assert not left and new_id() > first + 1


def test_split_sections_deal_their_texts_once(spark, no_broadcast):
    rows = [(1, t, float(t), float(t) + 1, "x" * 20 + str(t), "S", 0.0) for t in range(12)] + [
        (1, 12, 12.0, 13.0, "short", "T", 12.0), (2, 0, 0.0, 1.0, "y", "U", 0.0)]
    df = spark.createDataFrame(
        rows, "source_id long, seq int, start double, end double, text string, sec_title string, sec_start double")
    out = sections.split_oversized(df, 100, block_rows=4)
    nodes = plan(out).split("\n")
    depth = [len(x) - len(x.lstrip(" :+-")) for x in nodes]
    at = next(i for i, x in enumerate(nodes) if "Scan ExistingRDD" in x)
    above, level = [], depth[at]
    for i in range(at, -1, -1):
        if depth[i] < level:
            above, level = [*above, nodes[i]], depth[i]
    assert sum("Exchange hashpartitioning" in x for x in above) == 1
    got = {(r.source_id, r.seq): (r.part_no, r.sec_start, r.sec_title) for r in out.collect()}
    assert len(got) == 14 and got[1, 12] == (None, 12.0, "T") and got[2, 0] == (None, 0.0, "U")
    parts = [got[1, t] for t in range(12)]
    assert parts[0] == (0, 0.0, "S (1. kısım)") and parts == sorted(parts) and parts[-1][0] > 1
    assert all(start == min(t for t in range(12) if parts[t][0] == part) for part, start, _ in parts)
