"""Readers, writers, streams and the foreign scorer on small files."""

import json
import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.operators import library, parts, quality, requests
from lectern.plans import notes
from lectern.sources import captions, documents, inputs, jobs, silence, sinks, speech, textfiles
from lectern.streaming import captions as caption_stream
from lectern.streaming import jobs as job_stream
from lectern.streaming.presence import all_sessions, closed_sessions, presence_sessions
from lectern.streaming.run import ChangedRows, run_available

SEG = "source_id string, seq int, start double, end double, text string"


def files(root, suffix=""):
    return sorted(p for p in root.rglob(f"part-*{suffix}") if p.is_file())


@pytest.fixture
def segments(spark):
    rows = [("a", 0, 0.0, 1.5, "One. "), ("a", 1, 2.0, 1.0, "two"), ("a", 2, 3.0, 4.0, " "), ("b", 0, 3661.5, 3662.0, "üç\xa0 x")]
    return spark.createDataFrame(rows, SEG)


def test_announced_captions_are_opened_by_name(spark, segments, tmp_path):
    """The rows of a listed folder, from files that are named: one that is not announced is not seen."""
    folder, announced = tmp_path / "subs", str(tmp_path / "announced")
    named = captions.write_captions(segments, str(folder)).select("path")
    deep = folder / "source_id=deep"
    deep.mkdir()
    (deep / "x.subs.json3").write_text(json.dumps({"events": [{"tStartMs": 1, "segs": [{"utf8": "şimdi"}]}]}))
    (folder / "skipped.txt").write_text("{}")
    listed = run_available(caption_stream.stream_captions(spark, str(folder)))
    want = sorted(map(tuple, listed.collect()))
    more = spark.createDataFrame([("source_id=deep/x.subs.json3",), ("skipped.txt",)], "path string")
    named.unionByName(more).write.parquet(announced)
    (folder / "late.subs.json3").write_text(json.dumps({"events": [{"tStartMs": 1, "segs": [{"utf8": "late"}]}]}))
    got = run_available(caption_stream.stream_captions(spark, str(folder), announced=announced))
    assert got.dtypes == listed.dtypes
    assert sorted(map(tuple, got.collect())) == want and ("deep", "şimdi") in {(r[0], r[4]) for r in want}


def test_captions_round_trip(spark, segments, tmp_path):
    sidecars = tmp_path / "in"
    done = captions.write_captions(segments, str(sidecars))
    assert {tuple(r) for r in done.collect()} == {("a.subs.json3", 4), ("b.subs.json3", 3)}
    assert json.loads((sidecars / "a.subs.json3").read_text())["events"] == [
        {"tStartMs": 0, "dDurationMs": 1500, "segs": [{"utf8": "One."}]},
        {"tStartMs": 2000, "dDurationMs": 0, "segs": [{"utf8": "two"}]},
    ]
    want = [("a", 0.0, 1.5, "One."), ("a", 2.0, 2.0, "two"), ("b", 3661.5, 3662.0, "üç x")]
    read = captions.read_captions(spark, str(sidecars))
    live = run_available(caption_stream.stream_captions(spark, str(sidecars)))
    for out in (read, live):
        assert sorted((r.source_id, r.start, r.end, r.text) for r in out.collect()) == want


def test_caption_batches_are_not_counted_in_files(spark, tmp_path):
    """Many small files are few micro-batches, as their bytes say; each file is read once."""
    for k in range(1100):
        (tmp_path / f"s{k}.subs.json3").write_text(json.dumps({"events": [{"tStartMs": k, "segs": [{"utf8": f"t{k}"}]}]}))
    for limit, batches in (({}, 1), ({"max_files": 600}, 2)):
        report = {}
        got = run_available(caption_stream.stream_captions(spark, str(tmp_path), **limit), report=report)
        assert {(r.source_id, r.text) for r in got.collect()} == {(f"s{k}", f"t{k}") for k in range(1100)}
        assert got.count() == 1100 and report["batches"] == batches


def test_rolling_repeats_and_empty_files(spark):
    body = {"events": [
        {"tStartMs": 5, "segs": [{"utf8": "a"}, {"utf8": " b\n"}]}, {"segs": [{"utf8": "zero"}]},
        {"tStartMs": 5, "aAppend": 1, "segs": [{"utf8": "a b"}]}, {"tStartMs": 9}, {"segs": []},
        {"segs": [{"utf8": "\n"}]}, {"aAppend": 0, "tStartMs": 1000, "dDurationMs": 500, "segs": [{"x": 1}, {"utf8": "c"}]},
    ]}
    df = spark.createDataFrame([("a", json.dumps(body)), ("b", "{}"), ("c", "nonsense")], "source_id string, body string")
    got = captions.parse_captions(df)
    assert [(r.start, r.end, r.text) for r in got.orderBy("seq").collect()] == [(0.005, 0.005, "a b"), (0.0, 0.0, "zero"), (1.0, 1.5, "c")]
    assert sorted(r.source_id for r in captions.caption_errors(df, got).collect()) == ["b", "c"]


def test_long_documents_come_in_pieces(spark):
    """Starts need not rise with seq: the pieces joined are the document sorted by start."""
    rows = [("a", i, float((i * 7) % 10), i + 20.0, f"t{i}") for i in range(10)] + [("b", 0, 0.0, 1.0, "only")]
    made = captions.caption_json(spark.createDataFrame(rows, SEG), events=4).orderBy("source_id", "piece").collect()
    assert [(r.source_id, r.piece) for r in made] == [("a", 0), ("a", 1), ("a", 2), ("b", 0)]
    events = json.loads("".join(r.body for r in made if r.source_id == "a"))["events"]
    assert [e["segs"][0]["utf8"] for e in events] == [f"t{i}" for i in sorted(range(10), key=lambda i: (i * 7) % 10)]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_lines_of_a_long_log_are_numbered_over_its_splits(spark, tmp_path, end):
    """One file in many tasks; empty lines, no last line break, another small file beside it."""
    lines = [f"line {i} " + "x" * (i % 91) if i % 13 else "" for i in range(20_000)] + ["last"]
    (tmp_path / "big.log").write_bytes(end.join(lines).encode())
    (tmp_path / "small.txt").write_bytes(f"one{end}{end}three{end}".encode())
    size = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(size)
    spark.conf.set(size, "40000")
    try:
        tasks = spark.read.text(str(tmp_path)).rdd.getNumPartitions()
        got = inputs.read_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set(size, before)
    assert tasks > 8
    assert [r.line for r in sorted((r for r in got if r.source_id == "big"), key=lambda r: r.line_no)] == lines
    assert sorted((r.line_no, r.line) for r in got if r.source_id == "small") == [(0, "one"), (1, ""), (2, "three")]
    assert sorted(r.line_no for r in got if r.source_id == "big") == list(range(len(lines)))


def test_transcripts(spark, segments, tmp_path):
    sinks.write_transcripts(segments, str(tmp_path), segments.withColumn("text", F.upper("text")))
    def text(kind):
        return "".join(p.read_text() for p in files(tmp_path / kind / "source_id=a", "txt"))
    assert text("raw") == "[00:00] One. \n[00:02] two\n[00:03]  \n"
    assert text("transcript").startswith("[00:00] ONE.")


def tree(root):
    return {str(p.relative_to(root)): p.read_bytes().decode() for p in root.rglob("*") if p.is_file() and not p.name.startswith(".")}


def test_library_export(spark, tmp_path):
    """Files equal their notes, whichever tasks wrote them; a second export replaces them."""
    many = [("1", i, f"line {i} ç") for i in range(3000)]
    layout = spark.createDataFrame(
        [("1", "x", "x/a (b).md"), ("2", "y ü", "y ü/b.md"), ("3", "x", "x/none.md")], "id string, folder string, path string")
    lines = spark.createDataFrame([*many, ("2", 2, "b\rc"), ("2", 1, ""), ("9", 1, "lost"), ("2", 3, None)],
                                  "id string, ord int, line string").repartition(9)
    for _ in range(2):
        done = sinks.write_library(layout, lines, str(tmp_path / "lib"))
        assert {tuple(r) for r in done.collect()} == {("x/a (b).md", 3000), ("y ü/b.md", 3)}
        assert tree(tmp_path / "lib") == {
            "x/a (b).md": "".join(f"{line}\n" for _, _, line in many), "y ü/b.md": "\nb\rc\n\n"}
    assert sinks.write_library(layout.where("false"), lines, str(tmp_path / "none")).count() == 0


def test_digests_of_written_files(spark, tmp_path):
    """Files are opened by their names, in tasks: any name, and none that was not written now."""
    import hashlib

    notes = {"_x/.a.md": ["one", "two"], "x y/b%20+ç.md": [""], "c.md": ["z" * 3_000_000, "end"]}
    (tmp_path / "lib").mkdir()
    (tmp_path / "lib" / "old.md").write_text("of an earlier export")
    rows = spark.createDataFrame([(p, i, line) for p, lines in notes.items() for i, line in enumerate(lines)],
                                 "path string, ord int, line string").repartition(5)
    done = textfiles.write_text_files(rows, str(tmp_path / "lib"))
    got = textfiles.file_digests(done, str(tmp_path / "lib"))
    assert {tuple(r) for r in got.collect()} == {
        (p, len(lines), hashlib.sha256("".join(f"{x}\n" for x in lines).encode()).hexdigest()) for p, lines in notes.items()}


def test_parts_of_lost_tasks_are_not_published(spark, tmp_path):
    """What a failed attempt has left is neither listed nor moved; an aborted write leaves nothing."""
    spark.dataSource.register(textfiles.TextParts)
    staging = tmp_path / "s"
    for name in ("parts/dead", "manifests", "committed", "joined"):
        (staging / name).mkdir(parents=True)
    (staging / "parts/dead/0").write_text("half")
    (staging / "manifests/dead.json").write_text(json.dumps(
        {"path": "a.md", "place": 0, "part": "parts/dead/0", "task": "dead", "lines": 1}) + "\n")
    rows = spark.range(2000, numPartitions=4).selectExpr("'a.md' AS path", "id AS ord", "CAST(id AS STRING) AS line")
    spread = rows.repartitionByRange(4, "path", "ord").sortWithinPartitions("path", "ord").select("path", "line")
    spread.write.format("text_parts").option("path", str(staging)).mode("append").save()
    [row] = textfiles.committed_parts(spark, str(staging)).collect()
    assert row["lines"] == 2000 and len(row["parts"]) > 1 and "parts/dead/0" not in row["parts"]
    assert "".join((staging / p).read_text() for p in row["parts"]) == "".join(f"{i}\n" for i in range(2000))
    bad = rows.withColumn("line", F.when(F.col("ord") > 1500, F.raise_error(F.lit("lost"))).otherwise(F.col("line")))
    with pytest.raises(Exception, match="lost"):
        bad.write.format("text_parts").option("path", str(staging)).mode("append").save()
    assert not staging.exists()


def test_publishing_twice_gives_the_same_files(spark, tmp_path):
    """A publishing task that runs again finds its files in place."""
    staging, target = tmp_path / "s", tmp_path / "t"
    (staging / "joined").mkdir(parents=True)
    for k, text in enumerate(("a\n", "b\n", "c\n")):
        (staging / str(k)).write_text(text)
    frame = pd.DataFrame({"path": ["f/one.md", "f/two.md"], "parts": [["0"], ["1", "2"]], "lines": [1, 2]})
    run = textfiles._publisher(str(target), str(staging))
    for _ in range(2):
        assert len(list(run(iter([frame])))) == 1
        assert tree(target) == {"f/one.md": "a\n", "f/two.md": "b\nc\n"}


def test_no_two_jobs_share_a_path(spark):
    rows = [("abcdef22", "t", 3), ("abcdef33", "t", 2), ("abcdef44", "t", 1), ("x", "t (abcdef33)", 9), ("y", "only", 1),
            ("zzzzzz1", "only", 2), ("p", "q", 1), ("r", "q", 0), ("open", "t", 8)]
    jobs_ = spark.createDataFrame([(i, t, c, "open" if i == "open" else "done", "c") for i, t, c in rows],
                                  "id string, title string, created_at int, status string, collection string")
    got = {r["id"]: r["path"] for r in library.export_layout(jobs_, jobs_.select("id")).collect()}
    assert got["abcdef22"] == "c/t.md" and got["abcdef44"] == "c/t (abcdef44).md"
    assert got["x"] == "c/t (abcdef33).md" and got["abcdef33"].startswith("c/t (abcdef33 ")
    assert got["zzzzzz1"] == "c/only.md" and got["y"] == "c/only (y).md" and got["r"] == "c/q (r).md"
    assert len(set(got.values())) == len(got) == len(rows) - 1


def test_markdown_blocks(spark, tmp_path):
    docs = {
        "one": "\n\n# A\ntext\n## B\r\n### C\n##\n#tag\n# D\n", "two": "x" * 3001, "three": "  \n", "four": "plain\n# only\n",
        "five": "y" * 2500 + " " * 2500 + "z",
    }
    for name, body in docs.items():
        (tmp_path / f"{name}.md").write_bytes(body.encode())
    got = documents.read_documents(spark, str(tmp_path)).orderBy("source_id", "number").collect()
    blocks = {n: [(r.number, r.text) for r in got if r.source_id == n] for n in docs}
    assert blocks["one"] == [(1, "# A\ntext"), (2, "## B\n### C\n##\n#tag"), (3, "# D")]
    assert [len(t) for _, t in blocks["two"]] == [2500, 501]
    assert blocks["three"] == [] and blocks["four"] == [(1, "plain"), (2, "# only")]
    assert [n for n, _ in blocks["five"]] == [1, 3]


def test_chunked_equals_whole(spark):
    """Five chunks give the same times as one."""
    def payload(items):
        return json.dumps({"segments": [{"start": s, "end": s + 1, "text": f" t{s + b} "} for b, s in items]})
    whole = [("a", 0, payload([(0, float(t)) for t in range(0, 50, 5)]))]
    parts_ = [("a", c, payload([(c * 10, float(t - c * 10)) for t in range(c * 10, c * 10 + 10, 5)])) for c in range(5)]
    kind = "source_id string, chunk_idx long, body string"
    results = []
    for rows in (whole, parts_):
        df = spark.createDataFrame(rows, kind)
        offsets = df.select("source_id", "chunk_idx", (F.col("chunk_idx") * 10.0).alias("offset"))
        results.append(sorted((r.start, r.end) for r in speech.asr_segments(df, offsets).collect()))
    assert results[0] == results[1]


def test_evolving_schema(spark, tmp_path):
    spark.createDataFrame([("1",)], "id string").write.parquet(str(tmp_path / "t" / "v=1"))
    spark.createDataFrame([("2", "p")], "id string, provider string").write.parquet(str(tmp_path / "t" / "v=2"))
    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "provider", "referer")])
    got = jobs.read_evolving(spark, str(tmp_path / "t"), schema).orderBy("id").collect()
    assert [tuple(r) for r in got] == [("1", None, None), ("2", "p", None)]


def test_scorer_failures_become_rows(spark):
    def flaky(batches):
        for frame in batches:
            if (frame["user"] == "bad").any():
                raise ValueError("no")
            keep = frame[frame["user"] != "silent"]
            yield pd.DataFrame({"request_id": keep["request_id"], "body": keep["user"].str.upper()})
    asked = spark.createDataFrame([(1, "s", "ok", 9), (2, "s", "bad", 9), (3, "s", "silent", 9)], "request_id int, system string, user string, max_tokens int")
    got = {r.request_id: (r.body, r.error) for r in requests.score(asked, flaky, 1, attempts=2).collect()}
    assert got == {1: ("OK", None), 2: (None, "no"), 3: (None, "no response")}


def test_repair_guard(spark):
    original = spark.createDataFrame([("a", w, i, float(i), i + 1.0, "one two three four five") for w in range(3) for i in range(2)], "source_id string, window_id long, seq int, start double, end double, text string")
    repaired = spark.createDataFrame([("a", 0, 0, 0.5, 0.0, "One two three four five six.", ), ("a", 1, 0, 0.0, 0.0, "short")], "source_id string, window_id long, seq int, start double, end double, text string")
    got = quality.accept_repairs(original, repaired).collect()
    assert {(r.window_id, r.origin) for r in got} == {(0, "repaired"), (1, "original"), (2, "original")}
    assert [r.end for r in got if r.window_id == 0] == [2.0]


def test_explicit_null_patch(spark):
    base = spark.createDataFrame([("1", "error", "boom", 0)], "id string, status string, error string, updated_at int")
    patch = spark.createDataFrame([("1", 1, 5, {"status": "queued", "error": None}), ("1", 2, 6, {"status": "running"})], "id string, seq int, at int, fields map<string,string>")
    assert [tuple(r) for r in library.apply_patches(base, patch).collect()] == [("1", "running", None, 6)]


def test_rounding_half_even(spark):
    df = spark.createDataFrame([("a", 2.5 * 1800), ("b", 1.5 * 1800), ("c", 1.4 * 1800)], "source_id string, duration double")
    got = {r.source_id: r.parts for r in parts.plan_time_parts(df).collect()}
    assert got == {"a": 2, "b": 2}


def test_note_lines_have_a_total_order(spark):
    lines = spark.createDataFrame([("a", "x")], "source_id string, title string")
    empty = lines.where("false")
    srcs = lines.select("source_id", "title", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("uploader"), F.lit(61.0).alias("duration"))
    secs = lines.select("source_id", F.lit(0.0).alias("sec_start"), F.lit(0.0).alias("start"), "title", F.lit("s").alias("summary"))
    pts = empty.select("source_id", F.lit(0.0).alias("sec_start"), F.lit(0.0).alias("ts"), F.lit(0).alias("seq"), F.lit(0).alias("added"), F.col("title").alias("text"))
    tldr = lines.select("source_id", F.lit(0).alias("pos"), F.lit("b").alias("bullet"))
    gloss = empty.select("source_id", F.lit(0).alias("pos"), F.lit("").alias("term"), F.lit("").alias("definition"))
    learn = empty.select("source_id", F.array().cast("array<string>").alias("steps"), F.array().cast("array<string>").alias("actions"), F.array().cast("array<struct<soru:string,cevap:string>>").alias("quiz"), F.lit("").alias("deepen_prompt"))
    out = notes.render_timed(srcs, secs, pts, tldr, gloss, learn).orderBy("ord").collect()
    assert [r.line for r in out] == [
        "# x", "", "Süre: 01:01", "", "## TL;DR", "", "- b", "", "## Detaylı Özet", "", "### `00:00` x", "", "s", "", "",
        "---", "", "<sub>Otomatik üretildi · 1 bölüm · eleştirmen geçişi 0 eksik madde ekledi</sub>", "",
    ]


def test_stuck_stream_agrees_with_batch(spark, tmp_path):
    rows = [(1, "queued", "2024-01-01 00:00:00"), (2, "running", "2024-01-01 00:00:30"), (2, "done", "2024-01-01 00:00:50"),
            (3, "running", "2024-01-01 00:01:30"), (4, "done", "2024-01-01 00:02:00")]
    df = spark.createDataFrame(rows, "job int, stage string, t string").select("job", "stage", F.col("t").cast("timestamp").alias("ts"))
    df.repartition(3).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "e"))
    live = run_available(job_stream.stuck_jobs(stream, "0 seconds", 60))
    batch = job_stream.stuck_at(job_stream.last_stages(df), F.lit("2024-01-01 00:02:00").cast("timestamp"), 60)
    assert sorted(r.job for r in live.collect()) == sorted(r.job for r in batch.collect()) == [1]


def test_logs_from_files(spark, tmp_path):
    logs, lists = tmp_path / "logs", tmp_path / "lists"
    logs.mkdir(), lists.mkdir()
    (logs / "a.log").write_text(
        "x\n[s] silence_end: 1\n[s] silence_start: -0.5\nnoise\n[s] silence_end: 2.5 | silence_duration: 3\n"
        "silence_start: 4\nsilence_start: 5\nsilence_end: 6\nsilence_start: 9\n"
    )
    got = silence.silence_windows(inputs.read_lines(spark, str(logs)), block_rows=2).orderBy("start").collect()
    assert [(r.start, r.end) for r in got] == [(0.0, 2.5), (5.0, 6.0), (9.0, float("inf"))]
    (lists / "a.csv").write_text("c0,0.0,600.1\nc1,600.1,1200\n\n")
    (lists / "b.csv").write_text("c0,0.0,600.1\nc1,oops,1200\n")
    chunks = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0), ("b", 1), ("c", 0)], "source_id string, chunk_idx long")
    out = speech.chunk_offsets(inputs.read_lines(spark, str(lists)), chunks)
    assert sorted(tuple(r) for r in out.collect()) == [("a", 0, 0.0), ("a", 1, 600.1), ("b", 0, 0.0), ("b", 1, 600.0), ("c", 0, 0.0)]


def test_quarantine_never_reaches_a_request(spark):
    from lectern.operators import screen

    words = [("a", f, rot, i, w, c) for f, rot, c in ((0, 0, 90), (1, 0, 20), (1, 180, 91), (2, 0, 20), (2, 90, 30), (3, 0, -1))
             for i, w in enumerate(f"frame number{f} turned{rot} words".split())]
    df = spark.createDataFrame(words, "source_id string, frame_idx int, rotation int, widx int, word string, conf int")
    frames = screen.quarantine_frames(screen.read_frames(df)).withColumn("ts", F.col("frame_idx") * 10.0)
    got = {r.frame_idx: (r.rotation, r.quarantined, r.text) for r in frames.collect()}
    assert got == {0: (0, False, "frame number0 turned0 words"), 1: (180, False, "frame number1 turned180 words"), 2: (90, True, "")}
    shown = screen.screen_text(frames, ["source_id"]).collect()[0].screen
    assert shown == "[00:00 ekran]\nframe number0 turned0 words\n\n[00:10 ekran]\nframe number1 turned180 words"


def test_glossary_keeps_the_last_definition(spark):
    from lectern.operators import ledger

    terms = spark.createDataFrame([("a", 0, "İşlem", "1"), ("a", 1, "Cam", "2"), ("a", 2, "işlem", "3")], "source_id string, pos int, term string, definition string")
    synth = spark.createDataFrame([("a", 0, "CAM", "4"), ("a", 1, "Çam", "5")], "source_id string, pos int, term string, definition string")
    got = ledger.merge_glossary(terms, synth).orderBy("sort_key").collect()
    assert [(r.term, r.definition) for r in got] == [("CAM", "4"), ("Çam", "5"), ("işlem", "3")]


def sessions_of(times, gap):
    out = []
    for t in sorted(times):
        if out and t - out[-1][1] <= gap:
            out[-1] = (out[-1][0], t, out[-1][2] + 1)
        else:
            out.append((t, t, 1))
    return out


def test_presence_of_a_hot_agent(spark, monkeypatch):
    """Most pings from one agent, times before the epoch, gaps of just the limit, equal times, no time."""
    from lectern.operators import scan

    monkeypatch.setattr(scan.block_of, "__defaults__", (7,))
    rng = random.Random(2)
    pings = [(1, -5000)] + [(1, t) for _ in range(900) for t in [rng.randint(-4000, 30_000)]]
    pings += [(2, 0), (2, 90), (2, 180), (2, 271), (3, 5), (3, 5), (4, None)]
    df = spark.createDataFrame(pings, "agent int, s long").selectExpr("agent", "timestamp_seconds(s) AS ts").repartition(5)
    got = presence_sessions(df, 90).selectExpr(
        "agent", "unix_seconds(online_from)", "unix_seconds(last_ping)", "pings").collect()
    want = [(a, *s) for a in (1, 2, 3) for s in sessions_of([t for b, t in pings if b == a], 90)]
    assert sorted(tuple(r) for r in got) == want


def test_closed_sessions_and_late_pings(spark, tmp_path):
    """A session is given out once it cannot grow; pings behind the watermark are counted, not lost from sight."""
    feed = [[("a", 0), ("a", 50), ("b", 10)], [("a", 5000)], [("a", 5010)], [("a", 60), ("b", 20), ("c", 4000)], [("a", 9000)], [("a", 9100)]]
    schema = "agent string, s long"
    for k, rows in enumerate(feed):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "feed" / f"k={k}"))
        os.utime(next((tmp_path / "feed" / f"k={k}").glob("part-*")), (1e9 + k * 100, 1e9 + k * 100))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(
        str(tmp_path / "feed")).selectExpr("agent", "timestamp_seconds(s) AS ts")
    report = {}
    got = run_available(closed_sessions(stream, "100 seconds", 90), report=report)
    rows = sorted(tuple(r) for r in got.selectExpr("agent", "unix_seconds(online_from)", "unix_seconds(last_ping)", "pings").collect())
    assert rows == [("a", 0, 50, 2), ("a", 5000, 5010, 2), ("b", 10, 10, 1)] and report["late"] == 3


def test_sessions_open_at_the_end_of_a_feed(spark, tmp_path):
    """All sessions of a feed, those that no later ping closes too; somebody without a name is not the end mark."""
    feed = [[("a", 0), ("a", 50), ("b", 10)], [("a", 5000), (None, 5001)], [("a", 5010)], [("c", 5100), ("c", 5190)]]
    schema = "agent string, s long"
    for k, rows in enumerate(feed):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "feed" / f"k={k}"))
        os.utime(next((tmp_path / "feed" / f"k={k}").glob("part-*")), (1e9 + k * 100, 1e9 + k * 100))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(
        str(tmp_path / "feed")).selectExpr("agent", "timestamp_seconds(s) AS ts")
    report = {}
    got = all_sessions(stream, "100 seconds", 90, report)
    rows = [tuple(r) for r in got.selectExpr("agent", "unix_seconds(online_from)", "unix_seconds(last_ping)", "pings").collect()]
    assert sorted(rows, key=str) == [
        ("a", 0, 50, 2), ("a", 5000, 5010, 2), ("b", 10, 10, 1), ("c", 5100, 5190, 2), (None, 5001, 5001, 1)]
    assert report["late"] == 0 and report["batches"] > len(feed)


def test_folders_of_changed_rows_stay_few(spark, tmp_path):
    """Many batches, repeated ones, and one that was merged before it was repeated."""
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("v", T.IntegerType())])
    table, want = ChangedRows(spark, str(tmp_path / "t"), schema, ["id"], every=4), {}
    for number in range(13):
        rows = [(i, number) for i in range(number % 3, 9, 3)]
        want.update(rows)
        for _ in range(2 if number in (2, 3, 8) else 1):
            table.add(spark.createDataFrame(rows, schema).coalesce(1), number)
        assert {r.id: r.v for r in table.rows().collect()} == want
        assert len([p for p in (tmp_path / "t").iterdir() if p.is_dir()]) <= 5


def test_retrieved_questions(spark):
    """Rare shared words first, whole source where it fits, what is left out is counted; no match, no source."""
    rows = [("a", i, i * 10.0, i * 10.0 + 9, f"the {'zebra crossing' if i in (3, 7) else 'usual talk'} number {i}") for i in range(12)]
    segs_ = spark.createDataFrame(rows, SEG)
    asked = spark.createDataFrame(
        [(1, "a", "T", "Where is the ZEBRA?", None), (2, "a", "T", "Nothing of that", "K: q\n"), (3, "none", None, "zebra", None)],
        "id int, source_id string, title string, question string, history string")
    got = {r.id: r for r in requests.retrieved_question_requests(asked, segs_, 75).collect()}
    assert "[00:30] the zebra crossing number 3\n[01:10] the zebra crossing number 7\n\nSORU" in got[1].user and got[1].left_out == 10
    assert "number 0" in got[2].user and "K: q" in got[2].user and got[3].left_out == 0
    whole = requests.retrieved_question_requests(asked, segs_, 10_000).where("id = 1").first()
    assert whole.left_out == 0 and all(t in whole.user for *_, t in rows)
