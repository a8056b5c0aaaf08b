"""The pipeline against a brute-force version of each stage, on what its predecessor kept."""

import os
from collections import Counter

import corpus_pipeline
from compare import SF
from test_operators import brute_components, check_packing, empty, lower, odd, pairs  # noqa: F401

from lectern.llm import queries, rules
from lectern.llm.textbytes import written


def test_stages(spark):
    docs = queries.documents(spark, SF)
    columns = docs.columns
    kept = []
    for name, step in corpus_pipeline.STAGES:
        docs = written(step(spark, docs, SF))
        kept.append(docs)
        assert name == corpus_pipeline.STAGES[-1][0] or docs.columns == columns
    cleaned, exact, near, mixed, packed = kept

    source = queries.documents(spark, SF)
    judged = rules.judge(source).selectExpr("doc_id", "quality.cleaned AS text", "quality.kept AS kept")
    passed = [(i, t) for i, t, kept in pairs(judged, "doc_id", "text", "kept") if kept]
    assert Counter(pairs(cleaned, "doc_id", "text")) == Counter(passed)

    last = {}
    for i, t in pairs(cleaned, "doc_id", "text"):
        last[lower(t)] = max(last.get(lower(t), i), i)
    assert sorted(i for i, in pairs(exact, "doc_id")) == sorted(last.values())

    groups = brute_components(pairs(exact, "doc_id", "text"), 80, 100, 5)
    assert sorted(i for i, in pairs(near, "doc_id")) == sorted({c for _, _, c in groups})

    texts = dict(pairs(near, "doc_id", "text"))
    rows = pairs(mixed, "doc_id", "text")
    assert all(texts[i] == t for i, t in rows) and 0.5 * len(texts) < len(rows) < 1.5 * len(texts)

    got = pairs(packed, "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
    check_packing(rows, got, queries.tokenizer_path(), 4096)


def test_run_gives_the_last_stage(spark):
    assert corpus_pipeline.run(spark, SF).columns == [
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_odd_rows_and_clashing_columns(spark, odd):  # noqa: F811
    """Nulls, empty and long texts, ties, repeated rows and columns of the operators' own names."""
    docs, kept = odd.unionByName(odd.where("doc_id IN (8, 21)")), []
    for _, step in corpus_pipeline.STAGES:
        docs = written(step(spark, docs, SF))
        kept.append(docs)
    cleaned, exact, near, mixed, packed = kept
    assert all(d.columns == odd.columns for d in kept[:4])
    judged = rules.judge(odd, into="verdict").selectExpr("doc_id", "verdict.kept AS kept")
    assert {i for i, in pairs(cleaned, "doc_id")} == {i for i, k in pairs(judged, "doc_id", "kept") if k}
    texts = [lower(t) for t, in pairs(exact, "text")]
    assert len(texts) == len(set(texts)) == len({lower(t) for t, in pairs(cleaned, "text")})
    groups = brute_components(pairs(exact, "doc_id", "text"), 80, 100, 5)
    assert len(pairs(near, "doc_id")) == len({c for _, _, c in groups})
    check_packing(pairs(mixed, "doc_id", "text"), pairs(packed, *packed.columns), queries.tokenizer_path(), 4096)


def test_empty_table(spark, empty):  # noqa: F811
    docs = empty
    for _, step in corpus_pipeline.STAGES:
        docs = written(step(spark, docs, SF))
        assert docs.count() == 0


def test_scratch_of_a_finished_stage_goes(spark):
    docs = written(corpus_pipeline.ngram_jaccard_join(spark, queries.documents(spark, SF), SF))
    left = list(corpus_pipeline._left)
    assert left and all(os.path.isdir(p.removeprefix("file:").replace("//", "/", 1)) for p in left)
    assert corpus_pipeline.mix_sources(spark, docs, SF).count() > 0
    assert not any(os.path.isdir(p.removeprefix("file:").replace("//", "/", 1)) for p in left)
