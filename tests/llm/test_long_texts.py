"""Texts longer than what a task looks at together, through every operator."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F
from test_operators import WORD, check_packing, lower, pairs

from lectern.llm import (
    grades, language, mixing, packing, parity_join, queries, rules, suffixes, toxicity, tries, windows,
)
from lectern.llm.textbytes import CHUNK


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghijk", k=rng.randint(3, 8))) for _ in range(5000)]
    long = " ".join(rng.choices(words, k=CHUNK // 5))
    near = long.split(" ")
    for k in range(0, len(near), 400):
        near[k] = "edit"
    assert len(long) > CHUNK
    return [(1, "short one."), (2, long), (3, "Short ONE."), (4, long.upper()), (5, " ".join(near)), (6, long), (7, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s") for i, t in rows], "doc_id long, text string, lang string, source string")


def test_dedup_operators(docs, rows):
    text = dict(rows)
    exact = {r[0]: r[1:] for r in pairs(tries.groups(docs), "id", "keep_id", "group_size", "kept")}
    assert exact[2] == exact[4] == (6, 3, False) and exact[6] == (6, 3, True) and exact[1] == (3, 2, False)
    near = dict(pairs(parity_join.components(docs, 90, 100, 3), "id", "component_id"))
    assert near[2] == near[4] == near[5] == near[6] == 2 and near[1] == near[3] == 1
    spans = {r[0]: r[1:] for r in pairs(suffixes.dedup_bytes(docs), "id", "n_removed", "kept_sha256")}
    gone = len(text[2].encode())
    assert spans[2][0] == spans[6][0] == gone and spans[4][0] == 0 and 0 < spans[5][0] < gone
    assert spans[6][1] == hashlib.sha256(b"").hexdigest()
    words = {r[0]: r[1:] for r in pairs(windows.dedup_windows(docs), "id", "n_words", "n_removed")}
    n = len(WORD.findall(text[2]))
    assert words[2] == (n, 0) and words[6] == (n, n) and words[4] == (n, 0) and n // 2 < words[5][1] < n


def test_other_operators(spark, docs, rows):
    path = queries.tokenizer_path()
    check_packing(rows, pairs(packing.pack_documents(docs, path), *packing.OUTPUT), path, 4096)
    for i, text, n, chars in pairs(rules.judge(docs).select("doc_id", "text", "quality.*"), "doc_id", "text", "n_words", "word_chars"):
        words = WORD.findall(text or "")
        assert (n, chars) == (len(words), sum(map(len, words)))
    mixed = pairs(mixing.mix(docs, mixing.temper(docs)), "doc_id", "text")
    assert all(dict(rows)[i] == t for i, t in mixed)
    network = language.train(docs.select("doc_id", "text", "lang"), F.lit(True))
    assert {r[1] for r in pairs(language.identify(docs, network), "id", "lang_pred") if r[0] != 7} == {"en"}
    marks = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (5, 0, 1)], "doc_id long, toxic int, rating int")
    lexicons, _, classifier = toxicity.train(docs, marks, F.lit(True))
    scores = dict(pairs(toxicity.score(docs, lexicons, classifier), "id", "score"))
    assert scores[2] == scores[6] and len(scores) == 7
    model = grades.train(docs, marks, F.lit(True), grades=2)
    graded = dict(pairs(grades.grade(docs, model, tail=1), "id", "expected_grade"))
    assert graded[2] == graded[6] and lower(dict(rows)[3]) == dict(rows)[1]
