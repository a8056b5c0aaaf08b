"""Resampling, spelling variants and the suffix tree against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from compare import SF
from pyspark.sql import functions as F
from test_operators import SCHEMA, WORD, empty, lower, odd, pairs  # noqa: F401

from lectern.llm import checksums, features, queries, resampling, suffix_tree, variants
from lectern.llm.textbytes import CHUNK, written


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.read.parquet(f"{SF}/benchmark.parquet")


@pytest.fixture(scope="module")
def long_text(spark):
    """One text above what a task looks at together, between short ones."""
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdeéx", k=rng.randint(5, 9))) for _ in range(300)]
    rows = [(1, "Lettering letterings lettering"), (2, " ".join(rng.choices(words, k=CHUNK // 6))), (3, None)]
    assert len(rows[1][1].encode()) > CHUNK
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_crc32_of_spans():
    rng = np.random.default_rng(1)
    raw = rng.integers(0, 256, 4000).astype(np.uint8)
    starts = np.sort(rng.integers(0, 3900, 200))
    ends = starts + rng.integers(0, 100, 200)
    want = [zlib.crc32(raw[a:b].tobytes()) for a, b in zip(starts, ends)]
    assert checksums.crc32(raw, starts, ends).tolist() == want


# --- resampling ---------------------------------------------------------------------

TARGET_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features_of(text, longest):
    w = TARGET_WORD.findall(lower(text))
    return len(w), [" ".join(w[i:i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]


def brute_resample(rows, targets, longest=1, buckets=10_000, least=20):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for x in texts for f in features_of(x, longest)[1])
            for texts in ([x for _, x in rows], targets))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log(
        (float(t[b] + 1) * float(big_s + buckets)) / (float(s[b] + 1) * float(big_t + buckets))))
    out, able = [], []
    for i, x in rows:
        n, found = features_of(x, longest)
        weight = sum(gain(bucket(f)) for f in found)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((i, len(found), weight, score))
        if n >= least:
            able.append((-score, i is None, i or 0))
    return Counter(out), sorted(able)[: 10 * len(able) // 100]


@pytest.mark.parametrize("longest", [1, 3])
@pytest.mark.parametrize("table", ["odd", "some", "long_text"])
def test_resampling(request, spark, benchmark, table, longest):
    docs = queries.documents(spark, SF) if table == "some" else request.getfixturevalue(table)
    rows = pairs(docs, "doc_id", "text")
    got = pairs(resampling.resample(docs, benchmark, longest=longest, pivots=7),
                "id", "n_features", "weight", "score", "rank")
    want, drawn = brute_resample(rows, [x for x, in pairs(benchmark, "text")], longest)
    assert Counter(r[:4] for r in got) == want
    winners = sorted((r for r in got if r[4] is not None), key=lambda r: r[4])
    assert [r[4] for r in winners] == list(range(1, len(drawn) + 1))
    assert [(-r[3], r[0] is None, r[0] or 0) for r in winners] == drawn


def test_resampling_of_nothing(empty, benchmark):  # noqa: F811
    assert resampling.resample(empty, benchmark).count() == 0
    assert resampling.resample(benchmark.withColumnRenamed("item_id", "doc_id"), empty).count() == benchmark.count()


def test_kth_key_with_ties(spark):
    rng = random.Random(5)
    rows = [(rng.randint(0, 3), rng.choice([None, 1, 2]), k) for k in range(500)]
    table = written(spark.createDataFrame(rows, "down long, id long, row long").withColumn("none", F.col("id").isNull()))
    order = sorted((d, i is None, i or 0, r) for d, i, r in rows)
    for k in (1, 2, 77, 250, 499, 500):
        got = resampling.kth_key(table, ["down", "none", "id", "row"], k, pivots=5, seed=k)
        assert (got["down"], got["none"], got["id"] or 0, got["row"]) == order[k - 1]


# --- spelling variants --------------------------------------------------------------

RUN = re.compile(r"[A-Za-zÀ-ÿ]+")


def brute_words(rows, least, slip):
    out = Counter()
    for i, x in rows:
        for run in RUN.findall(x or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if slip and h % slip == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
            if len(run) >= least:
                out[run] += 1
    return out


def brute_variants(counts, ratio=10):
    words = {w: n for w, n in counts.items() if n >= 2}
    shapes = defaultdict(set)  # words that share one with a code point taken out, or a gap in its place
    for w in words:
        for k in range(len(w)):
            shapes[w[:k] + "\0" + w[k + 1:]].add(w)
            shapes[w[:k] + w[k + 1:]].add(w)
        shapes[w].add(w)
    near = defaultdict(set)

    def one_edit(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))

    for group in shapes.values():
        for a in group:
            near[a] |= {b for b in group if b != a and one_edit(a, b)}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        if best is not None and words[best] >= ratio * n:
            form[w] = best
    out = set()
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        f = form.get(w)
        out.add((w, f, root, n, len(near[w]), words[f] if f else None))
    return out


@pytest.mark.parametrize("table,slip,symbols", [("odd", 3, 4), ("some", 31, 8), ("some", None, 2), ("long_text", 31, 8)])
def test_variants(request, spark, table, slip, symbols):
    docs = queries.documents(spark, SF) if table == "some" else request.getfixturevalue(table)
    least = 3 if table == "odd" else 7
    got = pairs(variants.variant_forms(docs, least, 2, 10 if table != "odd" else 2, slip, symbols),
                "word", "form", "root", "n", "n_near", "form_n")
    want = brute_variants(brute_words(pairs(docs, "doc_id", "text"), least, slip), 10 if table != "odd" else 2)
    assert len(got) == len(want) and set(got) == want


def test_variants_of_planted_words(spark, empty):  # noqa: F811
    """A long chain of forms, letters of two bytes at the edges, a very long run."""
    texts = {"exemplar": 20_000, "exemplars": 2000, "exemplary": 3, "exemplarsé": 200, "xexemplarsé": 20,
             "xexemplrsé": 2, "éxemplar": 2, "z" * 3000: 20, "z" * 3001: 2, "y" + "z" * 2999: 2}
    rows = [(k, " ".join([w] * n)) for k, (w, n) in enumerate(texts.items())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["word"]: r for r in variants.variant_forms(docs).collect()}
    assert {w: r["n"] for w, r in got.items()} == texts
    assert got["xexemplrsé"]["root"] == "exemplar" and got["xexemplrsé"]["form"] == "xexemplarsé"
    assert got["éxemplar"]["form"] == "exemplar" and got["z" * 3001]["form"] == "z" * 3000 == got["y" + "z" * 2999]["root"]
    assert variants.variant_forms(empty).count() == 0


# --- suffix tree --------------------------------------------------------------------


def tokens(text):
    return [*WORD.findall(lower(text)), None]


def brute_tree(train, depth, share, cut):
    """Counts after every context, candidates, retained contexts and probabilities, by dictionary."""
    after = defaultdict(Counter)
    for x in train:
        w = tokens(x)
        for i, t in enumerate(w):
            for d in range(min(depth, i) + 1):
                after[tuple(w[i - d: i])][t] += 1
    n, v = sum(after[()].values()), len(after[()])
    least = max(2, math.ceil(share * n))
    known = {(): True}
    for d in range(1, depth + 1):
        for s in [s for s in after if len(s) == d and s[:-1] in known]:
            if after[s[:-1]][s[-1]] >= least:
                known[s] = True

    def p(s, t):
        c = after[s]
        if not s:
            return (c[t] + 1) / (n + v + 1)
        once = sum(1 for x in c.values() if x == 1)
        seen = c[t] if c[t] > 1 else 0
        return (seen + (1 + once) * p(s[1:], t)) / (sum(c.values()) + 1)

    retained = {()}
    for s in sorted(known, key=len, reverse=True):
        if s and sum(after[s].values()):
            total = sum(after[s].values())
            gain = sum(k * (math.log(p(s, t)) - math.log(p(s[1:], t))) for t, k in after[s].items() if k > 1)
            once = sum(1 for x in after[s].values() if x == 1)
            gain += once * math.log((1 + once) / (total + 1))
            if s in retained or gain >= cut * total:
                retained |= {s[i:] for i in range(len(s) + 1)}
    return after, n, p, retained


def brute_scores(rows, learn, depth, share, cut):
    after, n, p, retained = brute_tree([x for i, x in rows if learn(i)], depth, share, cut)
    for i, x in rows:
        w = tokens(x)
        base = sum(math.log10(p((), t)) for t in w)
        score = 0.0
        for k, t in enumerate(w):
            s = next(tuple(w[k - d: k]) for d in range(min(depth, k), -1, -1) if tuple(w[k - d: k]) in retained)
            score += math.log10(p(s, t))
        yield i, len(w), sum(after[()][t] > 0 for t in w), n, base, score


@pytest.mark.parametrize("table,share,cut,chunk", [
    ("odd", 0.002, 0.02, 3000), ("some", 1e-3, 0.02, 40_000), ("some", 3e-3, 0.5, 1 << 25), ("long_text", 1e-3, 0.01, 1 << 19)])
def test_suffix_tree(request, spark, table, share, cut, chunk):
    docs = queries.documents(spark, SF) if table == "some" else request.getfixturevalue(table)
    rows = pairs(docs, "doc_id", "text")
    got = pairs(suffix_tree.lm_scores(docs, ~features.held_out(of=7), least_share=share, divergence=cut, chunk_bytes=chunk),
                "id", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    learn = lambda i: i is None or zlib.crc32(str(i).encode()) % 7 != 2
    order = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    got, want = sorted(got, key=order), sorted(brute_scores(rows, learn, 3, share, cut), key=order)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    assert np.allclose([r[4:] for r in got], [r[4:] for r in want], rtol=1e-9, atol=1e-9)
    if table == "some":
        assert sum(r[5] for r in got if not learn(r[0])) > sum(r[4] for r in got if not learn(r[0]))


def test_suffix_tree_is_a_distribution(spark):
    """After any retained context the probabilities of all words, unknown ones together, add up to one."""
    rng = random.Random(2)
    texts = [" ".join(rng.choices("abcdefgh", [8, 7, 6, 5, 4, 3, 2, 1], k=200)) for _ in range(20)]
    after, n, p, retained = brute_tree(texts, 3, 1e-3, 0.0)
    for s in retained:
        assert abs(sum(p(s, t) for t in after[()]) + p(s, "new") - 1) < 1e-9


def test_suffix_tree_of_nothing(spark, empty, odd):  # noqa: F811
    assert suffix_tree.lm_scores(empty, F.lit(True)).count() == 0
    none = suffix_tree.lm_scores(odd, F.lit(False))
    assert {(r["train_tokens"], r["base_score"], r["score"]) for r in none.collect()} == {(0, 0.0, 0.0)}
