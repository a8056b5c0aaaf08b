"""Operators of lectern.llm against brute force, and their defined results in odd cases."""

import hashlib
import math
import random
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from compare import SF
from pyspark.sql import functions as F

from lectern.llm import (
    features, grades, language, mixing, packing, parity_join, queries, rules, suffixes, toxicity,
    tries, windows,
)

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, quality int, copy int, words_ string"


def lower(text):
    return (text or "").encode().lower().decode()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, clashing column names."""
    rng = random.Random(4)
    vocabulary = ["".join(rng.choices("abcdeé", k=rng.randint(1, 7))) for _ in range(400)]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n)) + "."
    base, passage = text(140), text(60)
    near = base.split()
    near[3] = "other"
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "One"), (6, "two words"), (7, "TWO words"),
        (8, base), (8, base), (9, base.upper()), (10, " ".join(near)), (11, text(30) + " " + passage),
        (12, passage + " " + text(40)), (13, text(6000)), (14, "same " * 300), (15, "same " * 301),
        (None, base), (None, None), (16, "x" * 50_000), (17, "é" * 150 + base[:300] + "é" * 150),
        (18, text(80) + "\nA | b | c | d | e\n" + text(70)), (19, "it's 'sabc <|endoftext|> ΑΣ ½ 12"),
        (20, base + " tail"), (21, text(120)),
    ]
    full = [(i, t, "en" if i != 3 else None, f"s{(i or 0) % 3}" if i != 4 else None, len(t or ""), 1, 2, "w")
            for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def some(spark):
    return queries.documents(spark, SF)


def pairs(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.select(*columns).collect()]


# --- exact dedup --------------------------------------------------------------------


def test_exact_groups(odd):
    rows_ = pairs(tries.groups(odd), "id", "keep_id", "group_size", "kept", "text_sha256")
    got = Counter((i, keep, size, digest) for i, keep, size, _, digest in rows_)
    assert Counter((d, k, i) for i, k, _, kept, d in rows_ if kept) == Counter(  # one row of each text, the owner's
        {(d, k, k): 1 for _, k, _, _, d in rows_})
    by_text = defaultdict(list)
    rows = pairs(odd, "doc_id", "text")
    for i, t in rows:
        by_text[lower(t)].append(i)
    want = Counter()
    for i, t in rows:
        ids = by_text[lower(t)]
        keep = max((x for x in ids if x is not None), default=None)
        want[(i, keep, len(ids), hashlib.sha256(lower(t).encode()).hexdigest())] += 1
    assert got == want


def test_exact_survivors_are_whole_rows(odd, empty):
    got = tries.survivors(odd)
    assert got.columns == odd.columns
    texts = [lower(t) for _, t in pairs(got, "doc_id", "text")]
    assert len(texts) == len(set(texts)) == len({lower(t) for _, t in pairs(odd, "doc_id", "text")})
    assert tries.survivors(empty).count() == 0 and tries.groups(empty).count() == 0


def test_trie_spills(odd):
    whole = sorted(pairs(tries.owners(odd), "n_bytes", "owner", "copies"), key=str)
    tight = sorted(pairs(tries.owners(odd, trie_bytes=500), "n_bytes", "owner", "copies"), key=str)
    assert whole == tight


def test_trie_smallest():
    trie = tries.Trie(largest=False)
    for key, i in ((b"abc", 5), (b"ab", 4), (b"abd", 3), (b"abc", 2), (b"", 9), (b"abc", None)):
        trie.add(key, i, 1, key)
    assert sorted((o[2], o[0], o[1]) for o in trie.all()) == [
        (b"", 9, 1), (b"ab", 4, 1), (b"abc", 2, 3), (b"abd", 3, 1)]


# --- n-gram join --------------------------------------------------------------------


def shingle_set(text, width):
    w = WORD.findall(lower(text))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1)))


def brute_components(rows, num, den, width):
    sets = [shingle_set(t, width) for _, t in rows]
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) * den >= num * max(len(x), len(y)):
                both = len(x & y)
                if den * both >= num * (len(x) + len(y) - both):
                    up[top(a)] = top(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[top(k)] = min(least.get(top(k), i), i)
    return Counter((i, len(sets[k]), least.get(top(k))) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize("num,width", [(90, 3), (80, 5)])
def test_jaccard_components(odd, num, width):
    got = Counter(pairs(parity_join.components(odd, num, 100, width), "id", "n_shingles", "component_id"))
    assert got == brute_components(pairs(odd, "doc_id", "text"), num, 100, width)


def test_jaccard_group_of_near_copies(spark, monkeypatch):
    """A large group in which few copies are linked with the centre; sketches are compared."""
    monkeypatch.setattr(parity_join, "SMALL", 2)
    rng = random.Random(9)
    base = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(120)]
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(40)}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(pairs(parity_join.components(docs), "id", "n_shingles", "component_id"))
    assert got == brute_components(rows, 90, 100, 3)


def test_jaccard_mixed_bucket_in_bounded_blocks(spark, monkeypatch):
    """A linked group and outsiders in one bucket: few comparisons, each task bounded, none missing."""
    monkeypatch.setattr(parity_join, "BLOCK", 8)
    rng = np.random.default_rng(3)
    base = rng.integers(-2**63, 2**63 - 1, 32)
    rows, table = [], []
    for rid in range(140):  # key 1: a group of 100 and one outsider; key 2: small labels beside them
        label = 0 if rid < 100 else rid if rid == 100 else 101 + rid % 13
        far = rng.integers(0, 3)
        sketch = [int(x) if k >= far else int(y) for k, (x, y) in enumerate(
            zip(base, rng.integers(-2**63, 2**63 - 1, 32)))]
        table.append((rid, 900, sketch))
        rows += [(1, rid, label)] * (rid <= 100) + [(2, rid, label)] * (rid >= 60)
    rows_df = spark.createDataFrame(rows, "key long, rid long, label long")
    members, sides = parity_join.label_blocks(rows_df)
    sent = pairs(members.join(sides, ["key", "own", "block"]), "key", "pair", "rid")
    assert max(Counter(p for _, p, _ in sent).values()) <= 8 * 8
    assert sum(k == 1 for k, _, _ in sent) < 100 * 3
    table_df = spark.createDataFrame(table, "rid long, n long, sketch array<long>")
    got = pairs(parity_join.close_sketches(rows_df, table_df, parity_join.Bands(90, 100)), "a", "b")
    most = 10 * 1800 // 190
    apart = lambda a, b: sum(
        ((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(table[a][2], table[b][2]))
    want = {(a, b) for k, a, x in rows for m, b, y in rows if k == m and a < b and x != y and apart(a, b) <= most}
    assert set(got) == want and want


def test_jaccard_partners_of_a_hub_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(parity_join, "PARTNERS", 4)
    words = [f"w{i}" for i in range(100)]
    texts = [" ".join(words)] + [" ".join([*words[:-1], f"end{i}"]) for i in range(40)] + ["quite another text"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bands = parity_join.Bands(90, 100)
    table = parity_join.written(parity_join.sketch_table(docs, bands, 3, "doc_id", "text"))
    rid = dict(pairs(table, "id", "rid"))
    tried = spark.createDataFrame([(rid[0], rid[i]) for i in range(1, 42)], "a long, b long")
    salts = Counter(pairs(parity_join.dealt(tried), "a", "salt"))
    assert len(salts) > 4 and max(salts.values()) <= 4 * 4
    got = pairs(parity_join.verified(tried, table, docs, bands, 3, "doc_id", "text"), "a", "b")
    assert Counter(got) == Counter((rid[0], rid[i]) for i in range(1, 41))


def test_jaccard_one_of_each(odd, empty):
    kept = parity_join.one_of_each(odd, 80, 100, 5)
    assert kept.columns == odd.columns
    want = brute_components(pairs(odd, "doc_id", "text"), 80, 100, 5)
    assert {c for (_, n, c) in want if n} <= {i for i, _ in pairs(kept, "doc_id", "text")}
    assert len([1 for _, t in pairs(kept, "doc_id", "text") if WORD.search(t or "")]) == len(
        {c for (_, n, c) in want if n})
    assert parity_join.components(empty).count() == 0 and parity_join.one_of_each(empty).count() == 0


@pytest.mark.parametrize("num", [70, 80, 90, 95])
def test_linked_sets_share_a_bucket_that_both_keep(num):
    """At the threshold, for sets of every size, whatever the order in which largest buckets are left."""
    bands = parity_join.Bands(num, 100)
    rng = np.random.default_rng(num)
    tight = 0
    for _ in range(400):
        both = int(rng.integers(1, 900))
        alone = both * (100 - num) // num  # elements in one set only, at most
        mine = int(rng.integers(0, alone + 1))
        pool = rng.integers(0, 2**64, both + alone, np.uint64)
        one, two = np.sort(pool[: both + mine]), np.sort(np.concatenate([pool[:both], pool[both + mine:]]))
        keys = []
        for x in (one, two):
            n = np.array([len(x)])
            own, beyond = bands.of(n)
            sent = {}
            for band in (own, own + 1) if beyond[0] else (own,):
                d, key, leave = parity_join.band_keys(np.zeros(len(x), np.int64), x, n, np.array([0]), band, bands)
                sent[int(band[0])] = (set(key.tolist()), int(leave[0]))
            keys.append(sent)
        place = dict(zip({k for s in keys for ks, _ in s.values() for k in ks}, rng.permutation(100_000)))
        kept = [{k for ks, leave in s.values() for k in sorted(ks, key=place.get)[leave:]} for s in keys]
        assert kept[0] & kept[1]
        tight += any(leave for s in keys for _, leave in s.values())
    assert tight or num == 70


def test_folded_sketches_bound_the_difference():
    rng = np.random.default_rng(2)
    values = [rng.integers(0, 2**63, n, np.int64) for n in (8, 4, 16, 4)]
    got = parity_join.folded_sketches(parity_join._lists(np.array([8, 4, 16, 4]), np.concatenate(values)))
    for row, v in zip(got, values):
        assert (row == np.bitwise_xor.reduce(v.view(np.uint64).reshape(-1, 4), axis=0)).all()


@pytest.mark.parametrize("num,width", [(90, 3), (80, 5)])
def test_jaccard_components_of_documents(some, num, width):
    got = Counter(pairs(parity_join.components(some, num, 100, width), "id", "n_shingles", "component_id"))
    assert got == brute_components(pairs(some, "doc_id", "text"), num, 100, width)


def test_jaccard_long_and_short_documents_with_passages(spark, monkeypatch):
    """Sizes over several bands, near copies at the threshold, a passage in all: sketches of many lengths."""
    monkeypatch.setattr(parity_join, "SMALL", 3)
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    passage, rows = [word() for _ in range(40)], []
    for size in (30, 60, 130, 400, 1500):
        base = [word() for _ in range(size)]
        for k in range(14):
            w = [*base[: size // 2], *passage, *base[size // 2:]]
            for _ in range(rng.randint(0, size // 20)):
                w[rng.randrange(len(w))] = word()
            rows.append((len(rows), " ".join(w[: len(w) - rng.randint(0, size // 12)])))
    rows += [(len(rows) + k, " ".join([word() for _ in range(rng.randint(0, 50))] + passage)) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for num, width in ((80, 5), (90, 3)):
        got = Counter(pairs(parity_join.components(docs, num, 100, width), "id", "n_shingles", "component_id"))
        assert got == brute_components(rows, num, 100, width)


def test_bound_of_the_sketch():
    bands = parity_join.Bands(90, 100)
    for a in range(1, 300):
        for b in range(a, a * 10 // 9 + 2):
            most = 10 * (a + b) // 190
            linked = [d for d in range((a + b) % 2, a + b, 2) if 100 * (a + b - d) >= 90 * (a + b + d)]
            assert not linked or max(linked) <= most
            if b * 9 <= a * 10:
                own, beyond = bands.of(np.array([a, b]))
                assert own[0] == own[1] or (own[1] == own[0] + 1 and beyond[0])


# --- windows and suffixes -----------------------------------------------------------


def brute_windows(rows, width):
    first = {}
    for i, t in rows:
        if i is not None:
            w = WORD.findall(t or "")
            for k in range(len(w) - width + 1):
                g = tuple(w[k:k + width])
                first[g] = min(first.get(g, i), i)
    out = Counter()
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = set()
        for k in range(len(w) - width + 1 if i is not None else 0):
            if first[tuple(w[k:k + width])] < i:
                gone.update(range(k, k + width))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[(i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())] += 1
    return out


@pytest.mark.parametrize("width,hot", [(50, 20_000), (50, 10), (14, 3)])
def test_windows(odd, empty, width, hot):
    got = windows.dedup_windows(odd, width, hot=hot)
    assert Counter(pairs(got, "id", "n_words", "n_removed", "kept_sha256")) == brute_windows(
        pairs(odd, "doc_id", "text"), width)
    assert windows.dedup_windows(empty, width).count() == 0


def test_windows_on_documents(some):
    got = windows.dedup_windows(some, hot=50)
    assert Counter(pairs(got, "id", "n_words", "n_removed", "kept_sha256")) == brute_windows(
        pairs(some, "doc_id", "text"), 50)


def brute_bytes(rows, width):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[k:k + width] for _, b in texts for k in range(len(b) - width + 1))
    out = Counter()
    for i, b in texts:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - width + 1):
            if seen[b[k:k + width]] > 1:
                gone[k:k + width] = True
        rest = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[(i, len(b), int(gone.sum()), spans, hashlib.sha256(rest).hexdigest())] += 1
    return out


@pytest.mark.parametrize("width,crowded", [(200, suffixes.CROWDED), (48, suffixes.CROWDED), (48, 100)])
def test_bytes(odd, empty, width, crowded):
    small = odd.where("doc_id IS NULL OR doc_id <> 16")
    got = suffixes.dedup_bytes(small, width, crowded=crowded)
    assert Counter(pairs(got, "id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) == brute_bytes(
        pairs(small, "doc_id", "text"), width)
    assert suffixes.dedup_bytes(empty).count() == 0


@pytest.mark.parametrize("crowded", [suffixes.CROWDED, 100])
def test_bytes_of_a_text_that_is_one_repeat(odd, crowded):
    small = odd.where("doc_id IN (8, 16, 17)")
    got = suffixes.dedup_bytes(small, 48, crowded=crowded)
    assert Counter(pairs(got, "id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) == brute_bytes(
        pairs(small, "doc_id", "text"), 48)


def test_bytes_equal_windows_travel_once(spark):
    """A passage in many contexts, and a template with a slot: bounded files, all repeats found."""
    rng = random.Random(5)
    word = lambda n: "".join(rng.choices("abcdefghij", k=n))
    passage, head, tail = word(60), word(40), word(40)
    texts = [word(50) + passage + word(50) for _ in range(300)] + [head + word(8) + tail for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = suffixes.dedup_bytes(docs, 48, crowded=100)
    assert Counter(pairs(got, "id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) == brute_bytes(
        list(enumerate(texts)), 48)
    one = spark.createDataFrame(
        [(1, k, 1, bytearray(t.encode())) for k, t in enumerate(texts[:300])],
        "anchor long, string long, n long, bytes binary")
    classes = suffixes.window_classes(suffixes.window_marks(one, 48), 48)
    sent = pairs(suffixes.windows_apart(one, classes, 48), "bytes", "n")
    number = {bytes(b).decode(): n for b, n in sent}
    assert len(number) == len(sent) and all(number[passage[k: k + 48]] == 300 for k in range(13))
    slots = spark.createDataFrame(
        [(1, k, 1, bytearray((head[-20:] + word(8) + head[:20]).encode())) for k in range(300)],
        "anchor long, string long, n long, bytes binary")
    marks = suffixes.window_marks(slots, 48).withColumn("file", F.lit(7).cast("long"))
    files = Counter(pairs(suffixes.window_classes(marks, 48, 48 * 50), "part"))
    assert sum(files.values()) == 300 and max(files.values()) < 120


def test_bytes_of_whole_copies_reach_the_merge(spark, monkeypatch):
    sent, solve = [], suffixes.suffix_repeats

    def seen(rows, width):
        sent.extend(pairs(rows, "n", "bytes"))
        return solve(rows, width)

    monkeypatch.setattr(suffixes, "suffix_repeats", seen)
    rng = random.Random(8)
    text = "".join(rng.choices("abcdefghij", k=400))
    rows = [(1, text), (2, text), (3, text), (4, "".join(rng.choices("klmnopq", k=400)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffixes.dedup_bytes(docs, 48)
    assert Counter(pairs(got, "id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) == brute_bytes(rows, 48)
    assert sent and all(n == 3 and bytes(b).decode() in text for n, b in sent)
    assert {text[k: k + 48] for k in range(353)} <= {
        bytes(b).decode()[k: k + 48] for _, b in sent for k in range(len(b) - 47)}


def test_bytes_on_documents(some):
    got = suffixes.dedup_bytes(some)
    assert Counter(pairs(got, "id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) == brute_bytes(
        pairs(some, "doc_id", "text"), 200)


def test_merged_transforms_count_windows():
    rng = random.Random(3)
    for _ in range(25):
        base = bytes(rng.choices(b"abc", k=60))
        strings = list({
            base[a: a + rng.randint(16, 40)] if rng.random() < 0.6 else bytes(rng.choices(b"ab\0", k=30))
            for a in (rng.randint(0, 20) for _ in range(rng.randint(1, 30)))})
        numbers = np.array([rng.choice([1, 1, 2]) for _ in strings])
        seen = Counter()
        for s, n in zip(strings, numbers):
            for k in range(len(s) - 15):
                seen[s[k:k + 16]] += int(n)
        got = suffixes.repeated_windows(strings, numbers, 16, rng.choice([40, 100, 9999]), rng.choice([8, 16]))
        assert [g.tolist() for g in got] == [
            [seen[s[k:k + 16]] > 1 for k in range(len(s) - 15)] for s in strings]


# --- packing ------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    pytest.importorskip("tokenizers")
    try:
        return queries.tokenizer_path()
    except ImportError:
        pytest.skip("no tokenizer files here")


def check_packing(rows, got, path, size):
    from tokenizers import Tokenizer

    tokens = Tokenizer.from_file(path)
    want = Counter()
    for i, t in rows:
        ids = tokens.encode(t or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), size):
            part = np.array(ids[k:k + size], "<u4")
            want[(i, k // size, k, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter(g[:5] for g in got) == want
    sequences = defaultdict(list)
    for g in got:
        sequences[g[5]].append((g[6], g[3]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    return len(sequences)


def test_packing(odd, empty, some, tokenizer):
    for docs, size in ((odd, 4096), (odd, 40), (some, 4096)):
        got = pairs(packing.pack_documents(docs, tokenizer, size), *packing.OUTPUT)
        used = check_packing(pairs(docs, "doc_id", "text"), got, tokenizer, size)
        assert used <= math.ceil(1.05 * sum(g[3] for g in got) / size) + 1
    assert packing.pack_documents(empty, tokenizer).count() == 0


def test_plan_is_best_fit_and_small():
    slots = packing.plan({5: 2, 4: 1, 3: 3, 2: 2}, 10)
    fill = defaultdict(int)
    for length, _, count, sequence, offset in slots:
        for k in range(count):
            assert fill[sequence + k] == offset
            fill[sequence + k] += length
    assert sorted(fill.values()) == [7, 10, 10]
    assert len(packing.plan({n: 10**9 for n in range(1, 4097)})) < 20_000


# --- mixing -------------------------------------------------------------------------


def test_mix_counts_follow_the_distribution(spark, odd, empty):
    docs = spark.range(4000).selectExpr("id AS doc_id", "'t' AS text", "if(id < 3000, 'a', 'b') AS source")
    weights = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", 9.0)], "source string, weight double")
    got = mixing.mix(docs, weights, total=40_000, seed=1)
    per_doc = Counter(i for i, in pairs(got, "doc_id"))
    for low, high, rate in ((0, 3000, 10 / 3), (3000, 4000, 30.0)):
        counts = np.array([per_doc[i] for i in range(low, high)])
        assert abs(counts.mean() - rate) < 4 * math.sqrt(rate / (high - low))
        assert 0.85 < counts.var() / rate < 1.15
    again = mixing.mix(docs.repartition(7), weights, total=40_000, seed=1)
    assert Counter(i for i, in pairs(again, "doc_id")) == per_doc
    order = [i for i, in pairs(got, "doc_id")]
    assert abs(np.corrcoef(np.arange(len(order)), order)[0, 1]) < 0.1
    mixed = mixing.mix(odd, mixing.temper(odd), copy=None, place=None)
    assert mixed.columns == odd.columns and mixed.count() > 0
    with pytest.raises(ValueError):
        mixing.mix(odd, mixing.temper(odd))
    assert mixing.mix(empty, mixing.temper(empty), copy=None, place=None).count() == 0


# --- rules --------------------------------------------------------------------------


def test_lines_without_sentence_marks(spark):
    """Keyword lists of twenty words go; headings, sentences of any script and one endless word stay."""
    keywords, sentence = " ".join(f"word{i}" for i in range(20)), " ".join(f"w{i}" for i in range(60)) + "."
    lines = [keywords, " \t" + keywords + " ", keywords[:-7], keywords + "!", keywords + " ؟", "x" * 200_000, "A heading", sentence]
    docs = spark.createDataFrame([(1, "\n".join([*lines, sentence]))], "doc_id long, text string")
    [row] = rules.judge(docs).select("quality.*").collect()
    assert row["cleaned"].split("\n") == [x for x in lines[2:]] + [sentence] and row["n_lines_removed"] == 2


def test_rules(odd, empty):
    got, want = {}, Counter()
    with pytest.raises(ValueError):
        rules.judge(odd)
    for r in rules.judge(odd, into="verdict").select("doc_id", "text", "verdict.*").collect():
        words = WORD.findall(r["text"] or "")
        grams = Counter(zip(words, words[1:], words[2:]))
        covered = {k + j for k in range(len(words) - 2)
                   if grams[tuple(words[k:k + 3])] > 1 for j in range(3)}
        assert r["n_words"] == len(words) and r["n_repeat_words"] == len(covered)
        assert r["word_chars"] == sum(map(len, words))
        assert r["base_failed"] == (len(words) < 50 or 2 * len(covered) > len(words))
        got[r["doc_id"]] = r
        want[r["doc_id"]] += r["kept"]
    assert got[18]["kept"] and got[18]["n_lines_removed"] == 1 and "|" not in got[18]["cleaned"]
    assert not got[14]["kept"] and not got[1]["kept"] and got[8]["kept"]
    cleaned = rules.clean(odd)
    assert cleaned.columns == odd.columns
    assert all(n == len(t) for t, n in pairs(cleaned, "text", "n_chars"))
    assert Counter(i for i, in pairs(cleaned, "doc_id")) == +want
    assert rules.clean(empty).count() == 0


# --- models -------------------------------------------------------------------------

LARGER = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def labelled(spark):
    import os

    if not os.path.isdir(LARGER):
        pytest.skip("needs the larger table")
    return queries.documents(spark, LARGER), queries.labels(spark, LARGER)


def test_toxicity(labelled, odd, empty):
    docs, labels = labelled
    lexicons, model, classifier = toxicity.train(docs, labels, ~features.held_out())
    assert (model.parent >= 0).sum() == toxicity.VOTERS - 1
    truth = dict(pairs(labels, "doc_id", "toxic"))
    rows = pairs(toxicity.score(docs.where(features.held_out()), lexicons, classifier), "id", "score")
    hit = [(s >= queries.TOXIC, truth[i]) for i, s in rows if i in truth]
    found = sum(1 for s, t in hit if s and t)
    assert found / sum(t for _, t in hit) > 0.85 and sum(1 for s, t in hit if s and not t) < 0.01 * len(hit)
    scores = pairs(toxicity.score(odd, lexicons, classifier), "id", "score")
    assert len(scores) == odd.count() and all(0 <= s <= 1 for _, s in scores)
    assert toxicity.score(empty, lexicons, classifier).count() == 0


def test_toxicity_without_labels(odd, empty):
    labels = empty.selectExpr("doc_id", "quality AS toxic")
    lexicons, _, classifier = toxicity.train(odd, labels, ~features.held_out())
    assert all(0 <= s <= 1 for _, s in pairs(toxicity.score(odd, lexicons, classifier), "id", "score"))
    toxicity.train(empty, labels, ~features.held_out())


def test_language(labelled, odd, empty):
    docs, _ = labelled
    network = language.train(docs, ~features.held_out())
    held = docs.where(features.held_out())
    truth = dict(pairs(held, "doc_id", "lang"))
    got = pairs(language.identify(held, network), "id", "lang_pred", "score")
    assert np.mean([truth[i] == p for i, p, _ in got]) > 0.99
    odd_rows = {i: (p, s) for i, p, s in pairs(language.identify(odd, network), "id", "lang_pred", "score")}
    assert odd_rows[1] == odd_rows[2] == odd_rows[3] == ("und", 0.0) and odd_rows[17][0] != "und"
    assert language.identify(empty, network).count() == 0
    nothing = language.train(empty, ~features.held_out())
    assert {p for p, in pairs(language.identify(odd, nothing), "lang_pred")} == {"und"}


def test_grades(labelled, odd, empty, spark):
    docs, labels = labelled
    graded = labels.selectExpr("doc_id", "if(quality = 0, 0, if(toxic = 1, 1, 2)) AS rating")
    model = grades.train(docs, graded, ~features.held_out(), grades=3)
    assert (np.diff(model.thresholds) >= 0).all()
    truth = dict(pairs(labels, "doc_id", "quality"))
    got = pairs(grades.grade(docs.where(features.held_out()), model, tail=1), "id", "selected", "expected_grade")
    assert np.mean([s == bool(truth[i]) for i, s, _ in got if i in truth]) > 0.97
    rows = pairs(grades.grade(odd, model, tail=2), "expected_grade", "tail_probability")
    assert all(0 <= p <= 1 and p <= e <= 2 for e, p in rows)
    assert grades.grade(empty, model, tail=1).count() == 0
    grades.train(odd, empty.selectExpr("doc_id", "quality AS rating"), ~features.held_out(), grades=3)


# --- words as the tokenizer splits them -----------------------------------------------


def apart(words, texts):
    """Texts whose ids differ from those of the tokenizer itself."""
    ids, lengths = words.encode(texts)
    found = np.split(ids, np.cumsum(lengths)[:-1])
    return [t for t, own in zip(texts, found)
            if own.tolist() != words.tokenizer.encode(t, add_special_tokens=False).ids]


def test_every_code_point_and_random_unicode():
    """Alone, between letters, digits and marks; assigned or not; special strings in between."""
    words = packing.WordTokens(queries.tokenizer_path())
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for a in range(0, len(every), 50_000):
        assert not apart(words, [f"{c} a{c}a 1{c}1 e\u0301{c}\u0301'{c}" for c in every[a: a + 50_000: 7]])
    surely = [c for c in every if words.kinds[ord(c)] != packing.UNSURE]
    assert not apart(words, [f"{c} a{c}a 1{c}1 e\u0301{c}\u0301'{c}" for c in surely])
    rng = random.Random(3)
    marks = [c for c in surely if unicodedata.category(c)[0] == "M"]
    pools = [every, surely, marks, list("aeiou'st09 \n"), list("\u1100\u1161\u11a8가"), ["<|endoftext|>", "\0", "Σ"]]
    assert not apart(words, ["".join(rng.choice(rng.choice(pools)) for _ in range(rng.randint(0, 40))) for _ in range(20_000)])


def test_words_that_do_not_come_back(monkeypatch):
    """Where the tokenizer joins or cuts words after all, texts are encoded whole."""
    words = packing.WordTokens(queries.tokenizer_path())
    words.kinds[ord("b")] = packing.SPACE
    words.kinds[ord("-")] = packing.LETTER
    assert not apart(words, ["a-a - a", "plain words", "-"])


def test_packing_of_unassigned_characters(spark):
    rows = [(1, "\U0001902fg"), (2, "\U00018D82\u0367"), (3, "a\u0558a"), (4, "plain")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    path = queries.tokenizer_path()
    check_packing(rows, pairs(packing.pack_documents(docs, path, 16), *packing.OUTPUT), path, 16)
