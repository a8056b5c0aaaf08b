"""Documented cases of the scalar functions."""

from urllib.parse import parse_qsl, urlencode, urlparse, urlunparse

import pytest
from pyspark.sql import functions as F

from lectern.functions import decode, naming, text, timecode


def values(spark, expr, cases):
    rows = [(i, c) for i, c in enumerate(cases)]
    kind = "double" if isinstance(cases[0], float) else "string"
    df = spark.createDataFrame(rows, f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("x"))).collect()]


def test_fmt_ts(spark):
    cases = [0.0, 59.9, 60.0, 3599.0, 3600.0, 3723.5, 360000.0]
    assert values(spark, timecode.fmt_ts, cases) == [
        "00:00", "00:59", "01:00", "59:59", "01:00:00", "01:02:03", "100:00:00",
    ]


def test_parse_ts(spark):
    cases = ["[01:02:03]", "02:03", "7", "9:1:2:3", "none", "", "12:30.5"]
    assert values(spark, timecode.parse_ts, cases) == [3723.0, 123.0, 7.0, 3723.0, 0.0, 0.0, 45005.0]


def test_turkish_order(spark):
    words = ["2x", "web", "Zaman", "Ürün", "Şema", "Ölçüm", "İşlem", "Isı", "Çekirdek", "Cam"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = [r.w for r in df.orderBy(text.tr_sort_key(F.col("w"))).collect()]
    assert got == list(reversed(words))


def test_glossary_key_merges_cases(spark):
    keys = values(spark, text.glossary_key, ["İşlem", "işlem", "Iteration", "iteration"])
    assert keys[0] == keys[1] and keys[2] == keys[3]


@pytest.mark.parametrize("space", [" ", " ", "\x1c", "\t", "\n", "　", "\x85"])
def test_unicode_space(spark, space):
    assert values(spark, text.strip, [f"{space} a{space}b {space}"]) == [f"a{space}b"]
    assert values(spark, text.word_count, [f"{space}a{space}b"]) == [2]
    assert values(spark, text.is_blank, [space * 3]) == [True]


def test_ends_sentence(spark):
    got = values(spark, text.ends_sentence, ["a.", "a! \n", "a", "", "a.b"])
    assert got == [True, True, False, False, False]


def reference_link(url, seconds):
    parsed = urlparse(url)
    query = dict(parse_qsl(parsed.query))
    query["t"] = f"{int(seconds)}s"
    return urlunparse(parsed._replace(query=urlencode(query)))


def test_deep_link_follows_form_encoding(spark):
    urls = [
        "https://e.org/w?v=a&t=3s&x=1", "https://e.org/w?b=&v=1&v=2#top", "HTTPS://e.org/p",
        "https://e.org/?q=a+b%20c&z=%C5%9F~*", "https://e.org/p?x", "https://e.org/p#", "e.org/a?k=1=2",
        "https://e.org/w?t=", "https://e.org/w?bad=%zz",
    ]
    got = values(spark, lambda c: timecode.deep_link(c, F.lit(75.9)), urls)
    assert got == [f"[`01:15`]({reference_link(u, 75.9)})" for u in urls]
    assert values(spark, lambda c: timecode.deep_link(c, F.lit(5.0)), ["", None]) == ["`00:05`"] * 2


def test_titles(spark):
    titles = ["A — Part 2 (1-2dk)", "A — B — Tüm hali", "  X ", "Playlist — Tüm hali", None]
    assert values(spark, naming.base_title, titles) == ["A", "A — B", "X", "Playlist", ""]
    assert values(spark, naming.is_generic_title, titles) == [False, False, False, True, True]
    assert values(spark, lambda c: naming.retitled_part(c, F.lit("N")), titles[:3]) == [
        "N — Part 2 (1-2dk)", "N — Tüm hali", "N — Part",
    ]


def test_safe_name(spark):
    got = values(spark, lambda c: naming.safe_name(c, 8), ['a<b>:c', "  ", 'x' * 20, "a\x01b"])
    assert got == ["a b c", "adsiz", "x" * 8, "a b"]


def test_owner_rules(spark):
    names = ["a1.md", "a1.transcript.raw.txt", "a1_frames", "a1_pages"]
    assert values(spark, naming.owner_of, names) == ["a1"] * 4
    assert values(spark, lambda c: naming.owner_of(c, True), names)[3] == "a1_pages"


def test_first_error_rule_wins(spark):
    got = values(spark, naming.error_class, [
        "Groq 500 and 429", "429", "YouTube thinks you are a BOT", "ffmpeg: Conversion failed!",
        "HTTP Error 403: Forbidden", "no audio stream in ffmpeg", "ffprobe", "x",
    ])
    assert got == ["asr_5xx", "quota", "bot_block", "postprocess", "download", "no_audio",
                   "media_tool", None]


def test_salvage(spark):
    got = values(spark, decode.salvage_json, ['{"a":1}', 'ok ```{"a":{"b":2}}``` bye', '{"a":', "", "}{"])
    assert got == ['{"a":1}', '{"a":{"b":2}}', None, None, None]


def test_compression_tiers(spark):
    got = values(spark, naming.compression_tier, [0.5, 1.0, 11.9, 12.0, 30.0])
    assert got == ["expansion", "low", "low", "medium", "high"]


def test_real_word_ratio(spark):
    good, bad = "kelime " * 20, "xyz " * 20
    got = values(spark, text.real_word_ratio, [good, bad, good[:70], good + bad])
    assert got == [1.0, 0.0, None, 0.5]
