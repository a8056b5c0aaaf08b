"""Quality rules, line first: clean a text line by line, then judge what is left.

Every line is judged by itself. It fails when it is

* broken by symbols: more than ``SYMBOL_SHARE`` of its characters are one of # * $ % & | < >,
* navigation: a list of labels between bars, arrows or bullets,
* boilerplate: a licence, cookie, copyright or sign-up line, or one written in
  capitals throughout,
* not punctuated: ``LONG_LINE`` words or more without any sentence mark, as lists of
  keywords are. Headings and short items are below that.

Failing lines are removed, and a document is rejected when it fails the base rules
or when the removed lines held more than ``max_loss`` of its word characters.
Everything is a column expression inside the scan's own stage: no shuffle, no Python.

Defined results: a null or empty text has no words, fails the base rules and is
rejected; its cleaned text is empty. Equal rows get equal results; other columns are
carried along untouched. Helper columns live in one struct that cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values ---------------------------------------------------------------
GAP = r"[\x20\x09-\x0D]+"
WORD_CHARACTER = r"[^\x20\x09-\x0D]"
NOT_SYMBOL = r"[^#*$%&|<>]+"
BAR = r"[|»›•·>]"
NAVIGATION = r"(?:[|»›•·>][^|»›•·>]*){3,}"
SENTENCE_MARK = r"[.!?…।؟。！？]"
BOILERPLATE = (
    "licensed under", "all rights reserved", "copyright (c)", "terms of service", "terms of use",
    "privacy policy", "cookie policy", "uses cookies", "use cookies", "enable javascript",
    "click here", "sign up now", "sign up for", "subscribe to", "lorem ipsum",
)
# --------------------------------------------------------------------------------

MAX_LOSS = 0.5
SYMBOL_SHARE = 0.10  # of a line's characters
CAPITALS = 20  # characters from which a line all in capitals is shouted
LONG_LINE = 20  # words from which a line needs a sentence mark


# from the start of the line and without going back, so that its cost is the line's length
MANY_WORDS = rf"\A[\x20\x09-\x0D]*+(?:{WORD_CHARACTER}++{GAP}+){{{LONG_LINE - 1}}}{WORD_CHARACTER}"


def bound_to(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, GAP), lambda w: w != "")


def characters_in_words(text: Column) -> Column:
    return F.length(F.regexp_replace(text, GAP, ""))


def symbols_in(text: Column) -> Column:
    return F.length(F.regexp_replace(text, NOT_SYMBOL, ""))


def lines_of(text: Column) -> Column:
    """The \\n-separated lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD_CHARACTER))


def windows_of(words: Column) -> Column:
    """A 64-bit hash for every three-word window of an array of words, in order."""
    every = F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    return F.slice(every, 1, F.greatest(F.size(words) - 2, F.lit(0)))


PLACE_BITS = 24


def packed(windows: Column) -> Column:
    """Windows as sorted numbers: the high bits of the hash above the place in the text."""
    high = F.lit(-(1 << PLACE_BITS)).cast("long")
    return F.sort_array(F.transform(
        windows, lambda h, i: h.bitwiseAND(high).bitwiseOR(i.cast("long"))))


def repeated_words(windows: Column, numbers: Column) -> Column:
    """Words that stand in a three-word window occurring twice or more in the text.

    ``numbers`` is ``packed(windows)``. Neighbours with equal high bits are candidates;
    these few are sorted again by the whole hash, and equal neighbours are repeats. A
    text too long for the place bits makes every window a candidate.
    """
    near = lambda a, b: F.shiftright(a.bitwiseXOR(b), PLACE_BITS) == 0
    close = F.filter(numbers, lambda x, k: F.coalesce(
        near(x, F.get(numbers, k - 1)) | near(x, F.get(numbers, k + 1)),
        near(x, F.get(numbers, k - 1)), near(x, F.get(numbers, k + 1)), F.lit(False)))
    places = F.transform(
        close, lambda x: x.bitwiseAND(F.lit((1 << PLACE_BITS) - 1).cast("long")).cast("int"))
    every = F.transform(windows, lambda h, i: i)
    candidates = F.when(F.size(windows) < 1 << PLACE_BITS, places).otherwise(every)
    pairs = F.sort_array(F.transform(
        candidates, lambda i: F.struct(F.get(windows, i).alias("h"), i.alias("i"))))
    repeats = bound_to(pairs, lambda s: F.filter(
        s, lambda p, k: F.get(s, k - 1)["h"].eqNullSafe(p["h"])
        | F.get(s, k + 1)["h"].eqNullSafe(p["h"])))
    return F.aggregate(
        F.sort_array(F.transform(repeats, lambda p: p["i"])),
        F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda acc, at: F.struct(
            (acc["n"] + F.least(F.lit(3), at - acc["last"])).alias("n"), at.alias("last")),
        lambda acc: acc["n"])


def line_fails(line: Column, symbols: Column, phrases: Column, bars: Column) -> Column:
    """True where a line is broken by symbols, navigation, boilerplate, shouted or not punctuated.

    ``symbols``, ``phrases`` and ``bars`` say whether the whole text has any symbol,
    standard phrase or bar; without one, no line needs to be searched for it.
    """
    return (
        (symbols & (symbols_in(line) > F.length(line) * SYMBOL_SHARE))
        | (bars & line.rlike(NAVIGATION))
        | ((F.length(line) >= CAPITALS) & (line == F.upper(line)) & (line != F.lower(line)))
        | (phrases & bound_to(F.lower(line), has_phrase))
        | (~line.rlike(SENTENCE_MARK) & line.rlike(MANY_WORDS))
    )


def has_phrase(small: Column) -> Column:
    return reduce(or_, [small.contains(phrase) for phrase in BOILERPLATE])


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def judge(
    docs: DataFrame, text: str = "text", max_loss: float = MAX_LOSS, into: str = "quality"
) -> DataFrame:
    """``docs`` with a struct column ``into``: the base counts, the cleaned text, the verdict.

    Fields: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    cleaned, n_lines, n_lines_removed, chars_removed, kept. ``into`` must be a new name.
    To filter by the verdict use ``clean``, or write the result first: a filter on top is
    pushed into these nested expressions and takes the optimizer very long.
    """
    if into.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"column {into} exists already; name another with into=")
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    q = F.col(f"`{into}`")
    # columns rather than nested expressions, so that each is made once
    words, windows, numbers, lines, phrases, symbols, bars = names = [fresh(docs, c) for c in (
        "words_", "windows_", "numbers_", "lines_", "phrases_", "symbols_", "bars_")]
    split = (
        docs.withColumns({
            words: words_of(whole), lines: lines_of(whole),
            symbols: symbols_in(whole).cast("long"), phrases: has_phrase(F.lower(whole)), bars: whole.rlike(BAR),
        })
        .withColumn(windows, windows_of(F.col(words)))
        .withColumn(numbers, packed(F.col(windows)))
    )
    failed = (q["n_words"] < 50) | (100 * q["n_repeat_words"] > 50 * q["n_words"])
    marked = F.transform(F.col(lines), lambda line: F.struct(
        line.alias("line"), line_fails(
            line, F.col(symbols) > 0, F.col(phrases), F.col(bars)).alias("fails")))
    counted = split.withColumn(into, F.struct(
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.col(symbols).alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col(windows), F.col(numbers)).cast("long").alias("n_repeat_words"),
        marked.alias("marked"),
    )).drop(*names)
    good = F.filter(q["marked"], lambda m: ~m["fails"])["line"]
    bad = F.filter(q["marked"], lambda m: m["fails"])["line"]
    lost = F.aggregate(bad, F.lit(0).cast("long"),
                       lambda a, line: a + characters_in_words(line).cast("long"))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    cleaned = counted.withColumn(into, F.struct(
        *[q[c].alias(c) for c in counts],
        failed.alias("base_failed"),
        F.array_join(good, "\n").alias("cleaned"),
        F.size(q["marked"]).cast("long").alias("n_lines"),
        F.size(bad).cast("long").alias("n_lines_removed"),
        lost.alias("chars_removed"),
    ))
    kept = ~q["base_failed"] & (q["chars_removed"] <= q["word_chars"] * max_loss)
    return cleaned.withColumn(into, q.withField("kept", kept))


def clean(docs: DataFrame, text: str = "text", max_loss: float = MAX_LOSS) -> DataFrame:
    """The documents that pass, with failing lines taken out of their texts; same columns.

    ``n_chars``, where there is one, follows the cleaned text.
    """
    name, new = fresh(docs, "quality"), fresh(docs, "cleaned_")
    q = F.col(name)
    # a generator gives one cleaned text or none; a filter would be pushed into the rules
    one = F.when(q["kept"], F.array(q["cleaned"])).otherwise(F.array().cast("array<string>"))
    kept = judge(docs, text, max_loss, name).select(
        *[F.col(f"`{c}`") for c in docs.columns], F.explode(one).alias(new))
    values = {text: F.col(new)}
    if "n_chars" in docs.columns:
        values["n_chars"] = F.length(new).cast(docs.schema["n_chars"].dataType)
    return kept.select(*[values.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])
