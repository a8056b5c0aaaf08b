"""Text measures and keys as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import labels

# The characters that count as white space, as a regex class for
# runs and as a plain list for trimming, which then needs no regex.
_SPACE = r"[\s\x1c-\x1f]"
_SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    """Remove leading and trailing white space of any kind."""
    return F.btrim(text, F.lit(_SPACES))


def strip_word(word: Column) -> Column:
    """``strip`` for single words, most of which begin and end in a visible ASCII character.

    Those have nothing to strip and are not compared with the list of white space. ``word``
    should be a plain column, as it is named several times.
    """
    def visible(start: Column) -> Column:
        return (start >= "!") & (start < "\x7f")

    return F.when(visible(word) & visible(F.right(word, F.lit(1))), word).otherwise(strip(word))


def squeeze(text: Column) -> Column:
    """Collapse runs of white space to one space and strip the ends."""
    return F.trim(F.regexp_replace(text, rf"(?U){_SPACE}+", " "))


def is_blank(text: Column) -> Column:
    """True for NULL and for text made of white space only."""
    return F.coalesce(strip(text) == "", F.lit(True))


def blank_to_null(text: Column) -> Column:
    """Stripped text, or NULL when nothing is left."""
    return F.nullif(strip(text), F.lit(""))


def word_count(text: Column) -> Column:
    """Number of white-space separated tokens; NULL text counts as none."""
    return F.coalesce(
        F.regexp_count(text, F.lit(r"(?U)[^\s\x1c-\x1f]+")), F.lit(0)
    ).cast("long")


def est_tokens(text: Column) -> Column:
    """Rough model-token estimate: one per three characters."""
    return F.floor(F.length(F.coalesce(text, F.lit(""))) / 3).cast("long")


def sentence_marks(text: Column) -> Column:
    """Number of sentence-final punctuation marks."""
    return F.coalesce(F.regexp_count(text, F.lit("[.!?]")), F.lit(0)).cast("long")


def ends_sentence(text: Column) -> Column:
    """True when the text, ignoring trailing space, ends in . ! or ?"""
    return F.coalesce(F.right(strip(text), F.lit(1)).isin(".", "!", "?"), F.lit(False))


def first_letter_upper(text: Column) -> Column:
    """Whether the first letter is upper case; NULL when there is no letter."""
    letter = F.regexp_extract(text, r"\p{L}", 0)
    return F.when(letter != "", F.regexp_like(letter, F.lit(r"\p{Lu}")))


def real_word_ratio(text: Column) -> Column:
    """Share of letter tokens that look like words; NULL under twenty tokens.

    A token counts when it is at most 22 letters long, has a vowel, and its vowel
    share lies within [0.15, 0.75].
    """
    tokens = F.regexp_extract_all(text, F.lit(r"(?U)([^\W\d_]{2,})"), F.lit(1))

    def counted(token: Column) -> Column:
        size = F.length(token)
        return F.struct(size.alias("n"), (size - F.length(F.translate(token, labels.VOWELS, ""))).alias("v"))

    def plausible(token: Column) -> Column:
        size, vowels = token["n"], token["v"]
        return (
            (vowels >= 1)
            & (size <= 22)
            & (vowels / size >= F.lit(0.15))
            & (vowels / size <= F.lit(0.75))
        )

    def share(found: Column) -> Column:
        return F.when(
            F.size(found) >= labels.MIN_RATIO_WORDS,
            F.size(F.filter(F.transform(found, counted), plausible)) / F.size(found),
        )

    # a list of one list: its tokens are looked for once, not wherever they are named
    return F.get(F.transform(F.array(tokens), share), 0)


def glossary_key(term: Column) -> Column:
    """Case-insensitive key that keeps I and i together in every language."""
    return strip(F.replace(F.lower(term), F.lit(labels.COMBINING_DOT), F.lit("")))


def tr_lower(text: Column) -> Column:
    """Turkish lower case (dotless and dotted i kept apart); for ordering only."""
    dotted = F.translate(text, "Iİ", "ıi")
    return F.replace(F.lower(dotted), F.lit(labels.COMBINING_DOT), F.lit(""))


def tr_sort_key(text: Column) -> Column:
    """Array of letter positions in the Turkish alphabet; foreign letters last."""
    letters = F.filter(F.split(strip(tr_lower(text)), ""), lambda c: c != "")
    alphabet = F.lit(labels.TR_ALPHABET)

    def rank(letter: Column) -> Column:
        at = F.position(letter, alphabet)
        return F.when(at > 0, at - 1).otherwise(len(labels.TR_ALPHABET)).cast("int")

    return F.transform(letters, rank)


def clean_strings(items: Column, cap: int | None = None) -> Column:
    """Strip every element, drop blanks, optionally keep the first ``cap``."""
    kept = F.filter(F.transform(items, strip), lambda item: item != "")
    kept = F.coalesce(kept, F.array().cast("array<string>"))
    return kept if cap is None else F.slice(kept, 1, cap)


def coerce_enum(value: Column, allowed: list[str], default: str = "") -> Column:
    """Known labels pass, anything else becomes ``default``; the row is kept."""
    return F.when(value.isin(allowed), value).otherwise(F.lit(default))


def budget_crop(text: Column, limit: Column | int) -> Column:
    """First ``limit`` characters."""
    size = limit if isinstance(limit, Column) else F.lit(limit)
    return F.substr(text, F.lit(1), size.cast("int"))


def was_cropped(text: Column, limit: Column | int) -> Column:
    """Whether ``budget_crop`` loses anything."""
    size = limit if isinstance(limit, Column) else F.lit(limit)
    return F.length(text) > size
