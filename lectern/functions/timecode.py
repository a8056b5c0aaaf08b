"""Time codes, position labels and deep links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _two(number: Column) -> Column:
    digits = number.cast("string")
    return F.when(number < 10, F.concat(F.lit("0"), digits)).otherwise(digits)


def fmt_ts(seconds: Column) -> Column:
    """``HH:MM:SS`` from one hour on, otherwise ``MM:SS``; fractions are cut."""
    total = seconds.cast("long")
    hours = F.floor(total / 3600).cast("long")
    minutes = F.floor((total % 3600) / 60).cast("long")
    tail = F.concat(_two(minutes), F.lit(":"), _two(total % 60))
    return F.when(hours > 0, F.concat(_two(hours), F.lit(":"), tail)).otherwise(tail)


def parse_ts(text: Column) -> Column:
    """Fold the last three digit runs base 60; no digits read as zero."""
    runs = F.regexp_extract_all(text, F.lit(r"(\d+)"), F.lit(1))
    size = F.size(runs)
    last = F.slice(runs, F.greatest(size - 2, F.lit(1)), F.lit(3))
    folded = F.aggregate(last, F.lit(0.0), lambda acc, run: acc * 60 + run.cast("double"))
    return F.when(size > 0, folded).otherwise(F.lit(0.0))


def stamped_line(seconds: Column, text: Column) -> Column:
    """``[time] text``."""
    return F.concat(F.lit("["), fmt_ts(seconds), F.lit("] "), text)


def position_label(number: Column, short: str) -> Column:
    """``s. 3`` for page three, ``b. 3`` for block three."""
    return F.concat(F.lit(f"{short} "), number.cast("long").cast("string"))


def _encode(text: Column) -> Column:
    # Form encoding; the tilde stays literal and the star is escaped.
    return F.replace(
        F.replace(F.url_encode(text), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A")
    )


def _decode(text: Column) -> Column:
    return F.coalesce(F.try_url_decode(text), F.replace(text, F.lit("+"), F.lit(" ")))


def deep_link(url: Column, seconds: Column) -> Column:
    """Markdown label for a moment: linked when there is a url, else code.

    The query keeps its first key order with the last value of each key, blank
    values vanish, and ``t`` is set to whole seconds.
    """
    label = F.concat(F.lit("`"), fmt_ts(seconds), F.lit("`"))
    moment = F.concat(seconds.cast("long").cast("string"), F.lit("s"))
    parts = r"(?s)\A([^?#]*)(?:\?([^#]*))?(?:#(.*))?\z"
    base = F.regexp_extract(url, parts, 1)
    scheme = F.regexp_extract(base, r"\A([A-Za-z][A-Za-z0-9+.\-]*:)", 1)
    base = F.concat(F.lower(scheme), F.substr(base, F.length(scheme) + 1))
    query = F.regexp_extract(url, parts, 2)
    fragment = F.regexp_extract(url, parts, 3)

    fields = F.filter(F.split(query, "&"), lambda f: F.regexp_like(f, F.lit(r"(?s)=.")))
    pairs = F.transform(
        fields,
        lambda f: F.struct(
            _decode(F.substring_index(f, "=", 1)).alias("k"),
            _decode(F.substr(f, F.length(F.substring_index(f, "=", 1)) + 2)).alias("v"),
        ),
    )
    keys = F.array_distinct(
        F.concat(F.transform(pairs, lambda p: p["k"]), F.array(F.lit("t")))
    )

    def render(key: Column) -> Column:
        latest = F.element_at(F.filter(pairs, lambda p: p["k"] == key), -1)["v"]
        return F.concat(
            _encode(key), F.lit("="), _encode(F.when(key == "t", moment).otherwise(latest))
        )

    target = F.concat(
        base,
        F.lit("?"),
        F.array_join(F.transform(keys, render), "&"),
        F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(F.lit("")),
    )
    linked = F.concat(F.lit("["), label, F.lit("]("), target, F.lit(")"))
    return F.when(F.coalesce(url, F.lit("")) == "", label).otherwise(linked)
