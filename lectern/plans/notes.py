"""Study notes as ordered markdown lines.

A renderer unions small child tables into ``(source_id, ord, line)`` rows; nothing
is gathered per source. ``ord`` is (block, item time, item, line), so the lines of
a note sort globally. ``note_pieces`` joins the lines of one block into a text, and
the pieces of a source in order, joined by newlines, are its note.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import labels
from ..functions.naming import whole_title
from ..functions.text import is_blank, tr_sort_key
from ..functions.timecode import deep_link, fmt_ts, position_label
from ..operators.transcripts import join_ordered

# The order of blocks in a note.
_HEAD, _SECTIONS, _TERMS, _STEPS, _ACTIONS, _QUIZ, _DEEPEN, _UNREAD, _FOOT = range(9)


def _lines(df: DataFrame, block: int, at: Column, item, texts: Column) -> DataFrame:
    """Rows for an array of lines; NULL lines are left out."""
    item = F.lit(item) if isinstance(item, str) else item
    return df.select(
        "source_id", F.lit(block).alias("block"), at.cast("double").alias("at"),
        item.alias("item"), F.posexplode(texts).alias("row", "line"),
    ).where(F.col("line").isNotNull())


_NO_KEY = ""


def _key(column: str) -> Column:
    """A sortable text of a whole number."""
    return F.lpad(F.col(column).cast("string"), 12, "0")


def _learning(learning: DataFrame) -> list[DataFrame]:
    zero = F.lit(0.0)

    def listed(name: str, heading: str, block: int, line) -> DataFrame:
        body = F.transform(F.col(name), line)
        lines = F.concat(F.array(F.lit(heading), F.lit("")), body, F.array(F.lit("")))
        return _lines(learning.where(F.size(name) > 0), block, zero, _NO_KEY, lines)

    steps = listed(
        "steps", "## Adım adım uygula", _STEPS,
        lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s),
    )
    actions = listed(
        "actions", "## Bu hafta yap", _ACTIONS, lambda a: F.concat(F.lit("- "), a)
    )
    quiz = learning.where(F.size("quiz") > 0).withColumn(
        "quiz",
        F.flatten(F.transform("quiz", lambda q: F.array(
            F.concat(F.lit("- **"), q["soru"], F.lit("**")),
            F.concat(F.lit("  <sub>Cevap: "), q["cevap"], F.lit("</sub>")),
        ))),
    )
    quiz = _lines(
        quiz, _QUIZ, zero, _NO_KEY,
        F.concat(F.array(F.lit("## Kendini test et"), F.lit("")), F.col("quiz"), F.array(F.lit(""))),
    )
    deepen = _lines(
        learning.where(F.col("deepen_prompt") != ""), _DEEPEN, zero, _NO_KEY,
        F.array(
            F.lit("## Daha derine — araştırma prompt'u"), F.lit(""),
            F.lit("Bunu ChatGPT ya da Claude'a olduğu gibi yapıştır:"), F.lit(""),
            F.lit("```"), F.col("deepen_prompt"), F.lit("```"), F.lit(""),
        ),
    )
    return [steps, actions, quiz, deepen]


def _glossary(glossary: DataFrame) -> list[DataFrame]:
    heading = _lines(
        glossary.select("source_id").distinct(), _TERMS, F.lit(-1.0), _NO_KEY,
        F.array(F.lit("## Terimler"), F.lit("")),
    )
    # letters become fixed-width numbers, so the text sorts like the key
    order = F.concat(
        F.array_join(
            F.transform(tr_sort_key(F.col("term")), lambda n: F.lpad(n.cast("string"), 2, "0")), ""
        ),
        F.lit(" "), _key("pos"),
    )
    line = F.concat(F.lit("- **"), F.col("term"), F.lit("** — "), F.col("definition"))
    body = _lines(glossary, _TERMS, F.lit(0.0), order, F.array(line))
    tail = _lines(
        glossary.select("source_id").distinct(), _TERMS, F.lit(1.0), _NO_KEY, F.array(F.lit(""))
    )
    return [heading, body, tail]


def _head(sources: DataFrame, tldr: DataFrame, facts: Column) -> list[DataFrame]:
    zero = F.lit(0.0)
    top = _lines(
        sources, _HEAD, F.lit(-2.0), _NO_KEY,
        F.array(F.concat(F.lit("# "), F.col("title")), F.lit(""), facts, F.lit(""),
                F.lit("## TL;DR"), F.lit("")),
    )
    bullets = _lines(
        tldr, _HEAD, zero, _key("pos"), F.array(F.concat(F.lit("- "), F.col("bullet")))
    )
    detail = _lines(
        sources, _HEAD, F.lit(1.0), _NO_KEY,
        F.array(F.lit(""), F.lit(labels.DETAIL_HEADING), F.lit("")),
    )
    return [top, bullets, detail]


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table)
    return out.select(
        "source_id", "block", "at", F.struct("block", "at", "item", "row").alias("ord"), "line"
    )


def _counts(df: DataFrame, name: str, condition: Column | None = None) -> DataFrame:
    n = F.count(F.lit(1)) if condition is None else F.count_if(condition)
    return df.groupBy("source_id").agg(n.alias(name))


def render_timed(
    sources: DataFrame, sections: DataFrame, points: DataFrame, tldr: DataFrame,
    glossary: DataFrame, learning: DataFrame, frames: DataFrame | None = None,
    added: DataFrame | None = None,
) -> DataFrame:
    """Note lines of timed sources.

    ``sources``: title, duration, url, uploader. ``sections``: sec_start, start,
    title, summary. ``points``: sec_start, ts, seq, added, text. ``tldr``: pos,
    bullet. ``glossary``: pos, term, definition. ``learning``: as decoded.
    ``frames``: sec_start, ts, frame_idx, path, conf, rotation, quarantined.
    ``added``: critic_added.
    """
    facts = F.concat_ws(
        " · ",
        F.concat(F.lit("Süre: "), fmt_ts(F.col("duration"))),
        F.when(~is_blank(F.col("uploader")), F.concat(F.lit("Kanal: "), F.col("uploader"))),
        F.when(~is_blank(F.col("url")), F.concat(F.lit("[Kaynak]("), F.col("url"), F.lit(")"))),
    )
    urls = sources.select("source_id", "url")
    at = F.col("sec_start")
    heading = _lines(
        sections.join(urls, "source_id"), _SECTIONS, at, F.lit("0"),
        F.array(
            F.concat(F.lit("### "), deep_link(F.col("url"), F.col("start")), F.lit(" "), "title"),
            F.lit(""), F.col("summary"), F.lit(""),
        ),
    )
    moment = F.concat(F.lpad((F.col("ts") * 1000).cast("long").cast("string"), 15, "0"))
    item = F.concat(F.lit("1 "), moment, F.col("added").cast("string"), _key("seq"))
    bullets = _lines(
        points.join(urls, "source_id"), _SECTIONS, at, item,
        F.array(F.concat(F.lit("- "), deep_link(F.col("url"), F.col("ts")), F.lit(" "), "text")),
    )
    gap = _lines(sections, _SECTIONS, at, F.lit("2"), F.array(F.lit("")))
    tables = [*_head(sources, tldr, facts), heading, bullets, gap]
    used = None
    if frames is not None:
        link = deep_link(F.col("url"), F.col("ts"))
        bad = F.concat(
            F.lit("<sub>"), link, F.lit(" bu ekranı okuyamadım (güven medyanı "),
            F.col("conf").cast("string"),
            F.lit(f", {len(labels.ROTATIONS)} açı denendi). "
                  "Metnini özete katmadım — işte görüntüsü, sen bak.</sub>"),
        )
        turned = F.when(
            F.col("rotation") != 0,
            F.concat(F.lit(", "), F.col("rotation").cast("string"), F.lit("° döndürülerek okundu")),
        ).otherwise("")
        fine = F.concat(F.lit("<sub>"), link, F.lit(" ekran görüntüsü"), turned, F.lit("</sub>"))
        picture = F.concat(
            F.lit("![Ekran "), fmt_ts(F.col("ts")), F.lit("]("), F.col("path"), F.lit(")")
        )
        shown = F.array(picture, F.when(F.col("quarantined"), bad).otherwise(fine), F.lit(""))
        tables.append(_lines(
            frames.join(urls, "source_id"), _SECTIONS, at,
            F.concat(F.lit("3 "), moment, _key("frame_idx")), shown,
        ))
        used = _counts(frames, "frames_used")
    tables += [*_glossary(glossary), *_learning(learning)]
    totals = sources.select("source_id").join(_counts(sections, "_sections"), "source_id", "left")
    totals = _with_counts(totals, added, used)
    footer = F.concat(
        F.lit("<sub>Otomatik üretildi · "), _text("_sections"), F.lit(" bölüm · eleştirmen geçişi "),
        _text("critic_added"), F.lit(" eksik madde ekledi"),
        F.when(
            F.col("frames_used") > 0,
            F.concat(F.lit(" · "), _text("frames_used"), F.lit(" slayt OCR ile okundu")),
        ).otherwise(""),
        F.lit("</sub>"),
    )
    tables.append(_lines(totals, _FOOT, F.lit(0.0), _NO_KEY,
                         F.array(F.lit("---"), F.lit(""), footer, F.lit(""))))
    return _union(tables)


def _text(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(0)).cast("string")


def _with_counts(totals: DataFrame, added: DataFrame | None, used: DataFrame | None) -> DataFrame:
    for table, name in ((added, "critic_added"), (used, "frames_used")):
        if table is None:
            totals = totals.withColumn(name, F.lit(0))
        else:
            totals = totals.join(table.select("source_id", name), "source_id", "left")
    return totals


def render_paged(
    sources: DataFrame, pages: DataFrame, sections: DataFrame, points: DataFrame, tldr: DataFrame,
    glossary: DataFrame, learning: DataFrame, unit: str = "sayfa", short: str = "s.",
    added: DataFrame | None = None,
) -> DataFrame:
    """Note lines of paged sources, with the pages that could not be read."""
    counted = pages.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("_pages"),
        F.count_if(~F.col("quarantined") & ~is_blank(F.col("text"))).alias("_read"),
        F.count_if("quarantined").alias("_bad"),
    )
    facts_of = sources.join(counted, "source_id", "left")
    size = F.concat(
        _text("_pages"), F.lit(f" {unit} · "), _text("_read"), F.lit(" okundu")
    )
    at = F.col("sec_start")
    heading = _lines(
        sections, _SECTIONS, at, F.lit("0"),
        F.array(
            F.concat(F.lit("### "), position_label(F.col("start"), short), F.lit(" · "), "title"),
            F.lit(""), F.col("summary"), F.lit(""),
        ),
    )
    moment = F.lpad((F.col("ts") * 1000).cast("long").cast("string"), 15, "0")
    item = F.concat(F.lit("1 "), moment, F.col("added").cast("string"), _key("seq"))
    bullets = _lines(
        points, _SECTIONS, at, item,
        F.array(F.concat(
            F.lit("- `"), position_label(F.col("ts"), short), F.lit("` "), F.col("text")
        )),
    )
    gap = _lines(sections, _SECTIONS, at, F.lit("2"), F.array(F.lit("")))
    unread = pages.where("quarantined")
    opening = _lines(
        unread.select("source_id").distinct(), _UNREAD, F.lit(-1.0), _NO_KEY,
        F.array(
            F.lit(f"## Okuyamadığım {unit}lar"), F.lit(""),
            F.lit(f"Bu {unit}ların metnini özete katmadım. Kanıtı önünde — sen bak."), F.lit(""),
        ),
    )
    number = F.col("number").cast("string")
    evidence = _lines(
        unread, _UNREAD, F.col("number"), _NO_KEY,
        F.array(
            F.when(
                F.col("img_rel").isNotNull(),
                F.concat(F.lit(f"![{unit.capitalize()} "), number, F.lit("]("), F.col("img_rel"),
                         F.lit(")")),
            ),
            F.concat(
                F.lit("<sub>`"), position_label(F.col("number"), short),
                F.lit("` okunamadı (güven medyanı "),
                F.coalesce(F.col("conf").cast("string"), F.lit("None")),
                F.lit(f", {len(labels.ROTATIONS)} açı denendi).</sub>"),
            ),
            F.lit(""),
        ),
    )
    totals = facts_of.join(_counts(sections, "_sections"), "source_id", "left")
    totals = _with_counts(totals, added, None)
    footer = F.concat(
        F.lit("<sub>Otomatik üretildi · "), size, F.lit(" · "), _text("_sections"),
        F.lit(" bölüm · eleştirmen "), _text("critic_added"), F.lit(" madde ekledi"),
        F.when(
            F.col("_bad") > 0, F.concat(F.lit(" · "), _text("_bad"), F.lit(f" {unit} karantinada"))
        ).otherwise(""),
        F.lit("</sub>"),
    )
    return _union([
        *_head(facts_of, tldr, size), heading, bullets, gap, *_glossary(glossary),
        *_learning(learning), opening, evidence,
        _lines(totals, _FOOT, F.lit(0.0), _NO_KEY,
               F.array(F.lit("---"), F.lit(""), footer, F.lit(""))),
    ])


def render_combined(parents: DataFrame, parts: DataFrame, tldr: DataFrame, titles: DataFrame,
                    failures: DataFrame) -> DataFrame:
    """Lines of the combined note of a split source.

    ``parents``: source_id, title, parts. ``parts``: part, part_title of good parts.
    ``tldr``: part, pos, bullet. ``titles``: part, sec_start, title.
    ``failures``: part, part_title, error.
    """
    head = _lines(
        parents, 0, F.lit(0.0), _NO_KEY,
        F.array(
            F.concat(F.lit("# "), whole_title(F.col("title"))), F.lit(""),
            F.concat(F.col("parts").cast("string"),
                     F.lit(" parça · her parçanın kendi ayrıntılı özeti ayrı girdide.")),
            F.lit(""),
        ),
    )
    at = F.col("part")
    names = _lines(parts, 1, at, F.lit("0"),
                   F.array(F.concat(F.lit("## "), F.col("part_title")), F.lit("")))
    bullets = _lines(tldr, 1, at, F.concat(F.lit("1 "), _key("pos")),
                     F.array(F.concat(F.lit("- "), F.col("bullet"))))
    joined = titles.groupBy("source_id", "part").agg(
        join_ordered(["sec_start"], F.col("title"), " · ").alias("_titles")
    )
    contents = _lines(joined, 1, at, F.lit("2"),
                      F.array(F.lit(""), F.concat(F.lit("_Bölümler:_ "), F.col("_titles"))))
    gaps = _lines(parts, 1, at, F.lit("3"), F.array(F.lit("")))
    lost = failures.select("source_id").distinct()
    opening = _lines(
        lost, 2, F.lit(-1.0), _NO_KEY,
        F.array(
            F.lit("## İşlenemeyen parçalar"), F.lit(""),
            F.lit("Bu parçalar tamamlanamadı (sebebi yanlarında); tek tek 'tekrar dene' ile "
                  "denenebilir."), F.lit(""),
        ),
    )
    reasons = _lines(
        failures, 2, at, _NO_KEY,
        F.array(F.concat(F.lit("- **"), F.col("part_title"), F.lit("** — "), F.col("error"))),
    )
    closing = _lines(lost, 3, F.lit(0.0), _NO_KEY, F.array(F.lit("")))
    return _union([head, names, bullets, contents, gaps, opening, reasons, closing])


def note_pieces(lines: DataFrame) -> DataFrame:
    """``(source_id, block, at, text)``: one text per head, section, list and footer."""
    return lines.groupBy("source_id", "block", "at").agg(
        F.array_join(
            F.transform(
                F.sort_array(F.collect_list(F.struct("ord", "line"))), lambda c: c["line"]
            ), "\n",
        ).alias("text")
    )


def with_truncation_banner(notes: DataFrame, coverage: DataFrame, wording: str) -> DataFrame:
    """Put a warning before the notes of sources whose pages were not all processed.

    ``wording`` has ``{total}`` and ``{processed}``; ``notes`` has source_id and text.
    """
    text = F.replace(F.lit(wording), F.lit("{total}"), F.col("total").cast("string"))
    text = F.replace(text, F.lit("{processed}"), F.col("processed").cast("string"))
    joined = notes.join(coverage.select("source_id", "total", "processed"), "source_id", "left")
    cut = (F.col("processed") > 0) & (F.col("processed") < F.col("total"))
    return joined.withColumn(
        "text", F.when(cut, F.concat(text, F.lit("\n\n"), F.col("text"))).otherwise(F.col("text"))
    ).select(*notes.columns)

