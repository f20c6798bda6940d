"""Sectioning: whole texts to chapters and paragraphs, one row per text throughout, so nothing is shuffled.

Lines are numbered within an array; headings, sections and paragraphs are positions in it. A section is the slice of lines between two
headings, and a paragraph a run of lines without a blank one, found by joining a section's lines and splitting at blank ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import blank, canonical_punctuation, canonical_quotes, strip


def lines(text: Column) -> Column:
    return F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n", -1)


def without_boilerplate(lines: Column) -> Column:
    """Lines after the first start marker and before the first end marker, each if there is one."""
    numbered = F.transform(lines, lambda line, i: F.struct(i.alias("i"), line.alias("line")))
    first = lambda pattern: F.element_at(F.filter(numbered, lambda x: x["line"].rlike(pattern)), 1)["i"]
    any_of = lambda pattern: F.exists(lines, lambda x: x.rlike(pattern))
    start = F.when(any_of(fixed.BOILERPLATE_START), first(fixed.BOILERPLATE_START) + 1).otherwise(0)
    end = F.when(any_of(fixed.BOILERPLATE_END), first(fixed.BOILERPLATE_END)).otherwise(F.size(lines))
    return F.slice(lines, start + 1, F.greatest(end - start, F.lit(0)))


def heading(line: Column, lang: str = "en", pattern: str | None = None, markdown: bool = False) -> Column:
    """The title that a line is, or null. A pattern of one's own replaces the language's, not the bare numerals."""
    if markdown:
        return F.when(line.rlike(fixed.MARKDOWN_HEADING), F.regexp_extract(line, fixed.MARKDOWN_HEADING, 2))
    s = strip(line)
    own = f"^(?:{pattern})" if pattern else fixed.HEADING[lang]
    return F.when(~blank(line) & (s.rlike(own) | s.rlike(fixed.BARE_NUMERAL)), s)


def paragraphs(lines: Column, lang: str = "en") -> Column:
    """Blocks between blank lines; lines of a block are unwrapped, by a space in English and by nothing in Chinese."""
    cleaned = F.transform(lines, strip)
    marked = F.array_join(F.transform(cleaned, lambda s: F.when(s == "", "\x02").otherwise(F.concat(F.lit("\x01"), s))), "")
    blocks = F.transform(F.split(marked, "\x02+", -1), lambda b: F.array_join(F.split(F.regexp_replace(b, "^\x01", ""), "\x01", -1), "" if lang == "zh" else " "))
    tidy = F.transform(blocks, lambda b: strip(F.regexp_replace(b, "[ \t]+", " ")))
    return F.transform(F.filter(tidy, lambda b: b != ""), lambda b: canonical_punctuation(canonical_quotes(b)))


def chapters(books: DataFrame, lang: str = "en", pattern: str | None = None, markdown: bool = False, key: str = "book") -> DataFrame:
    """(key, chapter, title, paragraphs) of books (key, text): dense numbers, and default titles by the place among all sections.

    Each step is a column of its own: an expression that a later lambda uses would be evaluated anew for every element.
    """
    rows = books.select(F.col(key).alias("key"), lines(F.coalesce("text", F.lit(""))).alias("lines"))
    rows = rows.select("key", without_boilerplate(F.col("lines")).alias("body"))
    numbered = F.transform("body", lambda line, i: F.struct(i.alias("i"), heading(line, lang, pattern, markdown).alias("title")))
    rows = rows.select("key", "body", F.filter(numbered, lambda x: x["title"].isNotNull()).alias("heads"))
    starts = F.concat(F.array(F.struct(F.lit(-1).alias("i"), F.lit("").alias("title"))), F.col("heads"))
    ends = F.concat(F.transform("heads", lambda x: x["i"]), F.array(F.size("body")))
    parts = F.zip_with(starts, ends, lambda s, e: F.struct(s["title"].alias("title"), F.slice("body", s["i"] + 2, e - s["i"] - 1).alias("body")))
    rows = rows.select("key", F.filter(parts, lambda s: (s["title"] != "") | F.exists(s["body"], lambda x: ~blank(x))).alias("kept"))
    titled = F.transform("kept", lambda s, i: F.struct(F.when(s["title"] == "", F.concat(F.lit("Chapter "), (i + 1).cast("string"))).otherwise(s["title"]).alias("title"), (s["title"] != "").alias("named"), paragraphs(s["body"], lang).alias("paragraphs")))
    rows = rows.select("key", titled.alias("titled"))
    full = F.filter("titled", lambda s: s["named"] | (F.size(s["paragraphs"]) > 0))
    return rows.select("key", F.posexplode(full).alias("chapter", "c")).select(F.col("key").alias(key), "chapter", "c.title", "c.paragraphs")


def paragraph_rows(chapters: DataFrame, key: str = "book") -> DataFrame:
    """(key, chapter, para, text): one row per paragraph."""
    return chapters.select(key, "chapter", F.posexplode("paragraphs").alias("para", "text"))


def summary(chapters: DataFrame) -> DataFrame:
    return chapters.agg(F.count(F.lit(1)).alias("chapters"), F.coalesce(F.sum(F.size("paragraphs")), F.lit(0)).cast("long").alias("paragraphs"))
