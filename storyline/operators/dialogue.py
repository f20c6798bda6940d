"""Dialogue: quoted spans of paragraphs, and their speakers by rule. One row per chapter throughout; no shuffle, no Python.

A paragraph is cut at its quote marks. Even pieces are narration and odd ones quoted, or the other way round where a quote of the paragraph
before is still open. Whether it is follows from the paragraphs' numbers of marks alone, in one fold per chapter.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import let, strip
from .cast import Character, resolver

SPAN = "struct<kind:string,text:string,speaker:string,confidence:double,quote_id:int>"


def carried(paragraphs: Column) -> Column:
    """For each paragraph, whether it starts within a quote; one more for what would follow the last."""

    def after(state: Column, p: Column) -> Column:
        marks = F.length(p) - F.length(F.replace(p, F.lit('"'), F.lit("")))
        inside = F.try_element_at(state, F.lit(-1))
        left = marks - F.startswith(p, F.lit('"')).cast("int")
        return F.array_append(state, F.when(inside, (left > 0) & ((left - 1) % 2 == 1)).otherwise(marks % 2 == 1))

    return F.aggregate(paragraphs, F.array(F.lit(False)), after)


def scare_quote(text: Column, lang: str) -> Column:
    """A short quoted term without punctuation is a name or a notion, no speech."""
    few = F.length(text) <= 4 if lang == "zh" else F.size(F.split(text, r"(?U)\s+", -1)) <= 2
    return (text != "") & ~text.rlike(fixed.SENTENCE_PUNCTUATION) & few


def spans(paragraph: Column, inside: Column, lang: str = "en") -> Column:
    """Array of struct(kind, text) of a paragraph."""
    text = F.when(inside, F.regexp_replace(paragraph, '^"', "")).otherwise(paragraph)
    pieces = F.transform(F.split(text, '"', -1), strip)
    last = F.size(pieces) - 1

    def cut(p: Column, i: Column) -> Column:
        quoted = F.when(inside, i % 2 == 0).otherwise(i % 2 == 1)
        lead, tail = inside & (i == 0), (i == last) & ~(inside & (i == 0))
        speech = quoted & F.when(lead, p != "").when(tail, F.lit(True)).otherwise((p != "") & ~scare_quote(p, lang))
        return F.struct(F.when(speech, "dialogue").otherwise("narration").alias("kind"), p.alias("text"), (speech | (p != "")).alias("there"))

    kept = F.filter(F.transform(pieces, cut), lambda s: s["there"])
    return F.transform(kept, lambda s: F.struct(s["kind"].alias("kind"), s["text"].alias("text")))


def matched_name(text: Column, patterns: Sequence[str], resolve: Callable[[Column], Column]) -> Column:
    """The first pattern's name that resolves, whole or by ever fewer of its words."""

    def resolved(name: Column) -> Column:
        words = F.split(name, r"(?U)\s+", -1)
        shorter = let(words, lambda w: F.coalesce(*(F.when(F.size(w) > n, resolve(F.array_join(F.slice(w, 1, n), " "))) for n in (3, 2, 1))))
        return F.when((name != "") & ~F.lower(name).isin(fixed.NO_NAMES), F.coalesce(resolve(name), shorter))

    return F.coalesce(*(let(F.regexp_replace(strip(F.regexp_extract(text, p, 1)), "[.,;:]+$", ""), resolved) for p in patterns))


def tagged(paragraph: Column, lang: str, resolve: Callable[[Column], Column]) -> Column:
    """spans with speaker and confidence: by the tag after a quote, else by the one before it."""

    def attribute(s: Column, i: Column) -> Column:
        beside = lambda k: F.get(paragraph, i + k)
        after = F.when(beside(1)["kind"] == "narration", matched_name(beside(1)["text"], fixed.TAGS_AFTER[lang], resolve))
        before = F.when((i > 0) & (beside(-1)["kind"] == "narration"), matched_name(beside(-1)["text"], fixed.TAGS_BEFORE[lang], resolve))
        speaker = F.when(s["kind"] == "narration", "narrator").otherwise(F.coalesce(after, before))
        sure = F.when(s["kind"] == "narration", fixed.NARRATED).when(speaker.isNotNull(), fixed.TAGGED).otherwise(0.0)
        return F.struct(s["kind"].alias("kind"), s["text"].alias("text"), speaker.alias("speaker"), sure.alias("confidence"))

    return F.transform(paragraph, attribute)


def with_split_quotes(paragraph: Column) -> Column:
    """Quotes around a short narration have one speaker. Left to right, so that a speaker goes on through several."""

    def spread(state: Column, i: Column) -> Column:
        a, mid, b = F.get(state, i - 2), F.get(state, i - 1), F.get(state, i)
        pair = (a["kind"] == "dialogue") & (b["kind"] == "dialogue") & (mid["kind"] == "narration") & (F.length(mid["text"]) < 60)
        forth = pair & a["speaker"].isNotNull() & b["speaker"].isNull()
        back = pair & b["speaker"].isNotNull() & a["speaker"].isNull()

        def changed(s: Column, k: Column) -> Column:
            taken = F.when(forth & (k == i), a["speaker"]).when(back & (k == i - 2), b["speaker"])
            return F.struct(s["kind"].alias("kind"), s["text"].alias("text"), F.coalesce(taken, s["speaker"]).alias("speaker"), F.when(taken.isNotNull(), fixed.SPLIT_QUOTE).otherwise(s["confidence"]).alias("confidence"))

        return F.when(forth | back, F.transform(state, changed)).otherwise(state)

    steps = F.when(F.size(paragraph) > 2, F.sequence(F.lit(2), F.size(paragraph) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, paragraph, spread)


def continued_speakers(paras: Column) -> Column:
    """For each paragraph, the speaker that its first span goes on with, or null. paras: array of struct(spans, open_end)."""

    def after(state: Column, p: Column) -> Column:
        before = F.try_element_at(state, F.lit(-1))
        first, last, one = F.get(p["spans"], F.lit(0)), F.try_element_at(p["spans"], F.lit(-1)), F.size(p["spans"]) == 1
        takes = F.when((first["kind"] == "dialogue") & first["speaker"].isNull(), before["open"])
        ends = F.when(last["kind"] == "dialogue", F.coalesce(last["speaker"], F.when(one, takes)))
        return F.array_append(state, F.struct(takes.alias("takes"), F.when(p["open_end"], ends).alias("open")))

    start = F.array(F.struct(F.lit(None).cast("string").alias("takes"), F.lit(None).cast("string").alias("open")))
    return F.transform(F.slice(F.aggregate(paras, start, after), 2, F.size(paras)), lambda s: s["takes"])


def dialogue_array(paragraphs: Column, cast: Sequence[Character], lang: str = "en") -> Column:
    """Array, per paragraph, of struct(para, open_end, spans) with speakers by all rules. Quote numbers come with `numbered`."""
    resolve = resolver(cast)
    inside = carried(paragraphs)
    raw = F.transform(paragraphs, lambda p, i: F.struct(i.alias("para"), F.get(inside, i + 1).alias("open_end"), spans(p, F.get(inside, i), lang).alias("spans")))
    return F.transform(raw, lambda p: F.struct(p["para"].alias("para"), p["open_end"].alias("open_end"), with_split_quotes(tagged(p["spans"], lang, resolve)).alias("spans")))


def with_continuations(paras: Column) -> Column:
    takes = continued_speakers(paras)

    def fill(p: Column, i: Column) -> Column:
        taken = F.get(takes, i)
        first = lambda s, k: F.struct(s["kind"].alias("kind"), s["text"].alias("text"), F.when((k == 0) & taken.isNotNull(), taken).otherwise(s["speaker"]).alias("speaker"), F.when((k == 0) & taken.isNotNull(), fixed.CONTINUED).otherwise(s["confidence"]).alias("confidence"))
        return F.struct(p["para"].alias("para"), p["open_end"].alias("open_end"), F.transform(p["spans"], first).alias("spans"))

    return F.transform(paras, fill)


def span_rows(chapters: DataFrame, cast: Sequence[Character], lang: str = "en") -> DataFrame:
    """(chapter, para, span, kind, text, speaker, confidence, quote_id, open_end) of chapters (chapter, paragraphs).

    Without a cast every paragraph is one narration. Each step is a column of its own, so no expression is evaluated again within the next.
    """
    if not cast:
        rows = chapters.select("chapter", F.posexplode("paragraphs").alias("para", "text"))
        return rows.select("chapter", "para", F.lit(0).alias("span"), F.lit("narration").alias("kind"), "text", F.lit("narrator").alias("speaker"), F.lit(fixed.NARRATED).alias("confidence"), F.lit(None).cast("int").alias("quote_id"), F.lit(False).alias("open_end"))
    paras = chapters.select("chapter", dialogue_array(F.col("paragraphs"), cast, lang).alias("paras"))
    paras = paras.select("chapter", with_continuations(F.col("paras")).alias("paras"))
    said = F.flatten(F.transform("paras", lambda p: F.transform(p["spans"], lambda s, i: F.struct(p["para"].alias("para"), i.alias("span"), p["open_end"].alias("open_end"), s["kind"].alias("kind"), s["text"].alias("text"), s["speaker"].alias("speaker"), s["confidence"].alias("confidence")))))
    rows = paras.select("chapter", F.explode(numbered(said)).alias("s")).select("chapter", "s.*")
    return rows.select("chapter", "para", "span", "kind", "text", "speaker", "confidence", "quote_id", "open_end")


def numbered(said: Column) -> Column:
    """Spans of a chapter, with numbers from 1 for its quotes in order: the quotes first, then the narration, as rows have their places."""
    fields = ("para", "span", "open_end", "kind", "text", "speaker", "confidence")
    given = lambda s, number: F.struct(*(s[f].alias(f) for f in fields), number.cast("int").alias("quote_id"))
    quotes = F.transform(F.filter(said, lambda s: s["kind"] == "dialogue"), lambda s, i: given(s, i + 1))
    return F.concat(quotes, F.transform(F.filter(said, lambda s: s["kind"] != "dialogue"), lambda s: given(s, F.lit(None))))
