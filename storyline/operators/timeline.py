"""Timelines: pauses between lines, offsets, chapter markers and their metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed


def with_offsets(lines: DataFrame, pauses: dict[str, float] = fixed.PAUSES, order: str = "id") -> DataFrame:
    """lines (chapter, speaker, duration) with pause (before the line), start and end in their chapter, in seconds."""
    w = W.partitionBy("chapter").orderBy(order)
    before = F.lag("speaker").over(w)
    first = F.row_number().over(w) == 1
    rows = lines.withColumn("pause", F.when(first, pauses["chapter"]).when(F.col("speaker").eqNullSafe(before), pauses["paragraph"]).otherwise(pauses["speaker_change"]))
    end = F.sum(F.col("pause") + F.col("duration")).over(w.rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("end", end).withColumn("start", F.col("end") - F.col("duration"))


def chapter_durations(lines: DataFrame, pauses: dict[str, float] = fixed.PAUSES, order: str = "id") -> DataFrame:
    """(chapter, lines, duration) with all pauses, the one at the end too."""
    rows = with_offsets(lines, pauses, order)
    return rows.groupBy("chapter").agg(F.count(F.lit(1)).alias("lines"), (F.sum(F.col("pause") + F.col("duration")) + pauses["paragraph"]).alias("duration"))


def markers(chapters: DataFrame) -> DataFrame:
    """chapters (book, chapter, title, duration) with start_ms and end_ms, one book's chapters after each other."""
    end = F.sum("duration").over(W.partitionBy("book").orderBy("chapter").rowsBetween(W.unboundedPreceding, 0))
    start = F.coalesce(F.sum("duration").over(W.partitionBy("book").orderBy("chapter").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    whole = lambda seconds: F.floor(F.round(seconds * 1000, 3)).cast("long")  # noqa: E731  a sum a hair under a millisecond is that millisecond
    return chapters.withColumn("start_ms", whole(start)).withColumn("end_ms", whole(end))


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([=;#\\\n])", r"\\$1")


def metadata(markers: DataFrame, genre: str = "Speech") -> DataFrame:
    """(book, metadata): the chapter metadata file of each book; markers has book, author, chapter, title, start_ms, end_ms."""
    one = F.concat(F.lit("[CHAPTER]\nTIMEBASE=1/1000\nSTART="), F.col("start_ms").cast("string"), F.lit("\nEND="), F.col("end_ms").cast("string"), F.lit("\ntitle="), escaped(F.col("title")), F.lit("\n"))
    all_of = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chapter", one.alias("t")))), lambda x: x["t"]), "\n")
    head = F.concat(F.lit(";FFMETADATA1\ntitle="), escaped(F.col("book")), F.lit("\nartist="), escaped(F.col("author")), F.lit("\nalbum="), escaped(F.col("book")), F.lit("\ngenre="), escaped(F.lit(genre)), F.lit("\n\n"))
    return markers.groupBy("book", "author").agg(all_of.alias("body")).select("book", F.concat(head, F.col("body")).alias("metadata"))


def concat_list(files: DataFrame) -> DataFrame:
    """(book, list) of files (book, chapter, path)."""
    one = F.concat(F.lit("file '"), F.col("path"), F.lit("'\n"))
    return files.groupBy("book").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chapter", one.alias("t")))), lambda x: x["t"]), "").alias("list"))


def complete(chapters: DataFrame) -> DataFrame:
    """(book, complete): whether every chapter is ready and its audio fresh."""
    return chapters.groupBy("book").agg(F.bool_and(F.col("ready") & F.col("fresh")).alias("complete"))


def book_backend(state: DataFrame, order: str = "id") -> DataFrame:
    """(book, backend): the first line's that has one."""
    return state.groupBy("book").agg(F.min_by("backend", F.when(F.col("backend").isNotNull(), F.col(order))).alias("backend"))


def ready(chapters: DataFrame, states: DataFrame) -> DataFrame:
    """Chapters without a reason to be rendered again; states has (chapter, reasons)."""
    return chapters.join(states.where(F.size("reasons") > 0).select("chapter"), "chapter", "left_anti")
