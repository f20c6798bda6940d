"""Incremental ingestion: new source files become chapters as they arrive, each once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sections import chapters


def stream_chapters(spark: SparkSession, folder: str, lang: str = "en", pattern: str | None = None) -> DataFrame:
    """(book, chapter, title, paragraphs) of text files in a folder, as a stream."""
    texts = spark.readStream.schema("value string").text(folder, wholetext=True)
    books = texts.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:\.[^./]*)?$", 1).alias("book"), F.col("value").alias("text"))
    return chapters(books, lang, pattern)


def ingest_new(spark: SparkSession, folder: str, to: str, checkpoint: str, lang: str = "en", pattern: str | None = None) -> None:
    """Appends the chapters of files that haven't come before, then returns."""
    query = stream_chapters(spark, folder, lang, pattern).writeStream.format("parquet").option("path", to).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
