"""Reading and writing a book's tables: sources, chapters, lines and states by chapter, review files and logs.

Tables are logs of commits (deltas.py), partitioned by chapter: a write replaces chapters, or adds lines, and overwrites nothing.
"""

from __future__ import annotations

import datetime
import json
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import deltas

LINES = "id string, chapter int, para int, kind string, speaker string, text string, lang string, style string, confidence double, locked boolean"
RENDER = "id string, chapter int, audio string, backend string, attempts int"
VERIFY = "id string, chapter int, transcript string, error_rate double, edits int, duration double, ok boolean, audio string"
SCHEMAS = {"lines": LINES, "render": RENDER, "verify": VERIFY}
#: Commits of a table after which they become one.
MOST_COMMITS = 16
#: What an older table may lack, and what stands for it.
DEFAULTS = {"lang": "en", "confidence": 1.0, "locked": False, "attempts": 0}


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text, from whatever file system has it; None if there is none."""
    if not exists(spark, path):
        return None
    return "".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Replaces a small file. The new one is complete before the old one goes."""
    jvm = spark._jvm
    to, new = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.new")
    fs = to.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(new, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    fs.delete(to, False)
    fs.rename(new, to)


def file_hashes(spark: SparkSession, paths: list[str]) -> dict[str, str]:
    """Content hashes (24 hexadecimal digits of the SHA-256 of their bytes) of those files that there are; a clip's identity."""
    there = [p for p in paths if exists(spark, p)]
    if not there:
        return {}
    rows = spark.read.format("binaryFile").load(there).select("path", F.substring(F.sha2("content", 256), 1, 24).alias("hash")).collect()
    plain = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p).toUri().getPath()
    found = {plain(r["path"]): r["hash"] for r in rows}
    return {p: found[plain(p)] for p in there}


def locate_source(spark: SparkSession, root: str) -> str:
    """A markdown source comes before a plain one."""
    for name in ("source.md", "source.txt"):
        if exists(spark, f"{root}/{name}"):
            return f"{root}/{name}"
    raise FileNotFoundError(f"no source.md or source.txt in {root}")


def read_source(spark: SparkSession, root: str) -> DataFrame:
    """(book, text, markdown): the whole source as one row."""
    path = locate_source(spark, root)
    return spark.read.text(path, wholetext=True).select(F.lit(root.rstrip("/").rpartition("/")[2]).alias("book"), F.col("value").alias("text"), F.lit(path.endswith(".md")).alias("markdown"))


def read_sources(spark: SparkSession, pattern: str) -> DataFrame:
    """(book, text) of many sources at once: the folder of each file names its book."""
    rows = spark.read.text(pattern, wholetext=True).withColumn("path", F.col("_metadata.file_path"))
    return rows.select(F.regexp_extract("path", "([^/]+)/[^/]+$", 1).alias("book"), F.col("value").alias("text"))


def write_chapters(chapters: DataFrame, root: str) -> None:
    chapters.write.mode("overwrite").parquet(f"{root}/chapters")


def read_chapters(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/chapters")


def columns_of(name: str) -> list[str]:
    return [c.split()[0] for c in SCHEMAS[name].split(", ")]


def read_table(spark: SparkSession, root: str, name: str, chapters: list[int] | None = None) -> DataFrame:
    """lines, render or verify; empty if it isn't there. Of rows with one identifier the last that was written counts. Only the partitions of
    the chapters asked for are read."""
    rows = deltas.read(spark, root, name, SCHEMAS[name], chapters)
    return rows.na.fill({k: v for k, v in DEFAULTS.items() if k in rows.columns})


def write_table(rows: DataFrame, root: str, name: str) -> None:
    """Replaces the chapters that rows has, and leaves the others: a commit that is whole for these. Many commits become one."""
    deltas.append(rows, root, name, columns_of(name), whole=True)
    if len(deltas.commits(rows.sparkSession, root, name)) > MOST_COMMITS:
        deltas.compact(rows.sparkSession, root, name, SCHEMAS[name])


def add_rows(rows: DataFrame, root: str, name: str) -> None:
    """Adds rows, or newer ones of the same identifiers: a commit of these alone, whatever the table holds."""
    deltas.append(rows, root, name, columns_of(name))


def chapter_numbers(spark: SparkSession, root: str, name: str = "lines") -> list[int]:
    """Chapters that a table has."""
    return sorted(r["chapter"] for r in read_table(spark, root, name).select("chapter").distinct().collect())


def prune_chapters(spark: SparkSession, root: str, name: str, count: int) -> list[int]:
    """Takes out chapters that the book no longer has."""
    there = chapter_numbers(spark, root, name)
    gone = [c for c in there if c >= count]
    if gone:
        deltas.compact(spark, root, name, SCHEMAS[name], [c for c in there if c < count])
    return gone


def read_jsonl(spark: SparkSession, path: str, name: str) -> DataFrame:
    """JSON lines of a known table; blank lines don't count, a missing file is empty. Of lines with one identifier the last one counts, in the
    order of files by name and of lines in a file."""
    if not exists(spark, path):
        return spark.createDataFrame([], SCHEMAS[name])
    rows = spark.read.schema(SCHEMAS[name]).json(path)
    rows = rows.select("*", F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("n")).alias("_at"))
    rows = rows.where(F.col("id").isNotNull())
    return rows.groupBy("id").agg(F.max_by(F.struct(*columns_of(name)), "_at").alias("_row")).select("_row.*")


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_review(rows: DataFrame, path: str) -> None:
    """Tab-separated rows for people to read."""
    flat = [F.regexp_replace(F.col(c).cast("string"), r"[\t\r\n]+", " ").alias(c) for c in rows.columns]
    rows.select(flat).write.mode("overwrite").option("sep", "\t").option("quote", "").csv(path)


def write_cast(cast: DataFrame, path: str, force: bool = False) -> None:
    """An existing cast may have been edited by hand: it is only replaced by force."""
    cast.write.mode("overwrite" if force else "errorifexists").json(path)


def read_config(path: str, text: str | None = None) -> dict:
    """A configuration file (or its text, if that was read already): JSON, or YAML where a YAML library is installed."""
    text = Path(path).read_text(encoding="utf-8") if text is None else text
    if path.endswith(".json"):
        return json.loads(text)
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("YAML files need a YAML library; JSON needs none") from e
    return yaml.safe_load(text) or {}


def log_line(message: str, now: datetime.datetime) -> str:
    """A log entry without style tags."""
    return f"{now.isoformat(timespec='seconds')} {re.sub(r'\[/?[a-z ]+\]', '', message)}"


def by_line(state: DataFrame) -> DataFrame:
    """(name, target): where each line's audio is found under the line's identifier."""
    return state.where(F.col("audio").isNotNull()).select(F.concat("id", F.lit(".wav")).alias("name"), F.concat(F.lit("../"), F.substring_index("audio", "/", -1)).alias("target"))


def scaffold(spark: SparkSession, source: str, root: str, title: str | None = None) -> dict:
    """A new book's folder with its source and configuration; a folder that holds anything is left alone."""
    to = Path(root)
    if to.exists() and any(to.iterdir()):
        raise FileExistsError(f"{root} isn't empty")
    to.mkdir(parents=True, exist_ok=True)
    name = "source.md" if source.endswith(".md") else "source.txt"
    (to / name).write_bytes(Path(source).read_bytes())
    text = (to / name).read_text(encoding="utf-8")
    lang = "zh" if len(re.findall("[一-鿿]", text)) > len(text) // 10 else "en"
    config = {
        "_": "voices: role to voice of the speech provider; narrator and _default, then names of cast.json, or name@style",
        "title": title or re.sub(r"[-_]+", " ", to.name).title(), "author": "", "language": lang, "genre": "Speech", "chapter_regex": None, "styles": [], "voices": {},
        "tts": {"backend": "tone", "params": {}}, "pauses": {}, "llm": {"provider": "tagged", "num_ctx": 16384}, "verify": {"provider": "deaf", "threshold": 0.15, "max_attempts": 3},
    }
    (to / "book.json").write_text(json.dumps(config, ensure_ascii=False, indent=1), encoding="utf-8")
    return config
