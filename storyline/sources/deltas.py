"""Tables as a log of commits: every write appends, a reader merges what the commits say, and compaction writes one commit for all.

    <root>/<name>.log/commit=<number>/chapter=<number>/*.parquet, and a _SUCCESS file once a commit is whole

A commit either adds rows, of which the last one of an identifier counts, or is whole for its chapters: then all that earlier commits have of
these chapters counts no more. A commit without its _SUCCESS file was broken off and doesn't count. A table that was written
by chapter, <root>/<name>, is its commit 0. One driver writes a table; a second one's commit of the same number is an error.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a commit adds to a table's own columns: the place of a row in it, and whether it is whole for its chapters.
OWN = "place long, whole boolean"


def merged(rows: DataFrame, key: str = "id", by: str = "chapter") -> DataFrame:
    """The rows that count, of rows with commit, place and whole beside their own columns: of each key the last, by commit and place, among
    those that no later commit of their chapter made void. An aggregate, so that a key that is written often is combined before it is moved."""
    own = [c for c in rows.columns if c not in ("commit", "place", "whole")]
    floors = rows.where("whole").groupBy(F.col(by).alias("_of")).agg(F.max("commit").alias("_floor"))
    live = rows.join(floors, rows[by].eqNullSafe(floors["_of"]), "left").where(F.col("_floor").isNull() | (F.col("commit") >= F.col("_floor")))
    last = live.groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct(*own), F.struct("commit", "place")).alias("_row"))
    return last.select("_row.*")


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _numbers(spark: SparkSession, root: str, name: str) -> list[tuple[int, bool]]:
    """Commits in order, and whether each is whole."""
    fs, at = _fs(spark, f"{root}/{name}.log")
    if not fs.exists(at):
        return []
    found = sorted(int(m[1]) for f in fs.listStatus(at) if (m := re.fullmatch(r"commit=(\d+)", f.getPath().getName())))
    done = lambda n: _fs(spark, f"{root}/{name}.log/commit={n:08d}/_SUCCESS")[1]
    return [(n, fs.exists(done(n))) for n in found]


def commits(spark: SparkSession, root: str, name: str) -> list[int]:
    return [n for n, whole in _numbers(spark, root, name) if whole]


def has_table(spark: SparkSession, root: str, name: str) -> bool:
    fs, at = _fs(spark, f"{root}/{name}")
    return fs.exists(at) or bool(commits(spark, root, name))


def append(rows: DataFrame, root: str, name: str, columns: list[str], whole: bool = False) -> int:
    """Adds a commit of rows and returns its number. rows may come from the table itself, of which nothing is overwritten."""
    spark = rows.sparkSession
    number = 1 + max((n for n, _ in _numbers(spark, root, name)), default=0)
    placed = rows.select(*columns).withColumn("place", F.monotonically_increasing_id()).withColumn("whole", F.lit(whole))
    placed.repartition("chapter").write.mode("errorifexists").partitionBy("chapter").parquet(f"{root}/{name}.log/commit={number:08d}")
    return number


def read(spark: SparkSession, root: str, name: str, schema: str, chapters: list[int] | None = None) -> DataFrame:
    """The table as its commits make it. Only partitions of the chapters asked for are read; one whole commit needs no merging."""
    columns = [c.split()[0] for c in schema.split(", ")]
    numbers, (fs, at) = commits(spark, root, name), _fs(spark, f"{root}/{name}")
    some = lambda rows: rows if chapters is None else rows.where(F.col("chapter").isin(chapters))
    parts = []
    if fs.exists(at):
        base = some(spark.read.schema(schema).parquet(f"{root}/{name}")).select(columns)
        if not numbers:
            return base
        parts.append(base.withColumn("place", F.monotonically_increasing_id()).withColumn("whole", F.lit(True)).withColumn("commit", F.lit(0).cast("long")))
    if numbers:
        paths = [f"{root}/{name}.log/commit={n:08d}" for n in numbers]
        log = spark.read.schema(f"{schema}, {OWN}, commit long").option("basePath", f"{root}/{name}.log").parquet(*paths)
        parts.append(some(log).select(*columns, "place", "whole", "commit"))
    if not parts:
        return spark.createDataFrame([], schema)
    rows = parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0]
    return merged(rows).select(columns)


def compact(spark: SparkSession, root: str, name: str, schema: str, keep: list[int] | None = None) -> int:
    """Writes what the table says, or its chapters `keep`, as one whole commit, and deletes what came before. If that is broken off, the table
    says the same before and after: the commit counts from its end on, and what it replaces is void by then."""
    columns = [c.split()[0] for c in schema.split(", ")]
    before = _numbers(spark, root, name)
    number = append(read(spark, root, name, schema, keep), root, name, columns, whole=True)
    for path in [f"{root}/{name}", *(f"{root}/{name}.log/commit={n:08d}" for n, _ in before)]:
        fs, at = _fs(spark, path)
        fs.delete(at, True)
    return number
