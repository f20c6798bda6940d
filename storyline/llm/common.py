"""What the operators of this package share: the shared folder, written tables, and safe column handling."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space of every word and text rule here: space, tab, LF, VT, FF, CR.
SPACE = " \t\n\x0b\x0c\r"
SPACE_RE = r"[\x20\x09-\x0D]"
WORD_RE = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session's spark.checkpoint.dir names it.

    Only where a session has none and runs on one machine alone, as in tests, a temporary folder is set. On a cluster that is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="storyline-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings of the session for what runs within."""
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def give_back() -> None:
    """Returns what this process has freed to the system, where the C library can (glibc's keeps it)."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run over a task's batches, with memory given back at the end: Spark keeps more workers than an executor has cores, and each would go
    on holding what its largest task has freed."""

    @functools.wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return wrapped


class Workspace:
    """Tables that one run of an operator writes to the shared folder, to cut lineage.

    A lost executor then costs a reread, not a recomputation of everything upstream.
    """

    #: All that this driver has made and not removed: results are read from them, so they stay until `remove_all`.
    made: list[Workspace] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/storyline/{name}-{uuid.uuid4().hex}"
        Workspace.made.append(self)

    @classmethod
    def remove_all(cls) -> None:
        """Deletes the folders of all operators that this driver has run; their results can't be read any more."""
        while cls.made:
            cls.made.pop().drop("")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def put(self, df: DataFrame, name: str, codec: str = "zstd", **options: object) -> DataFrame:
        """df as a written table. Python gets small batches, and row groups are small: both are held by every running task."""
        with settings(self.spark, {"spark.sql.execution.arrow.maxBytesPerBatch": "4m"}):
            df.write.mode("overwrite").option("compression", codec).options(**{"parquet.block.size": 32 << 20} | options).parquet(self.path(name))
        return self.get(name, df.schema)

    def sweep(self) -> None:
        """Lets Spark delete the shuffle files of steps whose results are written: it does so when the driver collects garbage."""
        gc.collect()
        self.spark._jvm.System.gc()

    def get(self, name: str, schema: T.StructType) -> DataFrame:
        nullable = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])
        return self.spark.read.schema(nullable).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Deletes tables no later step reads, through the file system that holds them."""
        jvm = self.spark._jvm
        for name in names:
            at = jvm.org.apache.hadoop.fs.Path(self.path(name).rstrip("/"))
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


class Sieve:
    """A bitmap of bounded size that keys pass which are in a table, and by chance a few others: about one in seventy as long as the table
    has no more than MOST / 16 keys, more beyond that. It takes rows out of a scan that a join needn't see; the join still decides."""

    MOST = 1 << 28

    def __init__(self, spark: SparkSession, words: np.ndarray):
        self.spark, self.words = spark, spark.sparkContext.broadcast(words)

    @classmethod
    def of(cls, keys: DataFrame) -> Sieve:
        """Of the hashes in keys' column `key`. At most MOST / 64 rows of 16 bytes come to the driver."""
        bits = 1 << min(cls.MOST.bit_length() - 1, max(10, (16 * keys.count()).bit_length()))
        at = F.explode(F.array(*(F.pmod(k, F.lit(bits)) for k in (F.col("key"), F.shiftright("key", 32)))))
        words = np.zeros(bits // 64, np.uint64)
        found = keys.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("set")).toArrow()
        words[np.asarray(found["word"])] = np.asarray(found["set"]).view(np.uint64)
        return cls(keys.sparkSession, words)

    def passes(self, key: Column) -> Column:
        held = self.words

        @lean
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            words = held.value
            for batch in batches:
                k, out = np.asarray(batch), None
                for h in (k, k >> 32):
                    at = h.view(np.uint64) & np.uint64(len(words) * 64 - 1)
                    found = (words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)
                    out = found if out is None else out & found
                yield pa.array(out.astype(bool))

        return F.arrow_udf(run, T.BooleanType())(key)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names not in df (compared without case), made from the names asked for."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def text_of(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def word_count(text: Column) -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("long")


def partitions_for(rows: int, per_partition: int, least: int = 1) -> int:
    return max(least, -(-rows // per_partition))
