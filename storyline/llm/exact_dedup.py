"""Exact deduplication as a stateful stream.

Documents arrive as narrow rows (digest of the normalised text, stable identifier, length, content locator), never with their text. A
streaming aggregation keyed by digest keeps, in a disk-backed state store (RocksDB) without watermark or expiry, the row that stays so far,
its locator and how many rows have come; rows of one digest meet in partial sums first, so a text that a third of all rows share costs one
row a task. The rows come in several micro-batches, each of which meets the state that the earlier ones left, and appends the digests that
it changed. A later run over more rows goes on from the same checkpoint.

A digest is not yet proof: on hits, full bytes are compared. A bounded bitmap of the hits' locators picks their rows out where they are
scanned, so that other texts stay where they are (the few that it lets through by chance are compared with themselves), and the least and
greatest text of each digest must be one; both are found in partial aggregates, so a hot text travels once a task. Where they differ (two
texts with one digest), those digests' rows are grouped again by the text itself.

Texts are equal when identical after deleting every [\\x20\\x09-\\x0D]. Of equal texts the row with the most code points stays, then the
smallest doc_id (null last), then the first by a hash of its file's name and its place in the file, so exactly one row of repeated rows
stays. Null text counts as empty; all texts without a visible character are equal to each other. An empty table gives no rows. Other
columns, of whatever name, are ignored and, when filtering, kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .common import SPACE, Sieve, Workspace, fresh, settings, text_of

#: How the state is kept: on disk, with changes logged instead of whole snapshots, without space set aside in
#: advance for each partition, and with one bound on the buffers and caches of all partitions that an executor has.
#: A partition's store stays open from one micro-batch to the next: each opening leaves some native memory behind for good.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    "spark.sql.streaming.stateStore.unloadOnCommit": "false",
}
LONG_MAX = (1 << 63) - 1
#: Micro-batches that a table comes in at least, if it has as many files, and how many groups at most may be broadcast for their size.
BATCHES, HOT = 3, 1000


def normalised(text: Column) -> Column:
    return F.translate(text_of(text), SPACE, "")


def located(documents: DataFrame, ws: Workspace, file: str = "__file", row: str = "__row") -> DataFrame:
    """documents with a content locator (file, row in it), in columns of these names. What isn't read from files is written first."""

    def place(df: DataFrame) -> DataFrame:
        at = df.metadataColumn("_metadata")
        return df.withColumns({file: at["file_path"], row: at["row_index"]})

    try:
        return place(documents)
    except AnalysisException:
        return place(ws.put(documents, "documents"))


def digest_of(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def digests(rows: DataFrame, digest: Column | None = None) -> DataFrame:
    """The narrow stream rows: sha256 of each normalised text, identifier, code points, locator."""
    return rows.select(
        (digest_of(normalised(F.col("text"))) if digest is None else digest).alias("digest"),
        "doc_id",
        F.length(text_of("text")).cast("long").alias("points"),
        F.col("__file").alias("file"),
        F.col("__row").alias("row"),
    )


def better() -> Column:
    """Ordered so that the greatest is the row that stays. Locators are turned round: an earlier place is greater."""
    order = F.coalesce(F.bitwise_not(F.col("doc_id")), F.lit(-LONG_MAX - 1))
    return F.struct("points", F.col("doc_id").isNotNull().alias("named"), order.alias("order"), F.bitwise_not(F.xxhash64("file")).alias("file_order"), F.bitwise_not(F.col("row")).alias("row_order"), "doc_id", "file", "row")


def stream_groups(arrivals: DataFrame, ws: Workspace, checkpoint: str, name: str = "groups") -> DataFrame:
    """Runs the stream over all rows that haven't come yet; returns the newest state of each digest."""
    spark = arrivals.sparkSession
    kept = arrivals.groupBy("digest").agg(F.max(better()).alias("best"), F.count(F.lit(1)).alias("group_size"))
    to = ws.path(name)

    def append(batch: DataFrame, batch_id: int) -> None:
        out = batch.select("digest", "group_size", F.col("best.doc_id").alias("keep_id"), F.col("best.file").alias("keep_file"), F.col("best.row").alias("keep_row"), F.lit(batch_id).alias("batch"))
        out.write.mode("overwrite").option("compression", "zstd").parquet(f"{to}/of={batch_id}")  # a batch that is run again replaces itself

    with settings(spark, STATE_STORE):
        query = kept.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(append).start()
        query.awaitTermination()
    schema = "digest string, group_size long, keep_id long, keep_file string, keep_row long, batch long"
    states = spark.read.schema(schema + ", of long").parquet(to) if _exists(spark, to) else spark.createDataFrame([], schema)
    newest = states.groupBy("digest").agg(F.max_by(F.struct("group_size", "keep_id", "keep_file", "keep_row"), "batch").alias("s"))
    return newest.select("digest", "s.*")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def assign(rows: DataFrame, ws: Workspace, digest: Column | None = None) -> DataFrame:
    """For each located row: doc_id, digest, file, row, keep_id, keep_file, keep_row, group_size, kept."""
    spark = rows.sparkSession
    narrow = ws.put(digests(rows, digest), "arrivals")
    files = len(narrow.inputFiles())
    arrivals = spark.readStream.schema(narrow.schema).option("maxFilesPerTrigger", max(1, files // BATCHES)).parquet(ws.path("arrivals"))
    groups = ws.put(stream_groups(arrivals, ws, ws.path("checkpoint"), "states").where(F.col("group_size") > 1), "groups")
    # no more than HOT groups have more than one in HOT of all rows, so these are broadcast; their rows are spread over all tasks
    hot = groups.where(F.col("group_size") > F.lit(-(-narrow.count() // HOT)))
    found = narrow.join(F.broadcast(hot.withColumn("hot", F.lit(True))), "digest", "left")
    cold = groups.join(F.broadcast(hot.select("digest")), "digest", "left_anti")
    cold = cold.select(F.col("digest").alias("spread"), *(F.col(c).alias(f"cold_{c}") for c in ("keep_id", "keep_file", "keep_row", "group_size")))
    member = found.withColumn("spread", F.when(F.col("hot"), F.concat_ws(":", "file", "row")).otherwise(F.col("digest"))).join(cold, "spread", "left")
    size = F.coalesce("group_size", "cold_group_size")
    out = member.select(
        "doc_id", "digest", "file", "row",
        F.when(size.isNull(), F.col("doc_id")).when(F.col("hot"), F.col("keep_id")).otherwise(F.col("cold_keep_id")).alias("keep_id"),
        F.coalesce("keep_file", "cold_keep_file", "file").alias("keep_file"), F.coalesce("keep_row", "cold_keep_row", "row").alias("keep_row"),
        F.coalesce(size, F.lit(1)).cast("long").alias("group_size"),
    )
    out = ws.put(out.withColumn("kept", (F.col("file") == F.col("keep_file")) & (F.col("row") == F.col("keep_row"))), "assigned")
    return confirmed(rows, out, ws, digest)


def locator(file: str, row: str) -> Column:
    return F.xxhash64(file, row)


def confirmed(rows: DataFrame, out: DataFrame, ws: Workspace, digest: Column | None = None) -> DataFrame:
    """Compares full bytes on every hit, and groups anew where a digest stands for more than one text."""
    hits = out.where(F.col("group_size") > 1).select(locator("file", "row").alias("key"))
    maybe = Sieve.of(hits)
    texts = rows.select("__file", "__row", "text").where(maybe.passes(locator("__file", "__row")))
    t = normalised(F.col("text"))
    each = texts.select((digest_of(t) if digest is None else digest).alias("digest"), F.encode(t, "UTF-8").alias("t"))
    wrong = ws.put(each.groupBy("digest").agg(F.min("t").alias("low"), F.max("t").alias("high")).where("low <> high").select("digest"), "collisions")
    if wrong.isEmpty():
        return out
    again = out.join(wrong, "digest", "left_semi").select("doc_id", "digest", F.col("file").alias("__file"), F.col("row").alias("__row"))
    again = texts.join(again, ["__file", "__row"]).select("doc_id", "digest", F.col("__file").alias("file"), F.col("__row").alias("row"), t.alias("t"), F.length(text_of("text")).cast("long").alias("points"))
    best = again.groupBy("digest", "t").agg(F.max(better()).alias("best"), F.count(F.lit(1)).alias("group_size"))
    fixed = again.join(ws.put(best, "by_text"), ["digest", "t"])
    fixed = fixed.select("doc_id", "digest", "file", "row", F.col("best.doc_id").alias("keep_id"), F.col("best.file").alias("keep_file"), F.col("best.row").alias("keep_row"), "group_size", ((F.col("file") == F.col("best.file")) & (F.col("row") == F.col("best.row"))).alias("kept"))
    return out.join(wrong, "digest", "left_anti").select(fixed.columns).unionByName(fixed)


def dedup_documents(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """Which row stays for every document."""
    ws = Workspace(spark, "exact")
    return assign(located(documents.select("doc_id", "text"), ws), ws).select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def drop_copies(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """documents without the copies, with the same columns. The rows to drop go by locator; a bounded bitmap of these locators lets all
    other rows pass where they are scanned."""
    ws = Workspace(spark, "exact")
    file, row, drop_file, drop_row = fresh(documents, "__file", "__row", "drop_file", "drop_row")
    rows = located(documents, ws, file, row)
    narrow = rows.select("doc_id", "text", F.col(file).alias("__file"), F.col(row).alias("__row"))
    dropped = ws.put(assign(narrow, ws).where(~F.col("kept")).select(F.col("file").alias(drop_file), F.col("row").alias(drop_row)), "dropped")
    maybe = Sieve.of(dropped.select(locator(drop_file, drop_row).alias("key"))).passes(locator(file, row))
    looked_up = rows.where(maybe).join(dropped, (F.col(file) == F.col(drop_file)) & (F.col(row) == F.col(drop_row)), "left_anti")
    return rows.where(~maybe).unionByName(looked_up).select(documents.columns)


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, length(t) AS points, regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g') AS norm FROM d),
r AS (SELECT *, count(*) OVER (PARTITION BY norm) AS group_size,
             first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS place
      FROM n WINDOW w AS (PARTITION BY norm ORDER BY points DESC, doc_id))
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, place = 1 AS kept, sha256(norm) AS text_sha256 FROM r
"""
