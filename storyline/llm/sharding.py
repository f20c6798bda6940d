"""Jump consistent hashing (Lamping and Veach, 2014) of stable keys to shards, by DataFrame operations alone.

A key's shard depends on the key and the number of shards, without a table of ring positions. Adding a shard moves rows only into it, and
only their due share. The published generator multiplies modulo 2^64; here the state is a decimal, which holds every product exactly.
The law is `key`.

A row's slot is its place in its shard, gapless from 0. No shard is ever sorted in one task: rows are counted and ranked in 1024 buckets of
a shard, by a hash of key and text, and a bucket starts after all earlier ones. So the rows of one key, or without one, are of one shard, as
the law asks, and still of all its buckets. The counts are 1024 rows a shard at most, whatever the input.

Defined cases: a null key hashes as the string "null"; repeated keys go to one shard and get slots of their own. A null text has no bytes.
Very long texts only count. An empty table gives no rows. Other columns are ignored (or kept, by with_shard, whose own column gets a _ before
its name if there is one of that name).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh, text_of

SHARDS, BUCKETS = 24, 1024
#: Fixed value of the published algorithm.
MULTIPLIER = "2862933555777941757"
STATES = "decimal(38,0)"


def key_of(doc_id: Column) -> Column:
    """The identifier's 64 hash bits as a number from 0."""
    h = F.xxhash64(F.coalesce(doc_id.cast("string"), F.lit("null"))).cast(STATES)
    return F.when(h < 0, h + F.lit("18446744073709551616").cast(STATES)).otherwise(h)


def jump(key: Column, shards: int) -> Column:
    """The shard, 0 to shards - 1, of a key from key_of. Each step draws the next shard count at which the key would jump; as it at least
    goes up by one, `shards` steps always suffice, and those after the last jump cost a comparison each."""
    start = F.struct(key.cast(STATES).alias("state"), F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"))

    def step(s: Column, _: Column) -> Column:
        state = ((s["state"] * F.lit(MULTIPLIER).cast("decimal(19,0)")).cast(STATES) + F.lit(1)).cast(STATES) % F.lit("18446744073709551616").cast(STATES)
        top = F.floor(state.cast(STATES) / F.lit("8589934592").cast(STATES)).cast("long")
        after = F.floor((s["j"] + 1).cast("double") * (F.lit(float(1 << 31)) / (top + 1).cast("double"))).cast("long")
        return F.when(s["j"] < shards, F.struct(state.cast(STATES).alias("state"), s["j"].alias("b"), after.alias("j"))).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step, lambda s: s["b"].cast("int"))


def with_shard(documents: DataFrame, shards: int = SHARDS, name: str = "shard") -> DataFrame:
    """documents with each row's shard as last column, all other columns as they are; needs no shuffle."""
    return documents.withColumn(fresh(documents, name)[0], jump(key_of(F.col("doc_id")), shards))


def shard_documents(spark: SparkSession, documents: DataFrame, shards: int = SHARDS) -> DataFrame:
    data = F.encode(text_of("text"), "UTF-8")
    bucket = F.pmod(F.xxhash64(F.col("doc_id"), F.crc32(data)), F.lit(BUCKETS)).cast("int")
    places = documents.select("doc_id", jump(key_of(F.col("doc_id")), shards).alias("shard"), bucket.alias("bucket"))
    counts = places.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(counts.select("shard", "bucket", before.alias("before")))
    rows = documents.select(
        "doc_id", (F.octet_length(data) + 8).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), F.lit("key").alias("law"),
        jump(key_of(F.col("doc_id")), shards).alias("shard"), jump(key_of(F.col("doc_id")), shards + 1).alias("grown_shard"), bucket.alias("bucket"),
    )
    within = F.row_number().over(W.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")) - 1
    out = rows.withColumn("within", within).join(starts, ["shard", "bucket"])
    return out.select("doc_id", "size", "text_crc32", "law", "shard", (F.col("before") + F.col("within")).cast("long").alias("slot"), "grown_shard")
