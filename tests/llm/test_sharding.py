from __future__ import annotations

import struct
import zlib
from collections import Counter, defaultdict

import xxhash
from pyspark.sql import functions as F

from storyline.llm import sharding


def jump(key, shards):
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2**31 / ((key >> 33) + 1)))
    return b


def test_jump_hash_matches_the_published_algorithm(spark):
    keys = [0, 1, 10, 256, 0xDEADBEEF, 2**63, 2**64 - 1]
    rows = spark.createDataFrame([(str(k),) for k in keys], "k string").select(F.col("k").cast("decimal(38,0)").alias("k"))
    for n in (1, 2, 24, 25, 200):
        got = {int(r.k): r.s for r in rows.select("k", sharding.jump(F.col("k"), n).alias("s")).collect()}
        assert got == {k: jump(k, n) for k in keys}


def test_shards_slots_and_growth(spark, documents):
    rows = [(k, "é" * (k % 5)) for k in range(3000)] + [(None, None), (7, "again"), (7, "again"), (3001, "x" * 10**6)]
    got = sharding.shard_documents(spark, documents(rows, extra=True)).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    slots = defaultdict(list)
    for r in got:
        assert r.law == "key" and 0 <= r.shard < 24 and r.grown_shard in (r.shard, 24)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(slots) == 24
    moved = sum(r.grown_shard == 24 for r in got)
    assert 0.5 * len(got) / 25 < moved < 1.6 * len(got) / 25
    assert max(map(len, slots.values())) < 1.5 * len(got) / 24
    assert len({r.shard for r in got if r.doc_id == 7}) == 1


def brute(rows, shards=24):
    """(doc_id, size, crc, shard, slot, grown_shard) by the published loop and one sort of everything."""
    placed = []
    for doc_id, text in rows:
        data = (text or "").encode()
        key = xxhash.xxh64_intdigest(str("null" if doc_id is None else doc_id).encode(), 42)
        crc = zlib.crc32(data)
        seed = 42 if doc_id is None else xxhash.xxh64_intdigest(struct.pack("<q", doc_id), 42)
        bucket = struct.unpack("<q", struct.pack("<Q", xxhash.xxh64_intdigest(struct.pack("<q", crc), seed)))[0] % 1024
        placed.append((jump(key, shards), bucket, doc_id is not None, doc_id or 0, crc, len(data) + 8, doc_id, jump(key, shards + 1)))
    out, slots = [], Counter()
    for shard, _, _, _, crc, size, doc_id, grown in sorted(placed):
        out.append((doc_id, size, crc, shard, slots[shard], grown))
        slots[shard] += 1
    return sorted(out, key=repr)


def test_whole_result_against_brute_force(spark, documents):
    rows = [(k * 7 - 300, f"text {k}" * (k % 4)) for k in range(900)] + [(None, None), (None, "a"), (None, ""), (7, "again"), (7, "again"), (7, None), (2**62, "é" * 300)]
    got = sharding.shard_documents(spark, documents(rows, extra=True)).select("doc_id", "size", "text_crc32", "shard", "slot", "grown_shard")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows)


def test_rows_of_one_key_are_of_all_buckets(spark, documents):
    """A third of all rows without a key meet in one shard, as the law asks, and in no single window."""
    docs = documents([(None, f"text {k}") for k in range(2000)])
    data = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    buckets = docs.select(F.pmod(F.xxhash64("doc_id", F.crc32(data)), F.lit(sharding.BUCKETS)).alias("b")).groupBy("b").count()
    assert buckets.agg(F.max("count")).first()[0] < 20
    slots = sorted(r.slot for r in sharding.shard_documents(spark, docs).collect())
    assert slots == list(range(2000))


def test_a_column_of_that_name_stays(spark, documents):
    docs = documents([(1, "x")], extra=True)
    out = sharding.with_shard(docs)
    assert out.columns == [*docs.columns, "_shard"] and out.first().shard == 1


def test_empty(spark, documents):
    assert sharding.shard_documents(spark, documents([(1, "x")]).limit(0)).count() == 0


def test_assignment_alone_needs_no_shuffle(spark, documents):
    out = sharding.with_shard(documents([(1, "x")], extra=True), name="to")
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString() and out.columns[-1] == "to"
