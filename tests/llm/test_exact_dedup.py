from __future__ import annotations

import hashlib
import re

from pyspark.sql import functions as F

from storyline.llm import exact_dedup
from storyline.llm.common import Workspace

ROWS = [(4, "a b"), (2, "ab"), (9, "a  b"), (1, "A b"), (7, None), (3, ""), (5, " \n\t\x0b\x0c\r "), (6, "x y"), (8, "xy"), (10, "é" * 5000), (11, "é " * 5000), (None, "ab"), (12, "q"), (12, "q"), (None, "only"), (None, "only")]


def expected(rows):
    groups = {}
    for k, (i, t) in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i or 0, k, i))
    out = []
    for k, (i, t) in enumerate(rows):
        norm = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        best = min(groups[norm])
        out.append((i, best[4], len(groups[norm]), best[3] == k, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_rows(spark, documents, tables):
    folder = tables(documents=documents(ROWS).coalesce(1))
    got = exact_dedup.dedup_documents(spark, spark.read.parquet(f"{folder}/documents.parquet"))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == expected(ROWS)


def test_frames_that_are_not_files(spark, documents):
    got = exact_dedup.dedup_documents(spark, documents(ROWS[:8]).coalesce(1))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == expected(ROWS[:8])


def test_one_digest_for_several_texts_is_told_apart_by_bytes(spark, documents, tables):
    folder = tables(documents=documents(ROWS).coalesce(1))
    ws = Workspace(spark, "t")
    rows = exact_dedup.located(spark.read.parquet(f"{folder}/documents.parquet"), ws)
    got = exact_dedup.assign(rows, ws, digest=F.lit("same")).select("doc_id", "keep_id", "group_size", "kept")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted((r[:4] for r in expected(ROWS)), key=repr)


def test_a_later_run_goes_on_from_the_state(spark, documents):
    ws = Workspace(spark, "t")
    narrow = exact_dedup.digests(exact_dedup.located(documents([(2, "ab"), (3, "c")]), ws))
    narrow.write.parquet(ws.path("in"))
    stream = lambda: spark.readStream.schema(narrow.schema).parquet(ws.path("in"))
    exact_dedup.stream_groups(stream(), ws, ws.path("ck"), "out")
    more = exact_dedup.digests(exact_dedup.located(documents([(1, "a b"), (4, "c")]), Workspace(spark, "t2")))
    more.write.mode("append").parquet(ws.path("in"))
    got = {r.keep_id: r.group_size for r in exact_dedup.stream_groups(stream(), ws, ws.path("ck"), "out").collect()}
    assert got == {1: 2, 3: 2}


def test_filter_keeps_columns(spark, documents, tables):
    folder = tables(documents=documents(ROWS, extra=True).coalesce(1))
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = exact_dedup.drop_copies(spark, docs)
    assert got.columns == docs.columns
    assert sorted(repr((r.doc_id, r.text)) for r in got.collect()) == sorted(repr(ROWS[k]) for k, e in enumerate(ROWS) if [x for x in _kept(ROWS)][k])


def _kept(rows):
    out, best = [], {}
    for k, (i, t) in enumerate(rows):
        norm = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        key = (-len(t or ""), i is None, i or 0, k)
        best[norm] = min(best.get(norm, key), key)
    for k, (_, t) in enumerate(rows):
        out.append(best[re.sub(r"[\x20\x09-\x0D]", "", t or "")][3] == k)
    return out


def test_clashing_names(spark, documents, tables):
    """Columns may have the names that locators and decisions have."""
    docs = documents(ROWS, extra=True).selectExpr("*", "'f' AS __file", "1 AS __row", "2 AS drop_file", "'m' AS _metadata", "'k' AS keep_id")
    folder = tables(documents=docs.coalesce(1))
    for some in (spark.read.parquet(f"{folder}/documents.parquet"), docs):
        got = exact_dedup.drop_copies(spark, some)
        assert got.columns == docs.columns and got.count() == sum(_kept(ROWS))
        assert exact_dedup.dedup_documents(spark, some).count() == len(ROWS)


def test_many_files_come_in_several_batches(spark, documents, tables):
    """One text that half of all rows share, over many files, and the state is met again."""
    rows = [(k, "the same" if k % 2 else f"text {k % 50}") for k in range(400)]
    folder = tables(documents=documents(rows).repartition(7))
    ws = Workspace(spark, "t")
    rows_at = exact_dedup.located(spark.read.parquet(f"{folder}/documents.parquet"), ws)
    got = exact_dedup.assign(rows_at, ws).select("doc_id", "keep_id", "group_size", "kept", "digest").collect()
    assert sorted((tuple(r) for r in got), key=repr) == expected(rows)
    assert spark.read.parquet(ws.path("states")).select("of").distinct().count() >= exact_dedup.BATCHES


def test_empty(spark, documents):
    assert exact_dedup.dedup_documents(spark, documents(ROWS).limit(0)).count() == 0
    assert exact_dedup.drop_copies(spark, documents(ROWS).limit(0)).count() == 0


def test_state_stores_stay_open_between_batches(spark, documents, tmp_path):
    """An opening leaves native memory behind: a partition's store is opened once, not again for each micro-batch."""
    rows = documents([(k, f"text {k % 50}") for k in range(400)]).repartition(8)
    rows.write.parquet(f"{tmp_path}/documents")
    assert exact_dedup.dedup_documents(spark, spark.read.parquet(f"{tmp_path}/documents")).where("kept").count() == 50
    stores = spark._jvm.java.lang.Class.forName("org.apache.spark.sql.execution.streaming.state.StateStore$")
    held = stores.getDeclaredField("loadedProviders")
    held.setAccessible(True)
    assert held.get(stores.getField("MODULE$").get(None)).size() >= int(spark.conf.get("spark.sql.shuffle.partitions"))
