"""The registered queries against SQL on the smallest tables, and the pipeline against its stages."""

from __future__ import annotations

from pathlib import Path

import pytest

from storyline.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the test tables")
RESULTS = {
    "op1": {"page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"},
    "op2": {"doc_id", "held_out", "score", "predicted"},
    "op3": {"doc_id", "keep_id", "group_size", "kept", "text_sha256"},
    "op4": {"doc_id", "size", "source_size", "target", "taken"},
    "op5": {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"},
    "op6": {"doc_id"},
    "op7": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"},
    "op8": {"query_id", "rank", "vec_id", "score"},
    "op9": {"doc_id", "n_words", "n_removed", "kept_sha256"},
    "op10": {"doc_id", "n_shingles", "component_id", "kept"},
    "op11": {"vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"},
    "op12": {"doc_id", "n_features", "weight", "score", "rank"},
    "op13": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
}


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    assert set(got.columns) >= RESULTS[name.split("_")[0]]
    columns = sorted(got.columns)
    rows = [tuple(r[c] for c in columns) for r in got.collect()]
    if name in ORACLES:
        found = duck.sql(ORACLES[name])
        assert sorted(found.columns) == columns
        order = [found.columns.index(c) for c in columns]
        assert sorted(map(repr, rows)) == sorted(repr(tuple(r[i] for i in order)) for r in found.fetchall())
    else:
        assert rows


ODD = [
    (1, "a plain text of some words that nobody else has written here"), (2, "a plain text of some words that nobody else has written here"), (3, None), (4, ""), (5, " \n\t "), (None, "no identifier but a text"), (None, None),
    (6, "word " * 3000), (7, "word " * 3001), (1, "a plain text of some words that nobody else has written here"), (8, "é 漢字 🙂 <|endoftext|>"), (9, "x"),
]


@pytest.mark.parametrize("rows", [ODD, []])
def test_pipeline_with_odd_rows(spark, tmp_path, rows):
    """Nulls, empty and repeated rows, no rows, and columns with the names that stages use themselves."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    names = ["__file", "__row", "drop_file", "toxic_score", "mix_source", "mix_rate", "mix_copy", "dropped_id", "shard", "kept", "component_id", "score"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)
    docs = spark.createDataFrame([(i, t, None if k % 3 else "en", None if k % 2 else "s", None, *("x" for _ in names)) for k, (i, t) in enumerate(rows)], schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (None, None, 1), (9, 0, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    start = docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert name == corpus_pipeline.STAGES[-1][0] or docs.columns == start.columns
    near = spark.read.parquet(f"{tmp_path}/near_dedup").select("doc_id").collect()
    assert sorted((r.doc_id for r in near), key=repr) == sorted([1, 5, 6, None, 8, 9] if rows else [], key=repr)  # of the empty texts, the one with most white space


def test_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = start = spark.read.parquet(f"{SF}/documents.parquet")
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == start.columns
            path = f"{spark.conf.get('spark.checkpoint.dir')}/test-pipeline/{name}"
            docs.write.mode("overwrite").parquet(path)
            docs = spark.read.parquet(path)
            counts.append(docs.count())
    assert start.count() >= counts[0] >= counts[1] >= counts[2] > 0
    ids = {r.doc_id for r in docs.select("doc_id").distinct().collect()}
    whole = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in whole.select("doc_id").distinct().collect()} == ids and whole.count() == docs.count()
