from __future__ import annotations

import math

import numpy as np
import pytest

from storyline.llm import topk_search

SCHEMA = "vec_id long, embedding array<float>, label int, score double, vector string, shard int"


def brute(rows, k=10):
    """Python's integers, so that no component is too large; a score is given as the nearest 64-bit number."""
    good = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in sorted({(i, tuple(v)) for i, v in good if i is not None and i % 100 == 0}):
        scores = sorted((-sum(x * y for x, y in zip(a, v, strict=False)), i is None, i or 0) for i, v in good if i != q)[:k]
        out += [(q, n, None if none else i, max(-(2**63), min(2**63 - 1, -s))) for n, (s, none, i) in enumerate(scores, 1)]
    return sorted(out, key=repr)


def search(spark, rows):
    frame = spark.createDataFrame([(i, v, 0, 0.5, "x", 1) for i, v in rows], SCHEMA)
    return sorted((tuple(r) for r in topk_search.search_embeddings(spark, frame).select("query_id", "rank", "vec_id", "score").collect()), key=repr)


@pytest.mark.parametrize("spread", [1.0, 0.05])
def test_against_brute_force(spark, spread):
    r = np.random.default_rng(3)
    scale = np.where(np.arange(32) < 4, 1.0, spread)
    rows = [(k, (r.normal(size=32) * scale).astype(np.float32).tolist()) for k in range(1200)]
    assert search(spark, rows) == brute(rows)


def test_ties_repeats_and_bad_vectors(spark):
    one = [1.0, -0.5, 0.25]
    rows = [(k, one) for k in range(0, 130)]
    rows += [(200, None), (201, [1.0, None, 0.0]), (202, [float("nan"), 0.0, 0.0]), (203, [float("inf"), 0.0, 0.0]), (300, [0.0, 0.0, 0.0]), (301, [9.0, 0.0]), (302, []), (303, [1e30, 0.0, 0.0]), (304, [50000.0, 0.0, 0.0]), (None, one), (5, one), (100, one)]
    assert search(spark, rows) == brute(rows)


def test_components_of_any_size(spark):
    """300000 needs more than 28 bits once scaled, 3e6 more than 32, 1e12 more than 64 in a product; 1e30 and 2e30 differ only beyond them."""
    r = np.random.default_rng(5)
    rows = [(k, r.normal(size=3).astype(np.float32).tolist()) for k in range(90)]
    rows += [(k, [x, 0.5, -1.0]) for k, x in enumerate([300000.0, 3e6, 1e12, 1e30, 2e30, -1e30, -300000.0, 3.4e38], 100)]
    rows += [(400, [3e6, 1.0, 0.0]), (500, [-2e30, 1.0, 3.0]), (600, [0.0, 1e-5, 0.0]), (None, [300000.0, 9.0, 9.0]), (700, [0.0, 0.0]), (700, [1.0, 0.0])]
    assert search(spark, rows) == brute(rows)


def test_shards_and_blocks_follow_the_rows(spark):
    """Not the partitions that they come in: 211 of these make as many shards as one."""
    rows = spark.range(900).selectExpr("id AS vec_id", "array(float(id), 1f) AS embedding")
    for parts in (1, 211):
        sizes = [len(r.ids) // 8 for r in topk_search.shards(topk_search.scaled(rows.repartition(parts)), 900, 300).collect()]
        assert len(sizes) == 3 and sum(sizes) == 900 and max(sizes) < 600


def test_fewer_than_k_and_none(spark):
    assert search(spark, [(0, [1.0])]) == []
    assert search(spark, [(0, [1.0]), (7, [2.0])]) == [(0, 1, 7, 1024 * 2048)]
    assert search(spark, [(7, [2.0])]) == []
    assert search(spark, [(0, [float("nan")])]) == []


def test_bounds_save_work():
    r = np.random.default_rng(1)
    x = (r.normal(size=(64, 4000)) * np.where(np.arange(64) < 6, 1000, 3)[:, None]).astype(np.int32)
    ids, least, most, best = np.arange(4000), x.min(1).astype(np.int64), x.max(1).astype(np.int64), topk_search.Best(10)
    query = x[:, 17].copy()
    topk_search.max_score(query, -1, ids[:2000], x[:, :2000], x[:, :2000].min(1).astype(np.int64), x[:, :2000].max(1).astype(np.int64), best)
    read = topk_search.max_score(query, -1, ids[2000:], x[:, 2000:], least, most, best)
    assert read < 0.5 * 64 * 2000
    scores = query.astype(np.int64) @ x.astype(np.int64)
    assert sorted(zip(-best.scores, best.ids, strict=True)) == sorted(zip(-scores, ids, strict=True))[:10]
