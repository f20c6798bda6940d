from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from storyline.functions.ranks import positions, positions_within


@pytest.fixture
def put(spark, tmp_path):
    def write(df):
        df.write.mode("overwrite").parquet(f"{tmp_path}/placed")
        return spark.read.parquet(f"{tmp_path}/placed")

    return write


def test_places_over_the_whole_table(spark, put):
    rng = random.Random(2)
    rows = [(rng.choice([None, *range(40)]), k, "x") for k in range(5000)]
    frame = spark.createDataFrame(rows, "value int, id long, at string").repartition(7)
    got = positions(frame, [F.desc_nulls_last("value"), F.asc("id")], put).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert sorted((r.position, r.value, r.id, r["at"]) for r in got if r.value is not None) == [(k, *r) for k, r in enumerate(order) if r[0] is not None]
    assert sorted((r.position, r.id) for r in got if r.value is None) == [(k, r[1]) for k, r in enumerate(order) if r[0] is None]


def test_one_hot_value_is_spread_over_ranges(spark, put, request):
    """All rows are alike, and yet no range has most of them."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled"))
    frame = spark.range(100000).select(F.lit(1).alias("value")).repartition(4)
    held = {}

    def keep(df):
        held["placed"] = put(df)
        return held["placed"]

    got = positions(frame, [F.col("value")], keep)
    assert got.agg(F.count_distinct("position").alias("n"), F.max("position").alias("m")).first()[:] == (100000, 99999)
    sizes = [r["count"] for r in held["placed"].groupBy(F.shiftright("at", 33)).count().collect()]
    assert len(sizes) > 1 and max(sizes) < 60000


def test_places_within_groups(spark, put):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([1, None]), k) for k in range(3000)]
    got = positions_within(spark.createDataFrame(rows, "voice string, kind int, id long"), ["voice", "kind"], [F.desc("id")], put, "place").collect()
    want = {}
    for voice, kind, k in sorted(rows, key=lambda r: -r[2]):
        want.setdefault((voice, kind), []).append(k)
    assert sorted((repr((r.voice, r.kind)), r.place, r.id) for r in got) == sorted((repr(g), p, k) for g, ids in want.items() for p, k in enumerate(ids))


def test_no_rows(spark, put):
    assert positions(spark.createDataFrame([], "id long"), [F.col("id")], put).collect() == []
