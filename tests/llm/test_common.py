"""What the operators share: the bitmap that takes rows out of scans, and the folders that they leave."""

from __future__ import annotations

import re
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from storyline.llm.common import Sieve, Workspace, lean, shared_dir


@pytest.mark.parametrize("n", [0, 1, 5000])
def test_every_key_passes_and_few_others(spark, n):
    key = lambda c: F.xxhash64(F.col(c))
    sieve = Sieve.of(spark.range(n).select(key("id").alias("key")))
    rows = spark.range(40_000).withColumn("passes", sieve.passes(key("id")))
    assert rows.where((F.col("id") < n) & ~F.col("passes")).count() == 0
    assert rows.where((F.col("id") >= n) & F.col("passes")).count() < 0.03 * 40_000


def test_a_full_bitmap_lets_everything_through(spark, monkeypatch):
    """Beyond its bound it only takes out fewer rows."""
    monkeypatch.setattr(Sieve, "MOST", 1 << 10)
    sieve = Sieve.of(spark.range(3000).select(F.xxhash64("id").alias("key")))
    assert spark.range(3000).where(~sieve.passes(F.xxhash64("id"))).count() == 0
    assert len(sieve.words.value) == 16


def test_folders_can_be_removed(spark, monkeypatch):
    monkeypatch.setattr(Workspace, "made", [])
    ws = Workspace(spark, "gone")
    at = ws.put(spark.range(3), "rows")
    assert at.count() == 3 and Workspace.made == [ws]
    Workspace.remove_all()
    path = spark._jvm.org.apache.hadoop.fs.Path(ws.root)
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path) and Workspace.made == []


def test_the_shared_folder_is_the_sessions(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


def test_a_cluster_without_one_is_an_error():
    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            getConf = staticmethod(Conf)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session())


@pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists() or not sys.platform.startswith("linux"), reason="memory can't be read here")
def test_a_worker_gives_memory_back_after_a_task():
    """What a task has freed lies below what is kept, so that the C library wouldn't return it."""
    own = lambda: int(re.search(r"Pss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024
    kept, grown = [], []

    def run(batches):
        for batch in batches:
            held = [b"x" * 100_000 for _ in range(1000)]
            kept.append(b"y" * 100_000)
            del held
            grown.append(own())
            yield batch

    before = own()
    assert list(run(iter([1, 2]))) == [1, 2] and own() - before > 60
    assert list(lean(run)(iter([3, 4]))) == [3, 4] and own() - before < 30
    assert max(grown) - before > 60
