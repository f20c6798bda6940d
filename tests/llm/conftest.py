from __future__ import annotations

import random

import pytest
from pyspark.sql import types as T

#: Columns of documents, and some whose names operators use themselves.
DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = ", score double, kept boolean, shard int, size string, part int, band long, digest string, rate string, a int, b int, window string, doc string"


@pytest.fixture
def documents(spark):
    """A table of documents from (doc_id, text) or (doc_id, text, source)."""

    def make(rows, extra=False):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) + ((0.5, True, 1, "x", 2, 3, "y", "z", 1, 2, "w", "v") if extra else ()) for r in rows]
        return spark.createDataFrame(full, DOCUMENT + (EXTRA if extra else ""))

    return make


@pytest.fixture
def rng():
    return random.Random(5)


@pytest.fixture
def words(rng):
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8))) for _ in range(4000)]
    return lambda n: rng.choices(vocabulary, k=n)


def as_table(spark, path, df):
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture
def tables(spark, tmp_path):
    """Writes tables into a folder as queries read them, and returns the folder."""

    def make(**frames):
        for name, df in frames.items():
            df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return make


LABELS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()), T.StructField("toxic", T.IntegerType())])
