from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    at = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", f"file://{at}/shared")
        .config("spark.sql.warehouse.dir", f"{at}/warehouse")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def value(spark):
    """The value of an expression over one row of named columns."""

    def of(expression, **columns):
        names = list(columns) or ["_"]
        rows = [tuple(columns.values()) or (0,)]
        kinds = ", ".join(f"`{n}` {'array<string>' if isinstance(v, list) else 'double' if isinstance(v, float) else 'long' if isinstance(v, int) else 'string'}" for n, v in zip(names, rows[0], strict=True))
        return spark.createDataFrame(rows, kinds).select(expression.alias("v")).first()["v"]

    return of
