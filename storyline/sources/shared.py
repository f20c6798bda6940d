"""The folder that driver and executors share, and tables written there between the steps of one operator."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """As the session's spark.checkpoint.dir names it. Only where there is none and Spark runs on one machine alone, a temporary one is set."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="storyline-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """df as a table under the shared folder: what is lost later is read again, not computed again, and doesn't change."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/storyline/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
