"""Tables written on the way, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def fresh_path(spark: SparkSession) -> str:
    """A new path under ``spark.checkpoint.dir``. Only where that is unset on one machine (tests) a temporary folder is
    taken; on a cluster that is an error."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/tidemark-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """``df``, written as Parquet to a fresh path and read again."""
    path = fresh_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
