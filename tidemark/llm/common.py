"""Shared helpers: the folder all executors see, written tables, files in it, and ordered prefix sums."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """A fresh path in the folder that driver and executors share.

    The folder is ``spark.checkpoint.dir`` of the session. Only where that is unset on one machine (tests)
    a temporary folder is made and set, so that later calls use the same one; on a cluster that is an error.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/tidemark-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return the table read again: lineage is cut, and the
    rows survive the loss of any executor."""
    path = path or shared_dir(df.sparkSession)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts(spark: SparkSession) -> int:
    """Number of partitions that the session is sized for."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def local_path(uri: str) -> str | None:
    """The path of a URI on a mounted file system, else None."""
    if uri.startswith("file:"):
        return "/" + uri[len("file:") :].lstrip("/")
    return uri if uri.startswith("/") else None


def open_out(uri: str):
    """A binary output stream at ``uri``; parents are made."""
    if (p := local_path(uri)) is not None:
        os.makedirs(os.path.dirname(p), exist_ok=True)
        return open(p, "wb")
    from pyarrow import fs

    store, p = fs.FileSystem.from_uri(uri)
    store.create_dir(os.path.dirname(p), recursive=True)
    return store.open_output_stream(p)


def map_in(uri: str) -> memoryview:
    """The bytes at ``uri``: memory-mapped if the store is mounted, else read."""
    if (p := local_path(uri)) is not None:
        if os.path.getsize(p) == 0:
            return memoryview(b"")
        return memoryview(pa.memory_map(p).read_buffer())
    from pyarrow import fs

    store, p = fs.FileSystem.from_uri(uri)
    with store.open_input_file(p) as f:
        return memoryview(f.read_buffer())


def open_in(uri: str):
    """A file object with seek and read, for range reads."""
    if (p := local_path(uri)) is not None:
        return open(p, "rb", buffering=0)
    from pyarrow import fs

    store, p = fs.FileSystem.from_uri(uri)
    return store.open_input_file(p)






def crc32_mod(col: str, n: int) -> Column:
    """crc32 of the column's value as text, modulo n; a null value counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % n


def ordered_sums(df: DataFrame, order: list[str], sums: dict[str, str]) -> DataFrame:
    """Running totals over all rows in the order of ``order``, with no task that sees all rows.

    Rows are range-partitioned on ``order`` and written with their partition's number; totals of the
    partitions (one row each) are summed up in order and added to the running totals inside each. For each
    ``{name: expression}`` of ``sums``, column ``name`` is the total of the expression over all rows before.
    Rows that tie on ``order`` keep some order among themselves; add columns to make it definite.
    """
    values = {f"_v_{k}": F.expr(e).cast("long") for k, e in sums.items()}
    cut = written(df.withColumns(values).repartitionByRange(parts(df.sparkSession), *order).withColumn("_pid", F.spark_partition_id()))
    totals = cut.groupBy("_pid").agg(*[F.sum(v).alias(f"_t{v}") for v in values])
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("_pid", *[F.coalesce(F.sum(f"_t{v}").over(before), F.lit(0)).alias(f"_b{v}") for v in values])
    inside = Window.partitionBy("_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = cut.withColumns({f"_s{v}": F.coalesce(F.sum(v).over(inside), F.lit(0)) for v in values}).join(base, "_pid")
    return out.select(*df.columns, *[(F.col(f"_b_v_{k}") + F.col(f"_s_v_{k}")).alias(k) for k in sums])
