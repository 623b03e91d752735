"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and every executor can reach.

    It is the session's ``spark.checkpoint.dir``; only where that is unset and all runs on one machine
    (local tests) is a temporary folder made and recorded in the session.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="segrec-")
        atexit.register(shutil.rmtree, path, True)
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_dir(spark)}/segrec/{name}-{uuid.uuid4().hex}"


_scopes: list[list[str]] = []


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables that ``materialise`` writes inside are deleted at the end: what goes on must not read them."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def materialise(df: DataFrame, name: str, lasting: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors.

    A ``lasting`` table outlives the innermost ``passing`` block and goes with the one around it, if there is one.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    if len(_scopes) > lasting:
        _scopes[-1 - lasting].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """What runs inside gives Python workers Arrow batches of at most ``rows`` rows: a worker's memory is that of so many texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def spread(rows: DataFrame, each: int = 50_000) -> DataFrame:
    """``rows`` in parts of about ``each`` rows, before every row becomes many."""
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() // each)
    return rows.repartition(parts)


def text_or_empty(name: str) -> Column:
    """The column as text, null as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def packed_row(df: DataFrame) -> Column:
    """All columns of ``df`` in one struct, so that helper columns cannot clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])
