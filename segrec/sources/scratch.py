"""Where stored models and intermediate tables go: a folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; on one machine, where that is unset, a temporary folder that ends with the process."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="segrec-")
        atexit.register(shutil.rmtree, path, True)
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/segrec/{name}-{uuid.uuid4().hex}"


_SIZES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1024", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def stored_in_small_batches(df: DataFrame, name: str) -> DataFrame:
    """As ``stored``, of a frame made in Python of long rows: a batch has 1,024 rows or 8 MB, as it is held a few times over outside the heap."""
    conf = df.sparkSession.conf
    before = {key: conf.get(key, None) for key in _SIZES}
    try:
        for key, value in _SIZES.items():
            conf.set(key, value)
        return stored(df, name)
    finally:
        for key, value in before.items():
            conf.unset(key) if value is None else conf.set(key, value)


_written: list[str] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet and read from there, until ``clear``."""
    path = scratch_path(df.sparkSession, name)
    _written.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> int:
    """Deletes the tables that ``stored`` has written so far, and tells how many; call it once the results that read them are read."""
    paths = _written[:]
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        _written.remove(path)
    return len(paths)
