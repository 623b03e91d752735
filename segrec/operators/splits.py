"""A persisted train/validation/test split: which transaction is where, by windows of time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segrec.operators.facts import micros

PARTS = ("train", "validation", "test")


def assigned(interactions: DataFrame, cuts: tuple[float, float]) -> DataFrame:
    """Rows (txn, part): before the first cut, between the cuts, from the second on."""
    at = micros("ts")
    return interactions.select("txn", F.when(at < cuts[0], PARTS[0]).when(at < cuts[1], PARTS[1]).otherwise(PARTS[2]).alias("part"))


def persist(interactions: DataFrame, cuts: tuple[float, float], path: str) -> None:
    """Write the transactions' numbers, a folder for each part, and one row of metadata beside them: no copy of the data."""
    assigned(interactions, cuts).repartition("part", F.pmod(F.xxhash64("txn"), F.lit(64))).write.partitionBy("part").parquet(f"{path}/transactions")
    spark = interactions.sparkSession
    written = spark.read.parquet(f"{path}/transactions").groupBy("part").agg(F.count("*").alias("rows"))
    told = written.agg(F.map_from_entries(F.collect_list(F.struct("part", "rows"))).alias("rows"))  # three parts
    told.select(F.lit(float(cuts[0])).alias("first_cut"), F.lit(float(cuts[1])).alias("second_cut"), "rows").coalesce(1).write.json(f"{path}/metadata")


def metadata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("first_cut double, second_cut double, rows map<string,bigint>").json(f"{path}/metadata")


def part(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Transactions (txn) of one part; only its folder is read."""
    if name not in PARTS:
        raise ValueError(f"parts are {PARTS}, not {name}")
    return spark.read.schema("txn string, part string").parquet(f"{path}/transactions").where(F.col("part") == name).select("txn")


def restored(interactions: DataFrame, path: str, name: str) -> DataFrame:
    """The interactions of one stored part."""
    return interactions.join(part(interactions.sparkSession, path, name), "txn", "left_semi").select(*interactions.columns)
