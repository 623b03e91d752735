"""Result documents: nested JSON that the engine writes, and tidy frames read back from it.

A document has a map of subjects (architectures, methods), each with a map of metrics by cutoff and the
difference from the reference: ``{"kind", "engine", "source", "results": {name: {"overall": {"10": {...}},
"vs_random": {...}}}}``. Every document is one file; readers take any number of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METRICS = ("ndcg", "hit_rate", "precision", "precision_ceiling", "recall", "mrr", "coverage", "gini")
_OVERALL = "struct<" + ",".join(f"{m}:double" for m in METRICS) + ">"
_VS = "struct<mean_difference:double,ci_95_low:double,ci_95_high:double,significant:boolean>"
SCHEMA = f"kind string, engine string, source string, users bigint, results map<string,struct<overall:map<string,{_OVERALL}>,vs_random:{_VS}>>"


class MissingResults(FileNotFoundError):
    """A result document isn't there."""


def write_results(rows: DataFrame, path: str, kind: str, engine: str, source: str) -> None:
    """Write tidy rows (name, k, users, metrics..., mean_difference, ci_95_low, ci_95_high, significant) as one document."""
    overall = F.struct(F.col("k").cast("string").alias("key"), F.struct(*METRICS).alias("value"))
    versus = F.max(F.struct("mean_difference", "ci_95_low", "ci_95_high", "significant")).alias("vs_random")
    each = rows.groupBy("name").agg(F.map_from_entries(F.collect_list(overall)).alias("overall"), versus, F.max("users").alias("users"))  # one row a cutoff
    entry = F.struct(F.col("name").alias("key"), F.struct("overall", "vs_random").alias("value"))
    whole = each.agg(F.max("users").alias("users"), F.map_from_entries(F.collect_list(entry)).alias("results"))
    whole.select(F.lit(kind).alias("kind"), F.lit(engine).alias("engine"), F.lit(source).alias("source"), "users", "results").coalesce(1).write.json(f"{path}/{kind}")


def read_documents(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The documents of a kind as written, one row each; raises if there are none."""
    if not available(spark, path, (kind,))[kind]:
        raise MissingResults(f"no {kind} results under {path}; evaluate them first")
    return spark.read.schema(SCHEMA).option("multiLine", True).json(f"{path}/{kind}")


def comparison(spark: SparkSession, path: str, kind: str, k: int, deployed: str, reference: str = "random") -> DataFrame:
    """A tidy row for each subject of a document at cutoff ``k``, with its difference from random."""
    rows = read_documents(spark, path, kind).select(F.explode("results").alias("name", "r"))
    at = F.col("r.overall")[str(k)]
    return rows.where(at.isNotNull()).select(
        "name", *[at[m].alias(m) for m in METRICS], F.col("r.vs_random.mean_difference").alias("vs_random"), F.col("r.vs_random.ci_95_low").alias("ci_low"), F.col("r.vs_random.ci_95_high").alias("ci_high"),
        F.coalesce("r.vs_random.significant", F.lit(False)).alias("significant"), (F.col("name") == reference).alias("is_reference"), (F.col("name") == deployed).alias("is_deployed"),
    )


def provenance(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """One row: what a document was computed with, from which source, over how many users, and what it compares."""
    return read_documents(spark, path, kind).select("kind", "engine", "source", "users", F.sort_array(F.map_keys("results")).alias("subjects"))


def lift_proxy(spark: SparkSession, path: str, kind: str, k: int, deployed: str, base: str, reference: str = "random") -> DataFrame:
    """One row: the deployed subject's hit rate over the base's, never without the reference's own."""
    rows = comparison(spark, path, kind, k, deployed, reference)
    of = lambda n: F.max(F.when(F.col("name") == n, F.col("hit_rate")))
    return rows.agg((of(deployed) / of(base)).alias("deployed"), (of(reference) / of(base)).alias("reference"))


def available(spark: SparkSession, path: str, kinds: tuple[str, ...]) -> dict[str, bool]:
    """Which kinds of results are present."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return {k: system.exists(spark._jvm.org.apache.hadoop.fs.Path(folder, k)) for k in kinds}
