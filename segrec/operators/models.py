"""Segment models that outlive their session: fit, save, load, assign.

A stored model is a folder: ``scaler`` (a row for each model column, in order: centre, scale, weight),
``centroids`` (cluster, position, c), ``clusterer`` (the Spark ML model itself, if one was fitted),
``segments`` (the persisted assignments, if saved), ``manifest`` (one row: artifact set, engine, Spark and
schema version, source) and ``files`` (a checksum of every file of the others). Users are scaled by the
training population's statistics, never by their own.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import __version__ as spark_version
from pyspark.ml.clustering import KMeansModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segrec.operators import clustering
from segrec.operators.quality import require_clean
from segrec.sources.scan import IntegrityError, check_integrity, save_manifest, set_version

ENGINE_VERSION = "3"
SCHEMA_VERSION = "1"
_SCALER = "position int, column string, centre double, scale double, weight double"
_CENTROIDS = "cluster int, position int, c double"
_PARTS = ("scaler", "centroids", "clusterer", "segments")


class VersionError(ValueError):
    """A stored model was written by another engine, Spark or schema version, or from another source; ``kinds`` says which."""

    def __init__(self, problems: dict[str, str]) -> None:
        super().__init__("; ".join(f"{kind}: {text}" for kind, text in problems.items()))
        self.kinds = tuple(problems)


class ColumnOrderError(ValueError):
    """A matrix has other columns than the model, or in another order."""


@dataclass(frozen=True)
class SegmentModel:
    """A scaler and centroids. ``scaler`` rows are (column, centre, scale, weight) in the order of the model's columns."""

    scaler: tuple[tuple[str, float, float, float], ...]
    centroids: tuple[tuple[float, ...], ...]
    source: str = ""
    clusterer: KMeansModel | None = None
    manifest: dict = field(default_factory=dict)
    problems: tuple[str, ...] = ()

    @property
    def columns(self) -> list[str]:
        return [c for c, *_ in self.scaler]

    # ---- use

    def check_columns(self, columns: list[str]) -> None:
        """Refuse a matrix whose columns aren't the model's, in the model's order."""
        if list(columns) != self.columns:
            lost = [c for c in self.columns if c not in columns]
            why = f"missing {lost}" if lost else "another order" if sorted(columns) == sorted(self.columns) else "unknown columns"
            raise ColumnOrderError(f"the model's columns are {self.columns}, given were {list(columns)}: {why}")

    def _scaled(self, values: list[Column]) -> Column:
        z = [(F.coalesce(v.cast("double"), F.lit(0.0)) - F.lit(float(m))) / F.lit(float(s)) * F.lit(float(w)) for v, (_, m, s, w) in zip(values, self.scaler, strict=True)]
        return F.array(*z)

    def vectors(self, features: DataFrame, key: str) -> DataFrame:
        """Rows (key, vector): the model's columns of ``features``, by name, scaled."""
        lost = [c for c in self.columns if c not in features.columns]
        if lost:
            raise ColumnOrderError(f"features lack {lost}")
        return features.select(key, self._scaled([F.col(f"`{c}`") for c in self.columns]).alias("vector"))

    def nearest(self, vector: Column) -> Column:
        """The nearest centroid's number; ties to the smaller."""
        d = lambda c: F.aggregate(F.zip_with(vector, c, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x)
        table = F.array(*[F.struct(F.round(d(F.array(*[F.lit(x) for x in c])), 9).alias("d"), F.lit(k).alias("cluster")) for k, c in enumerate(self.centroids)])
        return F.array_min(table)["cluster"]

    def assign(self, features: DataFrame, key: str) -> DataFrame:
        """Rows (key, cluster) of feature rows."""
        return self.vectors(features, key).select(key, self.nearest(F.col("vector")).alias("cluster"))

    def assign_matrix(self, rows: DataFrame, key: str, values: str, columns: list[str]) -> DataFrame:
        """Rows (key, cluster) of unscaled arrays whose entries are ``columns``: they must be the model's, in its order."""
        self.check_columns(columns)
        scaled = self._scaled([F.get(F.col(values), F.lit(i)) for i in range(len(columns))])
        return rows.select(key, scaled.alias("vector")).select(key, self.nearest(F.col("vector")).alias("cluster"))

    # ---- store

    def save(self, spark: SparkSession, path: str, segments: DataFrame | None = None) -> dict:
        """Write the model, and with it the assignments ``segments`` (user_id, cluster); returns the manifest."""
        spark.createDataFrame([(k, *r) for k, r in enumerate(self.scaler)], _SCALER).coalesce(1).write.parquet(f"{path}/scaler")
        rows = [(k, i, float(x)) for k, c in enumerate(self.centroids) for i, x in enumerate(c)]
        spark.createDataFrame(rows, _CENTROIDS).coalesce(1).write.parquet(f"{path}/centroids")
        if self.clusterer is not None:
            self.clusterer.write().save(f"{path}/clusterer")
        if segments is not None:
            segments.sortWithinPartitions(segments.columns[0]).write.parquet(f"{path}/segments")
        told = {"engine": ENGINE_VERSION, "spark": spark_version, "schema": SCHEMA_VERSION, "source": self.source, "columns": self.columns, "clusters": len(self.centroids)}
        told["artifact_set"] = set_version(*map(str, told.values()), str(self.scaler), str(self.centroids))
        kept = [p for p in _PARTS if p in ("scaler", "centroids") or (p == "clusterer" and self.clusterer is not None) or (p == "segments" and segments is not None)]
        told["parts"] = kept
        spark.createDataFrame([told], _MANIFEST).coalesce(1).write.json(f"{path}/manifest")
        for part in kept:
            save_manifest(spark, f"{path}/{part}", f"{path}/files/{part}", told["artifact_set"])
        return told

    @staticmethod
    def load(spark: SparkSession, path: str, source: str | None = None, strict: bool = True) -> SegmentModel:
        """A stored model, once its versions, source and files are checked; with ``strict`` false problems of version are kept in ``problems``."""
        told = spark.read.schema(_MANIFEST).json(f"{path}/manifest").first().asDict()
        problems = incompatible(told, source)
        if problems and strict:
            raise VersionError(problems)
        for part in told["parts"]:
            bad = check_integrity(spark, f"{path}/{part}", f"{path}/files/{part}").limit(20).collect()
            if bad:
                raise IntegrityError(f"{part}: {[r.asDict() for r in bad]}")
        scaler = tuple((r["column"], r["centre"], r["scale"], r["weight"]) for r in spark.read.schema(_SCALER).parquet(f"{path}/scaler").orderBy("position").collect())
        if [c for c, *_ in scaler] != told["columns"]:
            raise ColumnOrderError("scaler and manifest have other columns")
        rows = spark.read.schema(_CENTROIDS).parquet(f"{path}/centroids").orderBy("cluster", "position").collect()
        centroids = tuple(tuple(r["c"] for r in rows if r["cluster"] == k) for k in range(told["clusters"]))
        clusterer = KMeansModel.load(f"{path}/clusterer") if "clusterer" in told["parts"] else None
        return SegmentModel(scaler, centroids, told["source"], clusterer, told, tuple(f"{k}: {v}" for k, v in problems.items()))


_MANIFEST = "engine string, spark string, schema string, source string, columns array<string>, clusters int, artifact_set string, parts array<string>"


def incompatible(manifest: dict, source: str | None = None) -> dict[str, str]:
    """Problems of a stored model in this session, by kind: engine, schema, spark (its minor version) and source."""
    minor = lambda v: v.split(".")[:2]
    here = {"engine": ENGINE_VERSION, "schema": SCHEMA_VERSION}
    found = {k: f"written by {manifest[k]}, running {v}" for k, v in here.items() if manifest[k] != v}
    if minor(manifest["spark"]) != minor(spark_version):
        found["spark"] = f"written by {manifest['spark']}, running {spark_version}"
    if source is not None and manifest["source"] != source:
        found["source"] = f"trained from {manifest['source']}, given {source}"
    return found


def scaler_of(features: DataFrame, blocks: dict[str, list[str]], robust: bool = False, weighted: bool = False) -> tuple[tuple[str, float, float, float], ...]:
    """Centre, scale and weight of each column of the blocks, in their order, over all rows."""
    columns = [c for members in blocks.values() for c in members]
    share = {c: len(members) ** -0.5 if weighted else 1.0 for members in blocks.values() for c in members}
    if robust:
        from segrec.functions.quantiles import column_quantiles

        q = column_quantiles(features.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns]), columns, [0.25, 0.5, 0.75])
        return tuple((c, q[c][1], q[c][2] - q[c][0] or 1.0, share[c]) for c in columns)
    zero = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns]
    row = features.agg(*[F.avg(v).alias(f"m{i}") for i, v in enumerate(zero)], *[F.stddev_pop(v).alias(f"s{i}") for i, v in enumerate(zero)]).first()
    return tuple((c, float(row[f"m{i}"]), float(row[f"s{i}"]) or 1.0, share[c]) for i, c in enumerate(columns))


def fit(features: DataFrame, key: str, blocks: dict[str, list[str]], k: int, findings: DataFrame | None = None, known: tuple[str, ...] = (), source: str = "", robust: bool = False, weighted: bool = False, n_init: int = 10, seed: int = 42) -> SegmentModel:
    """A K-Means model of users' features. ``findings`` of the quality report stop it if one is an error that isn't ``known``."""
    if findings is not None:
        require_clean(findings, known)
    scaler = scaler_of(features, blocks, robust, weighted)
    rows = SegmentModel(scaler, ()).vectors(features, key)
    model = clustering.fit_kmeans(rows, "vector", k, seed, n_init)
    return SegmentModel(scaler, tuple(tuple(map(float, c)) for c in model.clusterCenters()), source, model)


def from_labels(features: DataFrame, key: str, columns: list[str], label: str, source: str = "") -> SegmentModel:
    """A model whose centroids are the means of labelled rows, clusters numbered by label."""
    scaler = scaler_of(features, {"all": columns})
    scaled = SegmentModel(scaler, ()).vectors(features.select(key, label, *columns), key).join(features.select(key, label), key)
    means = scaled.groupBy(label).agg(*[F.avg(F.get("vector", F.lit(i))).alias(f"c{i}") for i in range(len(columns))]).orderBy(label).collect()
    return SegmentModel(scaler, tuple(tuple(r[f"c{i}"] for i in range(len(columns))) for r in means), source)


def segment_of(spark: SparkSession, path: str, user_id: int) -> int | None:
    """The persisted segment of a user, or None; reads one row group at most of each file."""
    row = spark.read.parquet(f"{path}/segments").where(F.col("user_id") == user_id).first()
    return None if row is None else row["cluster"]


_EXPORT = "key string, columns array<struct<position:int,name:string,kind:string>>, model_columns array<string>, config struct<clusters:int,artifact_set:string,engine:string>"


def export_schema(features: DataFrame, key: str, model: SegmentModel, path: str) -> None:
    """SK12: one JSON document: the features' columns and types in order, the model's columns and its frozen configuration."""
    columns = [(i, name, kind) for i, (name, kind) in enumerate(features.dtypes)]
    row = (key, columns, model.columns, (len(model.centroids), model.manifest.get("artifact_set"), ENGINE_VERSION))
    features.sparkSession.createDataFrame([row], _EXPORT).coalesce(1).write.json(path)


def check_schema(features: DataFrame, path: str) -> None:
    """Refuse features whose columns or types differ from an exported schema's."""
    told = features.sparkSession.read.schema(_EXPORT).option("multiLine", True).json(path).first()
    want, have = [(c["name"], c["kind"]) for c in told["columns"]], features.dtypes
    if want != have:
        changed = sorted(set(want) ^ set(have)) or "their order"
        raise ColumnOrderError(f"features differ from the exported schema in {changed}")
