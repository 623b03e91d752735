"""Representations, clustering and its quality measures.

Measures work on long frames (id, label, dim, x), so that any number of dimensions stays an ordinary
aggregation. The silhouette compares all pairs in blocks; linkage, which holds all pairs at once, takes a
documented bound and raises beyond it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segrec.functions.quantiles import column_quantiles
from segrec.operators import kmeans, mixtures
from segrec.operators.blocks import cluster_distances, ward_distances, ward_nearest
from segrec.operators.facts import CATEGORIES
from segrec.sources.scratch import stored

MAX_LINKAGE = 4_000
#: Fits that are submitted at once.
AT_ONCE = 8


def long_form(df: DataFrame, key: str, vector: str, label: str | None = None) -> DataFrame:
    """Rows (id, label, dim, x) of an array column."""
    labels = [F.col(label).alias("label")] if label else []
    return df.select(F.col(key).alias("id"), *labels, F.posexplode(F.col(vector).cast("array<double>")).alias("dim", "x"))


def standardised(features: DataFrame, columns: list[str], robust: bool = False) -> DataFrame:
    """ML3: columns minus mean over population deviation (or median over quartile range); a constant column is divided by 1."""
    if robust:
        q = column_quantiles(features, columns, [0.25, 0.5, 0.75])
        z = {c: (F.coalesce(F.col(c), F.lit(0.0)) - q[c][1]) / ((q[c][2] - q[c][0]) or 1.0) for c in columns}
        return features.select("user_id", *[v.alias(c) for c, v in z.items()])
    center, scale = {c: F.avg(c) for c in columns}, {c: F.stddev_pop(c) for c in columns}
    stats = features.agg(*[v.alias(f"m_{c}") for c, v in center.items()], *[v.alias(f"s_{c}") for c, v in scale.items()])
    z = {c: (F.coalesce(F.col(c), F.lit(0.0)) - F.col(f"m_{c}")) / F.when(F.col(f"s_{c}") == 0, 1.0).otherwise(F.col(f"s_{c}")) for c in columns}
    return features.join(F.broadcast(stats)).select("user_id", *[v.alias(c) for c, v in z.items()])


def representation(features: DataFrame, blocks: dict[str, list[str]], robust: bool = False, weighted: bool = False) -> DataFrame:
    """ML1: rows (user_id, vector): scaled blocks of columns, each divided by the root of its size if ``weighted``."""
    columns = [c for members in blocks.values() for c in members]
    share = {c: 1 / np.sqrt(len(members)) if weighted else 1.0 for members in blocks.values() for c in members}
    scaled = standardised(features, columns, robust)
    return scaled.select("user_id", F.array(*[F.col(c) * float(share[c]) for c in columns]).alias("vector"))


@dataclass(frozen=True)
class Arm:
    """ML2: one way to represent users: category encoding, further blocks, scaling, block weights."""

    name: str
    category: str = "proportion"
    level: bool = True
    extra: bool = True
    demographics: bool = False
    providers: bool = False
    drop_correlated: bool = False
    robust: bool = False
    weighted: bool = False


GRID = (
    Arm("proportion"),
    Arm("one_hot", category="one_hot"),
    Arm("facets", category="facets"),
    Arm("numeric_only", category="none", level=False),
    Arm("basic", extra=False),
    Arm("demographic", demographics=True),
    Arm("provider", providers=True),
    Arm("uncorrelated", drop_correlated=True),
    Arm("robust", robust=True),
    Arm("weighted", weighted=True),
)
BASIC = ["total_courses", "avg_rating", "avg_spend", "depth_index", "diversity_score"]
EXTRA = ["frequency", "activity_span_days", "free_ratio", "category_entropy", "recency_days"]
CORRELATED = {"frequency", "diversity_score"}


def arm_blocks(arm: Arm) -> dict[str, list[str]]:
    """Column blocks of an arm; empty blocks are left out."""
    numeric = [c for c in BASIC + (EXTRA if arm.extra else []) if not (arm.drop_correlated and c in CORRELATED)]
    category = {"proportion": [f"share_{c}" for c in CATEGORIES], "one_hot": [f"prefers_{c}" for c in CATEGORIES], "facets": [c for c in ("category_entropy", "top_category_share") if c not in numeric], "none": []}
    blocks = {"numeric": numeric, "category": category[arm.category], "level": [f"level_{k}" for k in range(3)] if arm.level else [], "demographic": ["balance"] if arm.demographics else [], "provider": ["n_providers", "loyalty"] if arm.providers else []}
    return {name: members for name, members in blocks.items() if members}


def represent(features: DataFrame, arm: Arm) -> DataFrame:
    """Rows (user_id, vector) of an arm of the grid."""
    wide = with_levels(features).withColumns({f"prefers_{c}": (F.col("preferred_category") == c).cast("double") for c in CATEGORIES})
    return representation(wide, arm_blocks(arm), arm.robust, arm.weighted)


def grid_comparison(features: DataFrame, k: int = 4, n_init: int = 3, arms: tuple[Arm, ...] = GRID) -> DataFrame:
    """ML2: rows (arm, users, dims, norm, silhouette, smallest_share, agreement): every arm clustered, and its agreement with the first."""

    def at(arm: Arm) -> tuple:
        rows = represent(features, arm)
        labelled = predict(fit_kmeans(rows, "vector", k, n_init=n_init), rows, "vector")
        by = cluster_silhouettes(labelled, "vector", "cluster").agg(F.sum(F.col("n") * F.col("silhouette")) / F.sum("n"), F.min("n") / F.sum("n"), F.sum("n")).first()
        square = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
        told = rows.agg(F.max(F.size("vector")), F.avg(square)).first()
        return arm.name, labelled.select("user_id", F.col("cluster").alias(arm.name)), (int(by[2]), int(told[0]), float(told[1]), float(by[0]), float(by[1]))

    found = together(at, arms)
    first, base, _ = found[0]
    alike = together(lambda x: float(adjusted_rand(base.join(x[1], "user_id"), first, x[0]).first()[0]) if x[0] != first else 1.0, found)
    rows = [(name, *told, ari) for (name, _, told), ari in zip(found, alike, strict=True)]
    return features.sparkSession.createDataFrame(rows, "arm string, users bigint, dims int, norm double, silhouette double, smallest_share double, agreement double")


def with_levels(features: DataFrame) -> DataFrame:
    """One-hot columns of the preferred level."""
    return features.withColumns({f"level_{k}": (F.col("preferred_level") == k).cast("double") for k in range(3)})


def assign(points: DataFrame, centroids: DataFrame) -> DataFrame:
    """ML6: rows (id, cluster): the nearest centroid (cluster, dim, c); ties to the smaller cluster. Centroids are few."""
    distance = points.join(F.broadcast(centroids), "dim").groupBy("id", "cluster").agg(F.sum((F.col("x") - F.col("c")) ** 2).alias("d"))
    return distance.groupBy("id").agg(F.min_by("cluster", F.struct(F.round("d", 9), "cluster")).alias("cluster"))


def centroids_of(points: DataFrame) -> DataFrame:
    return points.groupBy(F.col("label").alias("cluster"), "dim").agg(F.avg("x").alias("c"))


def silhouette(df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """ML11: rows (id, label, silhouette), Euclidean; a singleton has 0. All pairs are compared in blocks; ``key`` is unique."""
    rows = df.select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    first = rows.select(F.size("v").alias("n")).first()
    totals = cluster_distances(rows, first["n"] if first else 1)
    sizes = F.broadcast(rows.groupBy(F.col("label").alias("o_label")).agg(F.count("*").alias("n")))  # one row a cluster
    own = F.col("label") == F.col("o_label")
    means = totals.join(sizes, "o_label").withColumn("mean", F.col("total") / F.nullif(F.col("n") - own.cast("int"), F.lit(0)))
    by = means.groupBy("id", "label").agg(F.max(F.when(own, F.col("mean"))).alias("a"), F.min(F.when(~own, F.col("mean"))).alias("b"))
    return by.select("id", "label", F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b")).alias("silhouette"))


def cluster_silhouettes(df: DataFrame, vector: str, label: str) -> DataFrame:
    """Rows (label, n, silhouette): the mean silhouette of each cluster by squared distances, in linear time from the clusters' sums.

    The mean squared distance from x to a cluster of n rows is |x|^2 + sum |y|^2 / n - 2 x . sum y / n. A singleton has 0.
    """
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    rows = df.select(F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v")).withColumn("q", dot("v", "v"))
    first = rows.select(F.size("v").alias("d")).first()
    dims = first["d"] if first else 0
    sums = rows.groupBy("label").agg(F.count("*").alias("n"), F.sum("q").alias("q"), *[F.sum(F.get("v", F.lit(i))).alias(f"y{i}") for i in range(dims)]).collect()  # a row a cluster
    away = {r["label"]: F.col("q") + r["q"] / r["n"] - F.lit(2.0) * dot("v", F.array(*[F.lit(r[f"y{i}"] / r["n"]) for i in range(dims)])) for r in sums}
    own, other = F.lit(None).cast("double"), []
    for r in sums:
        mine = F.col("label") == F.lit(r["label"])
        own = F.when(mine, away[r["label"]] * (r["n"] / (r["n"] - 1)) if r["n"] > 1 else F.lit(None)).otherwise(own)
        other.append(F.when(~mine, away[r["label"]]))
    near = F.array_min(F.array(*other)) if other else F.lit(None).cast("double")
    rows = rows.withColumns({"a": own, "b": near})
    value = F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise(F.coalesce((F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0)), F.lit(0.0)))
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.avg(value).alias("silhouette"))


def calinski_harabasz(points: DataFrame) -> DataFrame:
    """ML12: one row (calinski_harabasz)."""
    per = points.groupBy("label", "dim").agg(F.avg("x").alias("m"), F.count("*").alias("n"), F.var_pop("x").alias("v"))
    total = points.groupBy("dim").agg(F.avg("x").alias("g"))
    rows = per.join(F.broadcast(total), "dim")
    between, within = F.sum(F.col("n") * (F.col("m") - F.col("g")) ** 2), F.sum(F.col("n") * F.col("v"))
    sizes = points.select("id", "label").distinct().agg(F.count("*").alias("n_rows"), F.count_distinct("label").alias("k"))
    return rows.agg(between.alias("b"), within.alias("w")).join(sizes).select(((F.col("b") / (F.col("k") - 1)) / (F.col("w") / (F.col("n_rows") - F.col("k")))).alias("calinski_harabasz"))


def davies_bouldin(points: DataFrame) -> DataFrame:
    """ML12: one row (davies_bouldin)."""
    c = centroids_of(points).withColumnRenamed("cluster", "label")
    spread = points.join(F.broadcast(c), ["label", "dim"]).groupBy("id", "label").agg(F.sqrt(F.sum((F.col("x") - F.col("c")) ** 2)).alias("d")).groupBy("label").agg(F.avg("d").alias("s"))
    other = c.withColumnsRenamed({"label": "o_label", "c": "o_c"})
    apart = c.join(other, "dim").where("label <> o_label").groupBy("label", "o_label").agg(F.sqrt(F.sum((F.col("c") - F.col("o_c")) ** 2)).alias("d"))
    ratio = apart.join(spread, "label").join(spread.withColumnsRenamed({"label": "o_label", "s": "o_s"}), "o_label")
    return ratio.groupBy("label").agg(F.max((F.col("s") + F.col("o_s")) / F.col("d")).alias("r")).agg(F.avg("r").alias("davies_bouldin"))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """ML13: one row (ari) of two labelings of the same rows."""
    pairs = lambda n: n * (n - 1) / 2
    both = df.groupBy(a, b).agg(F.count("*").alias("n"))
    rows, cols = both.groupBy(a).agg(F.sum("n").alias("n")), both.groupBy(b).agg(F.sum("n").alias("n"))
    s = lambda d, name: d.agg(F.sum(pairs(F.col("n"))).alias(name), F.sum("n").alias(f"{name}_n"))
    t = s(both, "i").join(s(rows, "r")).join(s(cols, "c"))
    expected = F.col("r") * F.col("c") / pairs(F.col("i_n"))
    return t.select(((F.col("i") - expected) / ((F.col("r") + F.col("c")) / 2 - expected)).alias("ari"))


def intra_similarity(points: DataFrame) -> DataFrame:
    """ML14: rows (label, n, similarity): mean cosine of all pairs in a cluster, exactly and in linear time from the sum of unit vectors."""
    norms = points.groupBy("id").agg(F.sqrt(F.sum(F.col("x") ** 2)).alias("norm"))
    unit = points.join(norms, "id").withColumn("u", F.coalesce(F.col("x") / F.nullif(F.col("norm"), F.lit(0.0)), F.lit(0.0)))
    sums = unit.groupBy("label", "dim").agg(F.sum("u").alias("s"), F.sum(F.col("u") ** 2).alias("q"))
    sizes = points.groupBy("label").agg(F.count_distinct("id").alias("n"))
    by = sums.groupBy("label").agg(F.sum(F.col("s") ** 2).alias("whole"), F.sum("q").alias("own")).join(sizes, "label")
    return by.select("label", "n", F.when(F.col("n") > 1, (F.col("whole") - F.col("own")) / (F.col("n") * (F.col("n") - 1))).alias("similarity"))


def eta_squared(points: DataFrame) -> DataFrame:
    """Rows (dim, eta): share of a dimension's variance between clusters; 0 if it has none."""
    total = points.groupBy("dim").agg(F.avg("x").alias("g"), (F.var_pop("x") * F.count("*")).alias("t"))
    per = points.groupBy("label", "dim").agg(F.avg("x").alias("m"), F.count("*").alias("n"))
    return per.join(F.broadcast(total), "dim").groupBy("dim").agg(F.coalesce(F.sum(F.col("n") * (F.col("m") - F.col("g")) ** 2) / F.nullif(F.max("t"), F.lit(0.0)), F.lit(0.0)).alias("eta"))


def _vectors(df: DataFrame, vector: str) -> DataFrame:
    return df.withColumn("__v", array_to_vector(F.col(vector).cast("array<double>")))


def together(work: Callable, arguments: Iterable) -> list:
    """``work`` on each argument, several at a time: Spark runs their jobs side by side."""
    with ThreadPoolExecutor(AT_ONCE) as pool:
        return list(pool.map(inheritable_thread_target(SparkSession.active())(work), arguments))


def fit_kmeans(df: DataFrame, vector: str, k: int, seed: int = 42, n_init: int = 10) -> KMeansModel:
    """ML5: the model of least cost of ``n_init`` seeds; all fits share passes over the rows, told apart by their other columns.

    Spark's own model is made of the best centers: a fit to these few points alone, each of which is its cluster's mean.
    """
    points = kmeans.prepared(df, vector, *([c for c in df.columns if c != vector] or [vector]), seed=seed)
    try:
        centers, _, costs = kmeans.fit_many(points, [kmeans.Fit(k, seed + i) for i in range(n_init)])
    finally:
        points.unpersist()
    best = np.unique(centers[int(np.argmin(costs))], axis=0)
    few = df.sparkSession.createDataFrame([(c.tolist(),) for c in best], "c array<double>").coalesce(1)
    return KMeans(k=max(k, 2), seed=seed, initMode="random", maxIter=1, featuresCol="__v", predictionCol="cluster").fit(_vectors(few, "c"))


def predict(model: KMeansModel, df: DataFrame, vector: str) -> DataFrame:
    return model.transform(_vectors(df, vector)).drop("__v")


def kmeans_sweep(df: DataFrame, key: str, vector: str, ks: list[int], n_init: int = 10, seeds: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """ML7: rows (k, inertia, smallest_share, calinski_harabasz, davies_bouldin, silhouette, intra_similarity, silhouettes, seed_ari).

    Silhouettes, of all rows and of each cluster in its order, are those of squared Euclidean distances, which take one
    pass; ``seed_ari`` is the mean agreement of single fits from ``seeds``.
    """
    rows = df.select(key, vector).persist()
    points_of = kmeans.prepared(rows, vector, key)
    fits = {k: [kmeans.Fit(k, 42 + i) for i in range(n_init)] for k in ks}
    alone = {k: [kmeans.Fit(k, s) for s in seeds] for k in ks}
    every = [f for k in ks for f in (*fits[k], *alone[k])]

    def at(k: int) -> tuple:
        best = min(fits[k], key=lambda f: found[f][2])
        centers, sizes, cost = found[best]
        rows_k = kmeans.labelled(rows, key, vector, centers)
        points = long_form(rows_k, key, vector, "cluster")
        own = {r["label"]: (r["n"], r["silhouette"]) for r in cluster_silhouettes(rows_k, vector, "cluster").collect()}  # a row a cluster
        quality = sum(n * x for n, x in own.values()) / sum(n for n, _ in own.values())
        similar = intra_similarity(points).agg(F.sum(F.col("n") * F.col("similarity")) / F.sum("n")).first()[0]
        return (k, float(cost), float(min(sizes) / sum(sizes)), calinski_harabasz(points).first()[0], davies_bouldin(points).first()[0], float(quality), similar, [own[c][1] for c in sorted(own)], agreed[k])

    try:
        centers, sizes, costs = kmeans.fit_many(points_of, every)
        found = {f: told for f, *told in zip(every, centers, sizes, costs, strict=True)}
        agreed = _seed_agreement(points_of, alone, {f: told[0] for f, told in found.items()})
        rows_found = together(at, ks)
    finally:
        points_of.unpersist()
        rows.unpersist()
    return df.sparkSession.createDataFrame(rows_found, "k int, inertia double, smallest_share double, calinski_harabasz double, davies_bouldin double, silhouette double, intra_similarity double, silhouettes array<double>, seed_ari double")


def _seed_agreement(rows: DataFrame, by_k: dict[int, list[kmeans.Fit]], centers: dict[kmeans.Fit, np.ndarray]) -> dict[int, float]:
    """The mean adjusted Rand index of all pairs of each k's fits."""
    fits = [f for of in by_k.values() for f in of]
    pairs = [(i, j) for i, f in enumerate(fits) for j in range(i) if fits[j].k == f.k]
    found: dict[int, list[float]] = {}
    for (i, _), n in zip(pairs, kmeans.crossed(rows, fits, [centers[f] for f in fits], pairs), strict=True):
        found.setdefault(fits[i].k, []).append(kmeans.rand_index(n))
    return {k: float(np.mean(x)) for k, x in found.items()}


def seed_stability(df: DataFrame, key: str, vector: str, k: int, seeds: list[int]) -> float:
    """ML8: mean adjusted Rand index of the labelings of all pairs of seeds."""
    rows, fits = kmeans.prepared(df, vector, key), [kmeans.Fit(k, s) for s in seeds]
    try:
        centers = kmeans.fit_many(rows, fits)[0]
        return _seed_agreement(rows, {k: fits}, dict(zip(fits, centers, strict=True)))[k]
    finally:
        rows.unpersist()


def matched_jaccard(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows (a, jaccard): for each cluster of ``a`` (key, a) its best match among those of ``b`` (key, b) on shared rows."""
    both = a.join(b, key)
    n = both.groupBy("a", "b").agg(F.count("*").alias("n"))
    sizes = n.withColumns({"n_a": F.sum("n").over(Window.partitionBy("a")), "n_b": F.sum("n").over(Window.partitionBy("b"))})
    return sizes.groupBy("a").agg(F.max(F.col("n") / (F.col("n_a") + F.col("n_b") - F.col("n"))).alias("jaccard"))


def drawn(df: DataFrame, share: float, *by: Column | str | int) -> DataFrame:
    """The rows whose hash of ``by`` falls within ``share``: the same rows in any partitioning."""
    parts = [F.lit(x) if isinstance(x, int) else x for x in by]
    return df.where(F.pmod(F.xxhash64(*parts), F.lit(1 << 40)) < int(share * (1 << 40)))


def bootstrap_jaccard(df: DataFrame, key: str, vector: str, k: int, rounds: int = 100, seed: int = 42) -> DataFrame:
    """ML16: rows (a, jaccard), averaged over ``rounds`` refits on the distinct rows of draws with replacement.

    A draw of as many rows as there are holds each with chance 1 - 1/e.
    """
    found = _bootstraps(df, key, vector, [k], rounds, seed)[k]
    return df.sparkSession.createDataFrame(found, "a int, jaccard double").groupBy("a").agg(F.avg("jaccard").alias("jaccard"))


def _bootstraps(df: DataFrame, key: str, vector: str, ks: list[int], rounds: int, seed: int = 42) -> dict[int, list[tuple[int, float]]]:
    """For each k the (a, jaccard) of all rounds, all fitted in the same passes."""
    rows = kmeans.prepared(df, vector, key, seed=seed)
    fits = [f for k in ks for f in (kmeans.Fit(k, seed), *[kmeans.Fit(k, seed, 1 - math.exp(-1), r) for r in range(rounds)])]
    pairs = [(b, b + 1 + r) for b in range(0, len(fits), rounds + 1) for r in range(rounds)]
    try:
        centers = kmeans.fit_many(rows, fits)[0]
        tables = kmeans.crossed(rows, fits, centers, pairs)
    finally:
        rows.unpersist()
    found: dict[int, list[tuple[int, float]]] = {k: [] for k in ks}
    for (b, _), n in zip(pairs, tables, strict=True):
        found[fits[b].k] += kmeans.best_matches(n)
    return found


def subsample_consensus(df: DataFrame, key: str, vector: str, k: int, pairs: int = 30, seed: int = 42) -> float:
    """ML17: mean adjusted Rand index of labelings of pairs of 80 % samples, on the rows they share."""
    rows = kmeans.prepared(df, vector, key, seed=seed)
    fits = [kmeans.Fit(k, seed, 0.8, draw) for draw in range(2 * pairs)]
    try:
        centers = kmeans.fit_many(rows, fits)[0]
        tables = kmeans.crossed(rows, fits, centers, [(2 * p, 2 * p + 1) for p in range(pairs)])
    finally:
        rows.unpersist()
    return float(np.mean([kmeans.rand_index(n) for n in tables]))


def stability(jaccard: DataFrame, low: float = 0.6, high: float = 0.75) -> DataFrame:
    """ML18: rows (a, jaccard, verdict) by two thresholds."""
    return jaccard.withColumn("verdict", F.when(F.col("jaccard") < low, "unstable").when(F.col("jaccard") < high, "doubtful").otherwise("stable"))


def gaussian_mixture(df: DataFrame, vector: str, ks: list[int], seed: int = 42, n_init: int = 3) -> DataFrame:
    """ML10: rows (k, log_likelihood, bic, aic) of full-covariance mixtures, the best of ``n_init`` starts each; all fits share passes over the rows."""
    n, d = df.count(), len(df.select(vector).first()[0])
    starts = [(k, seed + i) for k in ks for i in range(n_init)]
    likely = [(k, ll) for (k, _), ll in zip(starts, mixtures.log_likelihoods(df, vector, starts), strict=True)]
    rows = []
    for k in ks:
        ll = max(x for j, x in likely if j == k)
        free = k - 1 + k * d + k * d * (d + 1) / 2
        rows.append((k, float(ll), float(free * np.log(n) - 2 * ll), float(2 * free - 2 * ll)))
    return df.sparkSession.createDataFrame(rows, "k int, log_likelihood double, bic double, aic double")


def _linkage_labels(x: np.ndarray, k: int, method: str) -> np.ndarray:
    """Lance-Williams merging of all rows down to k clusters."""
    n = len(x)
    d = np.sqrt(np.maximum(((x[:, None] - x[None]) ** 2).sum(-1), 0)) if n <= 1500 else np.sqrt(np.maximum((x**2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * x @ x.T, 0))
    if method == "ward":
        d = d**2
    np.fill_diagonal(d, np.inf)
    size, label, alive = np.ones(n), np.arange(n), np.ones(n, bool)
    for _ in range(n - k):
        i, j = np.unravel_index(np.argmin(d), d.shape)
        ni, nj = size[i], size[j]
        if method == "ward":
            new = ((ni + size) * d[i] + (nj + size) * d[j] - size * d[i, j]) / (ni + nj + size)
        else:
            new = (ni * d[i] + nj * d[j]) / (ni + nj)
        new[~alive] = np.inf
        d[i], d[:, i] = new, new
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        alive[j] = False
        size[i] += nj
        label[label == j] = i
    return np.unique(label, return_inverse=True)[1]


def hierarchical(df: DataFrame, key: str, vector: str, k: int, method: str = "ward", limit: int = MAX_LINKAGE) -> DataFrame:
    """ML9: rows (key, cluster) by Ward or average linkage. Needs all pairs at once: at most ``limit`` rows, else an error."""
    n = df.count()
    if n > limit:
        raise ValueError(f"linkage needs all pairs in one task: {n} rows, limit {limit}")
    kind = df.schema[key].dataType.simpleString()

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(key)
        return pd.DataFrame({key: rows[key], "cluster": _linkage_labels(np.stack(rows[vector]).astype(float), k, method).astype(np.int32)})

    return df.select(key, vector, F.lit(1).alias("__all")).groupBy("__all").applyInPandas(merge, f"{key} {kind}, cluster int")


def ward(df: DataFrame, key: str, vector: str, k: int, limit: int = MAX_LINKAGE) -> DataFrame:
    """ML9: rows (key, cluster) by Ward linkage of any number of rows; up to ``limit`` rows as ``hierarchical``.

    Beyond, all clusters that are each other's nearest merge in one round, which gives the merges of one by one (a union is never nearer to
    a third than both its parts). Clusters are compared by their means and sizes in blocks, so no task holds all pairs; the last ``limit``
    clusters merge on the driver. The cut undoes the k - 1 highest merges. Time is quadratic by nature.
    """
    if df.count() <= limit:
        return hierarchical(df, key, vector, k, limit=limit)
    dims = df.select(F.size(vector)).first()[0]
    live = stored(df.select(F.col(key).cast("bigint").alias("id"), F.lit(1.0).alias("n"), F.col(vector).cast("array<double>").alias("v")), "clusters")
    merged: list[DataFrame] = []
    while live.count() > limit:
        near = stored(ward_nearest(live, dims), "near")
        back = near.select(F.col("id").alias("other"), F.col("other").alias("id"))
        pairs = stored(near.where("id < other").join(back, ["id", "other"], "left_semi"), "merges")
        if pairs.isEmpty():  # both sides of a tie were rounded apart
            pairs = stored(near.orderBy("d", "id").limit(1).select(F.least("id", "other").alias("id"), F.greatest("id", "other").alias("other"), "d"), "merges")
        merged.append(pairs)
        into = pairs.select(F.col("other").alias("id"), F.col("id").alias("into"))
        parts = live.join(into, "id", "left").withColumn("id", F.coalesce("into", "id"))
        total = F.aggregate(F.collect_list(F.struct("n", "v")), F.array_repeat(F.lit(0.0), dims), lambda a, p: F.zip_with(a, F.transform(p["v"], lambda x: x * p["n"]), lambda x, y: x + y))  # two at most
        live = stored(parts.groupBy("id").agg(F.sum("n").alias("n"), total.alias("t")).select("id", "n", F.transform("t", lambda x: x / F.col("n")).alias("v")), "clusters")
    rest = _ward_rest(sorted((r["id"], r["n"], r["v"]) for r in live.collect()))  # at most limit clusters
    spark = df.sparkSession
    merged += [spark.createDataFrame(part, "id bigint, other bigint, d double") for part in rest]
    merged = [m.withColumn("round", F.lit(i)) for i, m in enumerate(merged)]
    undone = reduce(DataFrame.unionByName, merged).orderBy(F.desc("d"), F.desc("round"), F.desc("other")).limit(max(k - 1, 0)).select("other").collect()
    undone = [r["other"] for r in undone]  # a cluster is merged away once
    rows = df.select(key, F.col(key).cast("bigint").alias("__at"))
    for m in merged:
        rows = rows.join(m.where(~F.col("other").isin(undone)).select(F.col("other").alias("__at"), F.col("id").alias("__into")), "__at", "left").withColumn("__at", F.coalesce("__into", "__at")).drop("__into")
    rows = stored(rows, "members")
    roots = [r["__at"] for r in rows.select("__at").distinct().orderBy("__at").collect()]  # k
    return rows.select(key, (F.array_position(F.array(*map(F.lit, roots)), F.col("__at")) - 1).cast("int").alias("cluster"))


def _ward_rest(rows: list[tuple]) -> list[list[tuple[int, int, float]]]:
    """The remaining merges (id, other, d), smaller id first, a list for each round."""
    ids, n, v = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float), np.array([r[2] for r in rows], float)
    out: list[list[tuple[int, int, float]]] = []
    while len(ids) > 1:
        d = ward_distances(v, n, v, n)
        np.fill_diagonal(d, np.inf)
        d = np.minimum(d, d.T)
        near = d.argmin(axis=1)
        a = np.nonzero((near[near] == np.arange(len(ids))) & (np.arange(len(ids)) < near))[0]
        b = near[a]
        out.append([(int(ids[i]), int(ids[j]), float(d[i, j])) for i, j in zip(a, b, strict=True)])
        v[a] = (v[a] * n[a, None] + v[b] * n[b, None]) / (n[a] + n[b])[:, None]
        n[a] += n[b]
        ids, n, v = (np.delete(x, b, axis=0) for x in (ids, n, v))
    return out


def gap_statistic(df: DataFrame, vector: str, ks: list[int], references: int = 50, seed: int = 42) -> DataFrame:
    """ML15: rows (k, gap, error) against uniform draws over each dimension's range; a draw is a hash of the row's vector."""
    made = kmeans.prepared(df, vector, vector)
    d = len(made.first()["v"])
    value = lambda i: F.get("v", F.lit(i))
    fits = [kmeans.Fit(k, seed, reference=r) for k in ks for r in range(-1, references)]
    try:
        ends = made.agg(*[F.min(value(i)).alias(f"l{i}") for i in range(d)], *[F.max(value(i)).alias(f"h{i}") for i in range(d)]).first()
        low = np.array([ends[f"l{i}"] for i in range(d)])
        found = kmeans.fit_many(made, fits, (low, np.array([ends[f"h{i}"] for i in range(d)]) - low))[2]
    finally:
        made.unpersist()
    costs = {(f.k, f.reference): float(np.log(c)) for f, c in zip(fits, found, strict=True)}
    rows = []
    for k in ks:
        reference = [costs[k, r] for r in range(references)]
        rows.append((k, float(np.mean(reference) - costs[k, -1]), float(np.std(reference) * np.sqrt(1 + 1 / references))))
    return df.sparkSession.createDataFrame(rows, "k int, gap double, error double")


def gap_choice(gaps: DataFrame) -> DataFrame:
    """ML15: ``gaps`` (k, gap, error) with optimal_k, the smallest k whose gap is within an error of the next one's, and no_structure where that is 1.

    The largest k is taken if no smaller one is.
    """
    ahead = Window.orderBy("k")  # a row for each k
    enough = F.coalesce(F.col("gap") >= F.lead("gap").over(ahead) - F.lead("error").over(ahead), F.lit(True))
    told = gaps.withColumn("enough", enough).agg(F.min(F.when(F.col("enough"), F.col("k"))).alias("optimal_k"))
    return gaps.join(F.broadcast(told)).withColumn("no_structure", F.col("optimal_k") == 1)


def sweep_with_stability(df: DataFrame, key: str, vector: str, ks: list[int], n_init: int = 10, rounds: int = 100) -> DataFrame:
    """ML7, ML16, ML18: the sweep with each k's least bootstrap Jaccard index and its number of unstable clusters."""
    sweep = kmeans_sweep(df, key, vector, ks, n_init)
    least, unstable = F.min("jaccard"), F.count(F.when(F.col("verdict") == "unstable", 1))
    every = [(k, a, x) for k, found in _bootstraps(df, key, vector, ks, rounds).items() for a, x in found]
    means = df.sparkSession.createDataFrame(every, "k int, a int, jaccard double").groupBy("k", "a").agg(F.avg("jaccard").alias("jaccard"))
    told = stability(means).groupBy("k").agg(least.cast("double").alias("least_jaccard"), unstable.alias("unstable"))
    return sweep.join(told, "k")


def choose_k(sweep: DataFrame) -> DataFrame:
    """ML19: the k of best quality among those with all shares of 5 % or more and all clusters stable; else the fewest unstable.

    ``sweep`` has (k, quality, smallest_share, unstable).
    """
    fits = (F.col("smallest_share") >= 0.05) & (F.col("unstable") == 0)
    order = F.struct(fits.cast("int"), F.when(fits, F.col("quality")).otherwise(-F.col("unstable")), -F.col("k"))
    return sweep.agg(F.max_by("k", order).alias("k"))


def project(df: DataFrame, key: str, vector: str) -> DataFrame:
    """ML20: rows (key, pc1, pc2, explained); each component's largest loading is positive."""
    rows = _vectors(df, vector)
    model = PCA(k=2, inputCol="__v", outputCol="__p").fit(rows)
    loadings = model.pc.toArray()
    sign = [1.0 if c[np.abs(c).argmax()] >= 0 else -1.0 for c in loadings.T]
    p = vector_to_array("__p")
    return model.transform(rows).select(key, *[(F.get(p, F.lit(i)) * sign[i]).alias(f"pc{i + 1}") for i in (0, 1)], F.lit(float(sum(model.explainedVariance))).alias("explained"))


def deviations(features: DataFrame, segment: str, columns: list[str]) -> DataFrame:
    """Rows (segment, feature, deviation): segment means in sample deviations from the overall mean; null if it has none."""
    total = features.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_samp(c).alias(f"s_{c}") for c in columns])
    means = features.groupBy(segment).agg(*[F.avg(c).alias(c) for c in columns]).join(F.broadcast(total))
    entry = F.array(*[F.struct(F.lit(c).alias("feature"), ((F.col(c) - F.col(f"m_{c}")) / F.nullif(F.col(f"s_{c}"), F.lit(0.0))).alias("deviation")) for c in columns])
    return means.select(F.col(segment).alias("segment"), F.explode(entry).alias("e")).select("segment", "e.*")


def names(deviation: DataFrame, vocabulary: dict[str, tuple[str, str]], floor: float = 0.4) -> DataFrame:
    """ML21, T-7: rows (segment, name) from the two largest deviations of ``floor`` or more; ``balanced`` without any."""
    words = F.create_map(*[F.lit(x) for f, (up, down) in vocabulary.items() for x in (f"{f}+", up, f"{f}-", down)])
    size: Column = F.abs("deviation")
    order = Window.partitionBy("segment").orderBy(F.desc(F.round(size, 9)), "feature")
    word = F.get(F.array(words[F.concat("feature", F.when(F.col("deviation") > 0, "+").otherwise("-"))]), F.lit(0))
    top = deviation.where((size >= floor) & F.col("feature").isin(*vocabulary)).withColumn("r", F.row_number().over(order)).where("r <= 2").withColumn("word", word)
    named = top.groupBy("segment").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "word"))), lambda e: e["word"]), ", ").alias("name"))
    return deviation.select("segment").distinct().join(named, "segment", "left").withColumn("name", F.coalesce("name", F.lit("balanced")))
