"""Fits in common passes against brute force."""

import numpy as np
import pytest

from segrec.operators import clustering, kmeans


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(m, 0.2, size=(60, 3)) for m in (0.0, 4.0, 9.0)])
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k int, v array<double>")


def test_sweeps_take_jobs_by_pass_and_not_by_fit(spark, blobs):
    spark.sparkContext.setJobGroup("sweep", "sweep")
    try:
        found = {r["k"]: r for r in clustering.sweep_with_stability(blobs[1], "k", "v", [2, 3], n_init=2, rounds=40).collect()}
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("sweep"))
    finally:
        spark.sparkContext.setJobGroup("", "")
    assert jobs < 300  # 90 fits
    assert found[3]["inertia"] == pytest.approx(sum(((p - p.mean(axis=0)) ** 2).sum() for p in np.split(blobs[0], 3)))
    assert found[3]["least_jaccard"] > 0.6 and found[3]["silhouettes"] == pytest.approx([found[3]["silhouette"]] * 3, abs=0.1)


def test_fits_end_where_rows_and_centers_agree_in_any_partitioning(blobs):
    x, df = blobs
    fits = [kmeans.Fit(k, s) for k in (1, 3, 4) for s in (1, 2)] + [kmeans.Fit(3, 5, 0.5, 7)]
    one, two = (kmeans.fit_many(kmeans.prepared(d, "v", "k"), fits) for d in (df, df.repartition(7)))
    assert all(np.allclose(a, b) for a, b in zip(one[0], two[0], strict=True)) and np.allclose(one[2], two[2])
    for f, c, sizes, cost in zip(fits[:-1], *[part[:-1] for part in one], strict=True):
        d = ((x[:, None] - c) ** 2).sum(axis=2)
        near = d.argmin(axis=1)
        assert sizes.tolist() == np.bincount(near, minlength=f.k).tolist() and cost == pytest.approx(d.min(axis=1).sum())
        assert np.allclose([x[near == j].mean(axis=0) for j in range(f.k)], c, atol=1e-3)
    assert 50 < one[1][-1].sum() < 130


def test_tables_of_two_fits():
    assert kmeans.rand_index(np.array([[3, 0], [0, 5]])) == 1 and kmeans.rand_index(np.array([[2, 2], [2, 2]])) < 0.1
    assert kmeans.best_matches(np.array([[4, 0], [0, 0], [1, 5]])) == [(0, 0.8), (2, pytest.approx(5 / 6))]


@pytest.mark.parametrize("k", [1, 4, 7])
def test_ward_beyond_the_limit_equals_ward_within_it(spark, k):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=(70, 3)), [[40.0, 0, 0], [46.0, 0, 0]]])  # a far pair whose merge is among the highest
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, v array<double>")
    one, two = ({r["id"]: r["cluster"] for r in rows.collect()} for rows in (clustering.hierarchical(df, "id", "v", k), clustering.ward(df, "id", "v", k, limit=20)))
    assert len(two) == 72 and len({(one[i], two[i]) for i in one}) == len(set(one.values())) == len(set(two.values())) == k


def test_mixtures_share_passes_and_equal_spark_ml(spark, monkeypatch):
    """each start took its own passes over the rows."""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.functions import array_to_vector

    rng = np.random.default_rng(6)
    data = [(i, (rng.normal(size=3) + 3 * (i % 3)).tolist()) for i in range(240)]
    df = spark.createDataFrame(data, "id bigint, v array<double>").repartition(2).cache()
    vectors = df.select(array_to_vector("v").alias("v")).cache()
    want = {k: max(GaussianMixture(k=k, seed=42 + i, featuresCol="v").fit(vectors).summary.logLikelihood for i in range(2)) for k in (2, 3)}
    steps, real = [], GaussianMixture.fit
    monkeypatch.setattr(GaussianMixture, "fit", lambda self, rows: steps.append(self.getMaxIter()) or real(self, rows))
    found = {r["k"]: r["log_likelihood"] for r in clustering.gaussian_mixture(df, "v", [2, 3], n_init=2).collect()}
    assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-6 * abs(want[k]) for k in want)
    assert steps == [0] * 4  # starts only
