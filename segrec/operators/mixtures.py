"""Many Gaussian mixtures over the same rows at once.

Spark ML's ``GaussianMixture`` draws each start; from there a pass over the rows is one step of expectation and maximisation
of every fit that still moves, with Spark ML's formulas, bounds and end, as products of blocks of rows with matrices. A task
adds up its rows for each component, parts of these sums are added over the tasks, and the driver gets one sum for each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segrec.operators import kmeans

#: As in Spark ML: the least density of a component, most steps, and the change of the log likelihood that ends a fit.
EPSILON, STEPS, TOLERANCE = 2.0**-52, 100, 0.01


@dataclass(frozen=True)
class Mixture:
    """Components: weights (k), means (k, d), covariances (k, d, d)."""

    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray

    def whitening(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matrices (d, k * d) and shifts (k * d) that turn a row into unit normals of each component, and log densities at its mean (k)."""
        values, vectors = np.linalg.eigh(self.covariances)
        d = values.shape[1]
        used = values > EPSILON * values.max(axis=1, keepdims=True) * d
        if not used.any(axis=1).all():
            raise ValueError("a component's covariance has no non-zero singular value")
        root = vectors * np.where(used, np.where(used, values, 1) ** -0.5, 0)[:, None, :]
        height = -0.5 * (d * np.log(2 * np.pi) + np.where(used, np.log(np.where(used, values, 1)), 0).sum(axis=1))
        return root.transpose(1, 0, 2).reshape(d, -1), np.einsum("kd,kde->ke", self.means, root).ravel(), height


def start(rows: DataFrame, vector: str, k: int, seed: int) -> Mixture:
    """Spark ML's start of a fit over the vectors of ``rows``."""
    model = GaussianMixture(k=k, seed=seed, maxIter=0, featuresCol=vector).fit(rows)
    found = model.gaussiansDF.collect()  # k rows
    return Mixture(np.array(model.weights), np.array([r["mean"].toArray() for r in found]), np.array([r["cov"].toArray() for r in found]))


def _step(rows: DataFrame, fits: list[Mixture]) -> list[tuple[Mixture, float]]:
    """The next of each fit, and its own log likelihood."""
    d, ks = fits[0].means.shape[1], [len(f.weights) for f in fits]
    first, ends = np.cumsum([0, *ks[:-1]]), np.cumsum(ks)
    white = [f.whitening() for f in fits]
    matrix, shift, height = (np.concatenate([w[i] for w in white], axis=-1) for i in range(3))
    weights = np.concatenate([f.weights for f in fits])

    def work(_h: np.ndarray, x: np.ndarray) -> np.ndarray:
        y = x @ matrix - shift
        p = EPSILON + weights * np.exp(height - 0.5 * np.square(y, out=y).reshape(len(x), -1, d).sum(axis=2))
        total = np.add.reduceat(p, first, axis=1)
        p /= np.repeat(total, ks, axis=1)
        squares = [(x * q[:, None]).T @ x for q in p.T]
        return np.concatenate([np.log(total).sum(axis=0), p.sum(axis=0), (p.T @ x).ravel(), np.ravel(squares)])

    told = kmeans._added(rows, work)
    m = len(weights)
    likely, n, sums, squares = np.split(told, np.cumsum([len(fits), m, m * d]))
    means = sums.reshape(m, d) / n[:, None]
    spread = squares.reshape(m, d, d) / n[:, None, None] - means[:, :, None] * means[:, None, :]
    return [(Mixture(n[a:b] / n[a:b].sum(), means[a:b], spread[a:b]), float(ll)) for a, b, ll in zip(first, ends, likely, strict=True)]


def log_likelihoods(df: DataFrame, vector: str, starts: list[tuple[int, int]]) -> list[float]:
    """The log likelihood of the fit from each start (k, seed)."""
    vectors = df.select(array_to_vector(F.col(vector).cast("array<double>")).alias("__v")).persist()
    try:
        fits = [start(vectors, "__v", k, seed) for k, seed in starts]
    finally:
        vectors.unpersist()
    rows = kmeans.prepared(df, vector, vector)
    told, live = [float("-inf")] * len(fits), list(range(len(fits)))
    try:
        for _ in range(STEPS):
            moving = []
            for i, (fit, ll) in zip(live, _step(rows, [fits[i] for i in live]), strict=True):
                if not abs(ll - told[i]) <= TOLERANCE:
                    moving.append(i)
                fits[i], told[i] = fit, ll
            live = moving
            if not live:
                break
    finally:
        rows.unpersist()
    return told
