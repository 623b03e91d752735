"""Many K-Means fits over the same rows at once.

A pass over the rows assigns each row in every fit, so that a fit takes no jobs of its own: a task adds up its rows for each
center, parts of these sums are added over the tasks, and the driver gets one sum for each center. Fits that have settled
take no part in further passes. A fit starts from k-means++ over about ``SEEDS`` rows drawn by their hash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segrec.operators.stats import draws, mixed

PASSES = 20
TOLERANCE = 1e-4
SEEDS = 2048
#: Rows that are compared with all centers at a time, and parts in which sums are added up.
ROWS, PARTS = 512, 16


@dataclass(frozen=True)
class Fit:
    """A fit of ``k`` centers to the share of the rows that ``draw`` takes, or, with ``reference``, to that uniform draw for each row."""

    k: int
    seed: int = 42
    share: float = 1.0
    draw: int = 0
    reference: int = -1


def _salted(h: np.ndarray, salt: int) -> np.ndarray:
    return mixed(h.view(np.uint64) + np.uint64(salt * 0x9E3779B97F4A7C15 % 2**64))


def taken(h: np.ndarray, fit: Fit) -> np.ndarray:
    return np.ones(len(h), bool) if fit.share >= 1 else _salted(h, 2 * fit.draw + 1) < np.uint64(int(fit.share * 2**64))


def _points(h: np.ndarray, x: np.ndarray, reference: int, ends: tuple | None) -> np.ndarray:
    if reference < 0:
        return x
    u = draws(_salted(h, 2 * reference + 2).view(np.int64), x.shape[1]) >> np.uint64(11)
    return ends[0] + ends[1] * (u / 2**53)


def _groups(fits: list[Fit]) -> dict[tuple[int, int], list[int]]:
    by: dict[tuple[int, int], list[int]] = {}
    for i, f in enumerate(fits):
        by.setdefault((f.reference, f.k), []).append(i)
    return dict(sorted(by.items()))


def _assigned(h: np.ndarray, x: np.ndarray, fits: list[Fit], centers: list[np.ndarray], ends: tuple | None) -> Iterator[tuple]:
    """(numbers of fits, points, labels, squared distances) of each group of fits of one k over the same points."""
    reference, z = None, x
    for (of, k), at in _groups(fits).items():
        if of != reference:
            reference, z = of, _points(h, x, of, ends)
        c = np.concatenate([centers[i] for i in at])
        d = ((c**2).sum(axis=1) - 2 * z @ c.T).reshape(len(z), len(at), k)
        label = d.argmin(axis=2)
        yield at, z, label, np.maximum(np.take_along_axis(d, label[:, :, None], 2)[:, :, 0] + (z**2).sum(axis=1)[:, None], 0)


def _added(rows: DataFrame, work: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of ``work`` (h, x), arrays of one length, over all blocks of ``rows`` (h, v)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            h, x = batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
            for low in range(0, len(h), ROWS):
                found = work(h[low : low + ROWS], x[low : low + ROWS])
                total = found if total is None else total + found
        if total is not None:
            cut = np.array_split(total, PARTS)
            yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array(cut, pa.list_(pa.float64()))], names=["part", "x"])

    def add(table: pa.Table) -> pa.Table:
        lists = table["x"].combine_chunks()
        return pa.table({"part": table["part"].slice(0, 1), "x": pa.array([lists.flatten().to_numpy().reshape(len(lists), -1).sum(axis=0)], pa.list_(pa.float64()))})

    schema = "part int, x array<double>"
    found = rows.mapInArrow(each, schema).groupBy("part").applyInArrow(add, schema).collect()  # a number for each sum
    return np.concatenate([np.array(r["x"], float) for r in sorted(found, key=lambda r: r["part"])])


def _pass(rows: DataFrame, fits: list[Fit], centers: list[np.ndarray], ends: tuple | None) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Each fit's sums and counts by center, and its cost."""
    dims, start = centers[0].shape[1], np.cumsum([0, *[f.k for f in fits]])

    def work(h: np.ndarray, x: np.ndarray) -> np.ndarray:
        sums, cost, row = np.zeros((start[-1], dims + 1)), np.zeros(len(fits)), np.arange(len(h))[:, None]
        for at, z, label, d in _assigned(h, x, fits, centers, ends):
            w, k = np.stack([taken(h, fits[i]) for i in at], axis=1), fits[at[0]].k
            member = np.zeros((len(h), len(at) * k))
            member[row, np.arange(len(at)) * k + label] = w
            place = np.concatenate([np.arange(start[i], start[i + 1]) for i in at])
            sums[place, :dims] += member.T @ z
            sums[place, dims] += member.sum(axis=0)
            cost[at] += (d * w).sum(axis=0)
        return np.concatenate([sums.ravel(), cost])

    total = _added(rows, work)
    sums = total[: -len(fits)].reshape(-1, dims + 1)
    cut = [sums[a:b] for a, b in zip(start[:-1], start[1:], strict=True)]
    return [c[:, :dims] for c in cut], [c[:, dims] for c in cut], total[-len(fits) :]


def _seeded(h: np.ndarray, x: np.ndarray, fit: Fit, ends: tuple | None) -> np.ndarray:
    """k-means++ over the fit's rows among those drawn."""
    rng = np.random.default_rng([fit.seed, fit.k, fit.draw, fit.reference + 1])
    own = taken(h, fit)
    z = _points(h, x, fit.reference, ends)[own if own.any() else slice(None)]
    out = [z[rng.integers(len(z))]]
    d = ((z - out[0]) ** 2).sum(axis=1)
    while len(out) < fit.k:
        out.append(z[rng.choice(len(z), p=d / d.sum()) if d.sum() > 0 else rng.integers(len(z))])
        d = np.minimum(d, ((z - out[-1]) ** 2).sum(axis=1))
    return np.stack(out)


def prepared(df: DataFrame, vector: str, *hashed: str, seed: int = 42) -> DataFrame:
    """Rows (h, v) for ``fit_many``, kept for its passes; the caller unpersists them."""
    rows = df.select(F.xxhash64(F.lit(seed), *hashed).alias("h"), F.col(vector).cast("array<double>").alias("v"))
    return rows.repartition(df.sparkSession.sparkContext.defaultParallelism).persist()


def fit_many(rows: DataFrame, fits: list[Fit], ends: tuple | None = None) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Each fit's centers, sizes and cost over ``prepared`` rows; ``ends`` are the low ends and widths of reference draws."""
    n = rows.count()
    if not n:
        raise ValueError("K-Means needs at least one row")
    some = rows if n <= SEEDS else rows.where(F.pmod("h", F.lit(1 << 40)) < F.lit((SEEDS << 40) // n))
    drawn = sorted((r["h"], r["v"]) for r in (some.collect() or rows.limit(1).collect()))  # about SEEDS rows
    h, x = np.array([a for a, _ in drawn], np.int64), np.array([b for _, b in drawn], float)
    centers = [_seeded(h, x, f, ends) for f in fits]
    live = list(range(len(fits)))
    for _ in range(PASSES):
        sums, counts, _cost = _pass(rows, [fits[i] for i in live], [centers[i] for i in live], ends)
        moving = []
        for i, s, n in zip(live, sums, counts, strict=True):
            new = np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], centers[i])
            if ((new - centers[i]) ** 2).sum(axis=1).max() > TOLERANCE**2:
                moving.append(i)
            centers[i] = new
        live = moving
        if not live:
            break
    _sums, sizes, costs = _pass(rows, fits, centers, ends)
    return centers, sizes, costs


def crossed(rows: DataFrame, fits: list[Fit], centers: list[np.ndarray], pairs: list[tuple[int, int]]) -> list[np.ndarray]:
    """For each pair of fits, the number of rows that both draw by their clusters in the one and the other."""
    shape = [(fits[a].k, fits[b].k) for a, b in pairs]

    def work(h: np.ndarray, x: np.ndarray) -> np.ndarray:
        label = {i: g[:, j] for at, _z, g, _d in _assigned(h, x, fits, centers, None) for j, i in enumerate(at)}
        drawn = [taken(h, f) for f in fits]
        return np.concatenate([np.bincount(label[a] * kb + label[b], drawn[a] & drawn[b], ka * kb) for (a, b), (ka, kb) in zip(pairs, shape, strict=True)])

    found = np.split(_added(rows, work), np.cumsum([a * b for a, b in shape])[:-1])
    return [n.reshape(s) for n, s in zip(found, shape, strict=True)]


def rand_index(n: np.ndarray) -> float:
    """The adjusted Rand index of a table of counts; 1 where both labelings are one cluster."""
    two = lambda x: float((x * (x - 1) / 2).sum())
    both, a, b, every = two(n), two(n.sum(axis=1)), two(n.sum(axis=0)), two(n.sum())
    expected = a * b / every if every else 0.0
    return (both - expected) / ((a + b) / 2 - expected) if (a + b) / 2 != expected else 1.0


def best_matches(n: np.ndarray) -> list[tuple[int, float]]:
    """J17 of a table of counts: (a, jaccard) of each cluster of the first with rows, with its best match among the second's."""
    joint = n / np.maximum(n.sum(axis=1)[:, None] + n.sum(axis=0) - n, 1)
    return [(int(a), float(joint[a].max())) for a in np.nonzero(n.sum(axis=1))[0]]


def labelled(df: DataFrame, key: str, vector: str, centers: np.ndarray) -> DataFrame:
    """Rows (key, vector, cluster) with each row's nearest center."""
    weight = (centers**2).sum(axis=1)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().astype(float).reshape(batch.num_rows, -1)
            near = (weight - 2 * x @ centers.T).argmin(axis=1) if batch.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near.astype(np.int32))], names=[key, vector, "cluster"])

    kinds = {c: df.schema[c].dataType.simpleString() for c in (key, vector)}
    return df.select(key, vector).mapInArrow(work, f"`{key}` {kinds[key]}, `{vector}` {kinds[vector]}, cluster int")
