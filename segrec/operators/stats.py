"""Tests and resampling: statistics as aggregations, draws as hashes of (seed, replicate, row)."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segrec.functions.columns import TINY
from segrec.operators.metrics import METRICS
from segrec.sources.scratch import stored, stored_in_small_batches


def chi_square_p(statistic: float, dof: int) -> float:
    """Upper tail of the chi-square distribution (regularised incomplete gamma, series and continued fraction)."""
    a, x = dof / 2, statistic / 2
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while term > total * 1e-15:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - front * total)
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def student_p(spark: SparkSession, t: float, dof: float) -> float:
    """Two-sided tail of Student's t, from the library that Spark ships."""
    return 2 * (1 - spark._jvm.org.apache.commons.math3.distribution.TDistribution(float(dof)).cumulativeProbability(abs(float(t))))


def chi_square_uniform(counts: DataFrame, n: str) -> DataFrame:
    """ST1: one row (statistic, dof) of counts against equal shares."""
    return counts.agg(F.sum(n).alias("s"), F.sum(F.col(n) * F.col(n)).alias("q"), F.count("*").alias("k")).select((F.col("q") * F.col("k") / F.col("s") - F.col("s")).alias("statistic"), (F.col("k") - 1).alias("dof"))


def chi_square_independence(df: DataFrame, a: str, b: str) -> DataFrame:
    """ST2: one row (statistic, dof) of two columns, plain Pearson (no continuity correction, also for 2 x 2)."""
    both = df.groupBy(a, b).agg(F.count("*").alias("n"))
    rows, cols = both.groupBy(a).agg(F.sum("n").alias("r")), both.groupBy(b).agg(F.sum("n").alias("c"))
    total = both.agg(F.sum("n").alias("t"))
    dims = rows.agg(F.count("*").alias("nr")).join(cols.agg(F.count("*").alias("nc")))
    # cells without rows add their expectation: sum n^2 / (r c) over filled cells tells all
    part = both.join(rows, a).join(cols, b).agg(F.sum(F.col("n") ** 2 / (F.col("r") * F.col("c"))).alias("s"))
    return part.join(total).join(dims).select((F.col("t") * (F.col("s") - 1)).alias("statistic"), ((F.col("nr") - 1) * (F.col("nc") - 1)).alias("dof"))


def one_sample_t(df: DataFrame, value: str) -> DataFrame:
    """ST3: one row (n, mean, t) against 0."""
    return df.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), (F.avg(value) / (F.stddev_samp(value) / F.sqrt(F.count(value)))).alias("t"))


def uniform(*key: Column | str) -> Column:
    """A draw in (0, 1) that depends on the key alone."""
    return (F.shiftrightunsigned(F.xxhash64(*key), 12) + F.lit(0.5)) / float(1 << 52)


def with_replicates(df: DataFrame, replicates: int) -> DataFrame:
    return df.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))


def mixed(x: np.ndarray) -> np.ndarray:
    """64 well-mixed bits of each unsigned number (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def draws(base: np.ndarray, *sizes: int) -> np.ndarray:
    """64 random bits for each number of ``base`` and each place of a grid of ``sizes``: a hash of both, the same in any partitioning."""
    grid = np.arange(1, math.prod(sizes) + 1, dtype=np.uint64).reshape(sizes) * np.uint64(0x9E3779B97F4A7C15)
    return mixed(base.view(np.uint64).reshape(-1, *[1] * len(sizes)) + grid)


#: Bounds between the counts 0, 1, 2, ... of a Poisson(1) draw, as shares of 2^64.
_POISSON = np.array([min(int(sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) * 2**64), 2**64 - 1) for k in range(18)], np.uint64)


def poisson_counts(base: np.ndarray, replicates: int) -> np.ndarray:
    """For each row, by its hash, its count in every bootstrap replicate: Poisson(1)."""
    return np.searchsorted(_POISSON, draws(base, replicates), side="right")


def _weight_batches(batches: Iterator[pa.RecordBatch], replicates: int) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        base, group, value = (batch.column(k) for k in range(3))
        coded = group.dictionary_encode()
        names, code = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        base, value = base.to_numpy(), value.to_numpy(zero_copy_only=False)
        for low in range(0, len(base), 1024):  # 1,024 rows times the replicates at a time
            keys, row = np.unique(base[low : low + 1024], return_inverse=True)  # a key's rows in several groups share its counts
            counts = poisson_counts(keys, replicates).astype(np.float64)
            x, at = value[low : low + 1024], code[low : low + 1024]
            for k in np.unique(at):
                held = counts[row[at == k]]
                total = sums.setdefault(names[k], np.zeros((2, replicates)))
                total += held.sum(axis=0), x[at == k] @ held
    names = list(sums)
    lists = [pa.array([sums[n][k] for n in names], pa.list_(pa.float64())) for k in (0, 1)]
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *lists], names=["group", "w", "wx"])


def bootstrap_means(df: DataFrame, key: str, value: str, replicates: int, seed: int = 42, group: str | None = None) -> DataFrame:
    """Rows (group, replicate, m): the mean of each Poisson bootstrap replicate, in one pass.

    A row's counts in all replicates are an array drawn from a hash of (seed, key); a task adds up the arrays
    of its rows element by element, so rows are never multiplied by replicates.
    """
    rows = df.where(F.col(value).isNotNull()).select(F.xxhash64(F.lit(seed), key).alias("h"), (F.col(group).cast("string") if group else F.lit("")).alias("group"), F.col(value).cast("double").alias("x"))
    sums = rows.mapInArrow(partial(_weight_batches, replicates=replicates), "group string, w array<double>, wx array<double>")
    each = sums.select("group", F.posexplode(F.arrays_zip("w", "wx")).alias("replicate", "s"))
    return each.groupBy("group", "replicate").agg((F.sum("s.wx") / F.nullif(F.sum("s.w"), F.lit(0.0))).alias("m"))


def bootstrap_mean(df: DataFrame, key: str, value: str, replicates: int, seed: int = 42) -> DataFrame:
    """One row (mean, low, high, significant): percentile interval of the mean over Poisson bootstrap replicates."""
    interval = bootstrap_means(df, key, value, replicates, seed).agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))
    return df.agg(F.avg(value).alias("mean")).join(interval).withColumn("significant", (F.col("low") > 0) | (F.col("high") < 0))


def paired_bootstrap(a: DataFrame, b: DataFrame, key: str, value: str, replicates: int = 2000, seed: int = 42) -> DataFrame:
    """ST7: J19's differences on shared keys, bootstrapped."""
    diffs = a.select(key, F.col(value).alias("x")).join(b.select(key, F.col(value).alias("y")), key).select(key, (F.col("x") - F.col("y")).alias("d"))
    return bootstrap_mean(diffs, key, "d", replicates, seed)


def group_gap(df: DataFrame, key: str, group: str, value: str, one: str, other: str, replicates: int = 2000, seed: int = 42) -> DataFrame:
    """ST8: one row (gap, low, high) of the mean of ``one`` minus that of ``other``, unpaired."""
    rows = df.where(F.col(group).isin(one, other))
    mean = lambda g, v: F.avg(F.when(F.col(g) == one, F.col(v))) - F.avg(F.when(F.col(g) == other, F.col(v)))
    each = bootstrap_means(rows, key, value, replicates, seed, group).groupBy("replicate").agg(mean("group", "m").alias("g"))
    return rows.agg(mean(group, value).alias("gap")).join(each.agg(F.percentile("g", 0.025).alias("low"), F.percentile("g", 0.975).alias("high")))


def weighted_draws(sizes: DataFrame, weights: DataFrame, replicates: int, seed: int = 42) -> DataFrame:
    """ST4's draws: for each (user_id, n) and replicate, n distinct items with chances by weight: the n smallest of -ln(u) / w.

    ``weights`` (item, w) is a catalogue: few rows, exploded in each user's row.
    """
    catalogue = weights.agg(F.collect_list(F.struct("item", "w")).alias("items"))
    rows = with_replicates(sizes.join(F.broadcast(catalogue)), replicates)
    keyed = F.transform("items", lambda i: F.struct((-F.ln(uniform(F.lit(seed), F.col("replicate"), F.col("user_id"), i["item"])) / i["w"]).alias("e"), i["item"].alias("item")))
    return rows.select("user_id", "replicate", F.explode(F.slice(F.sort_array(keyed), 1, F.greatest(F.col("n"), F.lit(1)).cast("int"))).alias("d")).select("user_id", "replicate", "d.item")


PREFERENCE = ("distinct_categories", "top_category_share", "distinct_levels", "free_share")


def preference_statistics(sets: DataFrame, items: DataFrame) -> DataFrame:
    """ST4's observed statistics: one row of means over users of distinct (user_id, item) rows."""
    rows = sets.join(F.broadcast(items.select("item", "category", "level", "is_free")), "item")
    per = rows.groupBy("user_id", "category").agg(F.count("*").alias("n"), F.collect_set("level").alias("levels"), F.sum("is_free").alias("free"))
    users = per.groupBy("user_id").agg(
        F.count("*").alias("distinct_categories"), (F.max("n") / F.sum("n")).alias("top_category_share"),
        F.size(F.array_distinct(F.flatten(F.collect_list("levels")))).alias("distinct_levels"), (F.sum("free") / F.sum("n")).alias("free_share"),
    )
    return users.agg(*[F.avg(c).alias(c) for c in PREFERENCE])


def _null_batches(batches: Iterator[pa.RecordBatch], weight: np.ndarray, kinds: list[np.ndarray], free: np.ndarray, replicates: int) -> Iterator[pa.RecordBatch]:
    totals, users = np.zeros((len(PREFERENCE), replicates)), 0
    step = max(1, 2_000_000 // (replicates * len(weight)))
    for batch in batches:
        base, size = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        users += len(base)
        for low in range(0, len(base), step):
            n = size[low : low + step]
            u = (draws(base[low : low + step], replicates, len(weight)) >> np.uint64(11)).astype(np.float64)
            keys = -np.log((u + 0.5) / 2**53) / weight  # the n least are n draws by weight without replacement
            bar = np.take_along_axis(np.sort(keys, axis=2), np.broadcast_to((n - 1)[:, None, None], (*keys.shape[:2], 1)), axis=2)
            taken = (keys <= bar).astype(np.float64)
            by_category, by_level = (taken @ k for k in kinds)
            told = (by_category > 0).sum(axis=2), by_category.max(axis=2) / n[:, None], (by_level > 0).sum(axis=2), taken @ free / n[:, None]
            totals += [t.sum(axis=0) for t in told]
    yield pa.RecordBatch.from_arrays([pa.array([users]), pa.array([totals.ravel()], pa.list_(pa.float64()))], names=["users", "totals"])


def preference_null(sets: DataFrame, items: DataFrame, weights: DataFrame, replicates: int = 200, seed: int = 42) -> DataFrame:
    """ST4: rows (statistic, replicate, value): the statistics where each user's items are redrawn by popularity, as many as they have.

    ``items`` and ``weights`` are a catalogue: few rows. Draws stay in their user's task, which adds its users up.
    """
    table = items.join(weights, "item").orderBy("item").select("item", "category", "level", "is_free", "w").collect()
    kinds = [np.array([[r[c] == v for v in sorted({x[c] for x in table})] for r in table], np.float64) for c in ("category", "level")]
    weight, free = np.array([float(r["w"]) for r in table]), np.array([float(r["is_free"]) for r in table])
    known = sets.join(F.broadcast(weights.select("item")), "item", "left_semi")
    users = known.groupBy("user_id").agg(F.count("*").alias("n")).select(F.xxhash64(F.lit(seed), "user_id").alias("h"), "n")
    sums = users.mapInArrow(partial(_null_batches, weight=weight, kinds=kinds, free=free, replicates=replicates), "users bigint, totals array<double>")
    each = sums.select("users", F.posexplode("totals").alias("at", "x")).groupBy("at").agg((F.sum("x") / F.sum("users")).alias("value"))
    named = F.get(F.array(*map(F.lit, PREFERENCE)), F.floor(F.col("at") / replicates).cast("int"))
    return each.select(named.alias("statistic"), (F.col("at") % replicates).alias("replicate"), "value")


#: Rows of an item that take their draws in one group.
DRAWN_AT_ONCE = 250_000


def _provider_batches(batches: Iterator[pa.RecordBatch], replicates: int) -> Iterator[pa.RecordBatch]:
    """The number of users with two or more rows, and for each replicate the sum of their distinct providers over rows."""
    totals, users = np.zeros(replicates), 0
    for batch in batches:
        rows = batch.column(0)
        size = np.diff(rows.offsets.to_numpy())
        user, taken = np.repeat(np.arange(len(size)), size), rows.flatten()
        known = np.flatnonzero(np.diff(taken.offsets.to_numpy()))
        coded = taken.flatten().dictionary_encode()
        code = np.full((len(user), replicates), -1)  # a row without an item draws nothing
        code[known] = coded.indices.fill_null(-1).to_numpy().reshape(-1, replicates)
        order = np.sort(np.where(code < 0, -1, code + user[:, None] * (len(coded.dictionary) + 1)), axis=0)
        fresh = order >= 0
        fresh[1:] &= order[1:] != order[:-1]
        many = size >= 2
        users += int(many.sum())
        row, replicate = np.nonzero(fresh)
        of = order[row, replicate] // (len(coded.dictionary) + 1)
        totals += np.bincount(replicate, np.where(many[of], 1 / size[of], 0.0), replicates)
    yield pa.RecordBatch.from_arrays([pa.array([users]), pa.array([totals], pa.list_(pa.float64()))], names=["users", "totals"])


def provider_null(rows: DataFrame, replicates: int = 30, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """ST5: (ratio), and rows (replicate, ratio), of users with two or more rows (txn, user_id, item, provider_id): distinct providers over rows.

    A replicate takes for each row one of the providers of its item at random, by number among them. A row carries its draws of all
    replicates as one array: an item's rows meet its providers in groups of about ``DRAWN_AT_ONCE``, and a user's are counted in its row.
    """
    size = rows.groupBy("user_id").agg(F.count("*").alias("size"), F.count_distinct("provider_id").alias("providers")).where("size >= 2")
    observed = size.agg(F.avg(F.col("providers") / F.col("size")).alias("ratio"))
    pool = rows.where("item IS NOT NULL").select("item", "provider_id").distinct()
    sizes = rows.groupBy("item").agg(F.ceil(F.count("*") / DRAWN_AT_ONCE).cast("int").alias("groups")).join(pool.groupBy("item").agg(F.count("*").alias("many")), "item")
    sizes = F.broadcast(sizes)  # a catalogue
    asked = rows.where("user_id IS NOT NULL").select("txn", "user_id", "item").join(sizes, "item", "left")
    at = F.array(*[F.floor(uniform(F.lit(seed), F.lit(r), F.col("txn")) * F.col("many")).cast("int") for r in range(1, replicates + 1)])
    asked = asked.select("user_id", "item", F.pmod(F.xxhash64("txn", "user_id"), F.coalesce("groups", F.lit(1))).cast("int").alias("group"), F.when(F.col("many").isNotNull(), at).alias("at"))
    held = pool.join(sizes, "item").select(F.col("item").alias("item"), F.col("provider_id").alias("provider_id"), F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"))
    kind = {c: rows.schema[c].dataType.simpleString() for c in ("user_id", "provider_id")}

    def take(asked: pa.Table, held: pa.Table) -> pa.Table:
        providers = held.sort_by("provider_id")["provider_id"].combine_chunks()
        providers = providers.take(pa.array(np.roll(np.arange(len(providers)), providers.null_count)))  # nulls come first
        at = asked["at"].combine_chunks()
        offsets = pa.array(np.append(0, np.cumsum(at.is_valid().to_numpy(zero_copy_only=False)) * replicates).astype(np.int32), mask=np.append(~at.is_valid().to_numpy(zero_copy_only=False), False))
        return pa.table({"user_id": asked["user_id"], "taken": pa.ListArray.from_arrays(offsets, providers.take(at.flatten()))})

    key = ("item", "group")
    drawn = asked.groupBy(*key).cogroup(held.groupBy(*key)).applyInArrow(take, f"user_id {kind['user_id']}, taken array<{kind['provider_id']}>")
    users = drawn.groupBy("user_id").agg(F.collect_list(F.coalesce("taken", F.array().cast(f"array<{kind['provider_id']}>"))).alias("taken")).select("taken")
    sums = users.mapInArrow(partial(_provider_batches, replicates=replicates), "users bigint, totals array<double>")
    each = sums.select("users", F.posexplode("totals").alias("r", "x")).groupBy("r").agg(F.sum("x").alias("x"), F.sum("users").alias("users"))
    return observed, each.where("users > 0").select((F.col("r") + 1).alias("replicate"), (F.col("x") / F.col("users")).alias("ratio"))


def permutation_summary(observed: float, null: DataFrame, value: str) -> DataFrame:
    """One row (observed, null_mean, z, low, high, signal) against the null's replicates."""
    stats = null.agg(F.avg(value).alias("null_mean"), F.stddev_pop(value).alias("s"), F.percentile(value, 0.025).alias("low"), F.percentile(value, 0.975).alias("high"))
    z = (observed - F.col("null_mean")) / F.nullif(F.col("s"), F.lit(0.0))
    return stats.select(F.lit(observed).alias("observed"), "null_mean", z.alias("z"), "low", "high", ((observed < F.col("low")) | (observed > F.col("high"))).alias("signal"))


def simplex_weights(names: list[str], n: int, seed: int = 42, allow_zero: bool = True) -> list[dict[str, float]]:
    """ST9: ``n`` draws from the simplex; every other one drops a random subset of names."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        w = rng.dirichlet(np.ones(len(names)))
        if allow_zero and i % 2:
            drop = rng.choice(len(names), rng.integers(1, len(names)), replace=False) if len(names) > 1 else []
            w[drop] = 0
            w /= w.sum()
        out.append(dict(zip(names, map(float, w), strict=True)))
    return out


#: Scores that a task puts side by side at once.
TOGETHER = 250_000


def _run_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of rows (user_id, position, score) of one user as one row of arrays."""
    for batch in batches:
        user = batch.column(0).to_numpy()
        start = np.flatnonzero(np.append(True, user[1:] != user[:-1])) if len(user) else np.empty(0, np.int64)
        offsets = pa.array(np.append(start, len(user)).astype(np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(user[start]), *[pa.ListArray.from_arrays(offsets, batch.column(c)) for c in (1, 2)]], names=["user_id", "position", "score"])


def _side_by_side(rows: pa.Table, dims: int, scaled: bool) -> pa.Table:
    """A group of ``packed_candidates``, of rows (i, user_id, position, score): runs of component i, and with i = -1 what is held out."""
    i, user, lists = rows["i"].to_numpy(), rows["user_id"].to_numpy(), rows["position"].combine_chunks()
    users, size = np.unique(user[i < 0]), lists.value_lengths().to_numpy()
    position, of = lists.flatten().to_numpy(), np.repeat(i, size)
    at = np.repeat(np.searchsorted(users, user), size)
    known = np.repeat(np.isin(user, users), size)
    many = int(position.max(initial=-1)) + 1
    told, score = known & (of >= 0), rows["score"].combine_chunks().flatten().to_numpy()  # what is held out has no scores
    table, there, held = np.zeros((len(users), many, dims)), np.zeros((len(users), many), bool), np.zeros((len(users), many), bool)
    table[at[told], position[told], of[told]] = score[told[of >= 0]]
    there[at[told], position[told]] = True
    held[at[of < 0], position[of < 0]] = True
    held &= there
    keep = held.any(axis=1)
    users, table, there, held = users[keep], table[keep], there[keep], held[keep]
    if scaled and len(users):
        low, high = (f(np.where(there[:, :, None], table, sign * np.inf), axis=1)[:, None] for f, sign in ((np.min, 1), (np.max, -1)))
        table = np.where(high - low < TINY, 0.0, (table - low) / np.where(high - low < TINY, 1.0, high - low))
    offsets = np.append(0, np.cumsum(there.sum(axis=1))).astype(np.int32)
    lists = [pa.array(np.nonzero(there)[1].astype(np.int32)), pa.array(held[there])]
    return pa.table([users, *[pa.ListArray.from_arrays(pa.array(offsets), x) for x in lists], pa.ListArray.from_arrays(pa.array(offsets * dims), pa.array(table[there].ravel()))], names=["user_id", "position", "held", "c"])


def packed_candidates(components: dict[str, DataFrame], held_out: DataFrame, scaled: bool) -> DataFrame:
    """One row (user_id, position, held, c) for each user with a held-out candidate: all candidates by position, c their scores flattened.

    A candidate's scores of all components are side by side, ``scaled`` over the user's candidates or not, 0 where a component has none. A row
    holds at most the catalogue. Each component's rows are packed by user where they are made, and all components are shuffled once, to
    groups of users: a task holds about ``TOGETHER`` scores however many components there are.
    """
    if "position" not in held_out.columns:
        held_out = held_out.join(reduce(DataFrame.unionByName, [c.select("item", "position") for c in components.values()]).distinct(), "item")
    wanted = stored(held_out.groupBy("user_id").agg(F.collect_set(F.col("position").cast("int")).alias("position")), "wanted")
    size = wanted.agg(F.count("*").alias("users"), F.max(F.array_max("position")).alias("most")).first()
    rows = wanted.select(F.lit(-1).alias("i"), "user_id", "position", F.lit(None).cast("array<double>").alias("score"))
    for i, scores in enumerate(components.values()):
        plain = scores.select(F.col("user_id").cast("bigint").alias("user_id"), F.col("position").cast("int").alias("position"), F.coalesce("score", F.lit(0.0)).cast("double").alias("score"))
        rows = rows.unionByName(plain.mapInArrow(_run_batches, "user_id bigint, position array<int>, score array<double>").withColumn("i", F.lit(i)))
    groups = max(16, size["users"] * ((size["most"] or 0) + 1) * len(components) // TOGETHER)
    dealt = rows.select(F.pmod(F.xxhash64("user_id"), F.lit(groups)).alias("group"), "i", "user_id", "position", "score").groupBy("group")
    dims = len(components)
    return dealt.applyInArrow(lambda group: _side_by_side(group, dims, scaled), "user_id bigint, position array<int>, held array<boolean>, c array<double>")


def _blocks_of(position: pa.Array, held: pa.Array, scores: pa.Array, dims: int, each: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of ``packed_candidates`` in blocks of about ``TOGETHER`` numbers, ``each`` for a candidate: first, last, then by user and place its position,
    -1 behind the last, whether it is held out, its scores, and how many are held out."""
    size = position.value_lengths().to_numpy()
    starts, flat = np.append(0, np.cumsum(size)), [position.flatten().to_numpy(), held.flatten().to_numpy(zero_copy_only=False), scores.flatten().to_numpy().reshape(-1, dims)]
    step = max(1, TOGETHER // (each * max(int(size.max(initial=0)), 1)))
    for low in range(0, len(size), step):
        high = min(low + step, len(size))
        at = slice(starts[low], starts[high])
        user = np.repeat(np.arange(high - low), size[low:high])
        place = np.arange(len(user)) - np.repeat(starts[low:high] - starts[low], size[low:high])
        shape = (high - low, int(size[low:high].max(initial=0)))
        where, mine, table = np.full(shape, -1, np.int32), np.zeros(shape, bool), np.zeros((*shape, dims))
        where[user, place], mine[user, place], table[user, place] = (x[at] for x in flat)
        yield low, high, where, mine, table, mine.sum(axis=1)


def _held_ranks(total: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Users of held-out candidates in order, and their ranks from 0 by each column of ``total`` (user, place, column): those ahead are counted, nothing is sorted."""
    user, place = np.nonzero(held)
    ranks = np.empty((len(user), total.shape[2]), np.int64)
    for low in range(0, len(user), 32):
        rows, at = total[user[low : low + 32]], place[low : low + 32]
        own = np.take_along_axis(rows, at[:, None, None], axis=1)
        ahead = rows > own
        ahead |= (rows == own) & (np.arange(rows.shape[1]) < at[:, None])[:, :, None]
        ranks[low : low + 32] = ahead.sum(axis=1)
    return user, ranks


def _firsts(total: np.ndarray, k: int) -> np.ndarray:
    """The places of the first k of each user by each column, ties in order of place: (user, column, k)."""
    return np.argsort(-np.ascontiguousarray(total.transpose(0, 2, 1)), axis=2, kind="stable")[:, :, :k]


def _metric_batches(batches: Iterator[pa.RecordBatch], names: list[str], k: int) -> Iterator[pa.RecordBatch]:
    fade, dims = 1 / np.log2(np.arange(2, k + 2)), len(names)
    ideal = np.append(0, np.cumsum(fade))
    for batch in batches:
        out = [np.empty((len(METRICS), 0))]
        for _, _, where, held, table, n in _blocks_of(*(batch.column(c) for c in (1, 2, 3)), dims, dims):
            total = np.where(where[:, :, None] < 0, -np.inf, np.round(table, 9))
            user, ranks = _held_ranks(total, held)
            start = np.searchsorted(user, np.arange(len(n)))  # each user has one at least
            hits = np.add.reduceat(ranks < k, start, axis=0, dtype=np.int64)
            gain = np.add.reduceat(np.where(ranks < k, fade[np.minimum(ranks, k - 1)], 0.0), start, axis=0) / ideal[np.minimum(n, k)][:, None]
            first, many = np.minimum.reduceat(ranks, start, axis=0), np.broadcast_to(n[:, None], hits.shape)
            out.append(np.stack([x.ravel() for x in (hits / k, np.minimum(many, k) / k, hits / many, (hits > 0).astype(float), gain, 1 / (first + 1))]))
        users = np.repeat(batch.column(0).to_numpy(), dims)
        table = np.concatenate(out, axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(users), pa.array(names * batch.num_rows, pa.string()), *map(pa.array, table)], names=["user_id", "method", *METRICS])


def method_metrics(rows: DataFrame, names: list[str], k: int) -> DataFrame:
    """Rows (user_id, method, M1-M6 metrics) of ``packed_candidates`` that aren't scaled: all methods ranked in the user's row."""
    told = rows.mapInArrow(partial(_metric_batches, names=names, k=k), "user_id bigint, method string, " + ", ".join(f"{m} double" for m in METRICS))
    return stored_in_small_batches(told, "metrics")


def _shown_batches(batches: Iterator[pa.RecordBatch], names: list[str], k: int, items: int) -> Iterator[pa.RecordBatch]:
    counts, dims = np.zeros((len(names), items), np.int64), len(names)
    for batch in batches:
        for _, _, where, _, table, _ in _blocks_of(*(batch.column(c) for c in (1, 2, 3)), dims, dims):
            first = _firsts(np.where(where[:, :, None] < 0, -np.inf, np.round(table, 9)), k)
            position = where[np.arange(len(where))[:, None, None], first]
            method = np.broadcast_to(np.arange(dims)[:, None], position.shape)
            np.add.at(counts, (method[position >= 0], position[position >= 0]), 1)
    method, position = np.nonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(np.array(names, object)[method], pa.string()), pa.array(position.astype(np.int32)), pa.array(counts[method, position])], names=["method", "position", "n"])


def method_exposure(rows: DataFrame, names: list[str], k: int, items: int) -> DataFrame:
    """Rows (method, coverage, gini) of the first k items of each user; the ``items`` never shown count as 0."""
    shown = stored_in_small_batches(rows.mapInArrow(partial(_shown_batches, names=names, k=k, items=items), "method string, position int, n bigint"), "shown")
    shown = shown.groupBy("method", "position").agg(F.sum("n").alias("n"))
    i = F.row_number().over(Window.partitionBy("method").orderBy("n")) + items - F.count("*").over(Window.partitionBy("method"))  # after the items with none
    total = F.sum("n")
    ranked = shown.select("method", "n", i.alias("i")).groupBy("method")
    return ranked.agg((F.count("*") / items).alias("coverage"), ((2 * F.sum(F.col("i") * F.col("n")) - (items + 1) * total) / (items * total)).alias("gini"))


def _search_batches(batches: Iterator[pa.RecordBatch], weights: np.ndarray, k: int, items: int) -> Iterator[pa.RecordBatch]:
    n, dims = weights.shape
    hits, with_hit, gain, users, shown = np.zeros(n), np.zeros(n), np.zeros(n), 0, np.zeros((n, items), bool)
    fade = 1 / np.log2(np.arange(2, max(k, 1) + 2))
    ideal = np.append(0, np.cumsum(fade[:k]))
    for batch in batches:
        for _, _, where, held, table, many in _blocks_of(*(batch.column(c) for c in range(3)), dims, n):
            total = np.round(table @ weights.T, 9)
            total[where < 0] = -np.inf
            user, ranks = _held_ranks(total, held)
            start = np.searchsorted(user, np.arange(len(many)))  # each user has one at least
            within = ranks < k
            hits += within.sum(axis=0)
            with_hit += np.logical_or.reduceat(within, start, axis=0).sum(axis=0)
            gain += (np.where(within, fade[np.minimum(ranks, max(k, 1) - 1)], 0.0) / ideal[np.minimum(many, k)][user][:, None]).sum(axis=0)
            users += len(many)
            open_ = np.flatnonzero(~shown.all(axis=1))  # all items of the others have been shown already
            if len(open_):
                first = _firsts(total[:, :, open_], k)
                position = where[np.arange(len(where))[:, None, None], first]
                draw = np.broadcast_to(open_[:, None], position.shape)
                shown[draw[position >= 0], position[position >= 0]] = True
    lists = [pa.array([x], pa.list_(pa.float64())) for x in (hits, with_hit, gain)]
    yield pa.RecordBatch.from_arrays([pa.array([users]), *lists, pa.array([shown.ravel()], pa.list_(pa.bool_()))], names=["users", "hits", "with_hit", "gain", "shown"])


def search_weights(rows: DataFrame, names: list[str], draws: list[dict[str, float]], k: int, items: int) -> DataFrame:
    """ST10: rows (draw, hits, hit_rate, ndcg, items_shown) over the users of scaled ``packed_candidates``, for every draw of weights.

    All draws' totals of a user are one matrix product, ranked in the user's row, so neither candidates nor users
    are multiplied by draws. A task adds its users up. ``items`` is the size of the catalogue.
    """
    weights = np.array([[d.get(n, 0.0) for n in names] for d in draws])
    held = rows.select("position", "held", "c")
    sums = held.mapInArrow(partial(_search_batches, weights=weights, k=k, items=items), "users bigint, hits array<double>, with_hit array<double>, gain array<double>, shown array<boolean>")
    sums = stored_in_small_batches(sums, "search")  # a row for each task
    shown = F.transform(F.sequence(F.lit(0), F.lit(len(draws) - 1)), lambda d: F.slice("shown", d * items + 1, F.lit(items)))
    sums = sums.select("users", F.posexplode(F.arrays_zip("hits", "with_hit", "gain", shown.alias("shown"))).alias("draw", "x"))
    every = F.aggregate(F.collect_list("x.shown"), F.array_repeat(F.lit(False), items), lambda a, b: F.zip_with(a, b, lambda p, q: p | q))  # a row for each task
    by = sums.groupBy("draw").agg(F.sum("users").alias("users"), *[F.sum(f"x.{c}").alias(c) for c in ("hits", "with_hit", "gain")], F.size(F.filter(every, lambda x: x)).alias("items_shown"))
    share = lambda c: F.col(c) / F.nullif(F.col("users"), F.lit(0))
    return by.select("draw", F.col("hits").cast("bigint").alias("hits"), share("with_hit").alias("hit_rate"), share("gain").alias("ndcg"), "items_shown")


def ablations(best: dict[str, float]) -> dict[str, dict[str, float]]:
    """The weights without each component in turn; a set that would be empty is left out."""
    without = {n: {m: (0.0 if m == n else w) for m, w in best.items()} for n in best}
    return {n: d for n, d in without.items() if any(d.values())}


def shuffled(df: DataFrame, key: str, seed: int, n: int | None = None) -> DataFrame:
    """ST11: rows in an order, or a sample of n rows, that a hash of the key gives."""
    rows = df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key)
    return rows if n is None else rows.limit(n)
