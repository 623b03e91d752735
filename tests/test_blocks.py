"""Blocked comparisons, basket pairs, quantiles and resampling against brute force, hot keys included."""

import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from segrec.functions import quantiles
from segrec.operators import blocks, clustering, facts, metrics, pairs, scoring, stats
from segrec.operators.facts import Star


@pytest.fixture(scope="module")
def star(spark, sf):
    return Star(spark, sf)


# ---- baskets


def brute_pairs(sets):
    baskets, out = {}, {}
    for b, m in sets:
        baskets.setdefault(b, set()).add(m)
    for members in baskets.values():
        for p in itertools.combinations(sorted(members), 2):
            out[p] = out.get(p, 0) + 1
    return out


@pytest.mark.parametrize("block", [2, 7, 512])
def test_pairs_equal_brute_force_with_a_user_who_holds_every_item(spark, block):
    rng = random.Random(1)
    sets = {(u, f"i{rng.randrange(40)}") for u in range(30) for _ in range(rng.randint(0, 6))} | {(99, f"i{k}") for k in range(40)}
    found = pairs.shared_baskets(spark.createDataFrame(sorted(sets), "u int, i string"), "u", "i", block).collect()
    assert {(r["a"], r["b"]): r["both"] for r in found} == brute_pairs(sets) and len(found) == len(brute_pairs(sets))


def test_a_hot_basket_is_many_small_rows(spark):
    sets = spark.range(3000).select(F.lit(1).alias("u"), F.col("id").alias("i")).unionByName(spark.range(50).select(F.col("id").alias("u"), F.lit(7).cast("bigint").alias("i")).where("u <> 1"))
    packs = pairs._blocks(sets, "u", "i", 100).select(F.size("members").alias("n"), "basket").collect()
    assert sum(r["basket"] == 1 for r in packs) == 30 and max(r["n"] for r in packs) < 200


def test_pairs_of_nothing(spark):
    assert pairs.shared_baskets(spark.createDataFrame([], "u int, i string"), "u", "i").count() == 0


# ---- nearest rows


@pytest.mark.parametrize("rows", [3, 1000])
def test_nearest_vectors_equal_brute_force(spark, monkeypatch, rows):
    monkeypatch.setattr(blocks, "LEAST_ROWS", rows)
    monkeypatch.setattr(blocks, "CHUNK", 50)
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(40, 3)), 1)  # with ties
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "id bigint, v array<double>")
    found = {(r["id"], r["r"]): (r["other"], r["sim"]) for r in blocks.nearest(df.where("id % 3 = 0"), df, 3, 5).collect()}
    sim = np.round(x @ x.T, 9)
    for i in range(0, 40, 3):
        best = sorted((-sim[i, j], j) for j in range(40) if j != i)[:5]
        assert [found[i, k + 1] for k in range(5)] == [(j, -s) for s, j in best]
    assert len(found) == 14 * 5


@pytest.mark.parametrize("rows", [4, 1000])
def test_nearest_sets_equal_brute_force_with_an_item_that_all_hold(spark, monkeypatch, rows):
    monkeypatch.setattr(blocks, "LEAST_ROWS", rows)
    rng = random.Random(5)
    sets = {i: sorted({0, *(rng.randrange(1, 9) for _ in range(rng.randint(0, 5)))}) if i else [8] for i in range(30)}
    df = spark.createDataFrame(list(sets.items()), "id bigint, v array<int>")
    found = {(r["id"], r["r"]): (r["other"], r["sim"]) for r in blocks.nearest(df, df, 9, 4, overlap=True).collect()}
    want = {}
    for i, a in sets.items():
        sims = sorted((-len(set(a) & set(b)) / math.sqrt(len(a) * len(b)), j) for j, b in sets.items() if j != i and set(a) & set(b))
        want |= {(i, k + 1): (j, -s) for k, (s, j) in enumerate(sims[:4])}
    assert found.keys() == want.keys() and all(found[k] == (want[k][0], pytest.approx(want[k][1])) for k in want)


def test_equal_rows_meet_once(spark, monkeypatch):
    """Copies are not compared: blocks get one row for each distinct vector, and neighbours are still brute force's."""
    met = []
    real = blocks._meet
    monkeypatch.setattr(blocks, "_meet", lambda left, right, *rest: met.extend((left.count(), right.count())) or real(left, right, *rest))
    kinds = [[1.0, 0.0], [0.8, 0.6], [0.0, 1.0], [0.0, 0.0]]
    rows = [(i, kinds[i % 4]) for i in range(80)] + [(200, [0.6, 0.8])]
    df = spark.createDataFrame(rows, "id bigint, v array<double>")
    found = {(r["id"], r["r"]): (r["other"], r["sim"]) for r in blocks.nearest(df, df, 2, 25).collect()}
    assert met == [5, 5]
    for i, a in rows:
        best = sorted((-round(a[0] * b[0] + a[1] * b[1], 9), j) for j, b in rows if j != i)[:25]
        assert [found[i, k + 1] for k in range(25)] == [(j, -s) for s, j in best]
    assert len(found) == 81 * 25


def test_sums_of_a_list_are_those_of_each_user(star):
    """Users who share a list of neighbours get what their own neighbours' items add up to."""
    near, seen = scoring.set_neighbours(star, 3).collect(), {}
    for r in star.seen.collect():
        seen.setdefault(r["user_id"], set()).add(r["item"])
    want = {}
    for r in near:
        for i in seen[r["other"]]:
            want[r["user_id"], i] = want.get((r["user_id"], i), 0.0) + r["sim"]
    found = scoring.user_user_history(star, 3).collect()
    assert found and all(r["score"] == pytest.approx(want.get((r["user_id"], r["item"]), 0.0)) for r in found)


def test_candidates_stay_with_their_user(spark, star):
    """Scorers and their combination join candidates by user or to broadcast catalogue frames, never by item."""
    bar = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        parts = {"popularity": scoring.global_popularity(star), "preference": scoring.preference_match(star), "rating": scoring.rating(star), "item_item": scoring.item_item(star)}
        for df in (parts["popularity"], parts["preference"], parts["rating"]):
            plan = df._jdf.queryExecution().executedPlan().toString()
            joins = [line for line in plan.splitlines() if "SortMergeJoin" in line and ("[item#" in line or "[user_id#" in line and ", item#" in line)]
            assert not joins, joins
        del parts["item_item"]
        mixed = scoring.hybrid(parts, dict.fromkeys(parts, 0.25))._jdf.queryExecution().executedPlan().toString()
        assert "Union" not in mixed
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", bar)


def test_silhouette_in_blocks_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(blocks, "LEAST_ROWS", 6)
    monkeypatch.setattr(blocks, "CHUNK", 20)
    rng = np.random.default_rng(8)
    x, label = rng.normal(size=(50, 4)), [int(v) for v in rng.integers(0, 3, 50)]
    label[7] = 9  # alone
    x[3] = x[4]
    df = spark.createDataFrame([(i, [float(a) for a in v], c) for i, (v, c) in enumerate(zip(x, label))], "k int, v array<double>, c int")
    found = {r["id"]: r["silhouette"] for r in clustering.silhouette(df, "k", "v", "c").collect()}
    d, of = np.sqrt(((x[:, None] - x) ** 2).sum(axis=2)), np.array(label)
    for i in range(50):
        mean = {c: d[i, (of == c) & (np.arange(50) != i)].mean() for c in set(label) if ((of == c) & (np.arange(50) != i)).any()}
        a, b = mean.get(label[i]), min(m for c, m in mean.items() if c != label[i])
        assert found[i] == pytest.approx(0 if a is None else (b - a) / max(a, b))


# ---- quantiles


@pytest.mark.parametrize("few", [0, 10, 10**6])
def test_quantiles_equal_numpy(spark, monkeypatch, few):
    monkeypatch.setattr(quantiles, "FEW", few)
    monkeypatch.setattr(quantiles, "BINS", 5)
    rng = random.Random(2)
    data = {"a": [rng.gauss(0, 1) for _ in range(500)], "b": [float(rng.randrange(4)) for _ in range(100)], "c": [1e300, -1e300, 5e-324, 0.0, 1e-9], "d": [3.0]}
    rows = [(n, x) for n, v in data.items() for x in v] + [("a", None), ("e", None), ("b", float("nan"))]
    found = quantiles.quantiles(spark.createDataFrame(rows, "name string, x double"), [0.0, 0.25, 0.5, 0.7, 0.9, 1.0])
    assert found.keys() == data.keys()
    for n, v in data.items():
        assert found[n] == pytest.approx(np.quantile(v, [0.0, 0.25, 0.5, 0.7, 0.9, 1.0]))
    assert quantiles.quantiles(spark.createDataFrame([], "name string, x double"), [0.5]) == {}


def test_no_task_holds_all_values_of_the_cut(star):
    """The cut's passes count bins; nothing gathers values as an exact percentile does."""
    import inspect

    assert "percentile" not in inspect.getsource(quantiles) and star.cuts[0] < star.cuts[1]
    old = star.interactions.agg(F.percentile(facts.micros("ts"), 0.7), F.percentile(facts.micros("ts"), 0.8)).first()
    assert star.cuts == tuple(old)


# ---- joins


def test_a_key_counted_twice_raises_without_another_scan(spark, sf, star):
    dims = spark.createDataFrame([(1, "x"), (2, "y"), (None, "n"), (None, "m")], "k int, v string")
    rows = spark.createDataFrame([(1,), (1,), (3,)], "k int").join(facts.one_each(dims, "k", "dims"), "k", "left").collect()
    assert sorted((r["k"], r["v"]) for r in rows if r["v"]) == [(1, "x"), (1, "x")] and len(rows) == 3
    twice = dims.unionByName(spark.createDataFrame([(1, "z")], "k int, v string"))
    with pytest.raises(Exception, match="several rows have k 1"):
        spark.createDataFrame([(1,)], "k int").join(facts.one_each(twice, "k", "dims"), "k").collect()
    plan = star.interactions._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [l_orderkey") <= 1 and plan.count("o_orderkey") and plan.count("Relation [") == 4  # lines, orders, names, catalogue


# ---- resampling


def test_poisson_counts_are_poisson_and_the_same_in_any_partitioning(spark):
    counts = stats.poisson_counts(np.arange(4000, dtype=np.int64), 200)
    assert counts.mean() == pytest.approx(1, abs=0.01) and counts.var() == pytest.approx(1, abs=0.02) and (counts == 0).mean() == pytest.approx(math.exp(-1), abs=0.005)
    df = spark.createDataFrame([(i, float(i % 7), "ab"[i % 2]) for i in range(1500)], "k int, x double, g string")
    one, two = (sorted(stats.bootstrap_means(d, "k", "x", 300, group="g").collect()) for d in (df.coalesce(1), df.repartition(9)))
    assert len(one) == 600 and [r["m"] for r in one] == pytest.approx([r["m"] for r in two])


def test_two_thousand_replicates_give_the_interval_of_the_mean(spark):
    rng = random.Random(4)
    values = [rng.gauss(5, 2) for _ in range(900)]
    r = stats.bootstrap_mean(spark.createDataFrame(list(enumerate(values)), "k int, x double"), "k", "x", 2000).first()
    error = np.std(values) / math.sqrt(900)
    assert r["mean"] == pytest.approx(np.mean(values)) and r["low"] == pytest.approx(np.mean(values) - 1.96 * error, abs=0.3 * error) and r["high"] == pytest.approx(np.mean(values) + 1.96 * error, abs=0.3 * error)


def test_preference_null_draws_by_weight_and_finds_a_signal(spark):
    items = spark.createDataFrame([(f"i{k}", f"c{k % 3}", k % 2, k % 2) for k in range(9)], "item string, category string, level int, is_free int")
    weights = spark.createDataFrame([(f"i{k}", 1.0 + k) for k in range(9)], "item string, w double")
    loyal = spark.createDataFrame([(u, f"i{u % 3 + 3 * j}") for u in range(200) for j in range(3)], "user_id int, item string")  # one category each
    seen = stats.preference_statistics(loyal, items).first()
    assert (seen["distinct_categories"], seen["top_category_share"]) == (1, 1)
    null = stats.preference_null(loyal, items, weights, 40)
    assert null.count() == 160
    told = stats.permutation_summary(1.0, null.where("statistic = 'distinct_categories'"), "value").first()
    assert told["signal"] and 1.8 < told["null_mean"] < 2.6
    single = spark.createDataFrame([(u, "i0") for u in range(3000)], "user_id int, item string")
    share = stats.preference_null(single, items, weights, 20).where("statistic = 'free_share'").agg(F.avg("value")).first()[0]
    assert share == pytest.approx((2 + 4 + 6 + 8) / 45, abs=0.01)


def test_provider_null_stays_within_the_items_pool(spark):
    rows = spark.createDataFrame([(f"t{u}-{j}", u, "a", j) for u in range(50) for j in range(2)] + [("x", 99, "b", 5)], "txn string, user_id int, item string, provider_id int")
    observed, null = stats.provider_null(rows, 20)
    assert observed.first()["ratio"] == 1.0 and null.agg(F.avg("ratio")).first()[0] == pytest.approx(0.75, abs=0.03)


def test_provider_null_counts_draws_in_the_users_row(spark, monkeypatch):
    monkeypatch.setattr(stats, "DRAWN_AT_ONCE", 3)  # several groups an item
    told = [(f"t{k}", k % 7, None if k % 11 == 0 else f"i{k % 3}", None if k % 13 == 0 else k % 5) for k in range(60)] + [("only", 50, "i0", 1)]
    rows = spark.createDataFrame(told, "txn string, user_id int, item string, provider_id int")
    null = stats.provider_null(rows, 4)[1]
    assert "hashpartitioning(replicate" not in null._jdf.queryExecution().toString()  # rows aren't multiplied by replicates
    u = {(r["txn"], k): r[f"u{k}"] for r in rows.select("txn", *[stats.uniform(F.lit(42), F.lit(k), "txn").alias(f"u{k}") for k in range(1, 5)]).collect() for k in range(1, 5)}
    pools = {i: sorted({p for _, _, j, p in told if j == i}, key=lambda p: (p is not None, p or 0)) for i in ("i0", "i1", "i2")}
    found = {r["replicate"]: r["ratio"] for r in null.collect()}
    for k in range(1, 5):
        ratios = []
        for user in range(7):
            mine = [(t, i) for t, v, i, _ in told if v == user]
            drawn = {pools[i][int(u[t, k] * len(pools[i]))] for t, i in mine if i is not None} - {None}
            ratios.append(len(drawn) / len(mine))
        assert found[k] == pytest.approx(sum(ratios) / 7)


def test_rows_that_cannot_be_first_are_left_out_before_the_sort(spark):
    rng = np.random.default_rng(5)
    told = [(u, f"i{p}", p, x) for u in range(30) for p, x in enumerate([0.5, None, float("nan")] + [round(float(v), 1) + float(e) * 4e-10 for v, e in zip(rng.random(40), rng.integers(-2, 3, 40), strict=True)])]
    rows = spark.createDataFrame(told, "user_id int, item string, position int, score double")
    every = [tuple(r) for r in scoring.ranked(rows).where("rank <= 6").select("user_id", "item", "rank").orderBy("user_id", "rank").collect()]
    assert [tuple(r) for r in scoring.ranked(rows, 6).select("user_id", "item", "rank").orderBy("user_id", "rank").collect()] == every
    tied = pa.RecordBatch.from_pydict({"user_id": [1] * 100, "position": list(range(100)), "score": [1.0, 2.0] * 50})
    (kept,) = scoring._first_batches(iter([tied]), 6, 2e-9)
    assert kept.column(1).to_pylist() == [1, 3, 5, 7, 9, 11]


def test_hybrid_chooses_the_first_rows_and_scales_once(star, monkeypatch):
    parts = {"p": scoring.global_popularity(star), "m": scoring.preference_match(star)}
    first, weights = {}, {"p": 0.6, "m": 0.4}
    for k in (None, 3):
        rows = scoring.ranked(scoring.hybrid(parts, weights, k), 3).select("user_id", "item", "rank", F.round("score", 9), "contributions")
        first[k] = sorted((tuple(r) for r in rows.collect()), key=lambda r: (r[0], r[2]))
    assert first[3] and first[3] == first[None]
    # a scaled score refers to bounds found once for each user, not for each candidate
    plan = scoring.hybrid(parts, weights)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_min(") == 2


def test_item_sums_by_matrix_equal_those_by_joins(star, monkeypatch):
    by_matrix = scoring.item_item(star)
    assert "BroadcastHashJoin" not in by_matrix._jdf.queryExecution().executedPlan().toString()  # no row for each pair of a user's item and a candidate
    found = {(r["user_id"], r["item"], r["position"]): r["score"] for r in by_matrix.collect()}
    monkeypatch.setattr(scoring, "SMALL_ROWS", 0)
    want = {(r["user_id"], r["item"], r["position"]): r["score"] for r in scoring.item_item(star).collect()}
    assert found.keys() == want.keys() and all(found[k] == pytest.approx(want[k]) for k in want)


def test_weight_search_and_metrics_equal_ranking_one_by_one(star):
    parts = {"p": scoring.global_popularity(star), "r": scoring.rating(star), "m": scoring.preference_match(star)}
    held, items = metrics.relevant(star), len(star.catalogue)
    draws = stats.simplex_weights(list(parts), 6)
    found = {r["draw"]: r for r in stats.search_weights(stats.packed_candidates(parts, held, True), list(parts), draws, 10, items).collect()}
    for i, weights in enumerate(draws):
        ranking = scoring.ranked(scoring.hybrid(parts, weights))
        per = metrics.per_user(ranking, held, 10)
        want = per.agg(F.sum(F.col("precision") * 10).alias("hits"), F.avg("hit").alias("hit"), F.avg("ndcg").alias("ndcg")).first()
        shown = ranking.where("rank <= 10").join(held.select("user_id").distinct(), "user_id", "left_semi").select("item").distinct().count()
        assert (found[i]["hits"], found[i]["items_shown"]) == (round(want["hits"]), shown)
        assert (found[i]["hit_rate"], found[i]["ndcg"]) == (pytest.approx(want["hit"]), pytest.approx(want["ndcg"]))
    packed = stats.packed_candidates(parts, held, False)
    mine = {(r["method"], r["user_id"]): r for r in stats.method_metrics(packed, list(parts), 10).collect()}
    for r in metrics.per_user(scoring.ranked(parts["m"]), held, 10).collect():
        assert all(mine["m", r["user_id"]][m] == pytest.approx(r[m]) for m in metrics.METRICS)
    exposure = {r["method"]: r for r in stats.method_exposure(packed, list(parts), 10, items).collect()}
    want = metrics.exposure(scoring.ranked(parts["p"]), star.items, held.select("user_id").distinct(), 10).first()
    assert (exposure["p"]["coverage"], exposure["p"]["gini"]) == (pytest.approx(want["coverage"]), pytest.approx(want["gini"]))


def test_ablations_leave_out_one_component_each():
    assert stats.ablations({"a": 1.0, "b": 0.0}) == {"b": {"a": 1.0, "b": 0.0}}
    assert set(stats.ablations({"a": 0.5, "b": 0.5})) == {"a", "b"}


# ---- clusterings compared


def test_cluster_silhouettes_equal_the_evaluators_mean(spark):
    from pyspark.ml.evaluation import ClusteringEvaluator

    rng = random.Random(6)
    rows = [(i, [rng.gauss(4 * (i % 3), 1), rng.gauss(0, 1)], i % 3) for i in range(90)] + [(99, [50.0, 50.0], 7)]
    df = spark.createDataFrame(rows, "id int, v array<double>, c int")
    by = {r["label"]: (r["n"], r["silhouette"]) for r in clustering.cluster_silhouettes(df, "v", "c").collect()}
    mean = ClusteringEvaluator(featuresCol="__v", predictionCol="c").evaluate(clustering._vectors(df, "v").withColumn("c", F.col("c").cast("double")))
    assert sum(n * x for n, x in by.values()) / 91 == pytest.approx(mean) and by[7] == (1, 0.0)
    assert clustering.cluster_silhouettes(df.limit(0), "v", "c").count() == 0


def test_the_gap_says_one_cluster_of_noise_and_three_of_blobs(spark):
    """By the rule alone: the smallest k whose gap reaches the next one less its error."""
    kinds = "k int, gap double, error double"
    noise = clustering.gap_choice(spark.createDataFrame([(1, 0.5, 0.1), (2, 0.55, 0.1), (3, 0.9, 0.1)], kinds)).first()
    assert (noise["optimal_k"], noise["no_structure"]) == (1, True)
    blobs = clustering.gap_choice(spark.createDataFrame([(1, 0.1, 0.01), (2, 0.4, 0.01), (3, 0.9, 0.01), (4, 0.8, 0.01)], kinds)).first()
    assert (blobs["optimal_k"], blobs["no_structure"]) == (3, False)
    rising = clustering.gap_choice(spark.createDataFrame([(1, 0.1, 0.01), (2, 0.4, 0.01)], kinds)).first()
    assert rising["optimal_k"] == 2


def test_uniform_rows_have_no_structure(spark):
    rng = random.Random(42)
    uniform = spark.createDataFrame([([rng.random() for _ in range(3)],) for _ in range(200)], "v array<double>")
    found = clustering.gap_choice(clustering.gap_statistic(uniform, "v", [1, 2, 3], 6)).first()
    assert found["optimal_k"] == 1 and found["no_structure"]


def test_arms_are_clustered_and_compared(star):
    from segrec.operators.features import user_features

    rows = clustering.grid_comparison(user_features(star.train, star.users), 3, 1, clustering.GRID[:2]).collect()
    assert [r["arm"] for r in rows] == ["proportion", "one_hot"] and rows[0]["agreement"] == 1 and -1 <= rows[1]["agreement"] <= 1
    assert all(-1 <= r["silhouette"] <= 1 and 0 < r["smallest_share"] <= 1 / 3 for r in rows)


def test_pools_are_bits_of_their_items(spark):
    """no row for each item of a user's providers; positions beyond one number of 64 bits count as well."""
    from segrec.plans import audit

    rng = random.Random(15)
    rows = [(u, rng.randrange(9), rng.randrange(150), r) for u in range(40) for r in range(1, rng.randrange(2, 6))]
    size = {u: max(r for v, _, _, r in rows if v == u) for u in {x[0] for x in rows}}
    o = spark.createDataFrame([(u, p, i, r, size[u]) for u, p, i, r in rows], "user_id int, provider_id int, position int, r int, size int")
    told = audit._pool_hits(o, o.select("provider_id", "position"), 150)
    hits, chances = [], []
    for u, n in size.items():
        pool = {i for _, p, i, _ in rows if p in {q for v, q, _, r in rows if v == u and r < n}}
        if n > 1:
            hits.append(next(i for v, _, i, r in rows if v == u and r == n) in pool)
            chances.append(len(pool) / 150)
    row = told.first()
    assert 0 < row["hit_rate"] == pytest.approx(sum(hits) / len(hits), abs=1e-6) and row["chance"] == pytest.approx(sum(chances) / len(chances), abs=1e-6)
    assert "explode" not in told._jdf.queryExecution().analyzed().toString()


def test_a_key_is_drawn_once_for_all_groups(monkeypatch):
    """A user's counts in the replicates are the same under every method, and made once."""
    import pyarrow as pa

    made, real = [], stats.poisson_counts
    monkeypatch.setattr(stats, "poisson_counts", lambda base, n: made.append(len(base)) or real(base, n))
    base = np.repeat(np.arange(300, dtype=np.int64) * 7919, 5)
    value = np.random.default_rng(2).random(1500)
    batch = pa.record_batch([pa.array(base), pa.array(list("abcde") * 300), pa.array(value)], names=["h", "group", "x"])
    out = next(iter(stats._weight_batches(iter([batch]), 50)))
    assert sum(made) <= 302  # a slice may end inside a key
    counts = real(base, 50)
    for k, g in enumerate(out.column(0).to_pylist()):
        at = np.arange(1500) % 5 == "abcde".index(g)
        assert np.allclose(out.column(1)[k].as_py(), counts[at].sum(axis=0)) and np.allclose(out.column(2)[k].as_py(), value[at] @ counts[at])


def test_methods_are_ranked_without_shuffling_candidates(star):
    """A task ranks the candidates of one method, not of all, and joins them by user."""
    from segrec.plans import ranking

    plan = ranking.method_table(star)._jdf.queryExecution().analyzed().toString()
    assert "row_number() windowspecdefinition(user_id" in plan and "row_number() windowspecdefinition(method" not in plan


def test_sets_meet_in_single_products_with_exact_likeness(spark):
    """rows of ones were multiplied as doubles; ties and sizes are still brute force's."""
    rng = np.random.default_rng(19)
    sets = sorted({tuple(np.flatnonzero(rng.random(64) < rng.choice([0.05, 0.2, 0.6])).tolist()) for _ in range(150)} - {()})
    assert blocks._matrix(pa.chunked_array([pa.array(sets, pa.list_(pa.int32()))]), 64, True).dtype == np.float32
    assert blocks._matrix(pa.chunked_array([pa.array(sets, pa.list_(pa.int32()))]), blocks.SINGLE + 1, True).dtype == np.float64
    df = spark.createDataFrame([(i, list(v)) for i, v in enumerate(sets)], "id bigint, v array<int>")
    found = {(r["id"], r["r"]): (r["other"], r["sim"]) for r in blocks.nearest(df, df, 64, 9, overlap=True).collect()}
    for i, a in enumerate(sets):
        common = [(j, len(set(a) & set(b)), b) for j, b in enumerate(sets) if j != i]
        best = sorted((-n / np.sqrt(len(a) * len(b)), j) for j, n, b in common if n)[:9]
        assert [found[i, k + 1] for k in range(len(best))] == [(j, pytest.approx(-s, abs=1e-15)) for s, j in best]


def test_neighbours_of_many_blocks_equal_brute_force(spark, monkeypatch):
    """leaves that can't hold a neighbour aren't multiplied, and one row a list leaves a task; ties, copies and several blocks are still brute force's."""
    monkeypatch.setattr(blocks, "LEAST_ROWS", 70)
    monkeypatch.setattr(blocks, "SEARCHED_BYTES", 1)
    monkeypatch.setattr(blocks, "LEAF", 8)
    monkeypatch.setattr(blocks, "ASKED", 32)
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(300, 5)), 1)
    x[200:] = x[:100]  # copies
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "id bigint, v array<double>")
    near = blocks.neighbour_lists(df, df, 5, 6)
    assert "Window" not in near._jdf.queryExecution().executedPlan().toString()  # no row for each neighbour
    found = {r["list"]: [(n["r"], n["other"], n["sim"]) for n in r["near"]] for r in near.collect()}
    sim = np.round(x @ x.T, 9)
    assert found.keys() == {min(np.flatnonzero((x == v).all(axis=1))) for v in x}
    for i, got in found.items():
        best = np.lexsort((np.arange(300), -sim[i]))[:7]
        assert got == [(k + 1, j, pytest.approx(sim[i, j], abs=1e-12)) for k, j in enumerate(best)]


def test_leaves_out_of_reach_are_not_multiplied(monkeypatch):
    """every pair of a block was multiplied."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(4000, 3))
    x /= np.linalg.norm(x, axis=1)[:, None]
    monkeypatch.setattr(blocks, "LEAF", 64)
    seen, real = [], blocks._where
    monkeypatch.setattr(blocks, "_where", lambda mask: seen.append(mask.size) or real(mask))
    for at, row, col, value in blocks._near_vectors(x[:500], x, 10):
        sim = np.round(x[at] @ x.T, 9)
        for i in range(len(at)):
            assert (col[row == i] == np.lexsort((np.arange(4000), -sim[i]))[:10]).all()
    assert sum(seen) < 500 * 4000 / 4


def test_sets_of_several_words_and_sizes_equal_brute_force():
    """what sets have in common is a count of bits, exact with ties, over blocks of one size."""
    rng = np.random.default_rng(9)
    for dims in (20, 300):
        ones = rng.random((700, dims)) < rng.choice([0.02, 0.1, 0.5], (700, 1))
        lists = pa.chunked_array([pa.array([np.flatnonzero(r).tolist() for r in ones], pa.list_(pa.int32()))])
        bits, n = blocks._bits(lists, dims), ones.sum(axis=1)
        both = ones.astype(int) @ ones.T.astype(int)
        value = both / np.maximum(np.sqrt(n[:, None] * n), 1)
        got = 0
        for at, row, col, found in blocks._near_sets(bits, bits, 7):
            for i, a in enumerate(at):
                want = [j for j in np.lexsort((np.arange(700), -value[a]))[:7] if both[a, j]]
                assert col[row == i].tolist() == want and np.allclose(found[row == i], value[a, want])
                got += len(want)
        assert got > 3000


def test_all_users_are_asked_for_their_history_neighbours(star):
    """a twentieth of the users was scored."""
    from segrec import catalog

    rows = catalog.QUERIES["r6_user_user_history"](star.spark, star.sf_dir).select("user_id").distinct().count()
    assert rows == star.candidates.select("user_id").distinct().count()


def test_components_are_packed_by_one_shuffle_and_not_by_joins(star):
    """components met in as many joins, whose sorters and aggregates shared a task's memory."""
    joins = []
    for n in (2, 5):
        parts = {str(i): scoring.random_score(star, i) for i in range(n)}
        plan = stats.packed_candidates(parts, metrics.placed(star), False)._jdf.queryExecution().analyzed().toString()
        joins.append((plan.count("Join"), plan.count("FlatMapGroupsInArrow")))
    assert joins[0] == joins[1] and joins[0][1] == 1


def test_weight_search_sorts_only_for_items_that_were_never_shown(monkeypatch):
    """each user's candidates were sorted for every draw."""
    rng = np.random.default_rng(5)
    users, items = 300, 12
    held = rng.random((users, items)) < 0.2
    held[:, 0] |= ~held.any(axis=1)
    scores = np.round(rng.random((users, items, 2)), 1)
    batch = pa.RecordBatch.from_arrays([pa.array([list(range(items))] * users, pa.list_(pa.int32())), pa.array(held.tolist()), pa.array(scores.reshape(users, -1).tolist())], names=["position", "held", "c"])
    weights = np.array([[1.0, 0.0], [0.3, 0.7], [0.0, 1.0]])
    monkeypatch.setattr(stats, "TOGETHER", 720)  # 20 users at a time
    seen, real = [], stats._firsts
    monkeypatch.setattr(stats, "_firsts", lambda total, k: seen.append(total.shape[2]) or real(total, k))
    out = next(stats._search_batches(iter([batch]), weights, 3, items)).to_pylist()[0]
    assert out["users"] == users and sum(seen) < 3 * 15 / 2
    fade = 1 / np.log2(np.arange(2, 5))
    for d, w in enumerate(weights):
        first = np.argsort(-np.round(scores @ w, 9), axis=1, kind="stable")[:, :3]
        hit = np.take_along_axis(held, first, axis=1)
        gain = sum((fade @ h) / fade[: min(3, m.sum())].sum() for h, m in zip(hit, held, strict=True))
        assert (out["hits"][d], out["with_hit"][d], out["gain"][d]) == (hit.sum(), hit.any(axis=1).sum(), pytest.approx(gain))
    assert all(out["shown"])
