"""Operators on hand-made inputs: metrics, quality checks, scorers, clustering, statistics, sources."""

import math
import random

import pytest
from pyspark.sql import functions as F

from segrec.functions.columns import min_max, random_hit_rate, tier
from segrec.operators import clustering, metrics, quality, scoring, stats
from segrec.operators.facts import Star
from segrec.operators.features import require_rows, user_features
from segrec.plans.serving import Unservable, recommend
from segrec.sources import scan
from segrec.sources.schema import ORDERS, TABLES, Column, Table


@pytest.fixture(scope="module")
def star(spark, sf):
    return Star(spark, sf)


# ---- metrics


def test_metrics_by_hand(spark):
    ranking = spark.createDataFrame([(1, i, r) for r, i in enumerate([4, 7, 1, 9], 1)] + [(2, i, r) for r, i in enumerate([1, 2, 3], 1)], "user_id int, item int, rank int")
    held = spark.createDataFrame([(1, 7), (1, 9), (2, 5)], "user_id int, item int")
    rows = {r["user_id"]: r for r in metrics.per_user(ranking, held, 2).collect()}
    one = rows[1]
    assert (one["precision"], one["ceiling"], one["recall"], one["hit"], one["reciprocal_rank"]) == (0.5, 1.0, 0.5, 1, 0.5)
    assert one["ndcg"] == pytest.approx((1 / math.log2(3)) / (1 + 1 / math.log2(3)))
    assert (rows[2]["hit"], rows[2]["reciprocal_rank"], rows[2]["ndcg"]) == (0, 0.0, 0.0)


def test_exposure_counts_items_never_shown(spark):
    items = spark.createDataFrame([(i,) for i in range(4)], "item int")
    ranking = spark.createDataFrame([(1, 0, 1), (2, 1, 1), (3, 0, 1), (3, 3, 2)], "user_id int, item int, rank int")
    users = spark.createDataFrame([(1,), (2,), (3,)], "user_id int")
    r = metrics.exposure(ranking, items, users, 1).first()
    assert r["coverage"] == 0.5 and r["gini"] == pytest.approx((2 * (3 * 1 + 4 * 2) - 5 * 3) / (4 * 3))


def test_small_functions(spark):
    df = spark.createDataFrame([(1, 5.0), (1, 5.0), (2, 1.0), (2, 3.0)], "g int, x double")
    assert sorted(r[0] for r in df.select(min_max(F.col("x"), "g")).collect()) == [0.0, 0.0, 0.0, 1.0]
    tiers = spark.createDataFrame([(n,) for n in (0, 1, 2, 8, 9)], "n int").select(tier(F.col("n"))).collect()
    assert [t[0] for t in tiers] == ["insufficient", "minimal", "moderate", "moderate", "rich"]
    chance = spark.range(1).select(random_hit_rate(F.lit(59), F.lit(1), 10)).first()[0]
    assert chance == pytest.approx(10 / 59)


# ---- quality: what is broken must be found


def errors(df, table):
    return {(r["check_id"], r["subject"]): r["n"] for r in quality.value_findings(df, table).where("n > 0").collect()}


ITEMS = Table("items", (Column("id", "string", unique=True, prefix="I"), Column("kind", "string", domain=("a", "b")), Column("price", "double", low=0, high=10)))


def test_each_corruption_is_found(spark):
    good = [("I1", "a", 1.0), ("I2", "b", 2.0)]
    make = lambda rows: spark.createDataFrame(rows, "id string, kind string, price double")
    assert errors(make(good), ITEMS) == {}
    assert errors(make([*good, ("I1", "a", 1.0)]), ITEMS) == {("uniqueness", "id"): 1}
    assert errors(make([*good, (None, "a", 1.0), (None, "a", 1.0)]), ITEMS) == {("nulls", "id"): 2, ("uniqueness", "id"): 1}
    assert errors(make([*good, ("X3", "c", -1.0)]), ITEMS) == {("id_format", "id"): 1, ("value_domain", "kind"): 1, ("range_below", "price"): 1}
    assert errors(make([*good, ("I3", "a", 47.0)]), ITEMS) == {("range_above", "price"): 1}
    assert quality.duplicate_rows(make([*good, good[0], good[0]]), ITEMS).first()["n"] == 2
    assert {(r["check_id"], r["subject"]) for r in quality.column_findings(make(good).drop("kind").withColumn("x", F.lit(1)), ITEMS).collect()} == {("columns_missing", "kind"), ("columns_unexpected", "x")}
    with pytest.raises(ValueError):
        quality.require_clean(quality.value_findings(make([("X", "a", 1.0)]), ITEMS).where("n > 0"))


def test_null_keys_are_orphans(spark):
    child, parent = spark.createDataFrame([(1,), (2,), (None,)], "k int"), spark.createDataFrame([(1,), (5,)], "p int")
    assert {r["check_id"]: r["n"] for r in quality.orphans(child, "k", parent, "p", "c", "p").collect()} == {"orphan_fk": 2, "unreferenced_parent": 1}


def test_report_skips_checks_of_missing_columns(spark, sf):
    tables = {n: scan.load(spark, sf, n) for n in ("orders", "customer")}
    tables["orders"] = tables["orders"].drop("o_custkey")
    found = {(r["check_id"], r["subject"]) for r in quality.report(tables, TABLES).collect()}
    assert ("columns_missing", "o_custkey") in found and ("skipped", "o_custkey") in found


# ---- windows, features, scorers


def test_windows_are_disjoint_and_pure(star):
    assert star.train.join(star.test, "txn", "left_semi").count() == 0
    assert star.train.count() + star.test.count() == star.interactions.count()
    assert star.train.agg(F.max("ts")).first()[0] < star.test.agg(F.min("ts")).first()[0]


def test_features_do_not_depend_on_row_order(star):
    a = user_features(star.train).orderBy("user_id").collect()
    b = user_features(star.train.repartition(5, "amount")).orderBy("user_id").collect()
    for x, y in zip(a, b, strict=True):
        assert all(p == q or p == pytest.approx(q) for p, q in zip(x, y, strict=True))
    with pytest.raises(ValueError):
        require_rows(star.train.limit(0))


def test_injected_future_changes_nothing(spark, sf, star):
    before = star.train
    late = star.interactions.withColumn("ts", F.expr("timestampadd(YEAR, 50, ts)"))
    other = Star(spark, sf)
    other.__dict__["interactions"] = star.interactions.unionByName(late)
    other.__dict__["cut"] = star.cut
    assert user_features(other.train).exceptAll(user_features(before)).count() == 0


@pytest.mark.parametrize("scorer", [scoring.random_score, scoring.global_popularity, scoring.rating, scoring.content_based, scoring.item_item, scoring.provider_affinity, scoring.diversified_fallback, scoring.preference_match])
def test_scorers_score_every_candidate_once(star, scorer):
    rows = scorer(star)
    assert rows.count() == star.candidates.count() and rows.select("user_id", "item").distinct().count() == star.candidates.count()
    assert rows.where("score IS NULL").count() == 0 and rows.join(star.seen, ["user_id", "item"], "left_semi").count() == 0


def test_ranks_are_contiguous_and_ties_go_to_position(spark):
    scores = spark.createDataFrame([(1, "a", 2, 1.0), (1, "b", 0, 1.0), (1, "c", 1, 2.0)], "user_id int, item string, position int, score double")
    assert [(r["item"], r["rank"]) for r in scoring.ranked(scores).orderBy("rank").collect()] == [("c", 1), ("b", 2), ("a", 3)]
    assert scoring.ranked(scores, 10_000).count() == 3
    with pytest.raises(ValueError):
        scoring.ranked(scores, 0)


def test_hybrid_contributions_add_up(star):
    rows = scoring.hybrid({"p": scoring.global_popularity(star), "r": scoring.rating(star), "z": scoring.rating(star)}, {"p": 0.7, "r": 0.3, "z": 0.0})
    r = rows.select("score", "contributions").first()
    assert set(r["contributions"]) == {"p", "r"} and r["score"] == pytest.approx(sum(r["contributions"].values()))


def test_serving_errors_and_filters(star):
    user = star.seen.select("user_id").first()[0]
    rows = recommend(star, user, 5, category="gear").collect()
    assert rows and all(r["item"].endswith("gear") and r["explanation"] for r in rows)
    for bad in (dict(k=0), dict(user_id=-1), dict(category="none")):
        with pytest.raises(Unservable):
            recommend(star, **bad)


def test_explanations_quote_counted_facts(star):
    rows = recommend(star, k=3).where("tier <> 'minimal'").limit(50).collect()
    assert rows and all(f"{r['segment_enrollments']} enrollments" in r["explanation"] for r in rows if r["score"] > 0)


def test_command_line(spark, sf, star, capsys):
    from segrec.__main__ import main

    user = star.seen.select("user_id").first()[0]
    assert main([sf, "--user", str(user), "-k", "2", "--json"], spark) == 0 and capsys.readouterr().out.count("explanation") == 2
    assert main([sf, "--user", "-5"], spark) == 1 and main([sf, "--describe"], spark) == 0
    assert '"users"' in capsys.readouterr().out


# ---- clustering


def test_grid_arms_differ(star):
    dims = {a.name: len([c for b in clustering.arm_blocks(a).values() for c in b]) for a in clustering.GRID}
    assert len(dims) == 10 and dims["numeric_only"] == 10 and dims["proportion"] == 21 and dims["demographic"] == 22
    rows = clustering.represent(user_features(star.train, star.users), clustering.GRID[1]).first()
    assert len(rows["vector"]) == dims["one_hot"]


@pytest.fixture(scope="module")
def blobs(spark):
    rng = random.Random(42)
    rows = [(i, [rng.gauss(c, 0.3) for _ in range(4)], c) for i, c in enumerate([-6] * 40 + [0] * 40 + [6] * 40)]
    return spark.createDataFrame(rows, "id int, v array<double>, label int")


def ari(df, a, b):
    return clustering.adjusted_rand(df, a, b).first()[0]


def test_clusterings_find_blobs(blobs):
    model = clustering.fit_kmeans(blobs, "v", 3, n_init=2)
    assert ari(clustering.predict(model, blobs, "v"), "label", "cluster") == pytest.approx(1)
    for method in ("ward", "average"):
        assert ari(clustering.hierarchical(blobs, "id", "v", 3, method).join(blobs, "id"), "label", "cluster") == pytest.approx(1)
    with pytest.raises(ValueError):
        clustering.hierarchical(blobs, "id", "v", 3, limit=10)


def test_starts_of_a_model_share_passes(blobs, monkeypatch):
    given, fit = [], clustering.KMeans.fit
    monkeypatch.setattr(clustering.KMeans, "fit", lambda self, df: given.append(df.count()) or fit(self, df))
    model = clustering.fit_kmeans(blobs, "v", 3, n_init=4)
    assert given == [3]  # the best centers alone
    want = {r["label"]: r["c"] for r in blobs.groupBy("label").agg(F.array(*[F.avg(F.get("v", F.lit(i))) for i in range(4)]).alias("c")).collect()}
    assert sorted(tuple(map(float, c)) for c in model.clusterCenters()) == [pytest.approx(tuple(c)) for c in sorted(want.values())]


def test_quality_measures(spark, blobs):
    points = clustering.long_form(blobs, "id", "v", "label")
    assert clustering.silhouette(blobs, "id", "v", "label").agg(F.avg("silhouette")).first()[0] > 0.9
    assert clustering.davies_bouldin(points).first()[0] < 0.2 and clustering.calinski_harabasz(points).first()[0] > 1000
    assert min(r["eta"] for r in clustering.eta_squared(points).collect()) > 0.99
    alone = spark.createDataFrame([(1, [0.0], 0), (2, [1.0], 1), (3, [1.5], 1)], "id int, v array<double>, label int")
    assert {r["id"]: r["silhouette"] for r in clustering.silhouette(alone, "id", "v", "label").collect()}[1] == 0.0


def test_names_follow_deviations(spark):
    dev = spark.createDataFrame([("s", "a", 1.0), ("s", "b", -0.5), ("s", "c", 0.45), ("t", "a", 0.1), ("t", "b", None)], "segment string, feature string, deviation double")
    vocabulary = {"a": ("high", "low"), "b": ("much", "little"), "c": ("x", "y")}
    assert {r["segment"]: r["name"] for r in clustering.names(dev, vocabulary).collect()} == {"s": "high, little", "t": "balanced"}


def test_constant_column_scales_to_zero(spark):
    df = spark.createDataFrame([(1, 5.0, 1.0), (2, 5.0, 3.0)], "user_id int, a double, b double")
    rows = clustering.standardised(df, ["a", "b"]).orderBy("user_id").collect()
    assert [(r["a"], r["b"]) for r in rows] == [(0.0, -1.0), (0.0, 1.0)]


# ---- statistics


def test_tails_of_distributions(spark):
    assert stats.chi_square_p(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert stats.chi_square_p(18.307038053275146, 10) == pytest.approx(0.05, abs=1e-9)
    assert stats.chi_square_p(0, 3) == 1
    assert stats.student_p(spark, 2.228138851964939, 10) == pytest.approx(0.05, abs=1e-6)


def test_independence_by_hand(spark):
    df = spark.createDataFrame([("a", "x")] * 10 + [("a", "y")] * 20 + [("b", "x")] * 30 + [("b", "y")] * 40, "p string, q string")
    r = stats.chi_square_independence(df, "p", "q").first()
    assert (r["statistic"], r["dof"]) == (pytest.approx(100 * (10 * 40 - 20 * 30) ** 2 / (30 * 70 * 40 * 60)), 1)


def test_bootstrap_interval_holds_the_mean(spark):
    df = spark.createDataFrame([(i, 1.0 + (i % 5 - 2) / 10) for i in range(200)], "k int, x double")
    r = stats.bootstrap_mean(df, "k", "x", 200).first()
    assert r["low"] < 1.0 < r["high"] and r["significant"] and r["high"] - r["low"] < 0.1
    zero = stats.paired_bootstrap(df, df, "k", "x", 50).first()
    assert (zero["mean"], zero["low"], zero["high"], zero["significant"]) == (0, 0, 0, False)


def test_draws_have_no_repeats_and_follow_weights(spark):
    sizes = spark.createDataFrame([(i, 2) for i in range(300)], "user_id int, n int")
    weights = spark.createDataFrame([("a", 10.0), ("b", 1.0), ("c", 1.0), ("d", 1.0)], "item string, w double")
    rows = stats.weighted_draws(sizes, weights, 2).collect()
    assert len(rows) == 1200 and len({tuple(r) for r in rows}) == 1200
    assert sum(r["item"] == "a" for r in rows) > 500


def test_simplex_and_samples(spark):
    draws = stats.simplex_weights(["a", "b", "c"], 40)
    assert all(sum(d.values()) == pytest.approx(1) for d in draws) and any(0.0 in d.values() for d in draws)
    df = spark.range(100)
    a = [r[0] for r in stats.shuffled(df, "id", 1, 10).collect()]
    assert a == [r[0] for r in stats.shuffled(df.repartition(3), "id", 1, 10).collect()] and a != sorted(a)


# ---- sources


def test_personal_columns_never_leave_the_scan(spark, sf):
    for name, df in scan.load_all(spark, sf).items():
        assert not [c.name for c in TABLES[name].columns if c.personal and c.name in df.columns]
    with pytest.raises(scan.IntegrityError):
        scan.coerce(spark.range(1), ORDERS)


@pytest.mark.parametrize("kind", ["parquet", "json", "csv", "orc"])
def test_sinks_round_trip(spark, sf, tmp_path, kind):
    rows = scan.load(spark, sf, "supplier")
    scan.write_table(rows, str(tmp_path / kind), kind)
    back = spark.read.option("header", True).schema(rows.schema).format(kind).load(str(tmp_path / kind))
    assert sorted(back.collect()) == sorted(rows.collect())


def test_manifest_finds_tampering(spark, sf, tmp_path):
    scan.write_table(scan.load(spark, sf, "supplier"), str(tmp_path / "t"), partition_by=("s_nationkey",))
    scan.save_manifest(spark, str(tmp_path / "t"), str(tmp_path / "m"), scan.set_version("a", "b"))
    scan.verify(spark, str(tmp_path / "t"), str(tmp_path / "m"))
    victim = next((tmp_path / "t").rglob("*.parquet"))
    victim.write_bytes(victim.read_bytes() + b"x")
    (victim.parent / f".{victim.name}.crc").unlink()  # else the file system itself finds it
    (tmp_path / "t" / "new.bin").write_bytes(b"1")
    assert {r["problem"] for r in scan.check_integrity(spark, str(tmp_path / "t"), str(tmp_path / "m")).collect()} == {"changed", "unexpected"}
    with pytest.raises(scan.IntegrityError):
        scan.verify(spark, str(tmp_path / "t"), str(tmp_path / "m"))


def test_rankings_are_never_broadcast(spark):
    """a ranking's rows are the users' times the catalogue's, which Spark's estimate doesn't tell."""
    items = F.explode(F.array(*[F.struct(F.lit(f"i{k}").alias("item"), F.lit(k).alias("position")) for k in range(30)]))
    rows = spark.range(8).select(F.col("id").alias("user_id"), items.alias("c")).select("user_id", "c.*", F.lit(0.0).alias("score"))
    held = spark.range(4000).select((F.col("id") % 10).alias("user_id"), F.concat(F.lit("i"), F.col("id") % 40).alias("item")).distinct()
    plan = metrics.per_user(scoring.ranked(rows), held, 10)
    lines, inside = plan._jdf.queryExecution().executedPlan().toString().splitlines(), None
    for line in lines:
        depth = len(line) - len(line.lstrip(" :+-"))
        inside = None if inside is not None and depth <= inside else depth if inside is None and "BroadcastExchange" in line else inside
        assert inside is None or "Window" not in line
    told = {r["user_id"]: r for r in plan.collect()}
    pairs = {(r["user_id"], r["item"]) for r in held.collect()}
    assert len(told) == 10
    for user, row in told.items():
        ranks = [k + 1 for k in range(30) if (user, f"i{k}") in pairs and user < 8]
        assert row["n_rel"] == sum(u == user for u, _ in pairs) and row["precision"] == sum(r <= 10 for r in ranks) / 10
        assert row["reciprocal_rank"] == (1 / min(ranks) if ranks else 0)


def test_large_files_are_hashed_in_pieces_and_never_held(spark, tmp_path, monkeypatch):
    """F8: a file was one value of one row, which ends at 2 GB."""
    import hashlib
    import random

    from segrec.sources import scan

    monkeypatch.setattr(scan, "WHOLE", 5000)
    most = spark.conf.get("spark.sql.sources.binaryFile.maxLength")
    rng = random.Random(8)
    data = {"a b+c%.parquet": rng.randbytes(300_000), "lines": b"\n\n\r\nx\r" * 1200 + b"\n", "none": bytes(6000), "mark": b"\xef\xbb\xbf" + rng.randbytes(6000) + b"\n", "small": b"s", "packed.gz": rng.randbytes(2000), "in/deep.parquet": rng.randbytes(70_000)}
    folder = tmp_path / "set"
    for name, value in data.items():
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_bytes(value)
    bar = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")  # many splits
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "5000")  # as 2 GB are by default
    try:
        found = {r["file"]: (r["sha256"], r["bytes"]) for r in scan.checksums(spark, str(folder)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", bar)
        spark.conf.set("spark.sql.sources.binaryFile.maxLength", most)
    assert found == {n: (hashlib.sha256(v).hexdigest(), len(v)) for n, v in data.items()}
