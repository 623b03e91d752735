"""What the engine stores: models, splits and result documents, read back in full and refused when they don't fit."""

import json
import os

import duckdb
import pytest
from pyspark.ml.clustering import KMeansModel
from pyspark.sql import functions as F

from segrec import catalog
from segrec.operators import clustering, facts, models, quality, splits
from segrec.operators.facts import Star
from segrec.operators.features import user_features
from segrec.plans import stores
from segrec.plans.segments import BLOCKS
from segrec.sources import results, scratch
from segrec.sources.scan import IntegrityError


@pytest.fixture(scope="module")
def star(spark, sf):
    return Star(spark, sf)


@pytest.fixture(scope="module")
def features(star):
    return clustering.with_levels(user_features(star.train)).persist()


@pytest.fixture(scope="module")
def model(features):
    return models.fit(features, "user_id", BLOCKS, 3, source="here", n_init=2)


def clusters(df):
    return {r["user_id"]: r["cluster"] for r in df.collect()}


@pytest.fixture(scope="module")
def stored(spark, features, model, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("models") / "m")
    model.save(spark, path, model.assign(features, "user_id"))
    return path


def test_a_loaded_model_assigns_as_the_fitted_one(spark, features, model, stored):
    again = models.SegmentModel.load(spark, stored, source="here")
    before = clusters(model.assign(features, "user_id"))
    assert clusters(again.assign(features, "user_id")) == before and again.columns == [c for b in BLOCKS.values() for c in b]
    by_spark = KMeansModel.load(f"{stored}/clusterer").transform(clustering._vectors(again.vectors(features, "user_id"), "vector"))
    assert clusters(by_spark.select("user_id", "cluster")) == before
    user, cluster = next(iter(before.items()))
    assert models.segment_of(spark, stored, user) == cluster and models.segment_of(spark, stored, -1) is None


def test_segments_equal_sql_over_the_stored_centroids(features, model, stored, tmp_path):
    features.write.parquet(str(tmp_path / "f"))
    columns = ", ".join(model.columns)
    rows = duckdb.sql(f"""
        WITH l AS (UNPIVOT (SELECT user_id, {", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in model.columns)} FROM '{tmp_path}/f/*.parquet') ON {columns} INTO NAME "column" VALUE x),
        z AS (SELECT user_id, position, (x - centre) / scale * weight AS z FROM l JOIN '{stored}/scaler/*.parquet' s ON s."column" = l."column"),
        d AS (SELECT user_id, cluster, sum((z - c) * (z - c)) AS d FROM z JOIN '{stored}/centroids/*.parquet' k ON k.position = z.position GROUP BY ALL)
        SELECT user_id, arg_min(cluster, round(d, 9)) FROM d GROUP BY user_id""").fetchall()
    assert dict(rows) == clusters(model.assign(features, "user_id"))


def test_a_newcomer_is_scaled_by_the_training_population(spark, features, model):
    user = features.first()["user_id"]
    alone = features.where(F.col("user_id") == user)
    assert clusters(model.assign(alone, "user_id"))[user] == clusters(model.assign(features, "user_id"))[user]


def test_other_columns_are_refused(spark, features, model):
    rows = features.select("user_id", F.array(*[F.col(c).cast("double") for c in model.columns]).alias("x"))
    assert clusters(model.assign_matrix(rows, "user_id", "x", model.columns)) == clusters(model.assign(features, "user_id"))
    for columns in ([*model.columns[1:], model.columns[0]], model.columns[:-1], [*model.columns, "more"]):
        with pytest.raises(models.ColumnOrderError):
            model.assign_matrix(rows, "user_id", "x", columns)
    with pytest.raises(models.ColumnOrderError):
        model.assign(features.drop(model.columns[3]), "user_id")


@pytest.mark.parametrize("kind", ["engine", "schema", "spark", "source"])
def test_a_mismatch_is_refused_by_kind(spark, model, tmp_path, kind):
    path = str(tmp_path / "m")
    model.save(spark, path)
    part = next((tmp_path / "m" / "manifest").glob("part-*"))
    told = json.loads(part.read_text()) | {kind: "0.1"}
    spark.createDataFrame([told], models._MANIFEST).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    with pytest.raises(models.VersionError) as error:
        models.SegmentModel.load(spark, path, source="here")
    assert error.value.kinds == (kind,)
    lenient = models.SegmentModel.load(spark, path, source="here", strict=False)
    assert len(lenient.problems) == 1 and lenient.problems[0].startswith(kind)


def test_a_changed_or_lost_file_is_found(spark, model, tmp_path):
    model.save(spark, str(tmp_path / "m"))
    victim = next((tmp_path / "m" / "centroids").glob("part-*.parquet"))
    (victim.parent / f".{victim.name}.crc").unlink()
    victim.write_bytes(victim.read_bytes() + b"x")
    with pytest.raises(IntegrityError, match="changed"):
        models.SegmentModel.load(spark, str(tmp_path / "m"))
    victim.unlink()
    with pytest.raises(IntegrityError, match="missing"):
        models.SegmentModel.load(spark, str(tmp_path / "m"))


def test_artifact_sets_are_told_apart_by_what_is_in_them(spark, model, tmp_path):
    one, two = model.save(spark, str(tmp_path / "a")), models.SegmentModel(model.scaler, model.centroids[::-1], "here").save(spark, str(tmp_path / "b"))
    assert one["artifact_set"] != two["artifact_set"] and len(one["artifact_set"]) == 12


def test_robust_and_weighted_scalers(spark):
    df = spark.createDataFrame([(i, float(i), 5.0, float(i * i)) for i in range(9)], "k int, a double, b double, c double")
    scaler = models.scaler_of(df, {"x": ["a", "b"], "y": ["c"]}, robust=True, weighted=True)
    assert scaler[0] == ("a", 4.0, 4.0, pytest.approx(2**-0.5)) and scaler[1][1:3] == (5.0, 1.0) and scaler[2][3] == 1.0


def test_errors_in_the_tables_stop_training(spark, sf, star, features):
    assert quality.require_clean(stores.star_report(star), stores.KNOWN) is None
    broken = Star(spark, sf)
    table = broken.table
    broken.table = lambda name: table(name).withColumn("c_nationkey", F.lit(99)) if name == "customer" else table(name)
    with pytest.raises(ValueError, match="range_above"):
        models.fit(features, "user_id", BLOCKS, 3, findings=stores.star_report(broken), known=stores.KNOWN)


# ---- splits


def test_a_stored_split_is_the_split(spark, star, tmp_path):
    path = str(tmp_path / "s")
    splits.persist(star.interactions, star.cuts, path)
    told = splits.metadata(spark, path).first()
    assert (told["first_cut"], told["second_cut"]) == star.cuts
    for name in splits.PARTS:
        assert told["rows"][name] == splits.part(spark, path, name).count()
    assert splits.restored(star.interactions, path, "test").exceptAll(star.test).count() == 0 and splits.restored(star.interactions, path, "test").count() == star.test.count()
    plan = splits.part(spark, path, "validation")._jdf.queryExecution().executedPlan().toString()
    assert "part#" in plan.split("PartitionFilters", 1)[1].split("]", 1)[0] and "part=validation" not in plan.split("PartitionFilters")[0]
    with pytest.raises(ValueError):
        splits.part(spark, path, "other")


# ---- documents

METRIC_ROW = dict(ndcg=0.1, hit_rate=0.2, precision=0.3, precision_ceiling=0.4, recall=0.5, mrr=0.6, coverage=0.7, gini=None)


def test_documents_round_trip_as_tidy_frames(spark, tmp_path):
    path = str(tmp_path / "r")
    rows = [dict(name=n, k=k, users=7, **(METRIC_ROW | {"hit_rate": h * k}), mean_difference=h - 0.1, ci_95_low=-0.1, ci_95_high=0.2, significant=None) for n, h in (("random", 0.1), ("popularity", 0.2), ("C", 0.3)) for k in (5, 10)]
    kinds = "name string, k int, users bigint, " + ", ".join(f"{m} double" for m in results.METRICS) + ", mean_difference double, ci_95_low double, ci_95_high double, significant boolean"
    results.write_results(spark.createDataFrame([tuple(r.values()) for r in rows], kinds), path, "architecture", "e", "s")
    found = {r["name"]: r for r in results.comparison(spark, path, "architecture", 10, "C").collect()}
    assert found["C"]["hit_rate"] == pytest.approx(3.0) and found["C"]["is_deployed"] and not found["C"]["significant"] and found["random"]["is_reference"] and found["C"]["gini"] is None
    assert results.comparison(spark, path, "architecture", 20, "C").count() == 0
    told = results.provenance(spark, path, "architecture").first()
    assert (told["engine"], told["source"], told["users"], told["subjects"]) == ("e", "s", 7, ["C", "popularity", "random"])
    lift = results.lift_proxy(spark, path, "architecture", 10, "C", "popularity").first()
    assert (lift["deployed"], lift["reference"]) == (pytest.approx(1.5), pytest.approx(0.5))
    assert results.available(spark, path, ("architecture", "audit")) == {"architecture": True, "audit": False}
    with pytest.raises(results.MissingResults):
        results.read_documents(spark, path, "audit")


# ---- tables written once for a star


def test_base_tables_are_joined_once_for_a_star(spark, sf, monkeypatch):
    names, write = [], facts.stored
    monkeypatch.setattr(facts, "stored", lambda df, name: names.append(name) or write(df, name))
    plan = catalog.QUERIES["q1_recommend"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(names) == ["interactions", "seen"]
    assert "l_orderkey" not in plan and "o_orderkey" not in plan


def test_written_tables_are_cleared(spark, monkeypatch):
    monkeypatch.setattr(scratch, "_written", [])
    rows = scratch.stored(spark.range(3), "three")
    assert rows.count() == 3
    path = scratch._written[0]
    assert os.path.isdir(path) and scratch.clear(spark) == 1 and not os.path.exists(path) and scratch.clear(spark) == 0
