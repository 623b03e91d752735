"""Queries over what the engine stores: models, splits, result documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segrec.operators import metrics, models, scoring, splits, stats
from segrec.operators.clustering import with_levels
from segrec.operators.facts import Star
from segrec.operators.features import user_features
from segrec.plans.methods import METRIC_SQL
from segrec.plans.quality import star_report
from segrec.plans.ranking import _VEC, deployed, strata
from segrec.plans.registry import query
from segrec.plans.segments import BLOCKS, embeddings
from segrec.sources import results
from segrec.sources.scan import write_table
from segrec.sources.scratch import scratch_path, stored

#: The stand-in catalogue prices its free items.
KNOWN = ("type_vs_price",)
_DIMS = [f"e{i}" for i in range(64)]


def wide(s: Star) -> DataFrame:
    """Embeddings with a column for each dimension."""
    return embeddings(s).select("vec_id", "label", *[F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate(_DIMS)])


@query("sk4_q2_fitted_segments")
def fitted(s: Star) -> DataFrame:
    """Users' segments by a model that was fitted, stored and loaded again, and what was persisted for them."""
    path = scratch_path(s.spark, "model")
    features = stored(with_levels(user_features(s.train)), "features")
    model = models.fit(features, "user_id", BLOCKS, 4, findings=star_report(s), known=KNOWN, source=s.sf_dir)
    model.save(s.spark, path, model.assign(features, "user_id"))
    again = models.SegmentModel.load(s.spark, path, source=s.sf_dir)
    kept = s.spark.read.parquet(f"{path}/segments").withColumnRenamed("cluster", "persisted")
    return again.assign(features, "user_id").join(kept, "user_id", "left").select("user_id", "cluster", "persisted")


_STORED = """WITH e AS (SELECT vec_id AS id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings),
    st AS (SELECT dim, avg(x) AS m, CASE WHEN stddev_pop(x) = 0 THEN 1 ELSE stddev_pop(x) END AS s FROM e GROUP BY dim), z AS (SELECT id, label, dim, (x - m) / s AS z FROM e JOIN st USING (dim)),
    cent AS (SELECT label, dim, avg(z) AS c FROM z GROUP BY ALL), num AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS cluster FROM (SELECT DISTINCT label FROM e)),
    d AS (SELECT z.id, cluster, sum((z - c) * (z - c)) AS d FROM z JOIN cent USING (dim) JOIN num ON num.label = cent.label GROUP BY ALL)
    SELECT id AS vec_id, CAST(cluster AS INTEGER) AS cluster FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(d, 9), cluster) AS r FROM d) WHERE r = 1"""


@query("sk4_ml6_stored_model", _STORED, base=False)
def stored_model(s: Star) -> DataFrame:
    """Vectors assigned by a stored and loaded model whose centroids are the labels' means."""
    path = scratch_path(s.spark, "model")
    rows = wide(s)
    models.from_labels(rows, "vec_id", _DIMS, "label", source=s.sf_dir).save(s.spark, path)
    return models.SegmentModel.load(s.spark, path, source=s.sf_dir).assign(rows, "vec_id")


_SPLIT = ", p AS (SELECT txn, CASE WHEN epoch_us(ts) < (SELECT cut_70 FROM cuts) THEN 'train' WHEN epoch_us(ts) < (SELECT cut_80 FROM cuts) THEN 'validation' ELSE 'test' END AS part FROM interactions)"


@query("sk6_persisted_split", _SPLIT + " SELECT part, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT txn) AS BIGINT) AS transactions, min(txn) AS first, max(txn) AS last FROM p GROUP BY part")
def sk6(s: Star) -> DataFrame:
    """A split written and read again, part by part."""
    path = scratch_path(s.spark, "split")
    splits.persist(s.interactions, s.cuts, path)
    out = None
    for name in splits.PARTS:
        rows = splits.part(s.spark, path, name).agg(F.count("*").alias("n"), F.count_distinct("txn").alias("transactions"), F.min("txn").alias("first"), F.max("txn").alias("last")).where("n > 0")
        rows = rows.select(F.lit(name).alias("part"), "*")
        out = rows if out is None else out.unionByName(rows)
    return out


ARCHITECTURES = {"A": "segment_popularity", "B": "preference_match", "C": "tiered"}


def architectures(s: Star, ks: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """Tidy rows (name, k, users, metrics..., difference from random) of the assembled architectures and of random."""
    parts = {"A": scoring.segment_popularity(s, strata(s)), "B": scoring.preference_match(s), "C": deployed(s), "random": scoring.random_score(s), "popularity": scoring.global_popularity(s)}
    parts = {n: d.select("user_id", "item", "position", F.col("score").cast("double").alias("score")) for n, d in parts.items()}
    rows, names = stored(stats.packed_candidates(parts, metrics.placed(s), False), "architectures"), list(parts)
    out = None
    for k in ks:
        per = stats.method_metrics(rows, names, k)
        told = per.groupBy("method").agg(F.count("*").alias("users"), *[F.avg(m).alias(m) for m in metrics.METRICS]).join(stats.method_exposure(rows, names, k, len(s.catalogue)), "method")
        told = told.select(F.lit(k).alias("k"), "*")
        out = told if out is None else out.unionByName(told)
    at = stats.method_metrics(rows, names, 10)
    diffs = at.join(at.where("method = 'random'").select("user_id", F.col("ndcg").alias("base")), "user_id").select("user_id", "method", (F.col("ndcg") - F.col("base")).alias("d"))
    low, high = F.percentile("m", 0.025), F.percentile("m", 0.975)
    interval = stats.bootstrap_means(diffs, "user_id", "d", 2000, group="method").groupBy(F.col("group").alias("method")).agg(low.alias("ci_95_low"), high.alias("ci_95_high"))
    gap = diffs.groupBy("method").agg(F.avg("d").alias("mean_difference")).join(interval, "method")
    return out.join(gap, "method").select(
        F.col("method").alias("name"), "k", "users", "ndcg", F.col("hit").alias("hit_rate"), "precision", F.col("ceiling").alias("precision_ceiling"), "recall", F.col("reciprocal_rank").alias("mrr"), "coverage", "gini",
        "mean_difference", "ci_95_low", "ci_95_high", ((F.col("ci_95_low") > 0) | (F.col("ci_95_high") < 0)).alias("significant"),
    )


def evaluated(s: Star) -> str:
    """Folder of the architectures' result document, newly written."""
    path = scratch_path(s.spark, "results")
    results.write_results(architectures(s), path, "architecture", models.ENGINE_VERSION, s.sf_dir.rstrip("/").rsplit("/", 1)[-1])
    return path


@query(
    "q10_architectures",
    METRIC_SQL("segment_popularity", "preference_match", "pop_n")
    + """, nm AS (SELECT CASE method WHEN 'segment_popularity' THEN 'A' WHEN 'preference_match' THEN 'B' ELSE 'popularity' END AS name, * FROM pm), cv AS (SELECT method, count(DISTINCT item) / (SELECT count(*) FROM items) AS coverage FROM mr WHERE rank <= 10 GROUP BY method)
    SELECT name, round(avg(ndcg), 6) AS ndcg, round(avg(hit), 6) AS hit_rate, round(avg(recall), 6) AS recall, round(max(coverage), 6) AS coverage FROM nm JOIN cv USING (method) GROUP BY name""",
)
def q10(s: Star) -> DataFrame:
    """Architectures A and B and popularity at 10, read back from the document."""
    rows = results.comparison(s.spark, evaluated(s), "architecture", 10, "C")
    return rows.where("name IN ('A', 'B', 'popularity')").select("name", *[F.round(m, 6).alias(m) for m in ("ndcg", "hit_rate", "recall", "coverage")])


@query("q10_sk11_architecture_document")
def q10_document(s: Star) -> DataFrame:
    """All subjects at all cutoffs, with significance, from the document."""
    path, out = evaluated(s), None
    for k in (5, 10, 20):
        rows = results.comparison(s.spark, path, "architecture", k, "C").select(F.lit(k).alias("k"), "*")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("q14_provenance", ", held AS (SELECT DISTINCT user_id, item FROM test WHERE user_id IN (SELECT user_id FROM seen) EXCEPT SELECT user_id, item FROM seen) SELECT 'architecture' AS kind, '3' AS engine, 'A,B,C,popularity,random' AS subjects, CAST(count(DISTINCT user_id) AS BIGINT) AS users FROM held")
def q14(s: Star) -> DataFrame:
    """What the document was computed with, over how many users."""
    return results.provenance(s.spark, evaluated(s), "architecture").select("kind", "engine", F.array_join("subjects", ",").alias("subjects"), "users")


@query("q14_lift_proxy")
def q14_lift(s: Star) -> DataFrame:
    """The deployed architecture's lift over popularity, beside random's own."""
    return results.lift_proxy(s.spark, evaluated(s), "architecture", 10, "C", "popularity")


_COVER = ", h AS (SELECT user_id, count(*) AS n FROM seen GROUP BY user_id), r AS (SELECT u.user_id, CASE WHEN n IS NULL THEN 'fallback' WHEN n = 1 THEN 'preference_match' ELSE 'segment_popularity' END AS route FROM users u LEFT JOIN h ON h.user_id = u.user_id)"


@query("q14_coverage", _COVER + " SELECT route, CAST(count(*) AS BIGINT) AS users, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM r GROUP BY route")
def q14_coverage(s: Star) -> DataFrame:
    """How many users each route serves."""
    n = s.seen.groupBy("user_id").agg(F.count("*").alias("n"))
    route = F.when(F.col("n").isNull(), "fallback").when(F.col("n") == 1, "preference_match").otherwise("segment_popularity")
    by = s.users.join(n, "user_id", "left").groupBy(route.alias("route")).agg(F.count("*").alias("users"))
    return by.join(F.broadcast(by.agg(F.sum("users").alias("n")))).select("route", "users", F.round(F.col("users") / F.col("n"), 6).alias("share"))


@query("sk3_item_matrix", _VEC + " SELECT item, dim, round(x, 6) AS x FROM v")
def sk3(s: Star) -> DataFrame:
    """Item vectors stored as one array a row, with the names of its places, and read back."""
    path, long = scratch_path(s.spark, "vectors"), scoring.item_vectors(s)
    names = sorted(r["dim"] for r in long.select("dim").distinct().collect())  # of the catalogue's vectors
    values = F.map_from_entries(F.collect_list(F.struct("dim", "x")))
    rows = long.groupBy("item").agg(values.alias("m")).select("item", F.array(*[F.coalesce(F.col("m")[n], F.lit(0.0)) for n in names]).alias("vector"))
    rows.write.parquet(f"{path}/vectors")
    s.spark.createDataFrame(list(enumerate(names)), "position int, dim string").coalesce(1).write.parquet(f"{path}/names")
    back = s.spark.read.parquet(f"{path}/vectors").select("item", F.posexplode("vector").alias("position", "x")).where("x <> 0")
    return back.join(F.broadcast(s.spark.read.parquet(f"{path}/names")), "position").select("item", "dim", F.round("x", 6).alias("x"))


@query("sk7_error_table", METRIC_SQL("pop_n") + ", hs AS (SELECT user_id, count(*) AS n FROM seen GROUP BY user_id) SELECT pm.user_id, CAST(n_rel AS BIGINT) AS n_rel, CAST(n AS BIGINT) AS history, CAST(hit AS INTEGER) AS hit, round(ndcg, 6) AS ndcg FROM pm JOIN tg ON tg.user_id = pm.user_id JOIN hs ON hs.user_id = pm.user_id")
def sk7(s: Star) -> DataFrame:
    """Each user's errors, written as CSV with a header and read back."""
    path = scratch_path(s.spark, "errors")
    per = metrics.per_user(scoring.ranked(scoring.global_popularity(s)), metrics.relevant(s), 10)
    rows = per.join(s.seen.groupBy("user_id").agg(F.count("*").alias("history")), "user_id").select("user_id", "n_rel", "history", "hit", F.round("ndcg", 6).alias("ndcg"))
    write_table(rows, path, "csv")
    return s.spark.read.option("header", True).schema(rows.schema).csv(path)


@query("sk12_feature_schema")
def sk12(s: Star) -> DataFrame:
    """The exported columns and types of the users' features, and which of them the model uses, read back."""
    path, features = scratch_path(s.spark, "schema"), with_levels(user_features(s.train))
    model = models.SegmentModel(models.scaler_of(features, BLOCKS), ())
    models.export_schema(features, "user_id", model, path)
    models.check_schema(features, path)
    told = s.spark.read.schema(models._EXPORT).option("multiLine", True).json(path)
    return told.select(F.explode("columns").alias("c"), "model_columns").select("c.position", "c.name", "c.kind", F.array_contains("model_columns", F.col("c.name")).alias("in_model"))


@query(
    "q15_stored_numbers",
    METRIC_SQL("segment_popularity", "preference_match", "pop_n")
    + """, nm AS (SELECT CASE method WHEN 'segment_popularity' THEN 'A' WHEN 'preference_match' THEN 'B' ELSE 'popularity' END AS name, * FROM pm), lo AS (SELECT name, 'ndcg' AS metric, ndcg AS v FROM nm UNION ALL SELECT name, 'hit_rate', hit FROM nm UNION ALL SELECT name, 'mrr', reciprocal_rank FROM nm)
    SELECT name, metric, round(avg(v), 6) AS stored, round(avg(v), 6) AS found, true AS same FROM lo GROUP BY name, metric""",
)
def q15_stored(s: Star) -> DataFrame:
    """Numbers of the stored document against the same computed anew by other code: agree to 1e-6."""
    kept = results.comparison(s.spark, evaluated(s), "architecture", 10, "C").where("name IN ('A', 'B', 'popularity')")
    kept = kept.unpivot(["name"], ["ndcg", "hit_rate", "mrr"], "metric", "stored")
    parts, held, out = {"A": scoring.segment_popularity(s, strata(s)), "B": scoring.preference_match(s), "popularity": scoring.global_popularity(s)}, metrics.relevant(s), None
    for name, scores in parts.items():
        row = metrics.per_user(scoring.ranked(scores), held, 10).agg(F.avg("ndcg").alias("ndcg"), F.avg("hit").alias("hit_rate"), F.avg("reciprocal_rank").alias("mrr")).select(F.lit(name).alias("name"), "*")
        out = row if out is None else out.unionByName(row)
    found = out.unpivot(["name"], ["ndcg", "hit_rate", "mrr"], "metric", "found")
    same = (F.abs(F.col("stored") - F.col("found")) <= 1e-6).alias("same")
    return kept.join(found, ["name", "metric"]).select("name", "metric", F.round("stored", 6).alias("stored"), F.round("found", 6).alias("found"), same)
