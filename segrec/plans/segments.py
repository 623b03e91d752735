"""Queries over representations, clusterings and segment profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segrec.operators import clustering, features
from segrec.operators.facts import CATEGORIES, Star
from segrec.plans.registry import query
from segrec.sources.scratch import stored

NUMERIC = ["total_courses", "diversity_score", "frequency", "avg_rating", "depth_index", "free_ratio", "recency_days", "loyalty"]
BLOCKS = {"behaviour": NUMERIC, "category": [f"share_{c}" for c in CATEGORIES], "level": ["level_0", "level_1", "level_2"]}
VOCABULARY = {
    "total_courses": ("busy", "occasional"),
    "diversity_score": ("broad", "focused"),
    "depth_index": ("advanced", "beginning"),
    "free_ratio": ("thrifty", "paying"),
    "recency_days": ("lapsed", "recent"),
    "loyalty": ("loyal", "exploring"),
}
#: Numbers of clusters of a sweep.
KS = [2, 3, 4, 5, 6, 7, 8, 9, 10]
_LONG = "WITH e AS (SELECT vec_id AS id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings)"


def embeddings(s: Star) -> DataFrame:
    return s.spark.read.parquet(f"{s.sf_dir}/embeddings.parquet")


def points(s: Star) -> DataFrame:
    return clustering.long_form(embeddings(s), "vec_id", "embedding", "label")


def user_vectors(s: Star) -> DataFrame:
    return clustering.representation(clustering.with_levels(features.user_features(s.train)), BLOCKS)


@query(
    "ml3_scaled_counts",
    ", f AS (SELECT user_id, CAST(count(*) AS DOUBLE) AS n, avg(level) AS depth FROM train GROUP BY user_id) SELECT user_id, round((n - avg(n) OVER ()) / stddev_pop(n) OVER (), 5) AS total_courses, round((depth - avg(depth) OVER ()) / stddev_pop(depth) OVER (), 5) AS depth_index FROM f",
)
def ml3(s: Star) -> DataFrame:
    scaled = clustering.standardised(features.user_features(s.train), ["total_courses", "depth_index"])
    return scaled.select("user_id", F.round("total_courses", 5).alias("total_courses"), F.round("depth_index", 5).alias("depth_index"))


@query(
    "ml3_robust_counts",
    ", f AS (SELECT user_id, CAST(count(*) AS DOUBLE) AS n FROM train GROUP BY user_id), q AS (SELECT median(n) AS m, quantile_cont(n, 0.75) - quantile_cont(n, 0.25) AS s FROM f) SELECT user_id, round((n - m) / CASE WHEN s = 0 THEN 1 ELSE s END, 6) AS total_courses FROM f, q",
)
def ml3_robust(s: Star) -> DataFrame:
    return clustering.standardised(features.user_features(s.train), ["total_courses"], robust=True).select("user_id", F.round("total_courses", 6).alias("total_courses"))


@query("ml1_representation")
def ml1(s: Star) -> DataFrame:
    return user_vectors(s)


@query("ml2_representation_grid")
def ml2(s: Star) -> DataFrame:
    """All arms of the grid clustered and compared."""
    return clustering.grid_comparison(stored(features.user_features(s.train, s.users), "features"))


@query("j20_projection_features")
def j20(s: Star) -> DataFrame:
    f = features.user_features(s.train, s.users)
    return clustering.project(user_vectors(s), "user_id", "vector").join(f.select("user_id", "total_courses", "preferred_category", "stratum"), "user_id", "left")


@query("j21_q11_sweep_with_stability")
def j21(s: Star) -> DataFrame:
    """The k sweep with the stability of each k."""
    return clustering.sweep_with_stability(embeddings(s), "vec_id", "embedding", KS, n_init=10, rounds=100)


@query("ml5_kmeans_segments")
def ml5(s: Star) -> DataFrame:
    rows = user_vectors(s)
    return clustering.predict(clustering.fit_kmeans(rows, "vector", 4), rows, "vector").select("user_id", "cluster")


_CENT = ", cent AS (SELECT label AS cluster, dim, avg(x) AS c FROM e GROUP BY ALL)"


@query("ml6_nearest_centroid", _LONG + _CENT + ", d AS (SELECT id, cluster, sum((x - c) * (x - c)) AS d FROM e JOIN cent USING (dim) GROUP BY ALL) SELECT id, cluster FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(d, 9), cluster) AS r FROM d) WHERE r = 1", base=False)
def ml6(s: Star) -> DataFrame:
    return clustering.assign(points(s), clustering.centroids_of(points(s)))


@query("ml7_k_sweep")
def ml7(s: Star) -> DataFrame:
    return clustering.kmeans_sweep(embeddings(s), "vec_id", "embedding", KS)


@query("ml8_seed_stability")
def ml8(s: Star) -> DataFrame:
    return s.spark.createDataFrame([(4, clustering.seed_stability(embeddings(s), "vec_id", "embedding", 4, [1, 2, 3, 4, 5]))], "k int, ari double")


@query("ml9_hierarchical")
def ml9(s: Star) -> DataFrame:
    return clustering.ward(embeddings(s), "vec_id", "embedding", 4)


@query("ml10_gaussian_mixture")
def ml10(s: Star) -> DataFrame:
    return clustering.gaussian_mixture(embeddings(s), "embedding", [2, 3, 4])


_SIL = (
    ", p AS (SELECT a.id, a.label, b.id AS other, b.label AS o_label, sqrt(sum((a.x - b.x) * (a.x - b.x))) AS d FROM e a JOIN e b ON a.dim = b.dim AND a.id <> b.id GROUP BY ALL), m AS (SELECT id, label, o_label, avg(d) AS mean FROM p GROUP BY ALL), ab AS (SELECT id, label, max(CASE WHEN label = o_label THEN mean END) AS a, min(CASE WHEN label <> o_label THEN mean END) AS b FROM m GROUP BY ALL)"
)


@query("ml11_silhouette", _LONG + _SIL + " SELECT id, label, round(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END, 6) AS silhouette FROM ab", base=False)
def ml11(s: Star) -> DataFrame:
    return clustering.silhouette(embeddings(s), "vec_id", "embedding", "label").select("id", "label", F.round("silhouette", 6).alias("silhouette"))


@query(
    "ml12_calinski_harabasz",
    _LONG + ", per AS (SELECT label, dim, avg(x) AS m, count(*) AS n, var_pop(x) AS v FROM e GROUP BY ALL), t AS (SELECT dim, avg(x) AS g FROM e GROUP BY dim), k AS (SELECT count(DISTINCT id) AS n, count(DISTINCT label) AS k FROM e) SELECT round((sum(per.n * (m - g) * (m - g)) / (max(k.k) - 1)) / (sum(per.n * v) / (max(k.n) - max(k.k))), 5) AS calinski_harabasz FROM per JOIN t USING (dim), k",
    base=False,
)
def ml12(s: Star) -> DataFrame:
    return clustering.calinski_harabasz(points(s)).select(F.round("calinski_harabasz", 5).alias("calinski_harabasz"))


@query(
    "ml12_davies_bouldin",
    _LONG + _CENT + ", sp AS (SELECT label, avg(d) AS s FROM (SELECT id, label, sqrt(sum((x - c) * (x - c))) AS d FROM e JOIN cent ON cluster = label AND cent.dim = e.dim GROUP BY ALL) GROUP BY label), ap AS (SELECT a.cluster AS l, b.cluster AS o, sqrt(sum((a.c - b.c) * (a.c - b.c))) AS d FROM cent a JOIN cent b ON a.dim = b.dim AND a.cluster <> b.cluster GROUP BY ALL), r AS (SELECT l, max((x.s + y.s) / d) AS r FROM ap JOIN sp x ON l = x.label JOIN sp y ON o = y.label GROUP BY l) SELECT round(avg(r), 5) AS davies_bouldin FROM r",
    base=False,
)
def ml12_db(s: Star) -> DataFrame:
    return clustering.davies_bouldin(points(s)).select(F.round("davies_bouldin", 5).alias("davies_bouldin"))


@query(
    "ml13_adjusted_rand",
    "WITH l AS (SELECT label AS a, label % 3 AS b FROM embeddings), c AS (SELECT a, b, count(*) AS n FROM l GROUP BY ALL), i AS (SELECT sum(n * (n - 1) / 2) AS s, sum(n) AS n FROM c), r AS (SELECT sum(n * (n - 1) / 2) AS s FROM (SELECT sum(n) AS n FROM c GROUP BY a)), q AS (SELECT sum(n * (n - 1) / 2) AS s FROM (SELECT sum(n) AS n FROM c GROUP BY b)) SELECT round((i.s - r.s * q.s / (i.n * (i.n - 1) / 2)) / ((r.s + q.s) / 2 - r.s * q.s / (i.n * (i.n - 1) / 2)), 6) AS ari FROM i, r, q",
    base=False,
)
def ml13(s: Star) -> DataFrame:
    rows = embeddings(s).select(F.col("label").alias("a"), (F.col("label") % 3).alias("b"))
    return clustering.adjusted_rand(rows, "a", "b").select(F.round("ari", 6).alias("ari"))


@query(
    "ml14_intra_similarity",
    _LONG + ", u AS (SELECT id, label, dim, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS u FROM e), s AS (SELECT label, dim, sum(u) AS s, sum(u * u) AS q FROM u GROUP BY ALL), n AS (SELECT label, count(DISTINCT id) AS n FROM e GROUP BY label) SELECT label, CAST(n AS BIGINT) AS n, round((sum(s * s) - sum(q)) / (n * (n - 1)), 6) AS similarity FROM s JOIN n USING (label) GROUP BY label, n",
    base=False,
)
def ml14(s: Star) -> DataFrame:
    return clustering.intra_similarity(points(s)).select("label", "n", F.round("similarity", 6).alias("similarity"))


_ETA = ", t AS (SELECT dim, avg(x) AS g, var_pop(x) * count(*) AS t FROM e GROUP BY dim), per AS (SELECT label, dim, avg(x) AS m, count(*) AS n FROM e GROUP BY ALL), eta AS (SELECT dim, sum(n * (m - g) * (m - g)) / max(t) AS eta FROM per JOIN t USING (dim) GROUP BY dim)"


@query("a26_eta_squared", _LONG + _ETA + " SELECT CAST(dim AS INTEGER) AS dim, round(eta, 6) AS eta FROM eta", base=False)
def a26(s: Star) -> DataFrame:
    return clustering.eta_squared(points(s)).select("dim", F.round("eta", 6).alias("eta"))


@query("a27_block_dominance", _LONG + _ETA + ", b AS (SELECT CASE WHEN dim < 16 THEN 'first' WHEN dim < 40 THEN 'second' ELSE 'third' END AS block, avg(eta) AS eta FROM eta GROUP BY 1) SELECT block, round(eta, 6) AS eta, round(eta / sum(eta) OVER (), 6) AS share FROM b", base=False)
def a27(s: Star) -> DataFrame:
    block = F.when(F.col("dim") < 16, "first").when(F.col("dim") < 40, "second").otherwise("third")
    by = clustering.eta_squared(points(s)).groupBy(block.alias("block")).agg(F.avg("eta").alias("eta"))
    total = F.sum("eta").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))  # one row a block
    return by.select("block", F.round("eta", 6).alias("eta"), F.round(F.col("eta") / total, 6).alias("share"))


@query("a28_cluster_sizes", "SELECT label, CAST(count(*) AS BIGINT) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM embeddings GROUP BY label", base=False)
def a28(s: Star) -> DataFrame:
    total = embeddings(s).agg(F.count("*").alias("all_n"))
    by = embeddings(s).groupBy("label").agg(F.count("*").alias("n")).join(F.broadcast(total))
    return by.select("label", "n", F.round(F.col("n") / F.col("all_n"), 6).alias("share"))


_FEAT = ", f AS (SELECT t.user_id, stratum, CAST(count(*) AS DOUBLE) AS total_courses, CAST(count(DISTINCT category) AS DOUBLE) AS diversity_score, avg(level) AS depth_index, avg(is_free) AS free_ratio, balance FROM train t JOIN users u ON t.user_id = u.user_id GROUP BY ALL)"
_SEG = ["total_courses", "diversity_score", "depth_index", "free_ratio"]


def profiled(s: Star) -> DataFrame:
    return features.user_features(s.train, s.users)


@query("a14_segment_profile", _FEAT + " SELECT stratum AS segment, CAST(count(*) AS BIGINT) AS users, round(count(*) / sum(count(*)) OVER (), 6) AS share, " + ", ".join(f"round(avg({c}), 5) AS {c}" for c in _SEG) + ", round(quantile_cont(balance, 0.5), 4) AS median_balance FROM f GROUP BY stratum")
def a14(s: Star) -> DataFrame:
    f = profiled(s)
    total = f.agg(F.count("*").alias("all_n"))
    by = f.groupBy(F.col("stratum").alias("segment")).agg(F.count("*").alias("users"), *[F.round(F.avg(c), 5).alias(c) for c in _SEG], F.round(F.percentile("balance", 0.5), 4).alias("median_balance"))
    return by.join(F.broadcast(total)).withColumn("share", F.round(F.col("users") / F.col("all_n"), 6)).drop("all_n")


@query("a15_centroid_deviations", _FEAT + " , d AS (" + " UNION ALL ".join(f"SELECT stratum AS segment, '{c}' AS feature, (avg({c}) - (SELECT avg({c}) FROM f)) / (SELECT stddev_samp({c}) FROM f) AS deviation FROM f GROUP BY stratum" for c in _SEG) + ") SELECT segment, feature, round(deviation, 5) + 0.0 AS deviation FROM d")
def a15(s: Star) -> DataFrame:
    return clustering.deviations(profiled(s), "stratum", _SEG).select("segment", "feature", (F.round("deviation", 5) + 0.0).alias("deviation"))


@query("a16_segment_category_share", ", p AS (SELECT t.user_id, category, count(*) / sum(count(*)) OVER (PARTITION BY t.user_id) AS p FROM train t GROUP BY t.user_id, category), n AS (SELECT stratum, count(DISTINCT t.user_id) AS n FROM train t JOIN users u ON t.user_id = u.user_id GROUP BY stratum) SELECT u.stratum AS segment, category, round(sum(p.p) / max(n.n), 6) AS share FROM p JOIN users u ON p.user_id = u.user_id JOIN n ON n.stratum = u.stratum GROUP BY u.stratum, category")
def a16(s: Star) -> DataFrame:
    wide = profiled(s).groupBy(F.col("stratum").alias("segment")).agg(*[F.avg(f"share_{c}").alias(c) for c in CATEGORIES])
    return wide.unpivot("segment", list(CATEGORIES), "category", "share").select("segment", "category", F.round("share", 6).alias("share"))


@query("t4_top_categories", ", c AS (SELECT u.stratum AS segment, category, count(*) AS n FROM train t JOIN users u ON t.user_id = u.user_id GROUP BY ALL) SELECT segment, category, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY n DESC, category) AS r FROM c) WHERE r <= 3")
def t4(s: Star) -> DataFrame:
    by = s.train.join(s.users, "user_id").groupBy(F.col("stratum").alias("segment"), "category").agg(F.count("*").alias("n"))
    return by.select("segment", "category", F.row_number().over(Window.partitionBy("segment").orderBy(F.desc("n"), "category")).alias("rank")).where("rank <= 3")


@query("ml15_gap_statistic")
def ml15(s: Star) -> DataFrame:
    """Gaps for k = 1 to 20 over 50 references, the k that they tell, and whether that means no structure."""
    return clustering.gap_choice(clustering.gap_statistic(embeddings(s), "embedding", list(range(1, 21)), 50))


@query("ml16_ml18_bootstrap_stability")
def ml16(s: Star) -> DataFrame:
    return clustering.stability(clustering.bootstrap_jaccard(embeddings(s), "vec_id", "embedding", 3, 100))


@query("ml17_subsample_consensus")
def ml17(s: Star) -> DataFrame:
    return s.spark.createDataFrame([(3, clustering.subsample_consensus(embeddings(s), "vec_id", "embedding", 3, 30))], "k int, ari double")


@query("ml19_t6_choose_k")
def ml19(s: Star) -> DataFrame:
    sweep = clustering.sweep_with_stability(embeddings(s), "vec_id", "embedding", KS, n_init=10, rounds=100)
    return clustering.choose_k(sweep.select("k", F.col("silhouette").alias("quality"), "smallest_share", "unstable"))


@query("ml20_projection")
def ml20(s: Star) -> DataFrame:
    return clustering.project(user_vectors(s), "user_id", "vector")


@query("j17_cluster_match", "WITH c AS (SELECT label AS a, label // 2 AS b, count(*) AS n FROM embeddings GROUP BY ALL), x AS (SELECT *, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb FROM c) SELECT a, round(max(n / (na + nb - n)), 6) AS jaccard FROM x GROUP BY a", base=False)
def j17(s: Star) -> DataFrame:
    e = embeddings(s)
    by = clustering.matched_jaccard(e.select("vec_id", F.col("label").alias("a")), e.select("vec_id", F.floor(F.col("label") / 2).alias("b")), "vec_id")
    return by.select("a", F.round("jaccard", 6).alias("jaccard"))
