"""Comparison of all recommendation methods, and the SQL of their scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segrec.functions.columns import columns_like, numeric_columns, tier
from segrec.functions.quantiles import quantiles
from segrec.operators import clustering, metrics, scoring, stats
from segrec.operators.facts import CATEGORIES, Star
from segrec.operators.features import NUMERIC, user_features
from segrec.plans.ranking import _FALL, _HELD, _PREF, _R8, _SIM, _VEC, WEIGHTS, deployed, strata, top, top_sql
from segrec.plans.registry import query
from segrec.plans.segments import VOCABULARY
from segrec.sources.scratch import stored

#: Features of the users of the training window.
FEATURE_SQL = """, fc AS (SELECT user_id, category, count(*) AS n FROM train WHERE user_id IS NOT NULL GROUP BY ALL),
    fs AS (SELECT user_id, abs(sum(p * log2(p))) AS category_entropy, max(p) AS top_category_share FROM (SELECT user_id, n / sum(n) OVER (PARTITION BY user_id) AS p FROM fc) GROUP BY user_id),
    fl AS (SELECT user_id, level AS preferred_level FROM (SELECT user_id, level, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, level) AS r FROM train GROUP BY user_id, level) WHERE r = 1),
    fp AS (SELECT user_id, category AS preferred_category FROM (SELECT user_id, category, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, category) AS r FROM fc) WHERE r = 1),
    fw AS (SELECT user_id, """ + ", ".join(f"coalesce(sum(n) FILTER (WHERE category = '{c}'), 0) / sum(n) AS share_{c}" for c in CATEGORIES) + """ FROM fc GROUP BY user_id),
    fm AS (SELECT user_id, CAST(count(*) AS BIGINT) AS total_courses, CAST(count(DISTINCT category) AS BIGINT) AS diversity_score, min(epoch_us(ts)) AS first, max(epoch_us(ts)) AS last, max(max(epoch_us(ts))) OVER () AS now, avg(rating) AS avg_rating,
      avg(amount) AS avg_spend, sum(amount) AS total_spend, avg(level) AS depth_index, avg(is_free) AS free_ratio, CAST(count(DISTINCT provider_id) AS BIGINT) AS n_providers FROM train WHERE user_id IS NOT NULL GROUP BY user_id),
    f AS (SELECT fm.user_id, total_courses, diversity_score, preferred_category, preferred_level, avg_rating, avg_spend, total_spend, depth_index, free_ratio, n_providers, total_courses / diversity_score AS avg_per_category,
      CAST((last - first) // 86400000000 AS BIGINT) AS activity_span_days, total_courses / ((last - first) // 86400000000 + 1) AS frequency, diversity_score / total_courses AS diversity_ratio, CAST((now - last) // 86400000000 AS BIGINT) AS recency_days,
      CAST((now - first) // 86400000000 AS BIGINT) AS first_days, 1 - n_providers / total_courses AS loyalty, category_entropy, top_category_share, """ + ", ".join(f"share_{c}" for c in CATEGORIES) + """, balance, stratum
      FROM fm JOIN fs USING (user_id) JOIN fl USING (user_id) JOIN fp USING (user_id) JOIN fw USING (user_id) LEFT JOIN users USING (user_id))"""
_PROFILE = FEATURE_SQL + ", ul AS (" + " UNION ALL ".join(f"SELECT user_id, '{c}' AS dim, CAST({c} AS DOUBLE) AS x FROM f" for c in (*NUMERIC, "balance")) + """),
    uz AS (SELECT user_id, dim, coalesce((x - avg(x) OVER (PARTITION BY dim)) / nullif(stddev_samp(x) OVER (PARTITION BY dim), 0), 0) AS z FROM ul),
    uu AS (SELECT user_id, dim, z / greatest(sqrt(sum(z * z) OVER (PARTITION BY user_id)), 1e-12) AS z FROM uz),"""


_ROUNDED = [*NUMERIC, *[f"share_{c}" for c in CATEGORIES]]


@query("a9_user_features", FEATURE_SQL + " SELECT user_id, preferred_category, preferred_level, stratum, balance, " + ", ".join(f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in _ROUNDED) + " FROM f")
def a9(s: Star) -> DataFrame:
    f = user_features(s.train, s.users)
    return f.select("user_id", "preferred_category", "preferred_level", "stratum", "balance", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in _ROUNDED])


def profile_sql(asked: str = "true") -> str:
    """Frames of the profile neighbours' scores: ``us7`` (user_id, item, s) and ``uw7`` (user_id, w)."""
    return _PROFILE + f"""
    up AS (SELECT a.user_id, b.user_id AS other, round(sum(a.z * b.z), 9) AS sim FROM uu a JOIN uu b ON a.dim = b.dim AND a.user_id <> b.user_id WHERE {asked} GROUP BY ALL),
    un7 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY sim DESC, other) AS r FROM up) WHERE r <= 50),
    us7 AS (SELECT n.user_id, s.item, sum(sim) AS s FROM un7 n JOIN seen s ON n.other = s.user_id GROUP BY ALL), uw7 AS (SELECT user_id, sum(sim) AS w FROM un7 GROUP BY user_id)"""


#: Frame ``comp``: each candidate with the scores of the components that SQL can express; ``held`` and ``tg`` tell what is wanted.
COMPONENT_SQL = (
    _VEC + _SIM + _PREF + _R8 + _HELD + profile_sql() + _FALL.replace(_R8.split(", per AS")[0], "", 1)
    + """, tg AS (SELECT user_id, count(*) AS n_rel FROM held GROUP BY user_id),
    us AS (SELECT user_id, dim, sum(x) AS u FROM seen s JOIN v ON s.item = v.item GROUP BY user_id, dim), un AS (SELECT user_id, sqrt(sum(u * u)) AS u_norm FROM us GROUP BY user_id), il AS (SELECT item, sqrt(sum(x * x)) AS i_norm FROM v GROUP BY item),
    dots AS (SELECT user_id, item, sum(u * x) AS dot FROM us JOIN v ON us.dim = v.dim GROUP BY user_id, item), ii AS (SELECT user_id, b AS item, sum(sim) AS sc FROM seen JOIN sim ON item = a GROUP BY ALL),
    pa AS (SELECT user_id, b.item, sum(n) AS sc FROM (SELECT user_id, provider_id, count(*) AS n FROM train GROUP BY ALL) m JOIN (SELECT DISTINCT item, provider_id FROM train) b ON m.provider_id = b.provider_id GROUP BY ALL),
    comp AS (SELECT c.user_id, c.item, c.position, coalesce(dot / (u_norm * i_norm), 0) AS content_based, CASE WHEN uw7.w > 0 THEN coalesce(us7.s, 0) ELSE 0 END AS user_user_profile,
      CAST(CASE WHEN u.stratum IS NULL THEN coalesce(pop.n, 0) ELSE coalesce(q.n, 0) END AS DOUBLE) AS segment_popularity, i.rating, pref.sc AS preference_match, coalesce(ii.sc, 0) AS item_item,
      coalesce(pop.n, 0) AS pop_n, CAST(coalesce(pa.sc, 0) AS DOUBLE) AS provider_affinity, fall.quality - fall.rk AS diversified_fallback
      FROM candidates c JOIN items i ON c.item = i.item JOIN un ON un.user_id = c.user_id JOIN il ON il.item = c.item LEFT JOIN dots d ON d.user_id = c.user_id AND d.item = c.item
      LEFT JOIN us7 ON us7.user_id = c.user_id AND us7.item = c.item LEFT JOIN uw7 ON uw7.user_id = c.user_id LEFT JOIN users u ON u.user_id = c.user_id LEFT JOIN pop ON pop.item = c.item
      LEFT JOIN per q ON q.stratum = u.stratum AND q.item = c.item JOIN pref ON pref.user_id = c.user_id AND pref.item = c.item LEFT JOIN ii ON ii.user_id = c.user_id AND ii.item = c.item
      LEFT JOIN pa ON pa.user_id = c.user_id AND pa.item = c.item JOIN fall ON fall.item = c.item)"""
)


def _ranked_sql(methods: tuple[str, ...]) -> str:
    """Frame ``mr``: candidates ranked for each user with a held-out item and each method, methods being columns of ``comp``."""
    long = " UNION ALL ".join(f"SELECT '{m}' AS method, user_id, item, position, {m} AS score FROM comp" for m in methods)
    return COMPONENT_SQL + f", ml AS ({long}), mr AS (SELECT method, user_id, item, row_number() OVER (PARTITION BY method, user_id ORDER BY round(score, 9) DESC, position) AS rank FROM ml WHERE user_id IN (SELECT user_id FROM held))"


def _metrics_sql(name: str, k: int) -> str:
    """Frame ``name``: metrics of each user and method at ``k``."""
    return f""", {name}_g AS (SELECT method, r.user_id, count(*) FILTER (WHERE rank <= {k}) AS hits, coalesce(sum(CASE WHEN rank <= {k} THEN 1 / log2(rank + 1) END), 0) AS dcg, min(rank) AS first FROM mr r JOIN held h ON h.user_id = r.user_id AND h.item = r.item GROUP BY ALL),
    {name} AS (SELECT method, user_id, hits / {k} AS "precision", least(n_rel, {k}) / {k} AS ceiling, hits / n_rel AS recall, CASE WHEN hits > 0 THEN 1 ELSE 0 END AS hit,
      dcg / list_sum(list_transform(range(1, CAST(least(n_rel, {k}) AS BIGINT) + 1), lambda i: 1 / log2(i + 1))) AS ndcg, 1 / first AS reciprocal_rank FROM {name}_g JOIN tg USING (user_id))"""


def METRIC_SQL(*methods: str) -> str:
    """Frame ``pm``: metrics of each user and method at 10."""
    return _ranked_sql(methods) + _metrics_sql("pm", 10)


_R7 = top_sql("CASE WHEN w > 0 THEN coalesce(s, 0) ELSE 0 END", "candidates c LEFT JOIN us7 d ON d.user_id = c.user_id AND d.item = c.item LEFT JOIN uw7 w ON w.user_id = c.user_id")


@query("r7_user_user_profile", profile_sql() + _R7)
def r7(s: Star) -> DataFrame:
    """All users against all users."""
    return top(scoring.user_user_profile(s, user_features(s.train, s.users), [*NUMERIC, "balance"]))


def all_methods(s: Star) -> dict[str, DataFrame]:
    """Scores of every method that is compared, by name."""
    f = user_features(s.train, s.users)
    return {
        "random": scoring.random_score(s), "global_popularity": scoring.global_popularity(s), "rating": scoring.rating(s), "content_based": scoring.content_based(s), "item_item": scoring.item_item(s),
        "user_user_history": scoring.user_user_history(s), "user_user_profile": scoring.user_user_profile(s, f, [*NUMERIC, "balance"]), "segment_popularity": scoring.segment_popularity(s, strata(s)),
        "provider_affinity": scoring.provider_affinity(s), "diversified_fallback": scoring.diversified_fallback(s), "preference_match": scoring.preference_match(s),
        "hybrid": scoring.hybrid({"popularity": scoring.global_popularity(s), "preference": scoring.preference_match(s), "rating": scoring.rating(s)}, WEIGHTS), "tiered": deployed(s),
    }


def comparison(s: Star, k: int = 10, replicates: int = 2000, reference: str = "random") -> DataFrame:
    """Q7: a row for every method: mean metrics, exposure, and the bootstrapped difference in NDCG from random."""
    methods = {n: rows.select("user_id", "item", "position", F.col("score").cast("double").alias("score")) for n, rows in all_methods(s).items()}
    rows = stored(stats.packed_candidates(methods, metrics.placed(s), False), "methods")
    names = list(methods)
    per = stats.method_metrics(rows, names, k)
    means = per.groupBy("method").agg(F.count("*").alias("users"), *[F.avg(m).alias(m) for m in metrics.METRICS])
    base = per.where(F.col("method") == reference).select("user_id", F.col("ndcg").alias("base"))
    diffs = per.join(base, "user_id").select("user_id", "method", (F.col("ndcg") - F.col("base")).alias("d"))
    each = stats.bootstrap_means(diffs, "user_id", "d", replicates, group="method")
    interval = each.groupBy(F.col("group").alias("method")).agg(F.percentile("m", 0.025).alias("ci_low"), F.percentile("m", 0.975).alias("ci_high"))
    gap = diffs.groupBy("method").agg(F.avg("d").alias("vs_random"))
    significant = ((F.col("ci_low") > 0) | (F.col("ci_high") < 0)).alias("significant")
    told = means.join(stats.method_exposure(rows, names, k, len(s.catalogue)), "method").join(gap, "method").join(interval, "method")
    lift = F.col("hit") / F.max(F.when(F.col("method") == "global_popularity", F.col("hit"))).over(Window.partitionBy())  # a row a method
    return told.select("*", significant, (F.col("method") == reference).alias("is_reference"), (F.col("method") == "tiered").alias("is_deployed"), lift.alias("lift_proxy"))


@query("q7_method_comparison")
def q7_comparison(s: Star) -> DataFrame:
    return comparison(s)


_TOLD = ["global_popularity", "rating", "content_based", "item_item", "user_user_profile", "segment_popularity", "provider_affinity", "diversified_fallback", "preference_match"]


@query(
    "q7_method_quality",
    METRIC_SQL(*["pop_n" if m == "global_popularity" else m for m in _TOLD])
    + ", shown AS (SELECT method, item, count(*) AS n FROM mr WHERE rank <= 10 GROUP BY ALL), ex AS (SELECT method, count(*) / (SELECT count(*) FROM items) AS coverage FROM shown GROUP BY method) SELECT CASE method WHEN 'pop_n' THEN 'global_popularity' ELSE method END AS method, CAST(count(*) AS BIGINT) AS users, "
    + ", ".join(f'round(avg("{m}"), 6) AS "{m}"' for m in metrics.METRICS)
    + ", round(max(coverage), 6) AS coverage FROM pm JOIN ex USING (method) GROUP BY method",
)
def q7_quality(s: Star) -> DataFrame:
    """The comparison's figures that don't depend on draws."""
    methods = {n: rows.select("user_id", "item", "position", F.col("score").cast("double").alias("score")) for n, rows in all_methods(s).items() if n in _TOLD}
    rows = stored(stats.packed_candidates(methods, metrics.placed(s), False), "methods")
    means = stats.method_metrics(rows, list(methods), 10).groupBy("method").agg(F.count("*").alias("users"), *[F.round(F.avg(m), 6).alias(m) for m in metrics.METRICS])
    exposure = stats.method_exposure(rows, list(methods), 10, len(s.catalogue))
    return means.join(exposure.select("method", F.round("coverage", 6).alias("coverage")), "method")


_MEANS = [*NUMERIC, "balance"]


@query("p9_numeric_means", FEATURE_SQL + " " + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(avg({c}), 6) AS mean FROM f" for c in ["preferred_level", *NUMERIC, *[f"share_{c}" for c in CATEGORIES], "balance"]))
def p9(s: Star) -> DataFrame:
    """Means of all columns of numeric types, whichever these are."""
    f = user_features(s.train, s.users)
    names = numeric_columns(f, ("user_id",))
    wide = f.agg(*[F.round(F.avg(c), 6).alias(c) for c in names])
    return wide.unpivot([], names, "feature", "mean")


@query("p9_share_totals", FEATURE_SQL + " SELECT user_id, round(" + " + ".join(f"share_{c}" for c in CATEGORIES) + ", 6) AS total FROM f")
def p9_shares(s: Star) -> DataFrame:
    f = user_features(s.train)
    return f.select("user_id", F.round(sum((F.col(c) for c in columns_like(f, "share_*")), F.lit(0.0)), 6).alias("total"))


_TIER = "CASE WHEN n = 1 THEN 'minimal' WHEN n <= 8 THEN 'moderate' ELSE 'rich' END"


def tiers(s: Star) -> DataFrame:
    return s.seen.groupBy("user_id").agg(F.count("*").alias("n")).select("user_id", tier(F.col("n")).alias("tier"))


@query("p10_pool", f", h AS (SELECT user_id, count(*) AS n FROM seen GROUP BY user_id) SELECT user_id, {_TIER} AS tier, stratum AS segment FROM h JOIN users USING (user_id) WHERE stratum IN ('BUILDING', 'MACHINERY') AND n BETWEEN 2 AND 8")
def p10(s: Star) -> DataFrame:
    """The pool of users of two segments and one tier."""
    return tiers(s).where("tier = 'moderate'").join(strata(s).where("segment IN ('BUILDING', 'MACHINERY')"), "user_id")


@query(
    "a14_full_profile",
    FEATURE_SQL
    + ", tc AS (SELECT stratum, category, row_number() OVER (PARTITION BY stratum ORDER BY count(*) DESC, category) AS r FROM train JOIN users USING (user_id) GROUP BY stratum, category), ts AS (SELECT stratum, string_agg(category, ', ' ORDER BY r) AS top_categories FROM tc WHERE r <= 3 GROUP BY stratum) SELECT f.stratum AS segment, CAST(count(*) AS BIGINT) AS users, "
    + ", ".join(f"round(avg({c}), 5) AS {c}" for c in _MEANS)
    + ", round(quantile_cont(balance, 0.5), 4) AS median_balance, any_value(top_categories) AS top_categories FROM f JOIN ts ON ts.stratum = f.stratum GROUP BY f.stratum",
)
def a14_full(s: Star) -> DataFrame:
    """Every mean of a segment, its exact median balance, its first three categories."""
    f = stored(user_features(s.train, s.users).where("stratum IS NOT NULL").withColumnRenamed("stratum", "segment"), "features")
    means = f.groupBy("segment").agg(F.count("*").alias("users"), *[F.round(F.avg(c), 5).alias(c) for c in _MEANS])
    medians = quantiles(f.select(F.col("segment").alias("name"), F.col("balance").alias("x")), [0.5])
    table = s.spark.createDataFrame([(n, round(v[0], 4)) for n, v in medians.items()], "segment string, median_balance double")
    by = s.train.join(strata(s), "user_id").groupBy("segment", "category").agg(F.count("*").alias("k"))
    first = by.withColumn("r", F.row_number().over(Window.partitionBy("segment").orderBy(F.desc("k"), "category"))).where("r <= 3").groupBy("segment")
    tops = first.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "category"))), lambda e: e["category"]), ", ").alias("top_categories"))
    return means.join(F.broadcast(table), "segment").join(F.broadcast(tops), "segment")  # a row a segment


@query(
    "ml21_segment_names",
    FEATURE_SQL
    + f", g AS (SELECT f.*, {_TIER} AS tier FROM f JOIN (SELECT user_id, count(*) AS n FROM seen GROUP BY user_id) USING (user_id)), dv AS ("
    + " UNION ALL ".join(f"SELECT tier AS segment, '{c}' AS feature, (avg({c}) - (SELECT avg({c}) FROM g)) / nullif((SELECT stddev_samp({c}) FROM g), 0) AS d, '{up}' AS up, '{down}' AS down FROM g GROUP BY tier" for c, (up, down) in VOCABULARY.items())
    + "), rk AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY round(abs(d), 9) DESC, feature) AS r FROM dv WHERE abs(d) >= 0.4), nm AS (SELECT segment, string_agg(CASE WHEN d > 0 THEN up ELSE down END, ', ' ORDER BY r) AS name FROM rk WHERE r <= 2 GROUP BY segment) SELECT segment, coalesce(name, 'balanced') AS name FROM (SELECT DISTINCT segment FROM dv) LEFT JOIN nm USING (segment)",
)
def ml21(s: Star) -> DataFrame:
    """Names of the history tiers as segments, from deviations of 0.4 or more."""
    f = user_features(s.train, s.users).join(tiers(s).withColumnRenamed("tier", "segment"), "user_id")
    return clustering.names(clustering.deviations(f, "segment", list(VOCABULARY)), VOCABULARY)


@query(
    "m11_by_k",
    _ranked_sql(("pop_n",)) + "".join(_metrics_sql(f"pm{k}", k) for k in (5, 10, 20))
    + ", hk AS (SELECT user_id, count(*) AS n FROM seen GROUP BY user_id), al AS (" + " UNION ALL ".join(f"SELECT {k} AS k, pm{k}.*, {_TIER} AS tier FROM pm{k} JOIN hk USING (user_id)" for k in (5, 10, 20)) + ") SELECT k, coalesce(tier, 'all') AS tier, CAST(count(*) AS BIGINT) AS users, "
    + ", ".join(f'round(avg("{m}"), 6) AS "{m}"' for m in metrics.METRICS)
    + " FROM al GROUP BY GROUPING SETS ((k), (k, tier))",
)
def m11_by_k(s: Star) -> DataFrame:
    """Metrics at 5, 10 and 20, over all users and by tier, from one ranking."""
    rows = stored(stats.packed_candidates({"global_popularity": scoring.global_popularity(s)}, metrics.placed(s), False), "popularity")
    per = reduce(DataFrame.unionByName, [stats.method_metrics(rows, ["global_popularity"], k).withColumn("k", F.lit(k)) for k in (5, 10, 20)]).join(tiers(s), "user_id")
    twice = per.select("k", F.explode(F.array(F.lit("all"), F.col("tier"))).alias("tier"), *metrics.METRICS)
    return twice.groupBy("k", "tier").agg(F.count("*").alias("users"), *[F.round(F.avg(m), 6).alias(m) for m in metrics.METRICS])
