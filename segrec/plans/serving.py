"""Serving and reporting queries: recommendations with explanations, profiles, histories, comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segrec.functions.columns import tier
from segrec.operators import explain, scoring
from segrec.operators.facts import CATEGORIES, Star
from segrec.operators.features import user_features
from segrec.plans.ranking import FALLBACK_SQL, METHOD_SQL, deployed, method_table, strata, top
from segrec.plans.registry import query
from segrec.sources.scan import checksums


class Unservable(ValueError):
    """A request that cannot be answered; the message says why."""


def recommend(star: Star, user_id: int | None = None, k: int = 10, category: str | None = None, level: int | None = None) -> DataFrame:
    """Q1: the first k items of one user, or of all, with routing by tier, filters before scoring, facts and explanation."""
    if k <= 0:
        raise Unservable("k must be positive")
    allowed = star.items
    if category is not None:
        allowed = allowed.where(F.col("category") == category)
    if level is not None:
        allowed = allowed.where(F.col("level") == level)
    if (category is not None or level is not None) and allowed.isEmpty():
        raise Unservable("no item passes the filters")
    candidates = star.candidates.join(scoring.star_small(star, allowed.select("item")), "item", "left_semi") if category is not None or level is not None else star.candidates
    if user_id is not None:
        candidates = candidates.where(F.col("user_id") == user_id)
    view = Star(star.spark, star.sf_dir)
    view.__dict__.update(star.__dict__)  # after the candidates, so that it has the star's written tables
    view.__dict__["candidates"] = candidates.select("user_id", "item", "position")
    ranked = scoring.ranked(deployed(view), k)
    if user_id is not None and ranked.isEmpty():
        raise Unservable("the user has no history, or met every item")
    component = F.when(F.col("tier") == "minimal", "preference_match").otherwise("segment_popularity")
    rows = ranked.withColumn("contributions", F.create_map(component, F.col("score")))
    return explain.sentences(explain.facts(star, rows, strata(star)))


@query("q1_recommend")
def q1(s: Star) -> DataFrame:
    return recommend(s).select("user_id", "rank", "item", F.round("score", 6).alias("score"), "tier", "explanation")


@query("q1_cold_start", FALLBACK_SQL + ", first AS (SELECT item, round(quality - rk, 6) AS score, CAST(row_number() OVER (ORDER BY quality - rk DESC, position) AS INTEGER) AS rank FROM fall) SELECT user_id, item, rank, score FROM users, first WHERE rank <= 10 AND user_id NOT IN (SELECT user_id FROM seen)")
def q1_cold(s: Star) -> DataFrame:
    """Users without history get the diversified fallback."""
    cold = s.users.select("user_id").join(s.seen.select("user_id").distinct(), "user_id", "left_anti")
    fall = scoring.fallback_items(s).withColumn("score", F.col("quality") - F.col("rank"))
    first = fall.withColumn("r", F.row_number().over(Window.orderBy(F.desc("score"), "position"))).where("r <= 10")  # catalogue-sized
    return cold.join(F.broadcast(first.select("item", F.col("r").alias("rank"), F.round("score", 6).alias("score"))))


_MINE = ", mine AS (SELECT user_id, category, count(*) AS n FROM train GROUP BY ALL), tot AS (SELECT user_id, count(*) AS total FROM train GROUP BY user_id), lv AS (SELECT user_id, level FROM (SELECT user_id, level, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, level) AS r FROM train GROUP BY user_id, level) WHERE r = 1)"


@query(
    "ex1_ex2_ex5_facts",
    _MINE + " SELECT c.user_id, c.item, CAST(coalesce(n, 0) AS BIGINT) AS shared_category_count, i.level = lv.level AS level_match, round(coalesce(n, 0) / total, 6) AS category_share FROM candidates c JOIN items i ON c.item = i.item LEFT JOIN mine m ON m.user_id = c.user_id AND m.category = i.category JOIN tot ON tot.user_id = c.user_id JOIN lv ON lv.user_id = c.user_id",
)
def ex1(s: Star) -> DataFrame:
    rows = explain.facts(s, s.candidates.select("user_id", "item"), strata(s))
    return rows.select("user_id", "item", "shared_category_count", "level_match", F.round("category_share", 6).alias("category_share"))


@query("ex3_segment_enrollments", ", per AS (SELECT stratum, item, count(*) AS n FROM train t JOIN users u ON t.user_id = u.user_id GROUP BY ALL) SELECT c.user_id, c.item, CAST(coalesce(n, 0) AS BIGINT) AS segment_enrollments FROM candidates c JOIN users u ON c.user_id = u.user_id LEFT JOIN per p ON p.stratum = u.stratum AND p.item = c.item")
def ex3(s: Star) -> DataFrame:
    rows = explain.facts(s, s.candidates.select("user_id", "item"), strata(s))
    return rows.select("user_id", "item", "segment_enrollments")


@query("ex_explanations")
def ex(s: Star) -> DataFrame:
    parts = {"preference_match": scoring.preference_match(s), "rating": scoring.rating(s), "segment_popularity": scoring.segment_popularity(s, strata(s))}
    rows = scoring.ranked(scoring.hybrid(parts, {"preference_match": 0.4, "rating": 0.2, "segment_popularity": 0.4}, 3), 3)
    return explain.sentences(explain.facts(s, rows, strata(s))).select("user_id", "item", "rank", "explanation")


@query("q2_segment_of", "SELECT user_id, stratum AS segment FROM users")
def q2(s: Star) -> DataFrame:
    return strata(s)


@query("q3_segment_summary", ", n AS (SELECT stratum, count(DISTINCT t.user_id) AS users, count(*) AS interactions FROM train t JOIN users u ON t.user_id = u.user_id GROUP BY stratum) SELECT stratum AS segment, CAST(users AS BIGINT) AS users, round(interactions / users, 6) AS per_user FROM n")
def q3(s: Star) -> DataFrame:
    return s.train.join(strata(s), "user_id").groupBy("segment").agg(F.count_distinct("user_id").alias("users"), F.round(F.count("*") / F.count_distinct("user_id"), 6).alias("per_user"))


@query("j10_q4_history", "SELECT user_id, item, category, level, strftime(ts, '%Y-%m-%d') AS day, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, txn DESC) AS INTEGER) AS recency FROM interactions")
def q4(s: Star) -> DataFrame:
    newest = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("txn"))
    return s.interactions.select("user_id", "item", "category", "level", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.row_number().over(newest).alias("recency"))


@query(
    "q5_user_profile",
    """, c AS (SELECT user_id, category, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, category) AS r FROM train GROUP BY user_id, category),
    l AS (SELECT user_id, level, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, level) AS r FROM train GROUP BY user_id, level),
    n AS (SELECT user_id, CAST(count(*) AS BIGINT) AS total_courses, count(DISTINCT provider_id) AS p FROM train GROUP BY user_id)
    SELECT n.user_id, total_courses, category AS preferred_category, level AS preferred_level, round(1 - p / total_courses, 6) AS loyalty, stratum
    FROM n JOIN c ON c.user_id = n.user_id AND c.r = 1 JOIN l ON l.user_id = n.user_id AND l.r = 1 LEFT JOIN users u ON u.user_id = n.user_id""",
)
def q5(s: Star) -> DataFrame:
    return user_features(s.train, s.users).select("user_id", "total_courses", "preferred_category", "preferred_level", F.round("loyalty", 6).alias("loyalty"), "stratum")


@query("q6_describe", ", h AS (SELECT user_id, count(*) AS n FROM seen GROUP BY user_id) SELECT (SELECT CAST(count(*) AS BIGINT) FROM users) AS users, (SELECT CAST(count(*) AS BIGINT) FROM items) AS items, (SELECT CAST(count(*) AS BIGINT) FROM interactions) AS interactions, CAST(count(*) FILTER (WHERE n = 1) AS BIGINT) AS minimal, CAST(count(*) FILTER (WHERE n BETWEEN 2 AND 8) AS BIGINT) AS moderate, CAST(count(*) FILTER (WHERE n > 8) AS BIGINT) AS rich FROM h")
def q6(s: Star) -> DataFrame:
    tiers = s.seen.groupBy("user_id").agg(F.count("*").alias("n")).select(tier(F.col("n")).alias("t")).agg(*[F.count(F.when(F.col("t") == t, 1)).alias(t) for t in ("minimal", "moderate", "rich")])
    parts = [s.users.agg(F.count("*").alias("users")), s.items.agg(F.count("*").alias("items")), s.interactions.agg(F.count("*").alias("interactions")), tiers]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p)  # one row each
    return out


@query("q7_q8_r18_method_choice", METHOD_SQL + """, c AS (SELECT method, hit_rate, CAST(CASE method WHEN 'global_popularity' THEN 1 WHEN 'rating' THEN 1 WHEN 'segment_popularity' THEN 2 ELSE 3 END AS INTEGER) AS complexity, hit_rate >= max(hit_rate) OVER () - 0.01 AS near FROM methods)
    SELECT method, round(hit_rate, 6) AS hit_rate, complexity, row_number() OVER (ORDER BY near DESC, complexity, hit_rate DESC, method) = 1 AS chosen FROM c""")
def q7(s: Star) -> DataFrame:
    """Methods by hit rate; ``chosen`` is the simplest within 0.01 of the best."""
    simple = F.create_map(*[F.lit(x) for n, c in (("global_popularity", 1), ("rating", 1), ("segment_popularity", 2), ("preference_match", 3)) for x in (n, c)])
    table = method_table(s).withColumn("complexity", F.get(F.array(simple[F.col("method")]), F.lit(0)))
    best = table.agg(F.max("hit_rate").alias("best"))
    rows = table.join(F.broadcast(best))
    near = F.col("hit_rate") >= F.col("best") - 0.01
    order = Window.orderBy(F.desc(near.cast("int")), "complexity", F.desc("hit_rate"), "method")
    return rows.select("method", F.round("hit_rate", 6).alias("hit_rate"), "complexity", (F.row_number().over(order) == 1).alias("chosen"))


@query("q12_segment_heatmap", ", c AS (SELECT stratum AS segment, category, count(*) AS n FROM train t JOIN users u ON t.user_id = u.user_id GROUP BY ALL), a AS (SELECT segment, category, n FROM c UNION ALL SELECT 'population', category, sum(n) FROM c GROUP BY category) SELECT segment, category, round(n / sum(n) OVER (PARTITION BY segment), 6) AS share FROM a")
def q12(s: Star) -> DataFrame:
    by = s.train.join(strata(s), "user_id").groupBy("segment", "category").agg(F.count("*").alias("n"))
    every = by.groupBy("category").agg(F.sum("n").alias("n")).select(F.lit("population").alias("segment"), "category", "n")
    rows = by.unionByName(every)
    return rows.select("segment", "category", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("segment")), 6).alias("share"))


@query("q15_reproducibility", METHOD_SQL + " SELECT method, true AS same FROM methods")
def q15(s: Star) -> DataFrame:
    """Rows (method, same): two computations of the table agree to 1e-6."""
    a, b = method_table(s), method_table(s).withColumnRenamed("hit_rate", "again")
    return a.join(b, "method").select("method", (F.abs(F.col("hit_rate") - F.col("again")) <= 1e-6).alias("same"))


@query("r19_fallback_diversity", FALLBACK_SQL + """, rk AS (SELECT user_id, category, level, row_number() OVER (PARTITION BY user_id ORDER BY round(quality - rk, 9) DESC, c.position) AS r FROM candidates c JOIN fall f ON c.item = f.item JOIN (SELECT item AS i, level FROM items) l ON l.i = c.item),
    n AS (SELECT user_id, category, count(*) AS k FROM rk WHERE r <= 10 GROUP BY ALL), lv AS (SELECT user_id, CAST(count(DISTINCT level) AS BIGINT) AS levels FROM rk WHERE r <= 10 GROUP BY user_id)
    SELECT user_id, CAST(count(*) AS BIGINT) AS categories, max(levels) AS levels, round(max(k) / sum(k), 6) AS largest_share FROM n JOIN lv USING (user_id) GROUP BY user_id""")
def r19(s: Star) -> DataFrame:
    """Distinct categories and levels, and the largest category's share, among each user's first ten fallback items."""
    rows = top(scoring.diversified_fallback(s)).join(scoring.star_small(s, s.items.select("item", "category", "level")), "item")
    shares = [F.count(F.when(F.col("category") == c, 1)) for c in CATEGORIES]
    return rows.groupBy("user_id").agg(F.count_distinct("category").alias("categories"), F.count_distinct("level").alias("levels"), F.round(F.greatest(*shares) / F.count("*"), 6).alias("largest_share"))


@query("sk9_integrity")
def sk9(s: Star) -> DataFrame:
    """Checksums of all stored tables, read on the executors."""
    return checksums(s.spark, s.sf_dir).select("file", "sha256", "bytes")
