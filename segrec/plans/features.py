"""Queries over the fact view, per-user features and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segrec.functions.columns import adjusted_skew, random_hit_rate, tier
from segrec.functions.quantiles import column_quantiles
from segrec.operators import features
from segrec.operators.facts import CATEGORIES, Star, micros
from segrec.plans.registry import query

DAY_SQL = "86400000000"


def r6(column: str):
    return F.round(column, 6).alias(column)


@query("j1_fact_items", "SELECT txn, user_id, item, category, level, is_free, price, duration, rating FROM interactions")
def j1(s: Star) -> DataFrame:
    return s.interactions.select("txn", "user_id", "item", "category", "level", "is_free", "price", "duration", "rating")


@query("j2_fact_users", "SELECT txn, i.user_id, balance, stratum FROM interactions i LEFT JOIN users u ON i.user_id = u.user_id")
def j2(s: Star) -> DataFrame:
    return s.interactions.join(s.users, "user_id", "left").select("txn", "user_id", "balance", "stratum")


@query("j3_fact_providers", "SELECT txn, provider_id, s_nationkey, s_acctbal FROM interactions LEFT JOIN supplier ON provider_id = s_suppkey")
def j3(s: Star) -> DataFrame:
    providers = s.table("supplier").withColumnRenamed("s_suppkey", "provider_id")
    return s.interactions.join(providers, "provider_id", "left").select("txn", "provider_id", "s_nationkey", "s_acctbal")


@query("j7_active_in_both", "SELECT DISTINCT user_id FROM train WHERE user_id IN (SELECT user_id FROM test)")
def j7(s: Star) -> DataFrame:
    return s.train.select("user_id").distinct().join(s.test.select("user_id").distinct(), "user_id", "left_semi")


@query("j9_two_hop", "SELECT s_nationkey, category, CAST(count(*) AS BIGINT) AS n FROM interactions JOIN supplier ON provider_id = s_suppkey JOIN (SELECT DISTINCT item AS i FROM items) ON item = i GROUP BY ALL")
def j9(s: Star) -> DataFrame:
    providers = s.table("supplier").select(F.col("s_suppkey").alias("provider_id"), "s_nationkey")
    return s.interactions.select("provider_id", "category").join(providers, "provider_id").groupBy("s_nationkey", "category").agg(F.count("*").alias("n"))


@query("j15_item_provider_bridge", "SELECT DISTINCT item, provider_id FROM train")
def j15(s: Star) -> DataFrame:
    return s.train.select("item", "provider_id").distinct()


@query("p2_level_and_free", "SELECT item, category, level, is_free FROM items")
def p2(s: Star) -> DataFrame:
    return s.items.select("item", "category", "level", "is_free")


@query("p3_window_sizes", "SELECT CAST((SELECT count(*) FROM train) AS BIGINT) AS n_train, CAST((SELECT count(*) FROM test) AS BIGINT) AS n_test")
def p3(s: Star) -> DataFrame:
    before = micros("ts") < s.cut
    return s.interactions.agg(F.count(F.when(before, 1)).alias("n_train"), F.count(F.when(~before, 1)).alias("n_test"))


@query("p6_membership", "SELECT txn FROM interactions WHERE user_id IN (SELECT user_id FROM users WHERE stratum = 'BUILDING')")
def p6(s: Star) -> DataFrame:
    return s.interactions.join(s.users.where("stratum = 'BUILDING'"), "user_id", "left_semi").select("txn")


@query("p7_min_threshold", "SELECT category, CAST(count(*) AS BIGINT) AS n FROM interactions GROUP BY category HAVING count(*) >= 1000")
def p7(s: Star) -> DataFrame:
    return s.interactions.groupBy("category").agg(F.count("*").alias("n")).where("n >= 1000")


@query("a1_user_counts", "SELECT user_id, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT category) AS BIGINT) AS n_categories FROM interactions GROUP BY user_id")
def a1(s: Star) -> DataFrame:
    return s.interactions.groupBy("user_id").agg(F.count("*").alias("n"), F.count_distinct("category").alias("n_categories"))


@query(
    "a2_span_recency",
    f"""SELECT user_id, CAST(floor((max(epoch_us(ts)) - min(epoch_us(ts))) / {DAY_SQL}) AS BIGINT) AS activity_span_days,
      CAST(floor(((SELECT max(epoch_us(ts)) FROM interactions) - max(epoch_us(ts))) / {DAY_SQL}) AS BIGINT) AS recency_days FROM interactions GROUP BY user_id""",
)
def a2(s: Star) -> DataFrame:
    return features.user_features(s.interactions).select("user_id", "activity_span_days", "recency_days")


@query(
    "a3_ratios",
    f"""SELECT user_id, round(count(*) / count(DISTINCT category), 6) AS avg_per_category,
      round(count(*) / (floor((max(epoch_us(ts)) - min(epoch_us(ts))) / {DAY_SQL}) + 1), 6) AS frequency,
      round(count(DISTINCT category) / count(*), 6) AS diversity_ratio, round(1 - count(DISTINCT provider_id) / count(*), 6) AS loyalty
    FROM interactions GROUP BY user_id""",
)
def a3(s: Star) -> DataFrame:
    return features.user_features(s.interactions).select("user_id", r6("avg_per_category"), r6("frequency"), r6("diversity_ratio"), r6("loyalty"))


@query(
    "a4_modes",
    """, c AS (SELECT user_id, category, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, category) AS r FROM interactions GROUP BY user_id, category),
    l AS (SELECT user_id, level, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, level) AS r FROM interactions GROUP BY user_id, level)
    SELECT c.user_id, category AS preferred_category, level AS preferred_level FROM c JOIN l ON c.user_id = l.user_id AND c.r = 1 AND l.r = 1""",
)
def a4(s: Star) -> DataFrame:
    return s.interactions.groupBy("user_id").agg(F.mode("category", True).alias("preferred_category"), F.mode("level", True).alias("preferred_level"))


@query("a5_means", "SELECT user_id, round(avg(rating), 10) AS avg_rating, round(avg(amount), 8) AS avg_spend, round(sum(amount), 2) AS total_spend, round(avg(level), 6) AS depth_index, round(avg(is_free), 6) AS free_ratio FROM interactions GROUP BY user_id")
def a5(s: Star) -> DataFrame:
    f = features.user_features(s.interactions)
    return f.select("user_id", F.round("avg_rating", 10).alias("avg_rating"), F.round("avg_spend", 8).alias("avg_spend"), F.round("total_spend", 2).alias("total_spend"), r6("depth_index"), r6("free_ratio"))


_SHARES = ", p AS (SELECT user_id, category, count(*) / sum(count(*)) OVER (PARTITION BY user_id) AS p FROM interactions GROUP BY user_id, category)"


@query("a6_user_entropy", _SHARES + " SELECT user_id, round(abs(sum(p * log2(p))), 6) AS category_entropy FROM p GROUP BY user_id")
def a6(s: Star) -> DataFrame:
    return features.user_features(s.interactions).select("user_id", r6("category_entropy"))


@query("a7_top_share", _SHARES + " SELECT user_id, round(max(p), 6) AS top_category_share FROM p GROUP BY user_id")
def a7(s: Star) -> DataFrame:
    return features.user_features(s.interactions).select("user_id", r6("top_category_share"))


@query("a8_category_profile", " SELECT user_id, " + ", ".join(f"round(count(*) FILTER (WHERE category = '{c}') / count(*), 6) AS share_{c}" for c in CATEGORIES) + " FROM interactions GROUP BY user_id")
def a8(s: Star) -> DataFrame:
    return features.category_profile(s.interactions).select("user_id", *[r6(f"share_{c}") for c in CATEGORIES])


@query("a10_item_popularity", "SELECT item, CAST(count(*) AS BIGINT) AS n FROM interactions GROUP BY item")
def a10(s: Star) -> DataFrame:
    return s.interactions.groupBy("item").agg(F.count("*").alias("n"))


@query("a11_segment_popularity", "SELECT stratum, item, CAST(count(*) AS BIGINT) AS n FROM interactions i JOIN users u ON i.user_id = u.user_id GROUP BY stratum, item")
def a11(s: Star) -> DataFrame:
    return s.interactions.join(s.users, "user_id").groupBy("stratum", "item").agg(F.count("*").alias("n"))


STRATA = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@query(
    "a12_popularity_table",
    ", w AS (SELECT item, count(*) AS n_all, " + ", ".join(f"count(*) FILTER (WHERE stratum = '{x}') AS n_{x.lower()}" for x in STRATA) + " FROM interactions i JOIN users u ON i.user_id = u.user_id GROUP BY item) SELECT i.item, i.position, CAST(coalesce(n_all, 0) AS BIGINT) AS n_all, "
    + ", ".join(f"CAST(coalesce(n_{x.lower()}, 0) AS BIGINT) AS n_{x.lower()}" for x in STRATA)
    + " FROM items i LEFT JOIN w ON i.item = w.item",
)
def a12(s: Star) -> DataFrame:
    counts = [F.count(F.when(F.col("stratum") == x, 1)).alias(f"n_{x.lower()}") for x in STRATA]
    wide = s.interactions.join(s.users, "user_id").groupBy("item").agg(F.count("*").alias("n_all"), *counts)
    return s.items.select("item", "position").join(wide, "item", "left").fillna(0)


@query("a13_crosstab", "SELECT category, level, round(count(*) / sum(count(*)) OVER (PARTITION BY category), 6) AS share FROM interactions GROUP BY category, level")
def a13(s: Star) -> DataFrame:
    by = s.interactions.groupBy("category", "level").agg(F.count("*").alias("n"))
    return by.select("category", "level", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("category")), 6).alias("share"))


@query(
    "a17_value_counts",
    ", c AS (SELECT user_id, count(*) AS n FROM interactions GROUP BY user_id), h AS (SELECT n, count(*) AS users FROM c GROUP BY n) SELECT CAST(n AS BIGINT) AS n, CAST(users AS BIGINT) AS users, round(100.0 * sum(users) OVER (ORDER BY n) / sum(users) OVER (), 6) AS cumulative_pct FROM h",
)
def a17(s: Star) -> DataFrame:
    sizes = s.interactions.groupBy("user_id").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("users"))
    running, all_users = F.sum("users").over(Window.orderBy("n")), F.sum("users").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return sizes.select("n", "users", F.round(100.0 * running / all_users, 6).alias("cumulative_pct"))


@query("a18_percentiles", "SELECT round(quantile_cont(amount, 0.25), 6) AS p25, round(quantile_cont(amount, 0.5), 6) AS p50, round(quantile_cont(amount, 0.9), 6) AS p90 FROM interactions")
def a18(s: Star) -> DataFrame:
    found = column_quantiles(s.interactions.select("amount"), ["amount"], [0.25, 0.5, 0.9]).get("amount", [None] * 3)
    return s.spark.createDataFrame([tuple(found)], "p25 double, p50 double, p90 double").select(*[r6(c) for c in ("p25", "p50", "p90")])


def gini(df: DataFrame, value: str, name: str) -> DataFrame:
    """Gini coefficient of a column of a small aggregate; 0 for an empty or all-zero one."""
    ranked = df.select(F.col(value).cast("double").alias("x"), F.row_number().over(Window.orderBy(value)).alias("i"))
    n, total = F.count("*"), F.sum("x")
    return ranked.agg(F.when((n == 0) | (F.coalesce(total, F.lit(0.0)) == 0), 0.0).otherwise((2 * F.sum(F.col("i") * F.col("x")) - (n + 1) * total) / (n * total)).alias(name))


_POP = ", pop AS (SELECT item, count(*) AS n FROM interactions GROUP BY item), r AS (SELECT CAST(n AS DOUBLE) AS x, row_number() OVER (ORDER BY n) AS i FROM pop)"


@query("a19_item_gini", _POP + " SELECT round((2 * sum(i * x) - (count(*) + 1) * sum(x)) / (count(*) * sum(x)), 6) AS gini FROM r")
def a19(s: Star) -> DataFrame:
    return gini(s.interactions.groupBy("item").agg(F.count("*").alias("n")), "n", "gini").select(r6("gini"))


@query("a20_monthly", "SELECT strftime(ts, '%Y-%m') AS month, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT user_id) AS BIGINT) AS users FROM interactions GROUP BY 1")
def a20(s: Star) -> DataFrame:
    return s.interactions.groupBy(F.date_format("ts", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query(
    "a21_providers_per_item",
    ", b AS (SELECT DISTINCT item, provider_id FROM interactions), x AS (SELECT count(*) AS n FROM b GROUP BY item), y AS (SELECT count(*) AS n FROM b GROUP BY provider_id) SELECT (SELECT CAST(min(n) AS BIGINT) FROM x) AS min_per_item, (SELECT CAST(max(n) AS BIGINT) FROM x) AS max_per_item, (SELECT CAST(min(n) AS BIGINT) FROM y) AS min_per_provider, (SELECT CAST(max(n) AS BIGINT) FROM y) AS max_per_provider, (SELECT max(n) FROM x) = 1 AND (SELECT max(n) FROM y) = 1 AS bijection",
)
def a21(s: Star) -> DataFrame:
    bridge = s.interactions.select("item", "provider_id").distinct()
    sides = [bridge.groupBy(k).agg(F.count("*").alias("n")).agg(F.min("n").alias(f"min_per_{name}"), F.max("n").alias(f"max_per_{name}")) for k, name in (("item", "item"), ("provider_id", "provider"))]
    return sides[0].join(sides[1]).withColumn("bijection", (F.col("max_per_item") == 1) & (F.col("max_per_provider") == 1))


_COHORT = ", h AS (SELECT user_id, count(*) AS n, count(DISTINCT provider_id) AS providers FROM interactions GROUP BY user_id), c AS (SELECT h.*, CASE WHEN n <= 4 THEN 'light' WHEN n >= 9 THEN 'heavy' ELSE 'middle' END AS cohort, balance FROM h LEFT JOIN users u ON h.user_id = u.user_id)"


@query("a22_a23_cohorts", _COHORT + " SELECT cohort, CAST(count(*) AS BIGINT) AS users, CAST(sum(n) AS BIGINT) AS interactions, round(avg(balance), 8) AS mean_balance, round(avg(providers / n), 6) AS provider_ratio FROM c GROUP BY cohort")
def a22(s: Star) -> DataFrame:
    users = s.interactions.groupBy("user_id").agg(F.count("*").alias("n"), F.count_distinct("provider_id").alias("providers")).join(s.users, "user_id", "left")
    cohort = F.when(F.col("n") <= 4, "light").when(F.col("n") >= 9, "heavy").otherwise("middle").alias("cohort")
    return users.groupBy(cohort).agg(F.count("*").alias("users"), F.sum("n").alias("interactions"), F.round(F.avg("balance"), 8).alias("mean_balance"), F.round(F.avg(F.col("providers") / F.col("n")), 6).alias("provider_ratio"))


@query(
    "a24_describe",
    ", f AS (SELECT user_id, CAST(count(*) AS DOUBLE) AS x FROM interactions GROUP BY user_id) SELECT CAST(count(*) AS BIGINT) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, min(x) AS low, max(x) AS high, round(skewness(x), 6) AS skew, round(100.0 * avg(CASE WHEN x = 0 THEN 1 ELSE 0 END), 6) AS pct_zero, CAST(count(DISTINCT x) AS BIGINT) AS n_unique FROM f",
)
def a24(s: Star) -> DataFrame:
    f = s.interactions.groupBy("user_id").agg(F.count("*").cast("double").alias("x"))
    x = F.col("x")
    return f.agg(
        F.count("*").alias("n"), F.round(F.avg(x), 6).alias("mean"), F.round(F.stddev_samp(x), 6).alias("std"), F.min(x).alias("low"), F.max(x).alias("high"),
        F.round(adjusted_skew(x), 6).alias("skew"), F.round(100.0 * F.avg((x == 0).cast("int")), 6).alias("pct_zero"), F.count_distinct(x).alias("n_unique"),
    )


@query("a25_correlation", ", f AS (SELECT count(*) AS n, sum(amount) AS spend, count(DISTINCT category) AS d, avg(level) AS depth FROM interactions GROUP BY user_id) SELECT round(corr(n, spend), 6) AS n_spend, round(corr(n, d), 6) AS n_diversity, round(corr(d, depth), 6) AS diversity_depth FROM f")
def a25(s: Star) -> DataFrame:
    f = s.interactions.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("amount").alias("spend"), F.count_distinct("category").alias("d"), F.avg("level").alias("depth"))
    return f.agg(F.round(F.corr("n", "spend"), 6).alias("n_spend"), F.round(F.corr("n", "d"), 6).alias("n_diversity"), F.round(F.corr("d", "depth"), 6).alias("diversity_depth"))


@query("a32_composition", "SELECT category, level, CAST(count(*) AS BIGINT) AS items, round(avg(price), 6) AS mean_price FROM items GROUP BY category, level")
def a32(s: Star) -> DataFrame:
    return s.items.groupBy("category", "level").agg(F.count("*").alias("items"), F.round(F.avg("price"), 6).alias("mean_price"))


@query("a33_w6_lorenz", _POP + " SELECT CAST(i AS INTEGER) AS rank, round(sum(x) OVER (ORDER BY i) / sum(x) OVER (), 6) AS lorenz FROM r")
def a33(s: Star) -> DataFrame:
    pop = s.interactions.groupBy("item").agg(F.count("*").cast("double").alias("x"))
    order = Window.orderBy("x")
    ranked = pop.select("x", F.row_number().over(order).alias("rank"))
    by = Window.orderBy("rank")
    return ranked.select("rank", F.round(F.sum("x").over(by) / F.sum("x").over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), 6).alias("lorenz"))


@query("a34_iqr", ", f AS (SELECT count(*) AS n, avg(level) AS depth FROM interactions GROUP BY user_id) SELECT round(quantile_cont(n, 0.75) - quantile_cont(n, 0.25), 6) AS iqr_n, round(quantile_cont(depth, 0.75) - quantile_cont(depth, 0.25), 6) AS iqr_depth FROM f")
def a34(s: Star) -> DataFrame:
    f = s.interactions.groupBy("user_id").agg(F.count("*").alias("n"), F.avg("level").alias("depth"))
    found = column_quantiles(f, ["n", "depth"], [0.25, 0.75])
    ranges = [found[c][1] - found[c][0] if c in found else None for c in ("n", "depth")]
    return s.spark.createDataFrame([tuple(ranges)], "iqr_n double, iqr_depth double").select(r6("iqr_n"), r6("iqr_depth"))


@query("a35_overdispersion", ", d AS (SELECT count(*) AS n FROM interactions GROUP BY ts) SELECT round(avg(n), 6) AS mean, round(var_samp(n), 6) AS variance FROM d")
def a35(s: Star) -> DataFrame:
    return s.interactions.groupBy("ts").agg(F.count("*").alias("n")).agg(F.round(F.avg("n"), 6).alias("mean"), F.round(F.var_samp("n"), 6).alias("variance"))


_ORDERED = ", o AS (SELECT *, row_number() OVER w AS r, count(*) OVER (PARTITION BY user_id) AS size, lag(ts) OVER w AS before FROM interactions WINDOW w AS (PARTITION BY user_id ORDER BY ts, txn))"


def ordered(s: Star, rows: DataFrame | None = None) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "txn")
    return (s.interactions if rows is None else rows).withColumns({"r": F.row_number().over(w), "size": F.count("*").over(Window.partitionBy("user_id")), "before": F.lag("ts").over(w)})


@query("w1_last_flag", _ORDERED + " SELECT txn, CAST(r AS INTEGER) AS r, CAST(size AS BIGINT) AS size, r = size AS is_last FROM o")
def w1(s: Star) -> DataFrame:
    return ordered(s).select("txn", "r", "size", (F.col("r") == F.col("size")).alias("is_last"))


@query("w2_a31_gaps", _ORDERED + ", g AS (SELECT date_diff('day', before, ts) AS gap FROM o WHERE before IS NOT NULL) SELECT round(avg(gap), 6) AS mean, round(quantile_cont(gap, 0.5), 6) AS median, CAST(max(gap) AS INTEGER) AS longest, round(avg(CASE WHEN gap = 0 THEN 1 ELSE 0 END), 6) AS same_day FROM g")
def w2(s: Star) -> DataFrame:
    gap = ordered(s).where("before IS NOT NULL").select(F.datediff("ts", "before").alias("gap"))
    return gap.agg(F.round(F.avg("gap"), 6).alias("mean"), F.round(F.percentile("gap", 0.5), 6).alias("median"), F.max("gap").alias("longest"), F.round(F.avg((F.col("gap") == 0).cast("int")), 6).alias("same_day"))


@query("w3_leave_one_out", _ORDERED + " SELECT user_id, CAST(count(*) FILTER (WHERE r < size) AS BIGINT) AS history, max(CASE WHEN r = size THEN item END) AS held_out FROM o WHERE size > 1 GROUP BY user_id")
def w3(s: Star) -> DataFrame:
    rows = ordered(s).where("size > 1")
    return rows.groupBy("user_id").agg(F.count(F.when(F.col("r") < F.col("size"), 1)).alias("history"), F.max(F.when(F.col("r") == F.col("size"), F.col("item"))).alias("held_out"))


@query("w7_positions", "SELECT item, position FROM items")
def w7(s: Star) -> DataFrame:
    return s.items.select("item", "position")


@query("w9_level_slopes", _ORDERED + " SELECT user_id, round(regr_slope(level, r), 6) + 0.0 AS slope FROM o GROUP BY user_id HAVING count(*) >= 3 AND count(DISTINCT level) >= 2")
def w9(s: Star) -> DataFrame:
    by = ordered(s).groupBy("user_id").agg(F.regr_slope("level", "r").alias("slope"), F.count("*").alias("n"), F.count_distinct("level").alias("levels"))
    return by.where("n >= 3 AND levels >= 2").select("user_id", (F.round("slope", 6) + 0.0).alias("slope"))


@query("u4_provider_item_sets", "SELECT user_id, CAST(count(DISTINCT b.item) AS BIGINT) AS reachable FROM (SELECT DISTINCT user_id, provider_id FROM interactions) u JOIN (SELECT DISTINCT provider_id, item FROM interactions) b ON u.provider_id = b.provider_id GROUP BY user_id")
def u4(s: Star) -> DataFrame:
    sets = s.interactions.groupBy("provider_id").agg(F.collect_set("item").alias("items"))
    met = s.interactions.select("user_id", "provider_id").distinct().join(sets, "provider_id")
    return met.groupBy("user_id").agg(F.size(F.array_distinct(F.flatten(F.collect_list("items")))).cast("bigint").alias("reachable"))


@query(
    "u5_jaccard",
    ", a AS (SELECT DISTINCT stratum, user_id FROM users WHERE balance > 5000) , b AS (SELECT stratum, i.user_id FROM interactions i JOIN users u ON i.user_id = u.user_id GROUP BY ALL HAVING count(*) >= 6) SELECT coalesce(a.stratum, b.stratum) AS stratum, round(count(*) FILTER (WHERE a.user_id IS NOT NULL AND b.user_id IS NOT NULL) / count(*), 6) AS jaccard FROM a FULL JOIN b ON a.stratum = b.stratum AND a.user_id = b.user_id GROUP BY 1",
)
def u5(s: Star) -> DataFrame:
    rich = s.users.where("balance > 5000").select("stratum", "user_id").distinct().withColumn("in_a", F.lit(1))
    active = s.interactions.groupBy("user_id").agg(F.count("*").alias("n")).where("n >= 6").join(s.users, "user_id").select("stratum", "user_id").withColumn("in_b", F.lit(1))
    return rich.join(active, ["stratum", "user_id"], "full").groupBy("stratum").agg(F.round(F.count(F.col("in_a") + F.col("in_b")) / F.count("*"), 6).alias("jaccard"))


@query("a29_tiers", ", h AS (SELECT u.user_id, count(DISTINCT s.item) AS n FROM users u LEFT JOIN seen s ON u.user_id = s.user_id GROUP BY u.user_id) SELECT CASE WHEN n <= 0 THEN 'insufficient' WHEN n = 1 THEN 'minimal' WHEN n <= 8 THEN 'moderate' ELSE 'rich' END AS tier, CAST(count(*) AS BIGINT) AS users FROM h GROUP BY 1")
def a29(s: Star) -> DataFrame:
    history = s.users.select("user_id").join(s.seen.groupBy("user_id").agg(F.count("*").alias("n")), "user_id", "left")
    return history.groupBy(tier(F.coalesce("n", F.lit(0))).alias("tier")).agg(F.count("*").alias("users"))


@query("f_strings", "SELECT item, upper(left(category, 1)) || substr(category, 2) AS title, replace(item, ' ', '_') AS slug, left(sha256(item), 12) AS short_hash, starts_with(item, 'hot') AS hot FROM items")
def f_strings(s: Star) -> DataFrame:
    return s.items.select("item", F.initcap("category").alias("title"), F.regexp_replace("item", " ", "_").alias("slug"), F.substring(F.sha2("item", 256), 1, 12).alias("short_hash"), F.col("item").startswith("hot").alias("hot"))


@query("f_dates", "SELECT txn, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, CAST(CAST(date_trunc('month', ts) AS DATE) AS VARCHAR) AS month, CAST(date_diff('day', TIMESTAMP '1995-01-01', ts) AS INTEGER) AS days, strftime(ts, '%Y-%m') AS label FROM interactions")
def f_dates(s: Star) -> DataFrame:
    return s.interactions.select("txn", F.to_date("ts").cast("string").alias("day"), F.to_date(F.date_trunc("month", "ts")).cast("string").alias("month"), F.datediff(F.col("ts"), F.lit("1995-01-01").cast("date")).alias("days"), F.date_format("ts", "yyyy-MM").alias("label"))


@query("f_bins", ", b AS (SELECT CASE WHEN p_size <= 14 THEN 'to14' WHEN p_size <= 20 THEN 'to20' WHEN p_size <= 30 THEN 'to30' ELSE 'over30' END AS bin FROM part) SELECT bin, CAST(count(*) AS BIGINT) AS n FROM b GROUP BY bin")
def f_bins(s: Star) -> DataFrame:
    size = F.col("p_size")
    return s.table("part").groupBy(F.when(size <= 14, "to14").when(size <= 20, "to20").when(size <= 30, "to30").otherwise("over30").alias("bin")).agg(F.count("*").alias("n"))


@query("f_json", "SELECT event_id, CAST(props->>'k' AS INTEGER) AS k FROM events", base=False)
def f_json(s: Star) -> DataFrame:
    return s.spark.read.parquet(f"{s.sf_dir}/events.parquet").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query(
    "f_random_hit_rate",
    ", h AS (SELECT user_id, 64 - count(*) AS m FROM seen GROUP BY user_id) SELECT user_id, round(1 - (1.0 * (m - 1) / m) * (1.0 * (m - 2) / (m - 1)) * (1.0 * (m - 3) / (m - 2)), 6) AS chance FROM h WHERE m > 4",
)
def f_random(s: Star) -> DataFrame:
    left = s.seen.groupBy("user_id").agg((64 - F.count("*")).alias("m")).where("m > 4")
    return left.select("user_id", F.round(random_hit_rate(F.col("m"), F.lit(1), 3), 6).alias("chance"))
