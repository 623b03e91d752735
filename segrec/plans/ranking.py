"""Queries over scorers, rankings and ranking metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segrec.functions.columns import tier
from segrec.operators import features, metrics, scoring
from segrec.operators.facts import Star
from segrec.plans.registry import query

TOP = 10


def strata(s: Star) -> DataFrame:
    return s.users.select("user_id", F.col("stratum").alias("segment"))


def top(scores: DataFrame, k: int = TOP) -> DataFrame:
    return scoring.ranked(scores, k).select("user_id", "item", "rank", F.round("score", 6).alias("score"))


def top_sql(score: str, source: str, k: int = TOP) -> str:
    """SQL for ``top`` over rows with a score expression."""
    return f""", scored AS (SELECT c.user_id, c.item, c.position, {score} AS score FROM {source}),
    ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, position) AS INTEGER) AS rank FROM scored)
    SELECT user_id, item, rank, round(score, 6) AS score FROM ranked WHERE rank <= {k}"""


_POP = ", pop AS (SELECT item, CAST(count(*) AS DOUBLE) AS n FROM train GROUP BY item)"


@query("j11_candidates", "SELECT user_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(position) AS BIGINT) AS positions FROM candidates GROUP BY user_id")
def j11(s: Star) -> DataFrame:
    return s.candidates.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("position").alias("positions"))


@query("r1_random")
def r1(s: Star) -> DataFrame:
    return top(scoring.random_score(s))


@query("r2_global_popularity", _POP + top_sql("coalesce(n, 0)", "candidates c LEFT JOIN pop p ON c.item = p.item"))
def r2(s: Star) -> DataFrame:
    return top(scoring.global_popularity(s))


@query("r3_rating", top_sql("coalesce(rating, 0)", "candidates c LEFT JOIN items i ON c.item = i.item"))
def r3(s: Star) -> DataFrame:
    return top(scoring.rating(s))


_VEC = (
    """, sc AS (SELECT *, CASE WHEN max(rating) OVER () - min(rating) OVER () < 1e-12 THEN 0 ELSE (rating - min(rating) OVER ()) / (max(rating) OVER () - min(rating) OVER ()) END AS r,
    CASE WHEN max(duration) OVER () - min(duration) OVER () < 1e-12 THEN 0 ELSE (duration - min(duration) OVER ()) / (max(duration) OVER () - min(duration) OVER ()) END AS d FROM items),
    v AS (SELECT item, dim, x FROM (SELECT item, 'category=' || category AS dim, CAST(1 AS DOUBLE) AS x FROM sc UNION ALL SELECT item, 'level=' || level, 1 FROM sc
      UNION ALL SELECT item, 'free', is_free FROM sc UNION ALL SELECT item, 'rating', r FROM sc UNION ALL SELECT item, 'duration', d FROM sc) WHERE x <> 0)"""
)


@query("r16_item_vectors", _VEC + " SELECT item, dim, round(x, 6) AS x FROM v")
def r16(s: Star) -> DataFrame:
    return scoring.item_vectors(s).select("item", "dim", F.round("x", 6).alias("x"))


@query(
    "r4_content_based",
    _VEC
    + ", us AS (SELECT user_id, dim, sum(x) AS u FROM seen s JOIN v ON s.item = v.item GROUP BY user_id, dim), un AS (SELECT user_id, sqrt(sum(u * u)) AS u_norm FROM us GROUP BY user_id), il AS (SELECT item, sqrt(sum(x * x)) AS i_norm FROM v GROUP BY item), dots AS (SELECT user_id, item, sum(u * x) AS dot FROM us JOIN v ON us.dim = v.dim GROUP BY user_id, item)"
    + top_sql("coalesce(dot / (u_norm * i_norm), 0)", "candidates c JOIN un ON c.user_id = un.user_id JOIN il ON c.item = il.item LEFT JOIN dots d ON c.user_id = d.user_id AND c.item = d.item"),
)
def r4(s: Star) -> DataFrame:
    return top(scoring.content_based(s))


_SIM = ", sizes AS (SELECT item, count(*) AS n FROM seen GROUP BY item), sim AS (SELECT a, b, both_n / sqrt(x.n * y.n) AS sim FROM (SELECT l.item AS a, r.item AS b, count(*) AS both_n FROM seen l JOIN seen r ON l.user_id = r.user_id AND l.item <> r.item GROUP BY ALL) JOIN sizes x ON a = x.item JOIN sizes y ON b = y.item)"


@query("j13_item_similarity", _SIM + " SELECT a, b, round(sim, 6) AS sim FROM sim")
def j13(s: Star) -> DataFrame:
    return scoring.item_similarity(s).select("a", "b", F.round("sim", 6).alias("sim"))


@query("r5_item_item", _SIM + ", sums AS (SELECT user_id, b AS item, sum(sim) AS sc FROM seen JOIN sim ON item = a GROUP BY ALL)" + top_sql("coalesce(sc, 0)", "candidates c LEFT JOIN sums d ON c.user_id = d.user_id AND c.item = d.item"))
def r5(s: Star) -> DataFrame:
    return top(scoring.item_item(s))


def asked_users(s: Star) -> DataFrame:
    """The stated query set of ``j14_t3_neighbours``; all users are searched."""
    return s.seen.select("user_id").distinct().where("user_id % 20 = 0")


_NEAR = """, sz AS (SELECT user_id, count(*) AS n FROM seen GROUP BY user_id),
    pairs AS (SELECT user_id, other, both_n / sqrt(x.n * y.n) AS sim FROM (SELECT l.user_id, r.user_id AS other, count(*) AS both_n FROM seen l JOIN seen r ON l.item = r.item AND l.user_id <> r.user_id WHERE l.user_id % 20 = 0 GROUP BY ALL) p JOIN sz x USING (user_id) JOIN sz y ON p.other = y.user_id),
    near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY sim DESC, other) AS r FROM pairs) WHERE r <= 50)"""


@query("j14_t3_neighbours", _NEAR + " SELECT user_id, other, CAST(r AS INTEGER) AS r FROM near")
def j14(s: Star) -> DataFrame:
    return scoring.set_neighbours(s, asked=asked_users(s)).select("user_id", "other", "r")


@query("r6_user_user_history", _NEAR.replace(" WHERE l.user_id % 20 = 0", "") + ", sums AS (SELECT n.user_id, s.item, sum(sim) AS sc FROM near n JOIN seen s ON n.other = s.user_id GROUP BY ALL)" + top_sql("coalesce(sc, 0)", "candidates c LEFT JOIN sums d ON c.user_id = d.user_id AND c.item = d.item"))
def r6(s: Star) -> DataFrame:
    """All users against all users."""
    return top(scoring.user_user_history(s))


_R8 = _POP + ", per AS (SELECT stratum, item, CAST(count(*) AS DOUBLE) AS n FROM train t JOIN users u ON t.user_id = u.user_id GROUP BY ALL)"


@query("r8_segment_popularity", _R8 + top_sql("CASE WHEN u.stratum IS NULL THEN coalesce(p.n, 0) ELSE coalesce(q.n, 0) END", "candidates c LEFT JOIN users u ON c.user_id = u.user_id LEFT JOIN pop p ON c.item = p.item LEFT JOIN per q ON q.stratum = u.stratum AND q.item = c.item"))
def r8(s: Star) -> DataFrame:
    return top(scoring.segment_popularity(s, strata(s)))


@query("r9_provider_affinity", ", sums AS (SELECT user_id, b.item, CAST(sum(n) AS DOUBLE) AS sc FROM (SELECT user_id, provider_id, count(*) AS n FROM train GROUP BY ALL) m JOIN (SELECT DISTINCT item, provider_id FROM train) b ON m.provider_id = b.provider_id GROUP BY ALL)" + top_sql("coalesce(sc, 0)", "candidates c LEFT JOIN sums d ON c.user_id = d.user_id AND c.item = d.item"))
def r9(s: Star) -> DataFrame:
    return top(scoring.provider_affinity(s))


_FALL = _POP + """, q0 AS (SELECT i.item, category, position, coalesce(n, 0) AS n, rating FROM items i LEFT JOIN pop p ON i.item = p.item),
    q1 AS (SELECT *, round(0.5 * CASE WHEN max(n) OVER () - min(n) OVER () < 1e-12 THEN 0 ELSE (n - min(n) OVER ()) / (max(n) OVER () - min(n) OVER ()) END
      + 0.5 * CASE WHEN max(rating) OVER () - min(rating) OVER () < 1e-12 THEN 0 ELSE (rating - min(rating) OVER ()) / (max(rating) OVER () - min(rating) OVER ()) END, 9) AS quality FROM q0),
    fall AS (SELECT *, CAST(row_number() OVER (PARTITION BY category ORDER BY quality DESC, position) - 1 AS INTEGER) AS rk FROM q1)"""


@query("w4_rank_in_category", _FALL + " SELECT item, category, rk AS rank, round(quality, 6) AS quality FROM fall")
def w4(s: Star) -> DataFrame:
    return scoring.fallback_items(s).select("item", "category", "rank", F.round("quality", 6).alias("quality"))


@query("w5_popularity_rank", _POP + " SELECT i.item, CAST(row_number() OVER (ORDER BY coalesce(n, 0) DESC, position) - 1 AS INTEGER) AS rank FROM items i LEFT JOIN pop p ON i.item = p.item")
def w5(s: Star) -> DataFrame:
    rows = s.items.join(scoring.popularity(s.train), "item", "left")
    return rows.select("item", (F.row_number().over(Window.orderBy(F.desc(F.coalesce("n", F.lit(0))), "position")) - 1).alias("rank"))


@query("r10_diversified_fallback", _FALL + top_sql("f.quality - f.rk", "candidates c JOIN fall f ON c.item = f.item"))
def r10(s: Star) -> DataFrame:
    return top(scoring.diversified_fallback(s))


_PREF = """, cn AS (SELECT user_id, category, count(*) AS n FROM train GROUP BY ALL), tot AS (SELECT user_id, count(*) AS total, avg(level) AS depth FROM train GROUP BY user_id),
    raw AS (SELECT c.user_id, c.item, c.position, coalesce(n / total, 0) AS share, 1 - abs(level - depth) / 2 AS near FROM candidates c JOIN items i ON c.item = i.item JOIN tot t ON c.user_id = t.user_id LEFT JOIN cn ON cn.user_id = c.user_id AND cn.category = i.category),
    pref AS (SELECT *, CASE WHEN max(share) OVER w - min(share) OVER w < 1e-12 THEN 0 ELSE (share - min(share) OVER w) / (max(share) OVER w - min(share) OVER w) END
      + CASE WHEN max(near) OVER w - min(near) OVER w < 1e-12 THEN 0 ELSE (near - min(near) OVER w) / (max(near) OVER w - min(near) OVER w) END AS sc FROM raw WINDOW w AS (PARTITION BY user_id))"""


@query("r11_w8_preference_match", _PREF + top_sql("sc", "pref c"))
def r11(s: Star) -> DataFrame:
    return top(scoring.preference_match(s))


WEIGHTS = {"popularity": 0.5, "preference": 0.3, "rating": 0.2}


@query(
    "r12_hybrid",
    _PREF
    + _POP
    + """, comp AS (SELECT user_id, item, position, 'popularity' AS component, 0.5 AS w, (SELECT coalesce(max(n), 0) FROM pop p WHERE p.item = c.item) AS s FROM candidates c
      UNION ALL SELECT user_id, item, position, 'preference', 0.3, sc FROM pref UNION ALL SELECT c.user_id, c.item, c.position, 'rating', 0.2, rating FROM candidates c JOIN items i ON c.item = i.item),
      part AS (SELECT user_id, item, position, round(CAST(w AS DOUBLE) * CASE WHEN max(s) OVER v - min(s) OVER v < 1e-12 THEN 0 ELSE (s - min(s) OVER v) / (max(s) OVER v - min(s) OVER v) END, 9) AS part FROM comp WINDOW v AS (PARTITION BY user_id, component)),
      total AS (SELECT user_id, item, position, sum(part) AS sc FROM part GROUP BY ALL)"""
    + top_sql("sc", "total c"),
)
def r12(s: Star) -> DataFrame:
    return top(scoring.hybrid({"popularity": scoring.global_popularity(s), "preference": scoring.preference_match(s), "rating": scoring.rating(s)}, WEIGHTS))


def deployed(s: Star) -> DataFrame:
    """The router: preference for one item, segment popularity for more."""
    by_segment = scoring.segment_popularity(s, strata(s))
    return scoring.tiered(s, {"minimal": scoring.preference_match(s), "moderate": by_segment, "rich": by_segment})


_TIERED = (
    _PREF
    + _R8.replace(", pop AS", ", pop AS", 1)
    + """, hist AS (SELECT user_id, count(*) AS h FROM seen GROUP BY user_id),
      routed AS (SELECT c.user_id, c.item, c.position, CASE WHEN h = 1 THEN c.sc WHEN u.stratum IS NULL THEN coalesce(p.n, 0) ELSE coalesce(q.n, 0) END AS sc
        FROM pref c JOIN hist USING (user_id) LEFT JOIN users u ON c.user_id = u.user_id LEFT JOIN pop p ON c.item = p.item LEFT JOIN per q ON q.stratum = u.stratum AND q.item = c.item)"""
)


@query("r13_tiered", _TIERED + top_sql("sc", "routed c"))
def r13(s: Star) -> DataFrame:
    return top(deployed(s))


@query("p5_filtered_top", _PREF.replace("FROM candidates c JOIN items i ON c.item = i.item", "FROM candidates c JOIN (SELECT * FROM items WHERE category = 'gear') i ON c.item = i.item") + top_sql("sc", "pref c", 3))
def p5(s: Star) -> DataFrame:
    wanted = s.candidates.join(s.items.where("category = 'gear'").select("item"), "item", "left_semi")
    return top(scoring.preference_match(s, wanted), 3)


_HELD = ", held AS (SELECT DISTINCT user_id, item FROM test WHERE user_id IN (SELECT user_id FROM seen) EXCEPT SELECT user_id, item FROM seen)"


@query("j16_evaluation_set", _HELD + " SELECT user_id, CAST(count(*) AS BIGINT) AS n_rel FROM held GROUP BY user_id")
def j16(s: Star) -> DataFrame:
    return metrics.relevant(s).groupBy("user_id").agg(F.count("*").alias("n_rel"))


_RANKED = _POP + _HELD + """, full_rank AS (SELECT c.user_id, c.item, row_number() OVER (PARTITION BY c.user_id ORDER BY coalesce(n, 0) DESC, position) AS rank FROM candidates c LEFT JOIN pop p ON c.item = p.item),
    tg AS (SELECT user_id, count(*) AS n_rel FROM held GROUP BY user_id),
    hit AS (SELECT h.user_id, rank FROM held h JOIN full_rank f ON h.user_id = f.user_id AND h.item = f.item),
    agg AS (SELECT user_id, count(*) FILTER (WHERE rank <= 10) AS hits, sum(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1) END) AS dcg, min(rank) AS first FROM hit GROUP BY user_id),
    pu AS (SELECT tg.user_id, n_rel, coalesce(hits, 0) / 10 AS "precision", least(n_rel, 10) / 10 AS ceiling, coalesce(hits, 0) / n_rel AS recall, CASE WHEN coalesce(hits, 0) > 0 THEN 1 ELSE 0 END AS hit,
      coalesce(dcg, 0) / list_sum(list_transform(range(1, CAST(least(n_rel, 10) AS BIGINT) + 1), lambda i: 1 / log2(i + 1))) AS ndcg, coalesce(1 / first, 0) AS reciprocal_rank FROM tg LEFT JOIN agg ON tg.user_id = agg.user_id)"""
_NAMES = metrics.METRICS


def popularity_ranking(s: Star) -> DataFrame:
    return scoring.ranked(scoring.global_popularity(s))


@query("m1_m6_m12_per_user", _RANKED + " SELECT user_id, CAST(n_rel AS BIGINT) AS n_rel, " + ", ".join(f'CAST(round("{m}", 6) AS DOUBLE) AS "{m}"' for m in _NAMES) + " FROM pu")
def m1(s: Star) -> DataFrame:
    rows = metrics.per_user(popularity_ranking(s), metrics.relevant(s), TOP)
    return rows.select("user_id", "n_rel", *[F.round(m, 6).cast("double").alias(m) for m in _NAMES])


@query("m7_m8_exposure", _RANKED + ", sh AS (SELECT i.item, CAST(count(f.user_id) AS DOUBLE) AS x FROM items i LEFT JOIN (SELECT * FROM full_rank WHERE rank <= 10 AND user_id IN (SELECT user_id FROM held)) f ON i.item = f.item GROUP BY i.item), r AS (SELECT x, row_number() OVER (ORDER BY x) AS i FROM sh) SELECT round(count(*) FILTER (WHERE x > 0) / count(*), 6) AS coverage, round((2 * sum(i * x) - (count(*) + 1) * sum(x)) / (count(*) * sum(x)), 6) AS gini FROM r")
def m7(s: Star) -> DataFrame:
    users = metrics.relevant(s).select("user_id").distinct()
    return metrics.exposure(popularity_ranking(s), s.items, users, TOP).select(F.round("coverage", 6).alias("coverage"), F.round("gini", 6).alias("gini"))


@query(
    "m11_by_tier",
    _RANKED
    + ", h AS (SELECT user_id, count(*) AS n FROM seen GROUP BY user_id), t AS (SELECT pu.*, CASE WHEN n = 1 THEN 'minimal' WHEN n <= 8 THEN 'moderate' ELSE 'rich' END AS tier FROM pu JOIN h ON pu.user_id = h.user_id) SELECT coalesce(tier, 'all') AS tier, CAST(count(*) AS BIGINT) AS users, "
    + ", ".join(f'round(avg("{m}"), 6) AS "{m}"' for m in _NAMES)
    + ', round(avg("precision") / avg(ceiling), 6) AS precision_vs_ceiling FROM t GROUP BY GROUPING SETS ((), (tier))',
)
def m11(s: Star) -> DataFrame:
    rows = metrics.per_user(popularity_ranking(s), metrics.relevant(s), TOP)
    tiers = s.seen.groupBy("user_id").agg(F.count("*").alias("n")).select("user_id", tier(F.col("n")).alias("tier"))
    by = rows.join(tiers, "user_id").rollup("tier").agg(F.count("*").alias("users"), *[F.round(F.avg(m), 6).alias(m) for m in _NAMES], F.round(F.avg("precision") / F.avg("ceiling"), 6).alias("precision_vs_ceiling"))
    return by.withColumn("tier", F.coalesce("tier", F.lit("all")))


@query("m14_summary", _HELD + " SELECT CAST(count(DISTINCT user_id) AS BIGINT) AS users, CAST(count(*) AS BIGINT) AS held_out, round(count(*) / count(DISTINCT user_id), 6) AS per_user FROM held")
def m14(s: Star) -> DataFrame:
    held = metrics.relevant(s)
    return held.agg(F.count_distinct("user_id").alias("users"), F.count("*").alias("held_out"), F.round(F.count("*") / F.count_distinct("user_id"), 6).alias("per_user"))


@query(
    "m13_leakage_controls",
    _HELD
    + """, tops AS (SELECT user_id, item FROM (SELECT c.user_id, c.item, row_number() OVER (PARTITION BY c.user_id ORDER BY coalesce(n, 0) DESC, position) AS r FROM candidates c LEFT JOIN (SELECT item, count(*) AS n FROM train GROUP BY item) p ON c.item = p.item) WHERE r <= 10),
    k AS (SELECT 'L1_train_before_cut' AS control, (SELECT count(*) FROM train WHERE epoch_us(ts) >= (SELECT cut_80 FROM cuts)) AS n
      UNION ALL SELECT 'L1b_test_after_cut', (SELECT count(*) FROM test WHERE epoch_us(ts) < (SELECT cut_80 FROM cuts))
      UNION ALL SELECT 'L2_no_shared_transaction', (SELECT count(*) FROM train WHERE txn IN (SELECT txn FROM test))
      UNION ALL SELECT 'L3_held_out_unseen', (SELECT count(*) FROM held h JOIN seen s ON h.user_id = s.user_id AND h.item = s.item)
      UNION ALL SELECT 'L5_never_recommends_seen', (SELECT count(*) FROM tops t JOIN seen s ON t.user_id = s.user_id AND t.item = s.item)
      UNION ALL SELECT 'L6_held_out_in_pool', (SELECT count(*) FROM held h WHERE NOT EXISTS (SELECT 1 FROM candidates c WHERE c.user_id = h.user_id AND c.item = h.item)))
    SELECT control, CAST(n AS BIGINT) AS n_broken, n = 0 AS passed FROM k""",
)
def m13(s: Star) -> DataFrame:
    """One row for each control: rows that break it."""
    held = metrics.relevant(s)
    tops = scoring.ranked(scoring.global_popularity(s), TOP)
    checks = {
        "L1_train_before_cut": s.train.where(F.unix_micros(F.col("ts").cast("timestamp")) >= s.cut),
        "L1b_test_after_cut": s.test.where(F.unix_micros(F.col("ts").cast("timestamp")) < s.cut),
        "L2_no_shared_transaction": s.train.join(s.test.select("txn"), "txn", "left_semi"),
        "L3_held_out_unseen": held.join(s.seen, ["user_id", "item"], "left_semi"),
        "L5_never_recommends_seen": metrics.of_user(tops, s.seen),
    }
    rows = [df.agg(F.count("*").alias("n_broken")).select(F.lit(name).alias("control"), "n_broken") for name, df in checks.items()]
    # held-out rows less those that are met among the candidates: the pool itself is neither shuffled nor broadcast
    inside = metrics.of_user(s.candidates.select("user_id", "item"), held).select(F.lit(-1).alias("k"))
    missing = held.select(F.lit(1).alias("k")).union(inside).agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n_broken"))
    out = rows[0]
    for r in [*rows[1:], missing.select(F.lit("L6_held_out_in_pool").alias("control"), "n_broken")]:
        out = out.union(r)
    return out.withColumn("passed", F.col("n_broken") == 0)


FALLBACK_SQL = _FALL
METHOD_SQL = (
    _PREF
    + _R8
    + _HELD
    + """, long AS (SELECT 'global_popularity' AS method, c.user_id, c.item, position, coalesce(n, 0) AS score FROM candidates c LEFT JOIN pop p ON c.item = p.item
      UNION ALL SELECT 'rating', c.user_id, c.item, c.position, rating FROM candidates c JOIN items i ON c.item = i.item
      UNION ALL SELECT 'preference_match', user_id, item, position, sc FROM pref
      UNION ALL SELECT 'segment_popularity', c.user_id, c.item, c.position, CASE WHEN u.stratum IS NULL THEN coalesce(p.n, 0) ELSE coalesce(q.n, 0) END FROM candidates c LEFT JOIN users u ON c.user_id = u.user_id LEFT JOIN pop p ON c.item = p.item LEFT JOIN per q ON q.stratum = u.stratum AND q.item = c.item),
    tops AS (SELECT method, user_id, item FROM (SELECT *, row_number() OVER (PARTITION BY method, user_id ORDER BY round(score, 9) DESC, position) AS r FROM long) WHERE r <= 10),
    methods AS (SELECT method, count(DISTINCT t.user_id) / (SELECT count(DISTINCT user_id) FROM held) AS hit_rate FROM tops t JOIN held h ON t.user_id = h.user_id AND t.item = h.item GROUP BY method)"""
)


def method_table(s: Star) -> DataFrame:
    """Rows (method, hit_rate) of methods with a hit: each is ranked by itself, so a task sorts one method's candidates, and none is shuffled."""
    methods = {"global_popularity": scoring.global_popularity(s), "rating": scoring.rating(s), "preference_match": scoring.preference_match(s), "segment_popularity": scoring.segment_popularity(s, strata(s))}
    held = metrics.relevant(s)
    hits = None
    for name, scores in methods.items():
        found = metrics.of_user(scoring.ranked(scores, TOP).select("user_id", "item"), held).agg(F.count_distinct("user_id").alias("with_hit"))
        row = found.where("with_hit > 0").select(F.lit(name).alias("method"), "with_hit")
        hits = row if hits is None else hits.unionByName(row)
    users = held.agg(F.count_distinct("user_id").alias("users"))
    return hits.join(F.broadcast(users)).select("method", (F.col("with_hit") / F.col("users")).alias("hit_rate"))


@query("m9_w10_lift_and_rank", METHOD_SQL + " SELECT method, round(hit_rate, 6) AS hit_rate, round(hit_rate / (SELECT hit_rate FROM methods WHERE method = 'global_popularity'), 6) AS lift, CAST(row_number() OVER (ORDER BY hit_rate DESC, method) AS INTEGER) AS rank FROM methods")
def m9(s: Star) -> DataFrame:
    table = method_table(s)
    base = table.where("method = 'global_popularity'").select(F.col("hit_rate").alias("base"))
    lift = F.when(F.col("base") > 0, F.col("hit_rate") / F.col("base"))
    return table.join(F.broadcast(base)).select("method", F.round("hit_rate", 6).alias("hit_rate"), F.round(lift, 6).alias("lift"), F.row_number().over(Window.orderBy(F.desc("hit_rate"), "method")).alias("rank"))
