"""Queries over statistical tests, nulls and resampling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segrec.functions.columns import tier
from segrec.operators import metrics, scoring, stats
from segrec.operators.facts import Star
from segrec.operators.features import NUMERIC, user_features
from segrec.plans.features import ordered
from segrec.plans.methods import COMPONENT_SQL, METRIC_SQL
from segrec.plans.ranking import strata
from segrec.plans.registry import query
from segrec.sources.scratch import stored

_POP = ", pop AS (SELECT item, count(*) AS n FROM interactions GROUP BY item)"


@query("st1_chi_square_uniform", _POP + " SELECT round(sum(n * n) * count(*) / sum(n) - sum(n), 5) AS statistic, CAST(count(*) - 1 AS BIGINT) AS dof FROM pop")
def st1(s: Star) -> DataFrame:
    counts = s.interactions.groupBy("item").agg(F.count("*").alias("n"))
    return stats.chi_square_uniform(counts, "n").select(F.round("statistic", 5).alias("statistic"), "dof")


@query(
    "st2_chi_square_independence",
    "WITH b AS (SELECT o_orderpriority AS a, o_orderstatus AS b, count(*) AS n FROM orders GROUP BY ALL), r AS (SELECT a, sum(n) AS r FROM b GROUP BY a), c AS (SELECT b, sum(n) AS c FROM b GROUP BY b) SELECT round((SELECT sum(n) FROM b) * (sum(n * n / (r * c)) - 1), 5) AS statistic, CAST(((SELECT count(*) FROM r) - 1) * ((SELECT count(*) FROM c) - 1) AS BIGINT) AS dof FROM b JOIN r USING (a) JOIN c USING (b)",
    base=False,
)
def st2(s: Star) -> DataFrame:
    return stats.chi_square_independence(s.table("orders"), "o_orderpriority", "o_orderstatus").select(F.round("statistic", 5).alias("statistic"), "dof")


@query("st2_labels_2x2", "WITH b AS (SELECT quality AS a, toxic AS b, count(*) AS n FROM labels GROUP BY ALL), r AS (SELECT a, sum(n) AS r FROM b GROUP BY a), c AS (SELECT b, sum(n) AS c FROM b GROUP BY b) SELECT round((SELECT sum(n) FROM b) * (sum(n * n / (r * c)) - 1), 5) AS statistic, CAST(((SELECT count(*) FROM r) - 1) * ((SELECT count(*) FROM c) - 1) AS BIGINT) AS dof FROM b JOIN r USING (a) JOIN c USING (b)", base=False)
def st2_labels(s: Star) -> DataFrame:
    labels = s.spark.read.parquet(f"{s.sf_dir}/labels.parquet")
    return stats.chi_square_independence(labels, "quality", "toxic").select(F.round("statistic", 5).alias("statistic"), "dof")


@query("st2_p_values")
def st2_p(s: Star) -> DataFrame:
    """Statistics with p-values of the contingency tables."""
    rows = []
    for a, b in (("o_orderpriority", "o_orderstatus"),):
        r = stats.chi_square_independence(s.table("orders"), a, b).first()
        rows.append((a, b, float(r["statistic"]), int(r["dof"]), stats.chi_square_p(r["statistic"], r["dof"])))
    return s.spark.createDataFrame(rows, "a string, b string, statistic double, dof int, p double")


_SLOPES = ", o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, txn) AS r FROM interactions), sl AS (SELECT user_id, regr_slope(level, r) AS slope FROM o GROUP BY user_id HAVING count(*) >= 3 AND count(DISTINCT level) >= 2)"


@query("st3_one_sample_t", _SLOPES + " SELECT CAST(count(*) AS BIGINT) AS n, round(avg(slope), 6) AS mean, round(avg(slope) / (stddev_samp(slope) / sqrt(count(*))), 5) AS t FROM sl")
def st3(s: Star) -> DataFrame:
    by = ordered(s).groupBy("user_id").agg(F.regr_slope("level", "r").alias("slope"), F.count("*").alias("n"), F.count_distinct("level").alias("levels"))
    return stats.one_sample_t(by.where("n >= 3 AND levels >= 2"), "slope").select("n", F.round("mean", 6).alias("mean"), F.round("t", 5).alias("t"))


@query("st3_p_value")
def st3_p(s: Star) -> DataFrame:
    r = st3(s).first()
    return s.spark.createDataFrame([(float(r["t"]), stats.student_p(s.spark, r["t"], r["n"] - 1))], "t double, p double")


def _sizes(s: Star) -> DataFrame:
    return s.interactions.groupBy("user_id").agg(F.count_distinct("item").alias("n"))


def _sets(s: Star) -> DataFrame:
    return s.interactions.where("user_id IS NOT NULL").select("user_id", "item").distinct()


_ST4 = ", g AS (SELECT DISTINCT user_id, item FROM interactions WHERE user_id IS NOT NULL), x AS (SELECT user_id, category, level, is_free FROM g JOIN items USING (item)), c AS (SELECT user_id, category, count(*) AS n FROM x GROUP BY ALL), u AS (SELECT user_id, count(*) AS d, max(n) / sum(n) AS top FROM c GROUP BY user_id), v AS (SELECT user_id, count(DISTINCT level) AS levels, avg(is_free) AS free FROM x GROUP BY user_id)"


@query("st4_observed_statistics", _ST4 + " SELECT round(avg(d), 6) AS distinct_categories, round(avg(top), 6) AS top_category_share, round(avg(levels), 6) AS distinct_levels, round(avg(free), 6) AS free_share FROM u JOIN v USING (user_id)")
def st4_observed(s: Star) -> DataFrame:
    return stats.preference_statistics(_sets(s), s.items).select(*[F.round(c, 6).alias(c) for c in stats.PREFERENCE])


@query("st4_preference_null")
def st4(s: Star) -> DataFrame:
    """The four statistics of users' items against 200 redraws of their histories by popularity."""
    sets = _sets(s)
    seen = stats.preference_statistics(sets, s.items).first()
    null = stored(stats.preference_null(sets, s.items, scoring.popularity(s.interactions).withColumnRenamed("n", "w")), "null")
    rows = [stats.permutation_summary(float(seen[c] or 0.0), null.where(F.col("statistic") == c), "value").select(F.lit(c).alias("statistic"), "*") for c in stats.PREFERENCE]
    return reduce(DataFrame.unionByName, rows)


@query("st5_observed_ratio", ", u AS (SELECT count(DISTINCT provider_id) / count(*) AS x FROM interactions WHERE user_id IS NOT NULL GROUP BY user_id HAVING count(*) >= 2) SELECT round(avg(x), 6) AS ratio FROM u")
def st5_observed(s: Star) -> DataFrame:
    return stats.provider_null(s.interactions.where("user_id IS NOT NULL"), 1)[0].select(F.round("ratio", 6).alias("ratio"))


@query("st5_provider_null")
def st5(s: Star) -> DataFrame:
    """Distinct providers over rows of a user, against 30 redraws among the providers of each row's item."""
    observed, null = stats.provider_null(s.kept.where("user_id IS NOT NULL"), 30)
    return stats.permutation_summary(float(observed.first()["ratio"] or 0.0), null, "ratio")


@query(
    "st6_provider_pool_hit",
    """, o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, txn) AS r, count(*) OVER (PARTITION BY user_id) AS size FROM interactions), b AS (SELECT DISTINCT provider_id, item FROM interactions),
    pool AS (SELECT DISTINCT user_id, b.item FROM (SELECT DISTINCT user_id, provider_id FROM o WHERE r < size) x JOIN b ON x.provider_id = b.provider_id), last AS (SELECT user_id, item AS last FROM o WHERE r = size AND size > 1),
    m AS (SELECT l.user_id, max(CASE WHEN item = last THEN 1 ELSE 0 END) AS hit, count(*) / 64 AS chance FROM last l JOIN pool p ON l.user_id = p.user_id GROUP BY l.user_id)
    SELECT round(avg(hit), 6) AS hit_rate, round(avg(chance), 6) AS chance, round(avg(hit) / avg(chance), 6) AS lift FROM m""",
)
def st6(s: Star) -> DataFrame:
    """Share of users whose last item comes from the pool of their earlier providers, and the pool's share of the catalogue."""
    return _pool_hits(ordered(s, s.kept), s.kept.select("provider_id", "position"), 64)


def _pool_hits(o: DataFrame, met: DataFrame, items: int) -> DataFrame:
    """One row (hit_rate, chance, lift) of ``ordered`` rows, against the pools of the providers of ``met`` (provider_id, position).

    A provider's items, and a user's pool, are bits at the items' positions, 64 to a number: neither is a row for each item.
    """
    word, bit = F.floor(F.col("position") / 64), F.expr("shiftleft(1L, CAST(pmod(position, 64) AS INT))")
    bridge = met.groupBy("provider_id", word.alias("word")).agg(F.bit_or(bit).alias("bits"))
    pool = o.where("r < size").select("user_id", "provider_id").distinct().join(bridge, "provider_id").groupBy("user_id", "word").agg(F.bit_or("bits").alias("bits"))
    last = o.where("r = size AND size > 1").select("user_id", word.alias("last"), bit.alias("bit"))
    found = (F.col("word") == F.col("last")) & (F.col("bits").bitwiseAND(F.col("bit")) != 0)
    met = last.join(pool, "user_id").groupBy("user_id").agg(F.max(found.cast("int")).alias("hit"), (F.sum(F.bit_count("bits")) / items).alias("chance"))
    return met.agg(F.round(F.avg("hit"), 6).alias("hit_rate"), F.round(F.avg("chance"), 6).alias("chance"), F.round(F.avg("hit") / F.avg("chance"), 6).alias("lift"))


def _ndcg(s: Star, scores: DataFrame) -> DataFrame:
    return metrics.per_user(scoring.ranked(scores), metrics.relevant(s), 10).select("user_id", "ndcg")


@query("st7_j19_paired_bootstrap")
def st7(s: Star) -> DataFrame:
    return stats.paired_bootstrap(_ndcg(s, scoring.global_popularity(s)), _ndcg(s, scoring.random_score(s)), "user_id", "ndcg", 2000)


@query("st8_group_gap")
def st8(s: Star) -> DataFrame:
    rows = _ndcg(s, scoring.global_popularity(s)).join(s.users, "user_id")
    return stats.group_gap(rows, "user_id", "stratum", "ndcg", "BUILDING", "MACHINERY", 2000)


@query("st7_st8_points", METRIC_SQL("pop_n", "rating") + """, d AS (SELECT user_id, max(CASE WHEN method = 'pop_n' THEN ndcg END) AS a, max(CASE WHEN method = 'rating' THEN ndcg END) AS b FROM pm GROUP BY user_id)
    SELECT CAST(count(*) AS BIGINT) AS users, round(avg(a - b), 6) AS difference, round(avg(a) FILTER (WHERE stratum = 'BUILDING') - avg(a) FILTER (WHERE stratum = 'MACHINERY'), 6) AS gap FROM d LEFT JOIN users USING (user_id)""")
def st7_points(s: Star) -> DataFrame:
    """The point estimates of a paired and an unpaired difference."""
    a, b = _ndcg(s, scoring.global_popularity(s)), _ndcg(s, scoring.rating(s)).withColumnRenamed("ndcg", "other")
    rows = a.join(b, "user_id").join(s.users, "user_id", "left")
    of = lambda g: F.avg(F.when(F.col("stratum") == g, F.col("ndcg")))
    return rows.agg(F.count("*").alias("users"), F.round(F.avg(F.col("ndcg") - F.col("other")), 6).alias("difference"), F.round(of("BUILDING") - of("MACHINERY"), 6).alias("gap"))


@query("st9_simplex_weights")
def st9(s: Star) -> DataFrame:
    """Draws of weights over the catalogue's categories."""
    names = [r["category"] for r in s.items.select("category").distinct().orderBy("category").collect()]
    rows = [(i, n, w) for i, d in enumerate(stats.simplex_weights(names, 20)) for n, w in d.items()] if names else []
    return s.spark.createDataFrame(rows, "draw int, name string, weight double")


COMPONENTS = ["content_based", "user_user_profile", "segment_popularity", "rating", "preference_match", "item_item"]
_DRAWS = stats.simplex_weights(COMPONENTS, 400)
_SCALED = ", scaled AS (SELECT user_id, item, position, " + ", ".join(f"CASE WHEN max({n}) OVER w - min({n}) OVER w < 1e-12 THEN 0 ELSE ({n} - min({n}) OVER w) / (max({n}) OVER w - min({n}) OVER w) END AS {n}" for n in COMPONENTS) + " FROM comp WINDOW w AS (PARTITION BY user_id))"
_WEIGHTS = ", wt(draw, " + ", ".join(COMPONENTS) + ") AS (VALUES " + ", ".join("(" + ", ".join([str(i), *[f"{d[n]!r}::DOUBLE" for n in COMPONENTS]]) + ")" for i, d in enumerate(_DRAWS)) + ")"


def _search_sql(name: str, weights: str) -> str:
    """CTE ``name`` (draw, hits, hit_rate, ndcg, items_shown) of the weights in a frame."""
    total = " + ".join(f"scaled.{n} * w.{n}" for n in COMPONENTS)
    return f""", {name}_rk AS (SELECT draw, user_id, item, row_number() OVER (PARTITION BY draw, user_id ORDER BY round({total}, 9) DESC, position) AS k FROM scaled, {weights} w WHERE user_id IN (SELECT user_id FROM held)),
    {name}_u AS (SELECT r.draw, r.user_id, count(h.item) FILTER (WHERE k <= 10) AS hits, coalesce(sum(1 / log2(k + 1)) FILTER (WHERE k <= 10 AND h.item IS NOT NULL), 0) AS dcg FROM {name}_rk r LEFT JOIN held h ON h.user_id = r.user_id AND h.item = r.item GROUP BY ALL),
    {name}_s AS (SELECT draw, count(DISTINCT item) AS items_shown FROM {name}_rk WHERE k <= 10 GROUP BY draw),
    {name} AS (SELECT u.draw, CAST(sum(hits) AS BIGINT) AS hits, avg(CASE WHEN hits > 0 THEN 1 ELSE 0 END) AS hit_rate,
      avg(dcg / list_sum(list_transform(range(1, CAST(least(n_rel, 10) AS BIGINT) + 1), lambda i: 1 / log2(i + 1)))) AS ndcg, CAST(max(items_shown) AS INTEGER) AS items_shown
      FROM {name}_u u JOIN tg USING (user_id) JOIN {name}_s s ON s.draw = u.draw GROUP BY u.draw)"""


_SEARCH = COMPONENT_SQL + _SCALED + _WEIGHTS + _search_sql("found", "wt")


def _packed(s: Star) -> DataFrame:
    """All components' scaled scores by user, written once for several searches."""
    f = user_features(s.train, s.users)
    parts = {
        "content_based": scoring.content_based(s), "user_user_profile": scoring.user_user_profile(s, f, [*NUMERIC, "balance"]), "segment_popularity": scoring.segment_popularity(s, strata(s)),
        "rating": scoring.rating(s), "preference_match": scoring.preference_match(s), "item_item": scoring.item_item(s),
    }
    return stored(stats.packed_candidates(parts, metrics.placed(s), True), "candidates")


def _told(rows: DataFrame) -> list:
    return ["hits", F.round("hit_rate", 6).alias("hit_rate"), F.round("ndcg", 6).alias("ndcg"), "items_shown"]


@query("st10_weight_search", _SEARCH + " SELECT draw, hits, round(hit_rate, 6) AS hit_rate, round(ndcg, 6) AS ndcg, items_shown FROM found")
def st10(s: Star) -> DataFrame:
    """400 draws of weights over six components, measured on the test window."""
    rows = stats.search_weights(_packed(s), COMPONENTS, _DRAWS, 10, len(s.catalogue))
    return rows.select("draw", *_told(rows))


@query(
    "st10_ablation",
    _SEARCH
    + ", best AS (SELECT wt.* FROM wt JOIN found USING (draw) ORDER BY round(ndcg, 9) DESC, draw LIMIT 1), without AS ("
    + " UNION ALL ".join(f"SELECT {i} AS draw, " + ", ".join("0::DOUBLE AS " + n if n == m else n for n in COMPONENTS) + f" FROM best WHERE {' + '.join(n for n in COMPONENTS if n != m)} > 0" for i, m in enumerate(COMPONENTS))
    + ")"
    + _search_sql("less", "without")
    + " SELECT removed, round(weight, 6) AS weight, hits, round(hit_rate, 6) AS hit_rate, round(ndcg, 6) AS ndcg, items_shown, round(ndcg - (SELECT max(ndcg) FROM found), 6) + 0.0 AS delta FROM less JOIN ("
    + " UNION ALL ".join(f"SELECT {i} AS draw, '{n}' AS removed, {n} AS weight FROM best" for i, n in enumerate(COMPONENTS))
    + ") USING (draw)",
)
def st10_ablation(s: Star) -> DataFrame:
    """The best draw without each component in turn."""
    rows = _packed(s)
    search = stats.search_weights(rows, COMPONENTS, _DRAWS, 10, len(s.catalogue))
    best = search.orderBy(F.desc(F.round("ndcg", 9)), "draw").first()
    weights = _DRAWS[best["draw"] if best else 0]
    without = stats.ablations(weights)
    found = stats.search_weights(rows, COMPONENTS, list(without.values()), 10, len(s.catalogue))
    told = s.spark.createDataFrame([(i, n, weights[n]) for i, n in enumerate(without)], "draw int, removed string, weight double")
    return found.join(F.broadcast(told), "draw").select("removed", F.round("weight", 6).alias("weight"), *_told(found), (F.round(F.col("ndcg") - F.lit(best["ndcg"] if best else None), 6) + 0.0).alias("delta"))


@query("st11_hash_sample")
def st11(s: Star) -> DataFrame:
    return stats.shuffled(s.users, "user_id", 3, 200)


_HITS = _POP.replace("FROM interactions", "FROM train") + ", held AS (SELECT DISTINCT user_id, item FROM test WHERE user_id IN (SELECT user_id FROM seen) EXCEPT SELECT user_id, item FROM seen), fr AS (SELECT c.user_id, c.item, row_number() OVER (PARTITION BY c.user_id ORDER BY coalesce(n, 0) DESC, position) AS rank FROM candidates c LEFT JOIN pop p ON c.item = p.item), pu AS (SELECT h.user_id, count(*) AS n_rel, max(CASE WHEN rank <= 10 THEN 1 ELSE 0 END) AS hit FROM held h LEFT JOIN fr ON h.user_id = fr.user_id AND h.item = fr.item GROUP BY h.user_id)"


@query("a36_error_analysis", _HITS + " SELECT CAST(n_rel AS BIGINT) AS n_rel, CAST(count(*) AS BIGINT) AS users, round(avg(hit), 6) AS hit_rate FROM pu GROUP BY n_rel")
def a36(s: Star) -> DataFrame:
    rows = metrics.per_user(scoring.ranked(scoring.global_popularity(s)), metrics.relevant(s), 10)
    return rows.groupBy("n_rel").agg(F.count("*").alias("users"), F.round(F.avg("hit"), 6).alias("hit_rate"))


@query("a30_accumulated", _HITS + " SELECT round(avg(hit), 6) AS hit_rate, CAST(count(*) AS BIGINT) AS users, CAST(sum(n_rel) AS BIGINT) AS held_out FROM pu")
def a30(s: Star) -> DataFrame:
    rows = metrics.per_user(scoring.ranked(scoring.global_popularity(s)), metrics.relevant(s), 10)
    return rows.agg(F.round(F.avg("hit"), 6).alias("hit_rate"), F.count("*").alias("users"), F.sum("n_rel").alias("held_out"))


@query(
    "a36_by_aspect",
    _HITS
    + """, hs AS (SELECT user_id, count(*) AS n FROM seen GROUP BY user_id), e AS (SELECT pu.*, n, CASE WHEN n = 1 THEN 'minimal' WHEN n <= 8 THEN 'moderate' ELSE 'rich' END AS tier FROM pu JOIN hs ON hs.user_id = pu.user_id),
    l AS (SELECT 'targets' AS aspect, n_rel::VARCHAR AS value, hit FROM e UNION ALL SELECT 'history', n::VARCHAR, hit FROM e UNION ALL SELECT 'tier', tier, hit FROM e)
    SELECT aspect, value, CAST(count(*) AS BIGINT) AS users, round(avg(hit), 6) AS hit_rate FROM l GROUP BY aspect, value""",
)
def a36_aspects(s: Star) -> DataFrame:
    """Hit rate by number of targets, by length of history and by tier, from one row a user."""
    rows = metrics.per_user(scoring.ranked(scoring.global_popularity(s)), metrics.relevant(s), 10)
    rows = rows.join(s.seen.groupBy("user_id").agg(F.count("*").alias("n")), "user_id")
    aspects = {"targets": F.col("n_rel").cast("string"), "history": F.col("n").cast("string"), "tier": tier(F.col("n"))}
    long = rows.select("hit", F.explode(F.array(*[F.struct(F.lit(a).alias("aspect"), v.alias("value")) for a, v in aspects.items()])).alias("e"))
    return long.groupBy("e.aspect", "e.value").agg(F.count("*").alias("users"), F.round(F.avg("hit"), 6).alias("hit_rate"))
