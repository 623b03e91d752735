"""Ranking metrics over full rankings (user_id, item, rank) and held-out items (user_id, item)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def relevant(star) -> DataFrame:
    """Held-out items of users of the training window, without items that they had met."""
    held = star.test.select("user_id", "item").distinct()
    return held.join(star.seen.select("user_id").distinct(), "user_id", "left_semi").join(star.seen, ["user_id", "item"], "left_anti")


def placed(star) -> DataFrame:
    """``relevant`` with the items' positions, from the catalogue."""
    return relevant(star).join(F.broadcast(star.items.select("item", "position")), "item")


def of_user(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """``rows`` that have their (user_id, item) in ``pairs``, once for each time it is there.

    A user's pairs are one array, joined by user: rows made of candidates stay in the partitions that made them, and are
    never broadcast, as their number, which no estimate of Spark's tells, is the users' times the catalogue's.
    """
    wanted = pairs.where("item IS NOT NULL").groupBy("user_id").agg(F.collect_list("item").alias("__wanted"))
    met = rows.join(wanted.hint("merge"), "user_id")
    return met.withColumn("__met", F.explode(F.filter("__wanted", lambda x: x == F.col("item")))).select(*rows.columns)


def per_user(ranking: DataFrame, held_out: DataFrame, k: int) -> DataFrame:
    """One row for each user with a held-out item: precision, ceiling, recall, hit, ndcg and reciprocal rank (over the full list)."""
    targets = held_out.groupBy("user_id").agg(F.count("*").alias("n_rel"))
    hits = of_user(ranking.select("user_id", "item", "rank"), held_out)
    within = F.col("rank") <= k
    found = hits.groupBy("user_id").agg(
        F.count(F.when(within, 1)).alias("hits"), F.sum(F.when(within, 1 / F.log2(F.col("rank") + 1))).alias("dcg"), F.min("rank").alias("first")
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n_rel", F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    n = F.coalesce("hits", F.lit(0))
    return targets.hint("merge").join(found, "user_id", "left").select(
        "user_id",
        "n_rel",
        (n / k).alias("precision"),
        (F.least("n_rel", F.lit(k)) / k).alias("ceiling"),
        (n / F.col("n_rel")).alias("recall"),
        (n > 0).cast("int").alias("hit"),
        (F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"),
    )


METRICS = ("precision", "ceiling", "recall", "hit", "ndcg", "reciprocal_rank")


def exposure(ranking: DataFrame, items: DataFrame, users: DataFrame, k: int) -> DataFrame:
    """One row (coverage, gini) of the first k items of the users; items never shown count as 0."""
    shown = ranking.where(F.col("rank") <= k).join(users, "user_id", "left_semi").groupBy("item").agg(F.count("*").alias("n"))
    every = items.select("item").join(shown, "item", "left").select(F.coalesce("n", F.lit(0)).cast("double").alias("x"))
    ranked = every.withColumn("i", F.row_number().over(Window.orderBy("x")))  # one row for each catalogue item
    n, total = F.count("*"), F.sum("x")
    return ranked.agg(
        (F.count(F.when(F.col("x") > 0, 1)) / n).alias("coverage"),
        F.when(F.coalesce(total, F.lit(0.0)) == 0, 0.0).otherwise((2 * F.sum(F.col("i") * F.col("x")) - (n + 1) * total) / (n * total)).alias("gini"),
    )
