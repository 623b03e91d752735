"""Per-user features of an interaction window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segrec.functions.columns import share_or_zero
from segrec.operators.facts import CATEGORIES, micros

DAY = 86_400_000_000
NUMERIC = (
    "total_courses", "diversity_score", "avg_per_category", "activity_span_days", "frequency", "avg_rating", "category_entropy",
    "top_category_share", "avg_spend", "total_spend", "diversity_ratio", "depth_index", "free_ratio", "recency_days", "first_days", "n_providers", "loyalty",
)


def category_counts(interactions: DataFrame) -> DataFrame:
    """Rows (user_id, category, n): the sub-aggregate that entropy, shares and top share have in common."""
    return interactions.groupBy("user_id", "category").agg(F.count("*").alias("n"))


def category_profile(interactions: DataFrame) -> DataFrame:
    """One share column for each category, rows sum to 1."""
    wide = interactions.groupBy("user_id").pivot("category", list(CATEGORIES)).count().fillna(0)
    total = sum((F.col(c) for c in CATEGORIES[1:]), F.col(CATEGORIES[0]))
    return wide.select("user_id", *[share_or_zero(F.col(c), total).alias(f"share_{c}") for c in CATEGORIES])


def user_features(interactions: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """One row for each user of the window; recency counts from the window's last date.

    An interaction without a user is left out. Users without interactions have no row.
    """
    rows = interactions.where("user_id IS NOT NULL")
    reference = rows.agg(F.max(micros("ts")).alias("now"))
    count = F.count("*")
    main = rows.groupBy("user_id").agg(
        count.alias("total_courses"),
        F.count_distinct("category").alias("diversity_score"),
        F.min(micros("ts")).alias("first"),
        F.max(micros("ts")).alias("last"),
        F.mode("category", True).alias("preferred_category"),
        F.mode("level", True).alias("preferred_level"),
        F.avg("rating").alias("avg_rating"),
        F.avg("amount").alias("avg_spend"),
        F.sum("amount").alias("total_spend"),
        F.avg("level").alias("depth_index"),
        F.avg("is_free").alias("free_ratio"),
        F.count_distinct("provider_id").alias("n_providers"),
    )
    shares = category_counts(rows).withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("user_id")))
    spread = shares.groupBy("user_id").agg(F.abs(F.sum(F.col("p") * F.log2("p"))).alias("category_entropy"), F.max("p").alias("top_category_share"))
    span = F.floor((F.col("last") - F.col("first")) / DAY)
    wide = (
        main.join(F.broadcast(reference))  # one row
        .withColumns(
            {
                "avg_per_category": F.col("total_courses") / F.col("diversity_score"),
                "activity_span_days": span,
                "frequency": F.col("total_courses") / (span + 1),
                "diversity_ratio": F.col("diversity_score") / F.col("total_courses"),
                "recency_days": F.floor((F.col("now") - F.col("last")) / DAY),
                "first_days": F.floor((F.col("now") - F.col("first")) / DAY),
                "loyalty": 1 - F.col("n_providers") / F.col("total_courses"),
            }
        )
        .drop("first", "last", "now")
        .join(spread, "user_id")
        .join(category_profile(rows), "user_id")
    )
    return wide.join(users, "user_id", "left") if users is not None else wide


def require_rows(interactions: DataFrame) -> DataFrame:
    """The frame itself, or an error if it is empty."""
    if interactions.isEmpty():
        raise ValueError("features need at least one interaction")
    return interactions
