"""Explanations of recommendations: facts from data, sentences from facts.

A component's contribution that is 1e-9 or less is left out; the others are told from the largest
down. Phrases quote counted facts; an unknown component gets a neutral phrase.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segrec.operators.facts import Star
from segrec.operators.scoring import fallback_items, star_small

SMALL = 1e-9
NOTHING = "This fills a gap in your list."


def facts(star: Star, rows: DataFrame, segments: DataFrame) -> DataFrame:
    """EX1-EX5 for rows (user_id, item, ...): shared category count, level match, segment rows, category rank, category share."""
    items = star_small(star, star.items.select("item", "category", "level"))
    mine = star.train.groupBy("user_id", "category").agg(F.count("*").alias("shared_category_count"))
    totals = star.train.groupBy("user_id").agg(F.count("*").alias("total"), F.mode("level", True).alias("modal_level"))
    per = star.train.join(segments, "user_id").groupBy("segment", "item").agg(F.count("*").alias("segment_enrollments"))
    told = rows.join(items, "item").join(mine, ["user_id", "category"], "left").join(totals, "user_id", "left").join(segments, "user_id", "left")
    told = told.join(per, ["segment", "item"], "left").join(star_small(star, fallback_items(star).select("item", F.col("rank").alias("category_rank"))), "item", "left")
    shared = F.coalesce("shared_category_count", F.lit(0))
    return told.select(
        *rows.columns,
        "category",
        shared.alias("shared_category_count"),
        F.coalesce(F.col("level") == F.col("modal_level"), F.lit(False)).alias("level_match"),
        F.coalesce("segment_enrollments", F.lit(0)).alias("segment_enrollments"),
        "category_rank",
        F.coalesce(shared / F.col("total"), F.lit(0.0)).alias("category_share"),
    )


def _phrase(component: Column, row) -> Column:
    n = row("shared_category_count")
    preference = F.when(n > 0, F.format_string("you took %d items in %s", n, row("category"))).otherwise(F.format_string("it opens %s", row("category")))
    return (
        F.when(component == "segment_popularity", F.format_string("%d enrollments among people like you", row("segment_enrollments")))
        .when(component == "preference_match", preference)
        .when(component == "diversified_fallback", F.format_string("number %d in %s", row("category_rank") + 1, row("category")))
        .when(component == "rating", F.lit("it is rated well"))
        .otherwise("it fits your history")
    )


def sentences(rows: DataFrame) -> DataFrame:
    """Rows with an ``explanation`` from a map ``contributions`` and the facts of each row."""
    told = F.filter(F.map_entries("contributions"), lambda e: e["value"] > SMALL)
    ordered = F.array_sort(told, lambda a, b: F.when(a["value"] > b["value"], -1).when(a["value"] < b["value"], 1).when(a["key"] < b["key"], -1).otherwise(1))
    phrases = F.transform(ordered, lambda e: _phrase(e["key"], F.col))
    text = F.when(F.size(phrases) == 0, NOTHING).otherwise(F.concat(F.lit("Recommended because "), F.array_join(phrases, " and "), F.lit(".")))
    return rows.withColumn("explanation", text)


def leading_component(rows: DataFrame) -> DataFrame:
    """Rows (component, n): how often each component contributes most."""
    entry = F.explode(F.map_entries("contributions")).alias("e")
    long = rows.select("user_id", "item", entry).select("user_id", "item", "e.*")
    order = Window.partitionBy("user_id", "item").orderBy(F.desc("value"), "key")
    return long.withColumn("r", F.row_number().over(order)).where("r = 1").groupBy(F.col("key").alias("component")).agg(F.count("*").alias("n"))
