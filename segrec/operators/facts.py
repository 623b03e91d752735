"""The star of interactions: users, items, providers and dated transactions, built from the order tables."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segrec.functions.quantiles import quantiles
from segrec.sources.scan import load
from segrec.sources.scratch import stored

CATEGORIES = ("anvil", "bolt", "gear", "gizmo", "plate", "ring", "rod", "widget")
LEVELS = {"cold": 0, "old": 0, "small": 0, "blue": 1, "new": 1, "red": 1, "hot": 2, "large": 2}
FREE = ("new", "old")
MAX_CATALOGUE = 10_000


def micros(column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp"))


def one_each(rows: DataFrame, key: str, what: str) -> DataFrame:
    """``rows`` as the one-side of a join on ``key``: a key that several rows have raises when it is read; rows without a key are left out.

    The check is part of the plan: rows are counted by the key that the join deals them by anyway.
    """
    others = [c for c in rows.columns if c != key]
    counted = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("__n"), F.any_value(F.struct(*others)).alias("__row"))
    repeated = F.raise_error(F.concat(F.lit(f"{what}: several rows have {key} "), F.col(key).cast("string")))
    return counted.withColumn("__row", F.when(F.col("__n") == 1, F.col("__row")).otherwise(repeated)).select(key, "__row.*")


class Star:
    """Lazy frames over one directory of tables; nothing is read until a result is asked for.

    What has a cut in time takes passes over the interactions before any plan, so these are written once, joined:
    windows, candidates and all scores then read that table, and the base tables are joined once for a star.
    """

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return load(self.spark, self.sf_dir, name)

    @cached_property
    def users(self) -> DataFrame:
        return self.table("customer").select(F.col("c_custkey").alias("user_id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("stratum"))

    @cached_property
    def items(self) -> DataFrame:
        """Catalogue: one row for each item name, with a stable position by name."""
        word = F.split("p_name", " ")
        level = F.lit(2)
        for n in (0, 1):
            level = F.when(F.get(word, F.lit(0)).isin([w for w, k in LEVELS.items() if k == n]), n).otherwise(level)
        rows = self.table("part").where("p_name IS NOT NULL").groupBy("p_name").agg(
            F.round(F.avg("p_retailprice"), 6).alias("price"), F.max("p_size").alias("duration"), F.round(1 + 4.0 * (F.avg("p_size") - 1) / 49, 6).alias("rating")
        )
        return rows.select(
            F.col("p_name").alias("item"),
            F.get(word, F.lit(1)).alias("category"),
            level.alias("level"),
            F.get(word, F.lit(0)).isin(list(FREE)).cast("int").alias("is_free"),
            "price",
            "duration",
            "rating",
            (F.row_number().over(Window.orderBy("p_name")) - 1).alias("position"),
        )

    @cached_property
    def transactions(self) -> DataFrame:
        """First lines of orders, with a synthetic key; null keys are left out."""
        lines = self.table("lineitem").where("l_linenumber = 1 AND l_orderkey IS NOT NULL AND l_partkey IS NOT NULL")
        orders = one_each(self.table("orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_orderstatus"), "o_orderkey", "orders").where("o_custkey IS NOT NULL")
        key = F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", F.date_format("l_shipdate", "yyyyMMdd"), F.round(F.col("l_extendedprice") * 100).cast("bigint"))
        return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
            F.col("o_custkey").alias("user_id"),
            F.col("l_partkey").alias("part_id"),
            F.col("l_suppkey").alias("provider_id"),
            F.col("o_orderdate").alias("ts"),
            F.col("l_extendedprice").alias("amount"),
            F.col("o_orderpriority").alias("priority"),
            F.col("o_orderstatus").alias("status"),
            key.alias("txn"),
        )

    @cached_property
    def interactions(self) -> DataFrame:
        """Fact view: transactions with the item's attributes; every join is many-to-one, and a key that isn't raises."""
        names = one_each(self.table("part").select(F.col("p_partkey").alias("part_id"), F.col("p_name").alias("item")), "part_id", "part").where("item IS NOT NULL")
        return self.transactions.join(names, "part_id").join(self.items, "item").drop("part_id")

    @cached_property
    def kept(self) -> DataFrame:
        """The interactions as a table in the shared folder, which the cuts and all windows read."""
        return stored(self.interactions, "interactions")

    @cached_property
    def cuts(self) -> tuple[float, float]:
        """Date quantiles (0.7, 0.8) of the interactions, in microseconds; 0 without any."""
        found = quantiles(self.kept.select(F.lit("ts").alias("name"), micros("ts").alias("x")), [0.7, 0.8])
        return tuple(found.get("ts", (0.0, 0.0)))

    @cached_property
    def cut(self) -> float:
        return float(self.cuts[1])

    @cached_property
    def train(self) -> DataFrame:
        return self.kept.where(micros("ts") < self.cut)

    @cached_property
    def test(self) -> DataFrame:
        return self.kept.where(micros("ts") >= self.cut)

    @cached_property
    def seen(self) -> DataFrame:
        """Distinct (user_id, item, position) of the training window, written once: most scorers and the candidates read it several times."""
        return stored(self.train.select("user_id", "item", "position").distinct(), "seen")

    @cached_property
    def catalogue(self) -> list[tuple[str, int]]:
        """All (item, position), on the driver; raises beyond ``MAX_CATALOGUE`` items, as all users' candidates are their product with it."""
        rows = self.items.select("item", "position").limit(MAX_CATALOGUE + 1).collect()
        if len(rows) > MAX_CATALOGUE:
            raise ValueError(f"scoring every item for every user takes a catalogue of at most {MAX_CATALOGUE} items")
        return sorted((r["item"], r["position"]) for r in rows)

    @cached_property
    def met(self) -> DataFrame:
        """One row for each user of the training window: the positions it has met."""
        return self.seen.groupBy("user_id").agg(F.collect_set("position").alias("met"))

    def unmet(self, users: DataFrame) -> DataFrame:
        """The candidates of rows of ``met`` with any further columns, exploded in the user's row: what is joined by user is joined before.

        The catalogue is a small, fixed list.
        """
        pairs = F.array(*[F.struct(F.lit(i).alias("item"), F.lit(p).alias("position")) for i, p in self.catalogue])
        others = [c for c in users.columns if c not in ("user_id", "met")]
        return users.select("user_id", "met", *others, F.explode(pairs).alias("c")).where(~F.array_contains("met", F.col("c.position"))).select("user_id", "c.item", "c.position", *others)

    @cached_property
    def candidates(self) -> DataFrame:
        """Every item that a user of the training window hasn't met."""
        return self.unmet(self.met)


#: The same frames in SQL, for the oracle queries.
BASE = """
WITH items AS (
  SELECT *, CAST(row_number() OVER (ORDER BY item) - 1 AS INTEGER) AS position FROM (
    SELECT p_name AS item, split_part(p_name, ' ', 2) AS category,
      CAST(CASE WHEN split_part(p_name, ' ', 1) IN ('cold','old','small') THEN 0 WHEN split_part(p_name, ' ', 1) IN ('blue','new','red') THEN 1 ELSE 2 END AS INTEGER) AS level,
      CAST(CASE WHEN split_part(p_name, ' ', 1) IN ('new','old') THEN 1 ELSE 0 END AS INTEGER) AS is_free,
      round(avg(p_retailprice), 6) AS price, max(p_size) AS duration, round(1 + 4.0 * (avg(p_size) - 1) / 49, 6) AS rating
    FROM part WHERE p_name IS NOT NULL GROUP BY p_name)),
users AS (SELECT c_custkey AS user_id, c_acctbal AS balance, c_mktsegment AS stratum FROM customer),
interactions AS (
  SELECT o_custkey AS user_id, i.item, l_suppkey AS provider_id, o_orderdate AS ts, l_extendedprice AS amount, o_orderpriority AS priority, o_orderstatus AS status,
    concat_ws('-', l_orderkey, l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m%d'), CAST(round(l_extendedprice * 100) AS BIGINT)) AS txn,
    category, level, is_free, price, duration, rating, position
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN items i ON p_name = i.item
  WHERE l_linenumber = 1 AND o_custkey IS NOT NULL),
cuts AS (SELECT quantile_cont(CAST(epoch_us(ts) AS DOUBLE), 0.7) AS cut_70, quantile_cont(CAST(epoch_us(ts) AS DOUBLE), 0.8) AS cut_80 FROM interactions),
train AS (SELECT * FROM interactions WHERE epoch_us(ts) < (SELECT cut_80 FROM cuts)),
test AS (SELECT * FROM interactions WHERE epoch_us(ts) >= (SELECT cut_80 FROM cuts)),
seen AS (SELECT DISTINCT user_id, item, position FROM train),
candidates AS (SELECT u.user_id, i.item, i.position FROM (SELECT DISTINCT user_id FROM seen) u CROSS JOIN items i
  WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.user_id = u.user_id AND s.item = i.item))
"""
