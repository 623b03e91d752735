"""How often two members share a basket, whatever a basket's size.

A basket of more than ``BLOCK`` members is cut into blocks by a hash of the member. Pairs within a block are
made in its row, pairs between two blocks of a basket where these meet, keyed by (basket, block): a basket
that holds every member becomes many small tasks, and no task sees more than two blocks at a time. Counts
are added up before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 512
#: At most this many baskets have their number of blocks broadcast; those beyond hold a like share of the rows at most.
HEAVY = 100_000


def _blocks(sets: DataFrame, basket: str, member: str, block: int) -> DataFrame:
    """Rows (basket, block, blocks, members) of the distinct rows (basket, member)."""
    sizes = sets.groupBy(F.col(basket).alias("basket")).agg(F.count("*").alias("n")).where(F.col("n") > block)
    cut = F.ceil(F.col("n") / block).cast("int")
    most = max(block, sets.count() // HEAVY)
    heavy = F.broadcast(sizes.where(F.col("n") > most).select("basket", cut.alias("heavy")))  # at most HEAVY rows
    rows = sets.select(F.col(basket).alias("basket"), F.col(member).alias("member")).join(heavy, "basket", "left")
    middle = sizes.where(F.col("n") <= most).select("basket", cut.alias("middle"))
    rows = rows.withColumn("middle", F.lit(None).cast("int")) if most == block else rows.join(middle, "basket", "left")
    blocks = F.coalesce("heavy", "middle", F.lit(1))
    rows = rows.select("basket", "member", blocks.alias("blocks"), F.pmod(F.xxhash64("member"), blocks).cast("int").alias("block"))
    return rows.groupBy("basket", "block", "blocks").agg(F.sort_array(F.collect_list("member")).alias("members"))


def shared_baskets(sets: DataFrame, basket: str, member: str, block: int = BLOCK) -> DataFrame:
    """Rows (a, b, both), a < b: the number of baskets with both members. ``sets`` has each (basket, member) once."""
    packs = _blocks(sets, basket, member, block)
    within = packs.select(F.posexplode("members").alias("i", "a"), "members").select("a", F.explode(F.expr("slice(members, i + 2, size(members))")).alias("b"))
    cut = packs.where("blocks > 1")
    ahead = cut.where("block < blocks - 1").select("basket", F.col("members").alias("mine"), F.explode(F.expr("sequence(block + 1, blocks - 1)")).alias("block"))
    across = ahead.join(cut.select("basket", "block", "members"), ["basket", "block"]).select(F.explode("mine").alias("x"), "members").select("x", F.explode("members").alias("y"))
    pairs = within.unionByName(across.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("both"))
