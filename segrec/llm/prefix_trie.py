"""Trie of conversations by their common first turns, built level by level.

``rebuild`` gives every conversation its first h turns from the conversation at the head of its twenty
(h from a CRC of its number) and the rest from its own. ``trie`` makes a node of each distinct sequence of
first turns of the rebuilt conversations.

Construction goes down level by level: the live conversations of a depth are grouped by (parent node, next
turn), and the smallest conv_id names the node. Equal conversations are one from the start, with a count,
so a group of very many copies is one row; and a conversation is live only while another one shares its
node: what it has below is a chain without branches, whose nodes are its own turns. So there are as many
levels as the longest run of turns that two different conversations share. Joins from the deepest level
upwards then roll leaves and savings up; a chain's are running sums.

Nothing gathers a large group: a conversation's turns are ordered by one range sort over all of them, in
which a long conversation is spread over many tasks, and numbered by each task's counts; running sums and
joins of turns go by blocks of ``BLOCK`` turns; the children of a node with very many are named by a
broadcast of at most ``HEAVY`` such nodes. The numbers of equal conversations are joined in pieces of at
most ``BLOCK`` numbers, before their pieces meet in numeric order in a running SHA-256, which by its nature
takes one input after the other. Turns are told apart by SHA-256, nodes by a chain of them, and whole
conversations by 128 bits over (depth, turn).

Nulls: null turns come first; null roles and texts are empty; rows without a conv_id belong to no
conversation and are left out. Equal turn numbers are ordered by role, then text; repeated rows are turns
of their own. A conversation without turns once rebuilt is a member of the root only. An empty table gives
no node, not even a root. Very long texts are read whole. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segrec.llm.common import materialise, text_or_empty

BLOCK = 4096
BLOCK_BITS = 12
HEAVY = 100_000
FAMILY = 20
HEADS = 4
WORD = r"[^\x20\x09-\x0D]+"
NOBODY = hashlib.sha256(b"").hexdigest()


def _sha(x: Column) -> Column:
    return F.unhex(F.sha2(x, 256))


def _blocks(first: Column, turns: Column) -> Column:
    """Numbers of the blocks of turns from number ``first`` (from 0) on, before number ``turns``; none if there is none."""
    last = F.shiftright(turns - 1, BLOCK_BITS)
    return F.explode(F.when(turns > first, F.sequence(F.shiftright(first, BLOCK_BITS), last)).otherwise(F.array().cast("array<bigint>"))).alias("block")


def numbered(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows (c, pos, turn, words): each conversation's turns in order from 0, by the digest of role and text."""
    order = ["c", "turn", "role", "text"]
    rows = df.select(F.col(f"`{conv}`").cast("bigint").alias("c"), F.col(f"`{turn}`").alias("turn"), text_or_empty(f"`{role}`").alias("role"), text_or_empty(f"`{text}`").alias("text"))
    rows = rows.where("c IS NOT NULL").repartitionByRange(*order).sortWithinPartitions(*order)
    said = _sha(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))
    rows = materialise(rows.select("c", F.monotonically_increasing_id().alias("at"), said.alias("turn"), F.regexp_count("text", F.lit(WORD)).cast("bigint").alias("words")), "turns")
    task = F.shiftright("at", 33).alias("task")  # of the sort: the high bits of its row numbers
    runs = rows.groupBy("c", task).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("c").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("c", "task", (before - F.col("first")).alias("shift"))
    return rows.withColumn("task", task).join(runs, ["c", "task"]).select("c", (F.col("at") + F.col("shift")).alias("pos"), "turn", "words")


def rebuild(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of ``numbered`` turns: the rebuilt conversations' turns (c, d, turn, words), d from 1, and all conversations (c, turns)."""
    taken = (F.crc32(F.col("c").cast("string")) % HEADS).alias("taken")
    heads = turns.where((F.col("c") % FAMILY == 0) & (F.col("pos") < HEADS - 1)).groupBy(F.col("c").alias("head")).agg(F.sort_array(F.collect_list(F.struct("pos", "turn", "words"))).alias("lent"))
    convs = turns.groupBy("c").agg(F.count("*").alias("own")).select("c", "own", taken, (F.col("c") - F.col("c") % FAMILY).alias("head"))
    lent = F.when(F.col("lent").isNull(), F.expr("slice(array(named_struct('pos', 0L, 'turn', X'', 'words', 0L)), 1, 0)")).otherwise(F.slice("lent", 1, F.col("taken").cast("int")))
    convs = convs.join(heads, "head", "left").select("c", "own", "taken", lent.alias("lent"))
    convs = materialise(convs.withColumn("turns", F.size("lent") + F.greatest(F.col("own") - F.col("taken"), F.lit(0))), "convs")
    block = F.shiftright("pos", BLOCK_BITS).alias("block")
    shift = convs.select("c", (F.size("lent") - F.col("taken") + 1).alias("shift"), "taken", _blocks(F.col("taken"), F.col("own")))
    own = turns.withColumn("block", block).join(shift, ["c", "block"]).where("pos >= taken").select("c", (F.col("pos") + F.col("shift")).alias("d"), "turn", "words")
    others = convs.select("c", F.explode("lent").alias("x")).select("c", (F.col("x.pos") + 1).alias("d"), "x.turn", "x.words")
    return own.unionByName(others), convs.select("c", "turns")


def _end_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (sequence, piece): the smallest conv_id of each sequence, how many there are, its turns, SHA-256 of the numbers."""
    key, digest, told = None, None, []
    for batch in batches:
        done = []
        for a, b, turns, least, n, numbers in zip(*(batch.column(x).to_pylist() for x in ("a", "b", "turns", "least", "n", "numbers")), strict=True):
            if (a, b, turns) != key:
                if key:
                    done.append((*told, digest.hexdigest()))
                key, digest, told = (a, b, turns), hashlib.sha256(numbers.encode()), [least, n, turns]
            else:
                digest.update(b"," + numbers.encode())
                told[1] += n
        yield _ends(done)
    if key:
        yield _ends([(*told, digest.hexdigest())])


def _ends(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(("c", "n", "turns", "ends"), r)) for r in rows], pa.schema([("c", pa.int64()), ("n", pa.int64()), ("turns", pa.int64()), ("ends", pa.string())]))


def distinct_sequences(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Rows (c, n, turns, ends) for each distinct sequence: its smallest conversation, how many have it, and the digest of their numbers."""
    seen = turns.groupBy("c").agg(F.bit_xor(F.xxhash64("d", "turn")).alias("a"), F.bit_xor(F.xxhash64("turn", "d", F.lit("b"))).alias("b"))
    keyed = convs.join(seen, "c", "left").select("c", F.col("turns").cast("bigint").alias("turns"), F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))
    listed = F.array_join(F.sort_array(F.collect_list("c")).cast("array<string>"), ",")
    parts = keyed.groupBy("a", "b", "turns", F.shiftright("c", BLOCK_BITS).alias("piece")).agg(F.min("c").alias("least"), F.count("*").alias("n"), listed.alias("numbers"))
    parts = parts.repartition("a", "b", "turns").sortWithinPartitions("a", "b", "turns", "piece")
    return parts.mapInArrow(_end_batches, "c bigint, n bigint, turns bigint, ends string")


def _named(children: DataFrame, parents: DataFrame) -> DataFrame:
    """``children`` with their parent's conv_id; parents of very many children, a bounded number of them, are broadcast."""
    most = max(10_000, children.count() // HEAVY)
    heavy = F.broadcast(parents.where(F.col("n_children") > most).select(F.col("key").alias("parent"), F.col("conv_id").alias("heavy_id")))
    light = parents.where(F.col("n_children") <= most).select(F.col("key").alias("parent"), F.col("conv_id").alias("light_id"))
    rows = children.join(heavy, "parent", "left")
    some = rows.where("heavy_id IS NULL").join(light, "parent").withColumn("parent_conv_id", F.col("light_id"))
    return some.drop("light_id", "heavy_id").unionByName(rows.where("heavy_id IS NOT NULL").withColumn("parent_conv_id", F.col("heavy_id")).drop("heavy_id"))


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row for each node of the trie of the conversations ``convs`` (c, turns) with the ``turns`` (c, d, turn, words)."""
    turns = materialise(turns, "rebuilt")
    kinds = materialise(distinct_sequences(turns, convs), "sequences")
    block = F.shiftright(F.col("d") - 1, BLOCK_BITS).alias("block")
    known = kinds.withColumnRenamed("turns", "last").select("c", "n", "last", "ends", _blocks(F.lit(0).cast("bigint"), F.col("last")))
    # by depth, so that a level reads its own turns only
    steps = turns.withColumn("block", block).join(known, ["c", "block"]).repartitionByRange("d", "c").sortWithinPartitions("d", "c")
    steps = materialise(steps, "steps")

    end = F.max(F.when(F.col("last") == F.col("depth"), F.col("ends"))).alias("ends")
    told = (F.min("c").alias("conv_id"), F.sum("n").alias("n_convs"), F.count("*").alias("kinds"), F.max("last").alias("last"), end)
    root = kinds.select("c", "n", "ends", F.col("turns").alias("last"), F.lit(0).cast("bigint").alias("depth")).groupBy("depth").agg(*told)
    root = root.select(F.lit(b"").alias("key"), F.lit(b"").alias("parent"), "depth", "conv_id", "n_convs", "kinds", "last", F.lit(0).cast("bigint").alias("words"), "ends")
    levels = [materialise(root, "nodes")]
    live = kinds.select("c", F.lit(b"").alias("key")).join(levels[0].where("kinds = 1").select(F.col("conv_id").alias("c")), "c", "left_anti")
    while not live.isEmpty():
        depth = len(levels)
        at = steps.where(F.col("d") == depth).join(live, "c")
        at = at.select("c", F.col("key").alias("parent"), _sha(F.concat("key", "turn")).alias("key"), F.lit(depth).cast("bigint").alias("depth"), "n", "last", "ends", "words")
        at = materialise(at, "level")
        nodes = at.groupBy("key").agg(F.max("parent").alias("parent"), F.max("depth").alias("depth"), *told, F.max("words").alias("words"))
        levels.append(materialise(nodes, "nodes"))
        alone = levels[-1].where("kinds = 1").select(F.col("conv_id").alias("c"))
        live = at.where("last > depth").join(alone, "c", "left_anti").select("c", "key")

    alone = levels[0].where("kinds = 1")
    for nodes in levels[1:]:
        alone = alone.unionByName(nodes.where("kinds = 1"))
    tails = alone.select(F.col("conv_id").alias("c"), "depth", _blocks(F.col("depth"), F.col("last")))
    tails = steps.join(tails, ["c", "block"]).where("d > depth").select("c", "d", "n", "last", "ends", "words", "block")
    shared = materialise(tails.where("n > 1"), "tails")
    onward = Window.partitionBy("c", "block").orderBy(F.desc("d"))
    later = Window.partitionBy("c").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    sums = shared.groupBy("c", "block").agg(F.sum("words").alias("words")).select("c", "block", F.coalesce(F.sum("words").over(later), F.lit(0)).alias("after"))
    summed = shared.withColumn("here", F.sum("words").over(onward)).join(sums, ["c", "block"]).withColumn("saved", (F.col("n") - 1) * (F.col("here") + F.col("after")))
    chain = tails.where("n = 1").withColumn("saved", F.lit(0).cast("bigint")).unionByName(summed.drop("here", "after"))
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
    ends = F.coalesce("ends", F.lit(NOBODY)).alias("ends_sha256")
    chain = chain.select(
        F.col("c").alias("conv_id"), F.col("d").alias("depth"), F.col("c").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        (F.col("d") < F.col("last")).cast("bigint").alias("n_children"), F.lit(1).cast("bigint").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.when(F.col("d") == F.col("last"), F.col("ends")).otherwise(F.lit(NOBODY)).alias("ends_sha256"),
    )

    rest = shared.groupBy(F.col("c").alias("conv_id")).agg(F.sum("words").alias("rest"))
    below, rolled = None, []
    for nodes in reversed(levels):
        nodes = nodes.join(rest, "conv_id", "left")
        if below is not None:
            nodes = nodes.join(below, "key", "left")
        got = lambda c: F.coalesce(c, F.lit(0)) if below is not None else F.lit(0).cast("bigint")  # noqa: B023, E731
        single = F.col("kinds") == 1
        nodes = nodes.select(
            "key", "parent", "depth", "conv_id", "n_convs", "ends",
            F.when(single, (F.col("last") > F.col("depth")).cast("bigint")).otherwise(got("children")).alias("n_children"),
            F.when(single, 1).otherwise(got("leaves")).cast("bigint").alias("n_leaves"),
            ((F.col("n_convs") - 1) * (F.col("words") + F.when(single, F.coalesce("rest", F.lit(0))).otherwise(0)) + got("saved")).alias("saved_tokens"),
        )
        nodes = materialise(nodes, "rolled")
        rolled.insert(0, nodes)
        below = nodes.groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    result = chain.unionByName(rolled[0].withColumn("parent_conv_id", F.lit(None).cast("bigint")).select(*columns, ends))
    for parents, children in zip(rolled, rolled[1:]):
        result = result.unionByName(_named(children, parents).select(*columns, ends))
    return result


def conversation_trie(df: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations of ``df`` (conv_id, turn, role, text)."""
    turns = materialise(numbered(df), "numbered")
    return trie(*rebuild(turns))
