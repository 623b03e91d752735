"""How document filters interact: what each removes in every order of applying them, and its Shapley share.

A document's failures are one bit for each filter: A few words, B repetitive words, C many capitals, D
odd characters, E a copy of a text with a smaller id. One pass over the texts tells A to D and a SHA-256;
E needs only digests and ids: the rows of a digest are counted by (part, labels) before they meet, and of
each such group only the least id, how many rows have it, and the count go on, so a text with very many
copies is a few rows. What is left of a part are its cells: documents by (failures, labels), at most 4 * 2^k
rows for k filters.

Orders are visited by adjacent transpositions (plain changes: the last filter sweeps through the orders of
the others), so two orders in succession differ in two neighbouring steps; only these two are counted anew
from the cells, by masks of what fails earlier. A filter's Shapley sum accumulates along the walk. Each part
is one group of that few rows.

Nulls: null text is empty, a null part the empty part. A null id has no smaller id and is none, so it fails
E never and makes none fail; labels of a null id count for nothing, and of several labels of an id any 1
counts. Rows of one id and text (repeated rows) have no smaller id among them, so all pass or fail together.
An empty table has no part and gives no row. Very long texts are read whole, one at a time. Other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segrec.llm.common import text_or_empty

FILTERS = "ABCDE"
MIN_WORDS = 100
DISTINCT_PERCENT = 80
CAPITALS_PERCENT = 10
ODD = b"#$%&*|"
COPY = FILTERS.index("E")
_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_INNER = bytes(range(0x80, 0xC0))  # bytes that begin no code point
SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def text_failures(text: bytes) -> int:
    """Bits of the filters A to D that a UTF-8 text fails."""
    words = text.split()
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    points = len(text.translate(None, _INNER))
    fails = len(words) < MIN_WORDS, 100 * len(set(words)) < DISTINCT_PERCENT * len(words), 100 * capitals > CAPITALS_PERCENT * points, len(text.translate(None, ODD)) < len(text)
    return sum(1 << k for k, fail in enumerate(fails) if fail)


def _mark_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        masks, digests = [], []
        for text in batch.column(2):
            data = text.as_py()
            masks.append(text_failures(data))
            digests.append(hashlib.sha256(data).digest())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(masks, pa.int32()), pa.array(digests, pa.binary())], names=["id", "part", "mask", "digest"])


def cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Documents ``n`` of each (part, mask, good, toxic): the bits of all filters that they fail, and their labels."""
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), text_or_empty(f"`{part_col}`").alias("part"), text_or_empty(f"`{text_col}`").cast("binary").alias("text"))
    marked = rows.mapInArrow(_mark_batches, "id bigint, part string, mask int, digest binary")
    is_one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    told = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("id")).agg(is_one("quality").alias("good"), is_one("toxic").alias("toxic"))
    flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    joined = marked.join(told, "id", "left").select("id", "part", "mask", "digest", flag("good"), flag("toxic"))
    by_id = joined.groupBy("id", "digest", "mask", "part", "good", "toxic").agg(F.count("*").alias("n"))
    group = by_id.groupBy("digest", "mask", "part", "good", "toxic").agg(
        F.sum("n").alias("n"),
        F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("least"),
        F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("nameless"),
    )
    first = F.min("least.id").over(Window.partitionBy("digest"))
    original = F.col("nameless") + F.when(F.col("least.id") == first, F.col("least.n")).otherwise(0)
    split = group.withColumn("original", original).select(
        "part", "good", "toxic", F.explode(F.array(F.struct("mask", F.col("original").alias("n")), F.struct((F.col("mask") + (1 << COPY)).alias("mask"), (F.col("n") - F.col("original")).alias("n")))).alias("x")
    )
    return split.where("x.n > 0").groupBy("part", F.col("x.mask").alias("mask"), "good", "toxic").agg(F.sum("x.n").alias("n"))


def plain_changes(k: int) -> Iterator[int]:
    """Places p of the swaps (p, p + 1) that lead through all orders of k things, each once."""
    if k < 2:
        return
    inner, leftward = plain_changes(k - 1), True
    while True:
        yield from reversed(range(k - 1)) if leftward else range(k - 1)
        place = next(inner, None)
        if place is None:
            return
        yield place + leftward
        leftward = not leftward


def walk(cell: pd.DataFrame, filters: str = FILTERS) -> pd.DataFrame:
    """All orders of the filters over the cells of one part: a row for each order and step."""
    mask, k = cell["mask"].to_numpy(np.int64), len(filters)
    n, good, toxic = (cell["n"].to_numpy(np.int64) * (cell[c].to_numpy(bool) if c else 1) for c in (None, "good", "toxic"))
    alone = [int(n[mask == 1 << f].sum()) for f in range(k)]
    order, steps, kept = list(range(k)), [()] * k, [0] * k

    def count(at: int) -> None:
        before = sum(1 << f for f in order[:at])
        fails, gone = (mask >> order[at]) & 1 == 1, mask & before != 0
        first = fails & ~gone
        steps[at] = int(n[first].sum()), int(n[fails & gone].sum()), alone[order[at]], int(good[first].sum()), int(toxic[first].sum())
        kept[at] = (kept[at - 1] if at else int(n.sum())) - steps[at][0]

    for at in range(k):
        count(at)
    shapley, rows = [0] * k, []

    def visit() -> None:
        name = "".join(filters[f] for f in order)
        for at, f in enumerate(order):
            shapley[f] += steps[at][0]
            rows.append((name, at + 1, kept[at], *steps[at]))

    visit()
    for at in plain_changes(k):
        order[at], order[at + 1] = order[at + 1], order[at]
        count(at)
        count(at + 1)
        visit()
    told = pd.DataFrame(rows, columns=["filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"])
    told.insert(0, "part", cell["part"].iloc[0])
    told["shapley"] = [shapley[filters.index(name[at - 1])] for name, at in zip(told["filter_order"], told["step"])]
    return told


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row for each part, order of the filters and step."""
    return cells(docs, labels, id_col, text_col, part_col).groupBy("part").applyInPandas(lambda cell: walk(cell), SCHEMA)
