"""Exact de-duplication with a split for heavy hitters.

Texts are compared by SHA-256. A Misra-Gries summary of ``capacity`` counters is kept over each
task's digests; the summed summaries undercount any digest by at most n / (capacity + 1), so every
digest with more than 2n / capacity rows is among at most ``capacity`` candidates. Exact counts over
all rows verify them; the winners (bounded by ``capacity``, about 60 bytes each) are broadcast, and
rows of a winner that don't have its largest id are removed map-side. All other rows, of groups of a
bounded share of the input, take an ordinary shuffle by digest.

Nulls: null text counts as empty. A null id is smaller than any other; a group without ids keeps one
of its rows. Repeated rows: of rows that tie on text and largest id, exactly one is kept. An empty
table gives an empty result. Extra columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segrec.llm.common import materialise, packed_row, text_or_empty

CAPACITY = 65_536


def _summarise(capacity: int):
    def misra_gries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            new, times = np.unique(batch.column(0).to_numpy(zero_copy_only=False), return_counts=True)
            keys, at = np.unique(np.concatenate([keys, new]), return_inverse=True)
            counts = np.bincount(at, weights=np.concatenate([counts, times]), minlength=len(keys)).astype(np.int64)
            if len(keys) > capacity:  # take the (capacity + 1)-th largest count off every counter
                counts = counts - np.partition(counts, -capacity - 1)[-capacity - 1]
                keys, counts = keys[counts > 0], counts[counts > 0]
        if len(keys):
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["key", "n"])

    return misra_gries


def heavy_digests(digests: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Verified frequent digests of ``digests`` (sha, id): rows (sha, top_id, n), at most about ``capacity``."""
    total = digests.count()
    counters = digests.select(F.xxhash64("sha").alias("key")).mapInArrow(_summarise(capacity), "key bigint, n bigint")
    least = max(2, total // capacity)
    candidates = counters.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "key").limit(capacity)
    seen = digests.join(F.broadcast(candidates.select("key")), F.xxhash64("sha") == F.col("key"))
    return seen.groupBy("sha").agg(F.max("id").alias("top_id"), F.count("*").alias("n")).where(F.col("n") >= least)


def _decided(rows: DataFrame, winners: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows removed map-side, rows left after the shuffle) of ``rows`` (sha, id, ...)."""
    told = rows.join(F.broadcast(winners.withColumnsRenamed({"sha": "w_sha", "n": "w_n"})), F.col("sha") == F.col("w_sha"), "left")
    removed = told.where(F.col("w_n").isNotNull() & ~F.col("id").eqNullSafe(F.col("top_id")))
    left = told.where(F.col("w_n").isNull() | F.col("id").eqNullSafe(F.col("top_id")))
    return removed, left


def decisions(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row for each row of ``df``: id, keep_id, group_size, kept, sha (binary)."""
    digests = materialise(df.select(F.col(id_col).alias("id"), F.unhex(F.sha2(text_or_empty(text_col), 256)).alias("sha")), "digests")
    removed, left = _decided(digests, materialise(heavy_digests(digests, capacity), "winners"))
    group = Window.partitionBy("sha")
    ranked = left.select(
        "id",
        F.coalesce(F.col("top_id"), F.max("id").over(group)).alias("keep_id"),
        F.coalesce(F.col("w_n"), F.count("*").over(group)).alias("group_size"),
        (F.row_number().over(group.orderBy(F.desc_nulls_last("id"))) == 1).alias("kept"),
        "sha",
    )
    return removed.select("id", F.col("top_id").alias("keep_id"), F.col("w_n").alias("group_size"), F.lit(False).alias("kept"), "sha").union(ranked)


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """The rows of ``df`` that stay, with its columns."""
    text = text_or_empty(text_col)
    digests = materialise(df.select(F.col(id_col).alias("id"), F.unhex(F.sha2(text, 256)).alias("sha")), "digests")
    winners = materialise(heavy_digests(digests, capacity), "winners")
    rows = df.select(packed_row(df).alias("row"), F.col(id_col).alias("id"), F.unhex(F.sha2(text, 256)).alias("sha"))
    _, left = _decided(rows, winners)
    first = F.row_number().over(Window.partitionBy("sha").orderBy(F.desc_nulls_last("id")))
    return left.select("row", first.alias("rank")).where("rank = 1").select("row.*")
