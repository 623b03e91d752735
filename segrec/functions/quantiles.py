"""Exact quantiles without sorting and without all distinct values in one task.

Each pass counts the rows of an interval of values in ``BINS`` equal bins, with the least and largest value
of each; the next pass looks only at the bin that holds the wanted rank, between those two values. It ends
where both are the same, or where at most ``FEW`` rows are left, whose values the driver counts. So a few
passes do, even over very many values.
"""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 4096
FEW = 20_000


def quantiles(long: DataFrame, shares: list[float]) -> dict:
    """Of rows (name, x): for each name the values at ``shares`` of its rows, interpolated between neighbours. Null x count for nothing.

    Names are few: columns, or groups of a report. A name without values is left out.
    """
    rows = long.where("x IS NOT NULL AND NOT isnan(x)").select("name", F.col("x").cast("double").alias("x")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        ends = rows.groupBy("name").agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).collect()
        size = {r["name"]: r["n"] for r in ends}
        whole = {r["name"]: (0, r["n"], r["low"], r["high"]) for r in ends}
        wanted = {(name, rank): whole[name] for name, n in size.items() for p in shares for rank in (math.floor(p * (n - 1)), math.ceil(p * (n - 1)))}
        while any(low < high for _, _, low, high in wanted.values()):
            spans = sorted({(name, *span) for (name, _), span in wanted.items() if span[2] < span[3]}, key=repr)
            bins = _count(rows, spans)
            for (name, rank), span in wanted.items():
                before, _, low, high = span
                if low < high:
                    for n, least, most in bins[spans.index((name, *span))]:
                        if rank < before + n:
                            wanted[name, rank] = (before, n, least, most)
                            break
                        before += n
    finally:
        rows.unpersist()
    found = {}
    for name, n in size.items():
        at = [(p * (n - 1), wanted[name, math.floor(p * (n - 1))][2], wanted[name, math.ceil(p * (n - 1))][2]) for p in shares]
        found[name] = [low if low == high else (math.ceil(x) - x) * low + (x - math.floor(x)) * high for x, low, high in at]
    return found


def _count(rows: DataFrame, spans: list[tuple]) -> list[list[tuple]]:
    """For each span (name, ranks before, rows, least, largest) its bins (rows, least, largest) in order."""
    kind = rows.schema["name"].dataType
    entry = [F.struct(F.lit(k).alias("span"), F.lit(name).cast(kind).alias("name"), F.lit(low).alias("low"), F.lit(high).alias("high"), F.lit(n <= FEW).alias("few")) for k, (name, _, n, low, high) in enumerate(spans)]
    table = rows.sparkSession.range(1).select(F.explode(F.array(*entry)).alias("s")).select("s.*")
    # halves, so that the width of a span of any two numbers is one; of a few rows each value is a bin
    half = F.nullif(F.col("high") / 2 - F.col("low") / 2, F.lit(0.0))  # none between the two smallest numbers
    share = F.coalesce((F.col("x") / 2 - F.col("low") / 2) / half, (F.col("x") > F.col("low")).cast("double"))
    place = F.least(F.floor(share * BINS), F.lit(BINS - 1)).cast("double")
    inside = rows.join(F.broadcast(table), "name").where("x BETWEEN low AND high")  # a few rows
    counted = inside.groupBy("span", F.when(F.col("few"), F.col("x")).otherwise(place).alias("bin")).agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
    bins: list[list[tuple]] = [[] for _ in spans]
    for r in sorted(counted.collect(), key=lambda r: (r["span"], r["bin"])):
        bins[r["span"]].append((r["n"], r["low"], r["high"]))
    return bins


def column_quantiles(df: DataFrame, columns: list[str], shares: list[float]) -> dict[str, list[float]]:
    """Quantiles of several columns of ``df``, read together."""
    entry = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("x")) for c in columns])
    return quantiles(df.select(F.explode(entry).alias("e")).select("e.*"), shares)
