"""Column functions that SQL lacks."""

from __future__ import annotations

from fnmatch import fnmatchcase

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

TINY = 1e-12


def min_max(value: Column, *by: str) -> Column:
    """Value scaled to 0..1 within ``by``; a constant gives 0."""
    w = Window.partitionBy(*by)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.when(high - low < TINY, 0.0).otherwise((value - low) / (high - low))


def entropy(count: str, *by: str) -> Column:
    """Aggregate: Shannon entropy, base 2, of counts whose group totals are in column ``total``."""
    share = F.col(count) / F.col("total")
    return -F.sum(share * F.log2(share))


def adjusted_skew(value: Column) -> Column:
    """Aggregate: sample skewness with the bias correction of n."""
    n = F.count(value)
    return F.when(n > 2, F.skewness(value) * F.sqrt(n * (n - 1)) / (n - 2))


def share_or_zero(part: Column, whole: Column) -> Column:
    return F.coalesce(part / F.nullif(whole, F.lit(0)), F.lit(0.0))


def cosine_parts(a: str, b: str) -> tuple[Column, Column, Column]:
    """Aggregates: dot product and the two squared norms of aligned columns."""
    return F.sum(F.col(a) * F.col(b)), F.sum(F.col(a) ** 2), F.sum(F.col(b) ** 2)


def tier(history: Column) -> Column:
    """History tier of a user by the number of distinct items."""
    return F.when(history <= 0, "insufficient").when(history == 1, "minimal").when(history <= 8, "moderate").otherwise("rich")


def random_hit_rate(candidates: Column, relevant: Column, k: int) -> Column:
    """Chance that k of m random candidates hit one of r relevant ones: 1 - C(m-r,k)/C(m,k)."""
    miss = F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.lit(1.0), lambda acc, i: acc * F.greatest(F.lit(0.0), (candidates - relevant - i) / (candidates - i)))
    return 1 - miss


def columns_like(df: DataFrame, pattern: str) -> list[str]:
    """Columns whose names match a pattern with ``*`` and ``?``, in the frame's order."""
    return [c for c in df.columns if fnmatchcase(c, pattern)]


def numeric_columns(df: DataFrame, but: tuple[str, ...] = ()) -> list[str]:
    """Columns of numeric types, keys ``but``, in the frame's order."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in but]
