"""Columns for numbers: means of the largest, scaling, bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Upper ends of the bins that term counts fall into, and their names (fixed values).
BINS = [(0, "0"), (1, "1"), (2, "2"), (3, "3"), (4, "4"), (5, "5"), (7, "6-7"), (10, "8-10"), (15, "11-15"), (20, "16-20"), (30, "21-30"), (40, "31-40"), (50, "41-50")]


def top_n_mean(values: Column, n) -> Column:
    """Mean of the n largest; null for an empty array."""
    top = F.slice(F.sort_array(values, asc=False), 1, n)
    return F.aggregate(top, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(top), F.lit(0))


def top_n_pct_mean(values: Column, percent: float) -> Column:
    """Mean of the largest ceil(percent / 100 * size)."""
    return top_n_mean(values, F.ceil(F.lit(percent) / 100 * F.size(values)).cast("int"))


def bin_of(count: Column) -> Column:
    out = F.lit("50+")
    for high, name in reversed(BINS):
        out = F.when(count <= high, name).otherwise(out)
    return out


def log_scaled(c: Column) -> Column:
    return F.log10(1 + c)


def min_max(df: DataFrame, columns: list[str], fit: DataFrame | None = None) -> DataFrame:
    """Columns scaled by the range of `fit` (df itself by default); a constant column gives null. The ranges are one row."""
    ends = (fit or df).agg(*[F.min(c).alias(f"_low_{c}") for c in columns], *[F.max(c).alias(f"_high_{c}") for c in columns])
    wide = df.join(F.broadcast(ends))
    return wide.withColumns({c: (F.col(c) - F.col(f"_low_{c}")) / F.nullif(F.col(f"_high_{c}") - F.col(f"_low_{c}"), F.lit(0)) for c in columns}).select(*df.columns)
