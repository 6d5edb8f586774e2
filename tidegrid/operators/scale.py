"""Scaling and imputation. Global statistics are one aggregate, read back as scalar subqueries of one row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.names import free_names
from tidegrid.operators.graph import written
from tidegrid.operators.order import quantiles


def _with_stats(df: DataFrame, stats: DataFrame) -> DataFrame:
    """df with the one row of stats on every row; that row is broadcast."""
    return df.join(F.broadcast(stats))


def min_max(df: DataFrame, cols: Sequence[str], suffix: str = "_mm", least_range: float = 1e-8) -> DataFrame:
    """(x - min) / (max - min); 0 for a constant column. Nulls stay null."""
    names = {c: free_names(df, f"_lo_{c}", f"_hi_{c}") for c in cols}
    stats = df.agg(*[f(c).alias(n) for c in cols for n, f in zip(names[c], (F.min, F.max))])
    out = _with_stats(df, stats)
    for c in cols:
        lo, hi = map(F.col, names[c])
        out = out.withColumn(f"{c}{suffix}", F.when(hi - lo < least_range, F.lit(0.0) * F.col(c)).otherwise((F.col(c) - lo) / F.nullif(hi - lo, F.lit(0.0))))
    return out.drop(*stats.columns)


def z_score(df: DataFrame, cols: Sequence[str], fit: DataFrame | None = None, suffix: str = "_z", constant_to_zero: bool = False) -> DataFrame:
    """(x - mean) / population deviation, fitted on ``fit`` (by default df); a zero deviation counts as 1, or gives 0."""
    names = {c: free_names(df, f"_m_{c}", f"_s_{c}") for c in cols}
    stats = (df if fit is None else fit).agg(*[f(c).alias(n) for c in cols for n, f in zip(names[c], (F.avg, F.stddev_pop))])
    out = _with_stats(df, stats)
    for c in cols:
        m, s = map(F.col, names[c])
        flat = F.lit(0.0) if constant_to_zero else F.col(c) - m
        out = out.withColumn(f"{c}{suffix}", F.when(s == 0, flat).otherwise((F.col(c) - m) / F.nullif(s, F.lit(0.0))))
    return out.drop(*stats.columns)


def median_impute(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Nulls and NaN to the column's exact median of the others; to 0 if there is none."""
    own = written(df.select(*cols), "columns")
    middle = {c: quantiles(own, c, [0.5])[0] for c in cols}
    return df.withColumns({c: F.coalesce(F.when(~F.isnan(c), F.col(c)), F.lit(middle[c] or 0.0)) for c in cols})
