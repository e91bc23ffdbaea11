"""Column expressions that Spark has no single function for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def mean_rank_share(value: Column, by: Sequence[Column | str], descending: bool = False) -> Column:
    """Rank with ties averaged, as a share of the non-null values of the partition; null for null.

    Neither percent_rank nor cume_dist: equal values get the mean of the ranks they cover."""
    ranked = Window.partitionBy(*by).orderBy(value.desc_nulls_last() if descending else value.asc_nulls_last())
    return F.when(value.isNotNull(), _mid_rank(value, ranked) / F.count(value).over(Window.partitionBy(*by)))


def mean_rank(value: Column, by: Sequence[Column | str]) -> Column:
    """Rank with ties averaged, ascending from 1."""
    return F.when(value.isNotNull(), _mid_rank(value, Window.partitionBy(*by).orderBy(value.asc_nulls_last())))


def _mid_rank(value: Column, ranked: WindowSpec) -> Column:
    """The rows of equal value are a frame of the same sorted window, so ranks and ties cost one sort."""
    ties = F.count(value).over(ranked.rangeBetween(Window.currentRow, Window.currentRow))
    return F.rank().over(ranked) + (ties - 1) / 2.0


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation as an aggregate over the rows where both are known; null where either is constant.

    Spark's corr raises under ANSI for a constant side, so it comes from co-moments."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.when((F.min(a) < F.max(a)) & (F.min(b) < F.max(b)), F.try_divide(F.covar_pop(a, b), spread))


def clean(value: Column) -> Column:
    """NaN as null: missing readings are null from the first table on."""
    return F.when(~F.isnan(value), value)


def hour_bucket(ts: Column) -> Column:
    return F.when((F.hour(ts) >= 6) & (F.hour(ts) < 18), "day").otherwise("night")


def season_bucket(ts: Column) -> Column:
    """Two seasons: dry from December to April, wet otherwise."""
    return F.when(F.month(ts).isin(12, 1, 2, 3, 4), "dry").otherwise("wet")


def seconds_between(a: Column, b: Column) -> Column:
    """Whole seconds from a to b, of timestamps without zone."""
    return F.timestamp_diff("SECOND", a, b)


def is_extreme(share: Column, tail: float = 0.05) -> Column:
    return (share < tail) | (share > 1 - tail)


def primary_method(a: str, b: str) -> str:
    """Spearman for a pair with precipitation, whose many zeros distort Pearson."""
    return "spearman" if "precipitation" in (a, b) else "pearson"
