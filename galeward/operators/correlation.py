"""Correlation between a station's sensors: pairwise, lagged, by time bucket."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from galeward.functions import hour_bucket, mean_rank, primary_method, safe_corr, season_bucket
from galeward.sources import SENSORS

BUCKETS = {"hour": hour_bucket, "season": season_bucket}
MAX_LAG = 36


def _pairs(wide: DataFrame, keys: list[str], sensors=SENSORS) -> DataFrame:
    """(keys, var1, var2, x, y): the rows where both sensors of a pair are known."""
    each = F.array(*[F.struct(F.lit(a).alias("var1"), F.lit(b).alias("var2"), F.col(a).alias("x"), F.col(b).alias("y")) for a, b in combinations(sensors, 2)])
    return wide.select(*keys, F.explode(each).alias("p")).select(*keys, "p.*").filter("x IS NOT NULL AND y IS NOT NULL")


def pairwise(wide: DataFrame, keys: tuple[str, ...] = ("station",), sensors=SENSORS) -> DataFrame:
    """(keys, var1, var2, method, correlation): Pearson, and Spearman as Pearson of the mean ranks within the pair's rows."""
    k = [*keys, "var1", "var2"]
    ranked = _pairs(wide, list(keys), sensors).withColumns({"rx": mean_rank(F.col("x"), k), "ry": mean_rank(F.col("y"), k)})
    both = ranked.groupBy(*k).agg(safe_corr(F.col("x"), F.col("y")).alias("pearson"), safe_corr(F.col("rx"), F.col("ry")).alias("spearman"))
    return both.unpivot(k, ["pearson", "spearman"], "method", "correlation")


def conditioned(wide: DataFrame, group_by: str = "hour", sensors=SENSORS) -> DataFrame:
    """pairwise within day and night, or within the seasons."""
    if group_by not in BUCKETS:
        raise ValueError(f"group_by must be one of {list(BUCKETS)}, got {group_by!r}")
    return pairwise(wide.withColumn("bucket", BUCKETS[group_by](F.col("ts"))), ("station", "bucket"), sensors).withColumn("group_by", F.lit(group_by))


def primary(pairs: DataFrame, sensors=SENSORS) -> DataFrame:
    """The rows of a pair's primary method."""
    rain = (F.col("var1") == "precipitation") | (F.col("var2") == "precipitation")
    return pairs.filter(F.col("method") == F.when(rain, "spearman").otherwise("pearson"))


def lagged(grid: DataFrame, var1: str, var2: str, max_lag: int = MAX_LAG) -> DataFrame:
    """(station, lag, correlation) of var1 now and var2 `lag` bins later, on a complete grid; null under two pairs.

    All lags come from one sort: a row carries the neighbours it needs as columns."""
    w = Window.partitionBy("station").orderBy("ts")
    lags = range(-max_lag, max_lag + 1)
    moved = grid.select("station", F.col(var1).alias("x"), *[F.lead(var2, k).over(w).alias(f"y{k + max_lag}") for k in lags])
    wide = moved.groupBy("station").agg(*[safe_corr(F.col("x"), F.col(f"y{k + max_lag}")).alias(str(k)) for k in lags])
    return wide.unpivot("station", [str(k) for k in lags], "lag", "correlation").withColumn("lag", F.col("lag").cast("int"))


def lag_peaks(ccf: DataFrame) -> DataFrame:
    """Of each station the lag of the largest absolute correlation (then the smallest lag), and lag 0."""
    known = F.col("correlation").isNotNull()
    t = ccf.groupBy("station").agg(F.max_by(F.when(known, F.struct("lag", "correlation")), F.when(known, F.struct(F.abs("correlation").alias("a"), (-F.col("lag")).alias("l")))).alias("b"), F.max(F.when(F.col("lag") == 0, F.col("correlation"))).alias("lag0_correlation"))
    return t.select("station", F.col("b.lag").alias("peak_lag_steps"), (F.col("b.lag") * 10).alias("peak_lag_minutes"), F.col("b.correlation").alias("peak_correlation"), "lag0_correlation")


__all__ = ["conditioned", "lag_peaks", "lagged", "pairwise", "primary", "primary_method"]
