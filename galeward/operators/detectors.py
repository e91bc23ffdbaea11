"""Statistical detectors on a regular grid, window features, and the shared detection table.

Tables are long: (station, sensor, ts, value) in, one more column out. A centred window of even width w
covers the w / 2 bins before a bin and the w / 2 - 1 after it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

CELL = ("station", "sensor")
WINDOW = 36
MIN_PERIODS = 18
FLOOR_SHARE = 0.1
MAD_FACTOR = 0.6745
THRESHOLDS = {"z_score": 3.0, "modified_z_score": 3.5, "z_score_context_hour": 3.0, "lof": 1.5, "isolation_forest": 0.5}
FEATURES = ("value", "window_mean", "window_std", "window_slope")
FEATURE_WINDOW = 6


def _frame(window: int, by: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*by).orderBy("ts").rowsBetween(-(window // 2), window - window // 2 - 1)


def _score(deviation: Column, scale: Column, floor: Column) -> Column:
    """deviation over the scale, which is at least the floor; null where that is no positive number."""
    held = F.when(scale.isNotNull(), F.greatest(scale, F.coalesce(floor, F.lit(0.0))))
    return F.when(held > 0, F.try_divide(deviation, held))


def rolling_z(grid: DataFrame, window: int = WINDOW, min_periods: int = MIN_PERIODS, floor: float = FLOOR_SHARE, by: Sequence[str] = CELL) -> DataFrame:
    """score: distance from the centred rolling mean in rolling deviations, these at least `floor` of the cell's own."""
    near, cell, v = _frame(window, by), Window.partitionBy(*by), F.col("value")
    enough = F.count(v).over(near) >= min_periods
    rows = grid.withColumns({"_m": F.when(enough, F.avg(v).over(near)), "_s": F.when(enough, F.stddev_samp(v).over(near)), "_g": F.stddev_samp(v).over(cell)})
    return rows.withColumn("score", _score(v - F.col("_m"), F.col("_s"), floor * F.col("_g"))).drop("_m", "_s", "_g")


def rolling_modified_z(grid: DataFrame, window: int = WINDOW, min_periods: int = MIN_PERIODS, floor: float = FLOOR_SHARE, by: Sequence[str] = CELL) -> DataFrame:
    """score: distance from the rolling median in rolling medians of such distances. Each distance is from its own
    row's median. The floor is a share of the cell's median absolute deviation, or of its deviation where that is 0."""
    near, cell = _frame(window, by), Window.partitionBy(*by)
    middle = lambda c: F.percentile(F.col(c), F.lit(0.5))
    enough = lambda c: F.count(c).over(near) >= min_periods
    rows = grid.withColumns({"_m": F.when(enough("value"), middle("value").over(near)), "_gm": middle("value").over(cell), "_gs": F.stddev_samp("value").over(cell)})
    rows = rows.withColumns({"_r": F.abs(F.col("value") - F.col("_m")), "_gr": F.abs(F.col("value") - F.col("_gm"))})
    rows = rows.withColumns({"_d": F.when(enough("_r"), middle("_r").over(near)), "_gd": middle("_gr").over(cell)})
    anchor = F.when(F.col("_gd") != 0, F.col("_gd")).otherwise(F.col("_gs"))
    return rows.withColumn("score", _score(MAD_FACTOR * (F.col("value") - F.col("_m")), F.col("_d"), floor * anchor)).drop("_m", "_gm", "_gs", "_r", "_gr", "_d", "_gd")


def hour_z(grid: DataFrame, by: Sequence[str] = CELL) -> DataFrame:
    """score: distance from the mean of the cell's same hour of day, in that hour's deviations."""
    w = Window.partitionBy(*by, F.hour("ts"))
    v, sd = F.col("value"), F.stddev_samp("value").over(w)
    return grid.withColumns({"_m": F.avg(v).over(w), "_s": sd}).withColumn("score", F.when(F.col("_s") > 0, F.try_divide(v - F.col("_m"), F.col("_s")))).drop("_m", "_s")


def window_features(grid: DataFrame, window: int = FEATURE_WINDOW, by: Sequence[str] = CELL) -> DataFrame:
    """window_mean, window_std, window_slope (a change per hour of six bins); null where the window is not complete."""
    near = _frame(window, by)
    rows = grid.withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy("ts")).cast("double"))
    whole = F.count("value").over(near) == window
    return rows.withColumns({
        "window_mean": F.when(whole, F.avg("value").over(near)), "window_std": F.when(whole, F.stddev_samp("value").over(near)),
        "window_slope": F.when(whole, F.regr_slope("value", "_i").over(near) * 6),
    }).drop("_i")


def scaled_features(features: DataFrame, by: Sequence[str] = CELL) -> DataFrame:
    """Complete rows only, each feature less its cell's median, over its interquartile range (1 where that is 0)."""
    rows = features.dropna(subset=list(FEATURES))
    w = Window.partitionBy(*by)
    rows = rows.withColumns({f"_q_{c}": F.percentile(F.col(c), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).over(w) for c in FEATURES})
    width = lambda c: F.get(f"_q_{c}", 2) - F.get(f"_q_{c}", 0)
    scaled = {f"scaled_{c}": (F.col(c) - F.get(f"_q_{c}", 1)) / F.when(width(c) != 0, width(c)).otherwise(1.0) for c in FEATURES}
    return rows.withColumns(scaled).drop(*[f"_q_{c}" for c in FEATURES])


def detections(scored: DataFrame, method: str, threshold: float | Column | None = None) -> DataFrame:
    """The shared table of one method: a row for each score there is; a null threshold flags nothing."""
    limit = F.lit(THRESHOLDS[method]) if threshold is None else threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    flagged = F.coalesce(F.abs("score") > limit, F.lit(False))
    return scored.filter("score IS NOT NULL").select("station", "sensor", F.col("ts").alias("timestamp"), F.lit(method).alias("method"), flagged.alias("flagged"), "score")


def statistical_detections(grid: DataFrame, window: int = WINDOW, min_periods: int = MIN_PERIODS) -> DataFrame:
    """Both rolling scores on every sensor, the hour score on light alone."""
    lux = grid.filter(F.col("sensor") == "luminous_intensity")
    return (
        detections(rolling_z(grid, window, min_periods), "z_score").unionByName(detections(rolling_modified_z(grid, window, min_periods), "modified_z_score"))
        .unionByName(detections(hour_z(lux), "z_score_context_hour"))
    )


def flag_summary(table: DataFrame) -> DataFrame:
    return table.groupBy("station", "sensor", "method").agg(F.count("*").alias("n_scored"), F.count_if("flagged").alias("n_flagged"), F.avg(F.col("flagged").cast("double")).alias("flagged_rate"))


def threshold_sensitivity(table: DataFrame, quantiles: Sequence[float] = (0.99, 0.995, 0.999)) -> DataFrame:
    """By sensor and method the published rate, and the cutoffs of |score| at quantiles."""
    score = F.abs("score")
    cuts = [F.percentile(score, F.lit(q)).alias(f"cutoff_q{q}") for q in quantiles]
    return table.groupBy("sensor", "method").agg(F.avg(F.col("flagged").cast("double")).alias("rate_at_published"), *cuts)


def tie_degeneracy(features: DataFrame, by: Sequence[str] = CELL, digits: int = 6) -> DataFrame:
    """Share of scored rows whose rounded features another row has too, and the largest such group's share."""
    alike = features.dropna(subset=list(FEATURES)).groupBy(*by, *[(F.round(c, digits) + 0.0).alias(c) for c in FEATURES]).agg(F.count("*").alias("n"))
    total = F.sum("n")
    return alike.groupBy(*by).agg(total.alias("n_scored"), (F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)) / total).alias("duplicate_share"), (F.max("n") / total).alias("largest_tied_group_share"))


def extreme_share(scored: DataFrame, limit: float = 1e3, by: Sequence[str] = ()) -> DataFrame:
    """(by, n_scored, extreme_share): scores so large that they tell of a degenerate neighbourhood."""
    return scored.filter("score IS NOT NULL").groupBy(*by).agg(F.count("*").alias("n_scored"), F.avg((F.col("score") > limit).cast("double")).alias("extreme_share"))


def strongest(table: DataFrame, k: int, by: Sequence[str] = ("sensor",)) -> DataFrame:
    """The k rows of the largest |score| of each group; ties by station, time and method."""
    w = Window.partitionBy(*by).orderBy(F.abs("score").desc(), "station", "timestamp", "method")
    return table.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def time_split(rows: DataFrame, fraction: float = 0.8, by: Sequence[str] = CELL) -> DataFrame:
    """is_train: the row lies in the earliest `fraction` of its cell's time."""
    w = Window.partitionBy(*by)
    first, last = F.min("ts").over(w), F.max("ts").over(w)
    return rows.withColumn("is_train", F.timestamp_diff("MICROSECOND", first, F.col("ts")) <= F.timestamp_diff("MICROSECOND", first, last) * F.lit(fraction))


def validation_threshold(scored: DataFrame, share: float = 0.99, by: Sequence[str] = CELL) -> DataFrame:
    """(by, threshold): the quantile of the scores outside the training part; null where that is empty."""
    return scored.groupBy(*by).agg(F.percentile(F.when(~F.col("is_train"), F.col("score")), F.lit(share)).alias("threshold"))
