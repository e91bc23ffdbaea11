"""The regular time grid: consolidation, resampling, gap filling.

One wide table (station, ts, pressure, precipitation, luminous_intensity) stands for all stations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galeward.sources import SENSORS

STEP = "10 minutes"
STEP_SECONDS = 600
GAP_LIMIT = 36


def consolidate(readings: DataFrame, windows: DataFrame | None = None, sensors: Sequence[str] = SENSORS) -> DataFrame:
    """Long readings (station, sensor, ts, value) as one row for each station and time, all sensors outer-joined;
    trimmed to windows (station, start, end), both ends in, where given. Raises where a station lacks a sensor, which
    takes one job when the plan is made: at most one station's name reaches the driver."""
    if windows is not None:
        readings = readings.join(F.broadcast(windows), "station").filter(F.col("ts").between(F.col("start"), F.col("end"))).drop("start", "end")
    lacking = readings.groupBy("station").agg(F.collect_set("sensor").alias("s")).filter(F.size(F.array_except(F.array(*map(F.lit, sensors)), "s")) > 0).limit(1).collect()
    if lacking:
        raise ValueError(f"station {lacking[0]['station']} has no file of every sensor")
    return readings.groupBy("station", "ts").pivot("sensor", list(sensors)).agg(F.first("value"))


def resample(wide: DataFrame, values: Sequence[str] = SENSORS, by: str = "station", step: str = STEP) -> DataFrame:
    """Means over left-closed bins labelled by their start, with a row for every bin from a station's first to its last.

    Empty bins are made from the gap to the next bin, so the rows are shuffled once."""
    bins = wide.groupBy(by, F.window("ts", step)["start"].alias("ts")).agg(*[F.avg(c).alias(c) for c in values])
    gap = F.expr(f"INTERVAL {step}")
    after = F.lead("ts").over(Window.partitionBy(by).orderBy("ts"))
    spread = bins.withColumn("_next", F.coalesce(after, F.col("ts") + gap)).withColumn("_bin", F.explode(F.sequence("ts", F.col("_next") - gap, gap)))
    here = F.col("_bin") == F.col("ts")
    return spread.select(by, F.col("_bin").alias("ts"), *[F.when(here, F.col(c)).alias(c) for c in values])


def to_long(wide: DataFrame, values: Sequence[str] = SENSORS, by: str = "station") -> DataFrame:
    return wide.unpivot([by, "ts"], list(values), "sensor", "value")


def fill_gaps(grid: DataFrame, limit: int = GAP_LIMIT, leave_long_gaps: bool = False, by: Sequence[str] = ("station", "sensor")) -> DataFrame:
    """grid (by, ts, value) with gaps filled along the straight line between their ends.

    Of a gap the first `limit` bins are filled, or, with leave_long_gaps, all or none; a gap at either end of
    the record is never filled."""
    w = Window.partitionBy(*by).orderBy("ts")
    # the next known value is the last one seen from the other end: a frame that runs to the end would be gone through anew for every row
    back = w.rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*by).orderBy(F.col("ts").desc()).rowsBetween(Window.unboundedPreceding, 0)
    known = F.when(F.col("value").isNotNull(), F.struct(F.col("_i").alias("i"), F.col("value").alias("v")))
    rows = grid.withColumn("_i", F.row_number().over(w)).withColumns({"_p": F.last(known, True).over(back), "_n": F.last(known, True).over(ahead)})
    width = F.col("_n.i") - F.col("_p.i")
    within = (width - 1 <= limit) if leave_long_gaps else (F.col("_i") - F.col("_p.i") <= limit)
    line = F.col("_p.v") + (F.col("_n.v") - F.col("_p.v")) * F.try_divide(F.col("_i") - F.col("_p.i"), width)
    return rows.withColumn("value", F.coalesce(F.col("value"), F.when(within, line))).drop("_i", "_p", "_n")


def suspect_zero(wide: DataFrame) -> Column:
    """A zero of rain while the other two sensors are silent; on the unfilled grid."""
    return F.coalesce((F.col("precipitation") == 0.0) & F.col("pressure").isNull() & F.col("luminous_intensity").isNull(), F.lit(False))


def missing_share(filled: DataFrame, by: Sequence[str] = ("station", "sensor")) -> DataFrame:
    """Percentage of bins without a value."""
    return filled.groupBy(*by).agg((F.avg(F.col("value").isNull().cast("double")) * 100).alias("pct_missing_after_fill"))


def rain_provenance(wide: DataFrame) -> DataFrame:
    zero = F.coalesce(F.col("precipitation") == 0.0, F.lit(False))
    offline = F.col("pressure").isNull() & F.col("luminous_intensity").isNull()
    zeros, suspects = F.count_if(zero), F.count_if(suspect_zero(wide))
    return wide.groupBy("station").agg(
        F.count("*").alias("n_bins"), (zeros / F.count("*")).alias("zero_share"), suspects.alias("suspect_zeros"),
        (suspects / F.greatest(zeros, F.lit(1))).alias("suspect_share_of_zeros"), F.count_if(offline & (F.col("precipitation") > 0)).alias("nonzero_while_offline"),
    )
