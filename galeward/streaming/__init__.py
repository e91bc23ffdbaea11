"""Readings as they come: bronze to the 10-minute grid with late data, and detections against a known scale."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galeward.functions import clean
from galeward.operators.grid import STEP

READING = "station string, sensor string, ts timestamp, value double"


def readings(spark: SparkSession, folder: str, per_trigger: int | None = None) -> DataFrame:
    """A stream of Parquet files of readings."""
    r = spark.readStream.schema(READING)
    if per_trigger:
        r = r.option("maxFilesPerTrigger", per_trigger)
    return r.parquet(folder).withColumn("value", clean(F.col("value")))


def ten_minute_means(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Means by station, sensor and bin, each emitted once its bin can get no more readings."""
    bins = stream.withWatermark("ts", late).groupBy("station", "sensor", F.window("ts", STEP))
    return bins.agg(F.avg("value").alias("value"), F.count("value").alias("n")).select("station", "sensor", F.col("window.start").alias("ts"), "value", "n")


def score_against(stream: DataFrame, scales: DataFrame, method: str = "z_score", threshold: float = 3.0) -> DataFrame:
    """Detections of a stream of bins against (station, sensor, mean, deviation) of the record so far: a row for each
    cell, joined as a static side. Centred windows need the future, so a stream is scored by the past."""
    z = F.when(F.col("deviation") > 0, F.try_divide(F.col("value") - F.col("mean"), F.col("deviation")))
    scored = stream.join(F.broadcast(scales), ["station", "sensor"]).withColumn("score", z).filter("score IS NOT NULL")
    return scored.select("station", "sensor", F.col("ts").alias("timestamp"), F.lit(method).alias("method"), (F.abs("score") > threshold).alias("flagged"), "score")


def write(stream: DataFrame, path: str, checkpoint: str):
    """Append to a Parquet table, exactly once; runs through what is there and ends."""
    return stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
