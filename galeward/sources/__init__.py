"""Raw sensor files in, detection and report tables out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galeward.functions import clean

SENSORS = ("pressure", "precipitation", "luminous_intensity")
# Fixed value: names of raw files, NN_sensor_station.csv.
FILE_NAME = r"^([0-9]{2})_(pressure|precipitation|luminous_intensity)_(.+)\.csv$"
DETECTION = "station string, sensor string, timestamp timestamp_ntz, method string, flagged boolean, score double"


def read_raw(spark: SparkSession, folder: str) -> DataFrame:
    """(index, station, sensor, ts, value): all readings of all sensor files of a folder, in one scan.

    Files of other names are left out. A time that a file has twice keeps the reading that comes first in
    it, by (file, byte block, row as read)."""
    lines = spark.read.schema("time timestamp_ntz, value double").option("header", True).option("pathGlobFilter", "*.csv").option("enforceSchema", True).csv(folder)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    rows = lines.select(
        F.regexp_extract(name, FILE_NAME, 1).alias("index"), F.regexp_extract(name, FILE_NAME, 3).alias("station"), F.regexp_extract(name, FILE_NAME, 2).alias("sensor"),
        F.col("time").alias("ts"), clean(F.col("value")).alias("value"), F.struct(name.alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("r")).alias("_at"),
    ).filter("sensor <> '' AND ts IS NOT NULL")
    return first_of_each(rows, ["station", "sensor", "ts"], "_at").withColumn("index", F.col("index").cast("int"))


def first_of_each(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Of rows alike in keys the one least by `order`, which is dropped."""
    others = [c for c in rows.columns if c not in keys and c != order]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*others), F.col(order)).alias("_r")).select(*keys, *[F.col(f"_r.{c}") for c in others])


def list_stations(raw: DataFrame) -> DataFrame:
    return raw.select("index", "station").distinct().orderBy("index")


def write_detections(detections: DataFrame, path: str) -> None:
    detections.write.mode("overwrite").partitionBy("method").parquet(path)


def read_detections(spark: SparkSession, *paths: str) -> DataFrame:
    """The union of detection tables, in the shared schema; a table is pruned by method."""
    return spark.read.schema(DETECTION).parquet(*paths).select("station", "sensor", "timestamp", "method", "flagged", "score")


def write_report(report: DataFrame, path: str) -> None:
    """A small report as one CSV file with a header."""
    report.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def runs_to_do(planned: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Planned runs that have no fit yet, so an interrupted study goes on where it stopped."""
    return planned.join(done.select(*keys), list(keys), "left_anti")
