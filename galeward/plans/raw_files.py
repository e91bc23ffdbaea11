"""Queries over raw sensor files: the stand-in's readings written as such files, one for each station and sensor, and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galeward.operators import coverage as V
from galeward.operators import grid
from galeward.plans import stand_in as S
from galeward.plans.catalog import LIMITS, SQL, query, r6
from galeward.sources import list_stations, read_raw
from galeward.sources.scratch import file_system, session_folder


def write_raw(spark, readings: DataFrame) -> str:
    """A folder of NN_sensor_station.csv files (time, value) of (station, sensor, ts, value). Stations are numbered by name."""
    home = session_folder(spark)
    parts, folder = f"{home}/parts-{uuid.uuid4().hex}", f"{home}/raw-{uuid.uuid4().hex}"
    rows = readings.select("station", "sensor", F.col("ts").alias("time"), "value").repartition("station", "sensor").sortWithinPartitions("station", "sensor", "time")
    rows.write.partitionBy("station", "sensor").option("header", True).csv(parts)
    fs, at = file_system(spark, parts)
    to = lambda name: file_system(spark, f"{folder}/{name}")[1]
    fs.mkdirs(file_system(spark, folder)[1])
    names = sorted(x.getPath().getName() for x in fs.listStatus(at) if x.isDirectory())
    for index, name in enumerate(names, 1):
        for sensor in fs.listStatus(file_system(spark, f"{parts}/{name}")[1]):
            for file in fs.listStatus(sensor.getPath()):
                fs.rename(file.getPath(), to(f"{index:02}_{sensor.getPath().getName().split('=')[1]}_{name.split('=')[1]}.csv"))
    fs.delete(at, True)
    return folder


def raw(spark, sf) -> DataFrame:
    return S.stored(spark, sf, "raw", lambda: read_raw(spark, write_raw(spark, S.readings(spark, sf))))


@query("SELECT row_number() OVER (ORDER BY station)::INT AS \"index\", station FROM (SELECT DISTINCT event_type AS station FROM events)")
def raw_stations(spark, sf):
    return list_stations(raw(spark, sf))


@query(f"""WITH {S.RAW}, d AS ({SQL['station_decision']}) SELECT w.station, w.ts, round(pressure, 6) AS pressure, round(precipitation, 6) AS precipitation, round(luminous_intensity, 6) AS luminous_intensity
FROM wide w JOIN (SELECT station, joint_span_start AS s, joint_span_end AS e FROM d WHERE decision IN ('GO', 'CONDITIONAL-GO')) x ON x.station = w.station WHERE w.ts BETWEEN s AND e""")
def raw_consolidated(spark, sf):
    """Files to readings, readings to decisions, the stations in scope as one row for each time within their joint span."""
    readings = raw(spark, sf).filter("value IS NOT NULL")
    scope = S.stored(spark, sf, "scope", lambda: V.in_scope(V.recommend(readings, LIMITS)).drop("decision"))
    return r6(grid.consolidate(readings.select("station", "sensor", "ts", "value"), scope), *grid.SENSORS)
