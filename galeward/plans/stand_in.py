"""Station readings made of the driver's tables, and the tables that several queries share.

`events` stands in for a network: the event type is the station, a 10-minute bin's mean value the pressure, its mean
props.k the light, its excess of values over 100 the rain (0 in empty bins, as rain gauges report)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galeward.operators import agreement, detectors, grid
from galeward.operators.grid import to_long
from galeward.sources.scratch import cut, release

LIMIT = grid.GAP_LIMIT
_STORED: dict[tuple[str, str, str], DataFrame] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A table that queries share, written once for an application: plans that read it several times, or join it with
    itself, do not make it again."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORED:
        _STORED[key] = cut(make(), name)
    return _STORED[key]


def is_stored(spark: SparkSession, sf_dir: str, name: str) -> bool:
    return (spark.sparkContext.applicationId, sf_dir, name) in _STORED


def forget() -> None:
    """Delete the shared tables, so that the next query makes its own."""
    for table in _STORED.values():
        release(table)
    _STORED.clear()


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select("event_type", "ts", "value", F.get_json_object("props", "$.k").cast("double").alias("k"))
    return e.groupBy(F.col("event_type").alias("station"), F.window("ts", grid.STEP)["start"].alias("ts")).agg(
        F.avg("value").alias("pressure"), F.sum(F.greatest(F.col("value") - 100, F.lit(0.0))).alias("precipitation"), F.avg("k").alias("luminous_intensity"))


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(station, ts, three sensors) on the full grid, not filled."""
    made = lambda: grid.resample(bins(spark, sf_dir)).withColumn("precipitation", F.coalesce("precipitation", F.lit(0.0)))
    return stored(spark, sf_dir, "wide", made)


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(station, sensor, ts, value): what was recorded."""
    return to_long(wide(spark, sf_dir)).filter("value IS NOT NULL")


def filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "filled", lambda: grid.fill_gaps(to_long(wide(spark, sf_dir)), LIMIT))


def rounded_scores(table: DataFrame) -> DataFrame:
    """Scores rounded, so that ties are ties on any engine. Scores by medians are exact up to rounding and lie between
    6-digit numbers often, so they keep 9 digits, with a trifle added that sends exact halves up."""
    return table.withColumn("score", F.when(F.col("method") == "modified_z_score", F.round(F.col("score") + F.lit(1e-12), 9)).otherwise(F.round("score", 6)) + F.lit(0.0))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistical detectors' table."""
    return stored(spark, sf_dir, "found", lambda: rounded_scores(detectors.statistical_detections(filled(spark, sf_dir))))


def aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "aligned", lambda: agreement.align(found(spark, sf_dir)))


def matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "matched", lambda: agreement.matched_budget(aligned(spark, sf_dir)))


# DuckDB SQL of the same tables, to be put before a query's own.
RAW = """raw AS (SELECT event_type AS station, time_bucket(INTERVAL '10 minutes', ts) AS ts, avg(value) AS pressure,
  avg(CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS luminous_intensity, sum(greatest(value - 100, 0)) AS precipitation FROM events GROUP BY 1, 2),
grid AS (SELECT station, unnest(generate_series(min(ts), max(ts), INTERVAL '10 minutes')) AS ts FROM raw GROUP BY station),
wide AS (SELECT g.station, g.ts, pressure, coalesce(precipitation, 0.0) AS precipitation, luminous_intensity FROM grid g LEFT JOIN raw r ON g.station = r.station AND g.ts = r.ts),
long AS (SELECT station, 'pressure' AS sensor, ts, pressure AS value FROM wide UNION ALL SELECT station, 'precipitation', ts, precipitation FROM wide
  UNION ALL SELECT station, 'luminous_intensity', ts, luminous_intensity FROM wide),
readings AS (SELECT * FROM long WHERE value IS NOT NULL)"""
NEIGHBOURS = f"""{RAW},
num AS (SELECT *, row_number() OVER (PARTITION BY station, sensor ORDER BY ts) AS i FROM long),
nb AS (SELECT *, max(CASE WHEN value IS NOT NULL THEN i END) OVER (PARTITION BY station, sensor ORDER BY ts ROWS UNBOUNDED PRECEDING) AS pi,
  min(CASE WHEN value IS NOT NULL THEN i END) OVER (PARTITION BY station, sensor ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ni FROM num)"""
FILLED = f"""{NEIGHBOURS},
filled AS (SELECT n.station, n.sensor, n.ts, n.i, CASE WHEN n.value IS NOT NULL THEN n.value WHEN n.i - n.pi <= {LIMIT} THEN p.value + (q.value - p.value) * (n.i - n.pi) / (n.ni - n.pi) END AS value
  FROM nb n LEFT JOIN num p ON p.station = n.station AND p.sensor = n.sensor AND p.i = n.pi LEFT JOIN num q ON q.station = n.station AND q.sensor = n.sensor AND q.i = n.ni)"""
_NEAR = "(PARTITION BY station, sensor ORDER BY ts ROWS BETWEEN 18 PRECEDING AND 17 FOLLOWING)"
Z = f"""zs AS (SELECT *, count(value) OVER f AS n, avg(value) OVER f AS m, stddev_samp(value) OVER f AS s, stddev_samp(value) OVER (PARTITION BY station, sensor) AS g FROM filled WINDOW f AS {_NEAR}),
z AS (SELECT station, sensor, ts, CASE WHEN n >= 18 AND s IS NOT NULL AND greatest(s, coalesce(0.1 * g, 0)) > 0 THEN (value - m) / greatest(s, coalesce(0.1 * g, 0)) END AS score FROM zs)"""
MZ = f"""m1 AS (SELECT *, count(value) OVER f AS n, quantile_cont(value, 0.5) OVER f AS m FROM filled WINDOW f AS {_NEAR}),
m2 AS (SELECT station, sensor, ts, value, CASE WHEN n >= 18 THEN m END AS m, CASE WHEN n >= 18 THEN abs(value - m) END AS r FROM m1),
m3 AS (SELECT *, count(r) OVER f AS nr, quantile_cont(r, 0.5) OVER f AS d FROM m2 WINDOW f AS {_NEAR}),
gm AS (SELECT station, sensor, stddev_samp(value) AS gs, median(value) AS gv FROM filled GROUP BY 1, 2),
gd AS (SELECT f.station, f.sensor, median(abs(f.value - gv)) AS gd, max(gs) AS gs FROM filled f JOIN gm ON f.station = gm.station AND f.sensor = gm.sensor GROUP BY 1, 2),
m4 AS (SELECT m3.*, greatest(d, coalesce(0.1 * CASE WHEN gd <> 0 THEN gd ELSE gs END, 0)) AS scale FROM m3 JOIN gd ON m3.station = gd.station AND m3.sensor = gd.sensor),
mz AS (SELECT station, sensor, ts, CASE WHEN nr >= 18 AND d IS NOT NULL AND scale > 0 THEN 0.6745 * (value - m) / scale END AS score FROM m4)"""
HZ = """hs AS (SELECT *, avg(value) OVER w AS m, stddev_samp(value) OVER w AS s FROM filled WHERE sensor = 'luminous_intensity' WINDOW w AS (PARTITION BY station, sensor, hour(ts))),
hz AS (SELECT station, sensor, ts, CASE WHEN s > 0 THEN (value - m) / s END AS score FROM hs)"""
FOUND = f"""{FILLED}, {Z}, {MZ}, {HZ},
found AS (SELECT station, sensor, ts AS "timestamp", method, abs(score) > lim AS flagged, CASE WHEN method = 'modified_z_score' THEN round(score + 1e-12, 9) ELSE round(score, 6) END AS score FROM (
  SELECT *, 'z_score' AS method, 3.0 AS lim FROM z UNION ALL SELECT *, 'modified_z_score', 3.5 FROM mz UNION ALL SELECT *, 'z_score_context_hour', 3.0 FROM hz) WHERE score IS NOT NULL)"""
_RANK = "(rank() OVER (PARTITION BY station, sensor, method ORDER BY strength DESC) + (count(*) OVER (PARTITION BY station, sensor, method, strength) - 1) / 2.0) / count(*) OVER (PARTITION BY station, sensor, method)"


def aligned_sql(table: str) -> str:
    return f"""need AS (SELECT sensor, count(DISTINCT method) AS need FROM {table} GROUP BY sensor),
aligned AS (SELECT * EXCLUDE (have, need) FROM (SELECT f.*, abs(score) AS strength, need, count(*) OVER (PARTITION BY station, f.sensor, "timestamp") AS have FROM {table} f JOIN need ON f.sensor = need.sensor) WHERE have = need)"""


def matched_sql(table: str) -> str:
    return f"""{aligned_sql(table)},
ranked AS (SELECT *, {_RANK} AS share FROM aligned),
matched AS (SELECT station, sensor, "timestamp", method, strength, share <= 0.01 AS flagged FROM ranked)"""


_PAIRS = """pairs AS (SELECT a.station, a.sensor, a.method AS method_a, b.method AS method_b, a.flagged AS fa, b.flagged AS fb FROM {t} a JOIN {t} b
  ON a.station = b.station AND a.sensor = b.sensor AND a."timestamp" = b."timestamp" AND a.method < b.method)"""


def pairs_sql(table: str = "matched") -> str:
    return _PAIRS.format(t=table)


def runs_sql(table: str = "matched") -> str:
    """Runs of flagged bins that are neighbours in time."""
    return f"""on_ AS (SELECT *, coalesce(epoch("timestamp" - lag("timestamp") OVER w) <> 600, true) AS fresh FROM {table} WHERE flagged WINDOW w AS (PARTITION BY station, sensor, method ORDER BY "timestamp")),
ids AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY station, sensor, method ORDER BY "timestamp") AS run FROM on_),
runs AS (SELECT station, sensor, method, min("timestamp") AS "start", max("timestamp") AS "end", count(*) AS length FROM ids GROUP BY station, sensor, method, run)"""


def round_value(rows: DataFrame) -> DataFrame:
    """Values to 6 places, a trifle added so that exact halves at the 7th go up on any engine."""
    return rows.withColumn("value", F.round(F.col("value") + F.lit(1e-10), 6) + F.lit(0.0))


def features(filled: DataFrame, window: int = detectors.FEATURE_WINDOW) -> DataFrame:
    """Windows' figures to 6 places, a trifle added so that exact halves at the 7th go up on any engine."""
    rows = detectors.window_features(filled, window)
    return rows.withColumns({c: F.round(F.col(c) + F.lit(1e-10), 6) + F.lit(0.0) for c in detectors.FEATURES})


def features_sql(window: int = 6, tag: str = "") -> str:
    """feat and full_ (complete rows), each with the tag behind its name."""
    return f"""wf{tag} AS (SELECT *, count(value) OVER f = {window} AS whole, avg(value) OVER f AS m, stddev_samp(value) OVER f AS sd, regr_slope(value, i) OVER f * 6 AS sl FROM filled
  WINDOW f AS (PARTITION BY station, sensor ORDER BY ts ROWS BETWEEN {window // 2} PRECEDING AND {window // 2 - 1} FOLLOWING)),
feat{tag} AS (SELECT station, sensor, ts, round(value + 1e-10, 6) AS value, round(CASE WHEN whole THEN m END + 1e-10, 6) AS window_mean,
  round(CASE WHEN whole THEN sd END + 1e-10, 6) AS window_std, round(CASE WHEN whole THEN sl END + 1e-10, 6) AS window_slope FROM wf{tag}),
full_{tag} AS (SELECT * FROM feat{tag} WHERE value IS NOT NULL AND window_mean IS NOT NULL)"""


ALIGNED = f"{FOUND}, {aligned_sql('found')}"
MATCHED = f"{FOUND}, {matched_sql('found')}"
PAIRS = f"{MATCHED}, {pairs_sql()}"
RUNS = f"{MATCHED}, {runs_sql()}"
CONTEXT_TABLES = f"""keys AS (SELECT DISTINCT station, sensor, "timestamp" FROM aligned),
kv AS (SELECT k.*, round(value + 1e-10, 6) AS value, hour(k."timestamp") AS hour FROM keys k LEFT JOIN filled f ON f.station = k.station AND f.sensor = k.sensor AND f.ts = k."timestamp"),
context AS (SELECT *, (rank() OVER (PARTITION BY station, sensor ORDER BY value) + (count(*) OVER (PARTITION BY station, sensor, value) - 1) / 2.0) / count(*) OVER (PARTITION BY station, sensor) AS global_pct,
  (rank() OVER (PARTITION BY station, sensor, hour ORDER BY value) + (count(*) OVER (PARTITION BY station, sensor, hour, value) - 1) / 2.0) / count(*) OVER (PARTITION BY station, sensor, hour) AS hour_pct FROM kv)"""
CONTEXT = f"{MATCHED},\n{CONTEXT_TABLES}"
