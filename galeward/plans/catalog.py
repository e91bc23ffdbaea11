"""Queries over the stand-in network, by name, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galeward.operators import agreement as A
from galeward.operators import correlation as C
from galeward.operators import coverage as V
from galeward.operators import crossmethod as X
from galeward.operators import density, grid
from galeward.operators import detectors as D
from galeward.operators import reconstruction as R
from galeward.plans import stand_in as S
from galeward.sources import runs_to_do

#: Decision thresholds for a record of 30 days that is two thirds empty.
LIMITS = V.Thresholds(min_span_days=14, pct_degraded=65.0, pct_absent=90.0, max_gap_days=7.0, min_season_days=10)
LAGS = 6
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r6(df: DataFrame, *columns: str) -> DataFrame:
    """Columns rounded to 6 places; -0.0 as 0.0."""
    return df.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in columns})


# --- grid and coverage ----------------------------------------------------------------------------


@query(f"WITH {S.FOUND} SELECT station, sensor, method, count(*) AS n_scored, count_if(flagged) AS n_flagged, round(avg(flagged::INT), 6) AS flagged_rate FROM found GROUP BY 1, 2, 3")
def flag_summary(spark, sf):
    return r6(D.flag_summary(S.found(spark, sf)), "flagged_rate")


@query(f"WITH {S.RAW} SELECT station, ts, round(pressure, 6) AS pressure, round(precipitation, 6) AS precipitation, round(luminous_intensity, 6) AS luminous_intensity FROM wide")
def grid_resample(spark, sf):
    return r6(S.wide(spark, sf), *grid.SENSORS)


@query(f"WITH {S.FILLED} SELECT station, sensor, ts, round(value + 1e-10, 6) AS value FROM filled")
def gap_fill_limit(spark, sf):
    return S.round_value(S.filled(spark, sf))


@query(f"""WITH {S.NEIGHBOURS} SELECT n.station, n.sensor, n.ts, round(CASE WHEN n.value IS NOT NULL THEN n.value WHEN n.ni - n.pi - 1 <= {S.LIMIT} THEN p.value + (q.value - p.value) * (n.i - n.pi) / (n.ni - n.pi) END + 1e-10, 6) AS value
FROM nb n LEFT JOIN num p ON p.station = n.station AND p.sensor = n.sensor AND p.i = n.pi LEFT JOIN num q ON q.station = n.station AND q.sensor = n.sensor AND q.i = n.ni""")
def gap_fill_whole(spark, sf):
    return S.round_value(grid.fill_gaps(grid.to_long(S.wide(spark, sf)), S.LIMIT, leave_long_gaps=True))


_COVER = f"""{S.RAW}, gp AS (SELECT *, CASE WHEN epoch(ts - lag(ts) OVER (PARTITION BY station, sensor ORDER BY ts)) > 600 THEN epoch(ts - lag(ts) OVER (PARTITION BY station, sensor ORDER BY ts)) END AS gap FROM readings),
cover AS (SELECT station, sensor, min(ts) AS "start", max(ts) AS "end", count(*) AS actual_rows, count(gap) AS n_gaps, coalesce(max(gap), 0)::BIGINT AS max_gap_seconds, (floor(epoch(max(ts) - min(ts)) / 600) + 1)::BIGINT AS expected_rows FROM gp GROUP BY 1, 2)"""


@query(f"""WITH {_COVER} SELECT station, sensor, "start", "end", round(epoch("end" - "start") / 86400, 6) AS span_days, expected_rows, actual_rows, expected_rows - actual_rows AS missing_rows,
round(100.0 * (expected_rows - actual_rows) / expected_rows, 6) AS pct_missing, n_gaps, max_gap_seconds FROM cover""")
def coverage_table(spark, sf):
    return r6(V.coverage(S.readings(spark, sf)), "span_days", "pct_missing")


@query(f"""WITH {_COVER}, i AS (SELECT *, sum((gap IS NOT NULL)::INT) OVER (PARTITION BY station, sensor ORDER BY ts) AS segment FROM gp)
SELECT station, sensor, segment::BIGINT AS segment, min(ts) AS "start", max(ts) AS "end", count(*) AS n FROM i GROUP BY 1, 2, 3""")
def coverage_segments(spark, sf):
    return V.segments(S.readings(spark, sf))


_WINDOWS = f"""{_COVER}, span AS (SELECT station, max("start") AS s, min("end") AS e FROM cover GROUP BY 1 HAVING count(DISTINCT sensor) = 3 AND max("start") < min("end")),
ins AS (SELECT r.*, s, e FROM readings r JOIN span USING (station) WHERE ts BETWEEN s AND e),
ing AS (SELECT *, CASE WHEN epoch(ts - lag(ts) OVER (PARTITION BY station, sensor ORDER BY ts)) > 600 THEN epoch(ts - lag(ts) OVER (PARTITION BY station, sensor ORDER BY ts)) END AS gap FROM ins),
wc AS (SELECT station, sensor, round(epoch(max(e) - max(s)) / 86400, 6) AS span_days, (floor(epoch(max(e) - max(s)) / 600) + 1)::BIGINT AS expected_rows, count(*) AS actual_rows,
  round(100.0 * ((floor(epoch(max(e) - max(s)) / 600) + 1) - count(*)) / (floor(epoch(max(e) - max(s)) / 600) + 1), 6) AS pct_missing, count(gap) AS n_gaps,
  round(greatest(coalesce(max(gap), 0), epoch(min(ts) - max(s)), epoch(max(e) - max(ts))) / 86400, 6) AS max_gap_days FROM ing GROUP BY 1, 2)"""


@query(f"WITH {_WINDOWS} SELECT * FROM wc")
def window_coverage(spark, sf):
    r = S.readings(spark, sf)
    return r6(V.window_coverage(r, V.joint_spans(V.coverage(r))), "span_days", "pct_missing", "max_gap_days")


@query(f"""WITH {_WINDOWS}, tiers AS (SELECT station, sensor, CASE WHEN actual_rows = 0 OR pct_missing >= 90 THEN 'absent' WHEN span_days < 14 THEN 'short-history' WHEN pct_missing > 65 OR max_gap_days > 7 THEN 'degraded' ELSE 'ok' END AS tier FROM wc),
p AS (SELECT station, max(tier) FILTER (sensor = 'pressure') AS pressure, max(tier) FILTER (sensor = 'precipitation') AS precipitation, max(tier) FILTER (sensor = 'luminous_intensity') AS luminous_intensity,
  string_agg(sensor, ', ' ORDER BY CASE sensor WHEN 'pressure' THEN 1 WHEN 'precipitation' THEN 2 ELSE 3 END) FILTER (tier <> 'ok') AS weak FROM tiers GROUP BY 1),
d AS (SELECT station, s, e, unnest(generate_series(s::DATE, e::DATE, INTERVAL 1 DAY)) AS day FROM span),
n AS (SELECT station, any_value(s) AS s, any_value(e) AS e, count_if(month(day) IN (12, 1, 2, 3, 4))::DOUBLE AS dry_days, count_if(month(day) NOT IN (12, 1, 2, 3, 4))::DOUBLE AS wet_days FROM d GROUP BY 1),
c AS (SELECT p.*, n.*  EXCLUDE (station), concat_ws(', ', CASE WHEN dry_days < 10 THEN 'dry' END, CASE WHEN wet_days < 10 THEN 'wet' END) AS thin FROM p JOIN n USING (station))
SELECT station, pressure, precipitation, luminous_intensity,
  CASE WHEN pressure IN ('absent', 'short-history') THEN 'NO-GO' WHEN weak IS NOT NULL OR thin <> '' THEN 'CONDITIONAL-GO' ELSE 'GO' END AS decision,
  CASE WHEN pressure = 'absent' THEN 'pressure sensor effectively absent within the joint window' WHEN pressure = 'short-history' THEN 'joint sensor overlap under 14 days — insufficient history to use'
    WHEN weak IS NOT NULL THEN 'usable with caveats on: ' || weak WHEN thin <> '' THEN 'all sensors clean, but thin coverage for season(s): ' || thin || ' (<10d) — caution with seasonal conditioning'
    ELSE 'all sensors within coverage thresholds over the joint window' END AS rationale,
  dry_days, wet_days, s AS joint_span_start, e AS joint_span_end, round(epoch(e - s) / 86400, 6) AS joint_span_days FROM c""")
def station_decision(spark, sf):
    return r6(V.recommend(S.readings(spark, sf), LIMITS), "joint_span_days")


@query(f"WITH {_COVER} SELECT station, round(sum(actual_rows)::DOUBLE / sum(expected_rows), 6) AS availability FROM cover GROUP BY 1")
def station_availability(spark, sf):
    return r6(V.availability(V.coverage(S.readings(spark, sf))), "availability")


@query(f"WITH {S.FILLED} SELECT station, sensor, round(100.0 * avg((value IS NULL)::INT), 6) AS pct_missing_after_fill FROM filled GROUP BY 1, 2")
def post_fill_missingness(spark, sf):
    return r6(grid.missing_share(S.filled(spark, sf)), "pct_missing_after_fill")


@query(f"WITH {S.RAW} SELECT station, ts FROM wide WHERE precipitation = 0 AND pressure IS NULL AND luminous_intensity IS NULL")
def suspect_zero(spark, sf):
    w = S.wide(spark, sf)
    return w.filter(grid.suspect_zero(w)).select("station", "ts")


@query(f"""WITH {S.RAW} SELECT station, count(*) AS n_bins, round(avg((precipitation = 0)::INT), 6) AS zero_share, count_if(precipitation = 0 AND pressure IS NULL AND luminous_intensity IS NULL) AS suspect_zeros,
round(count_if(precipitation = 0 AND pressure IS NULL AND luminous_intensity IS NULL)::DOUBLE / greatest(count_if(precipitation = 0), 1), 6) AS suspect_share_of_zeros,
count_if(precipitation > 0 AND pressure IS NULL AND luminous_intensity IS NULL) AS nonzero_while_offline FROM wide GROUP BY 1""")
def precip_provenance(spark, sf):
    return r6(grid.rain_provenance(S.wide(spark, sf)), "zero_share", "suspect_share_of_zeros")


# --- correlation ----------------------------------------------------------------------------------

_PAIR = """pr AS (SELECT {k}, 'pressure' AS var1, 'precipitation' AS var2, pressure AS x, precipitation AS y FROM {t} UNION ALL SELECT {k}, 'pressure', 'luminous_intensity', pressure, luminous_intensity FROM {t}
  UNION ALL SELECT {k}, 'precipitation', 'luminous_intensity', precipitation, luminous_intensity FROM {t}),
ok AS (SELECT * FROM pr WHERE x IS NOT NULL AND y IS NOT NULL),
rk AS (SELECT *, rank() OVER (PARTITION BY {k}, var1, var2 ORDER BY x) + (count(*) OVER (PARTITION BY {k}, var1, var2, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY {k}, var1, var2 ORDER BY y) + (count(*) OVER (PARTITION BY {k}, var1, var2, y) - 1) / 2.0 AS ry FROM ok),
cr AS (SELECT {k}, var1, var2, CASE WHEN min(x) < max(x) AND min(y) < max(y) THEN corr(x, y) END AS pearson, CASE WHEN min(rx) < max(rx) AND min(ry) < max(ry) THEN corr(rx, ry) END AS spearman FROM rk GROUP BY ALL)"""


@query(f"WITH {S.RAW}, {_PAIR.format(k='station', t='wide')} SELECT station, var1, var2, round(pearson, 6) AS correlation FROM cr")
def pearson_pairs(spark, sf):
    return r6(C.pairwise(S.wide(spark, sf)).filter("method = 'pearson'").drop("method"), "correlation")


@query(f"WITH {S.RAW}, {_PAIR.format(k='station', t='wide')} SELECT station, var1, var2, round(spearman, 6) AS correlation FROM cr")
def spearman_pairs(spark, sf):
    return r6(C.pairwise(S.wide(spark, sf)).filter("method = 'spearman'").drop("method"), "correlation")


@query(f"WITH {S.RAW}, {_PAIR.format(k='station', t='wide')} SELECT station, var1, var2, CASE WHEN 'precipitation' IN (var1, var2) THEN 'spearman' ELSE 'pearson' END AS method, round(CASE WHEN 'precipitation' IN (var1, var2) THEN spearman ELSE pearson END, 6) AS correlation FROM cr")
def primary_correlation(spark, sf):
    return r6(C.primary(C.pairwise(S.wide(spark, sf))), "correlation")


_LAG = f"""{S.RAW}, lags AS (SELECT unnest(range(-{LAGS}, {LAGS + 1})) AS lag), n AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY ts) AS i FROM wide),
j AS (SELECT a.station, lag, a.pressure AS x, b.luminous_intensity AS y FROM n a CROSS JOIN lags LEFT JOIN n b ON a.station = b.station AND b.i = a.i + lag),
ccf AS (SELECT station, lag::INT AS lag, CASE WHEN count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) > 1 THEN corr(x, y) END AS r FROM j GROUP BY 1, 2)"""


@query(f"WITH {_LAG} SELECT station, lag, round(r, 6) AS correlation FROM ccf")
def lagged_corr_near(spark, sf):
    """One pair over LAGS, which SQL checks."""
    return r6(C.lagged(S.wide(spark, sf), "pressure", "luminous_intensity", LAGS), "correlation")


@query(f"""WITH {_LAG} SELECT station, arg_max(lag, abs(r)) AS peak_lag_steps, arg_max(lag, abs(r)) * 10 AS peak_lag_minutes, round(arg_max(r, abs(r)), 6) AS peak_correlation, round(max(r) FILTER (lag = 0), 6) AS lag0_correlation FROM ccf GROUP BY 1""")
def ccf_peak_near(spark, sf):
    """One pair over LAGS, which SQL checks."""
    return r6(C.lag_peaks(C.lagged(S.wide(spark, sf), "pressure", "luminous_intensity", LAGS)), "peak_correlation", "lag0_correlation")


def _each_pair(spark, sf, made):
    """made(correlations by lag) of every pair of sensors over all lags, with the pair's name after the station."""
    out = None
    for a, b in combinations(grid.SENSORS, 2):
        t = made(C.lagged(S.wide(spark, sf), a, b, C.MAX_LAG)).withColumn("pair", F.lit(f"{a}-{b}"))
        out = t if out is None else out.unionByName(t)
    return out.select("station", "pair", *[c for c in out.columns if c not in ("station", "pair")])


@query()
def lagged_corr(spark, sf):
    """All pairs over all lags; the SQL join over them is left to the near form."""
    return r6(_each_pair(spark, sf, lambda t: t), "correlation")


@query()
def ccf_peak(spark, sf):
    return r6(_each_pair(spark, sf, C.lag_peaks), "peak_correlation", "lag0_correlation")


@query(f"""WITH {S.RAW}, wb AS (SELECT *, CASE WHEN hour(ts) BETWEEN 6 AND 17 THEN 'day' ELSE 'night' END AS bucket FROM wide), {_PAIR.format(k='station, bucket', t='wb')}
SELECT station, bucket, var1, var2, 'pearson' AS method, round(pearson, 6) AS correlation, 'hour' AS group_by FROM cr UNION ALL SELECT station, bucket, var1, var2, 'spearman', round(spearman, 6), 'hour' FROM cr""")
def day_night_corr(spark, sf):
    return r6(C.conditioned(S.wide(spark, sf), "hour"), "correlation")


@query(f"""WITH wb AS (SELECT o_orderpriority AS station, CASE WHEN month(o_orderdate) IN (12, 1, 2, 3, 4) THEN 'dry' ELSE 'wet' END AS bucket, avg(o_totalprice) AS pressure, count(*) AS precipitation, avg(o_custkey) AS luminous_intensity FROM orders GROUP BY o_orderpriority, o_orderdate),
{_PAIR.format(k='station, bucket', t='wb')} SELECT station, bucket, var1, var2, 'pearson' AS method, round(pearson, 6) AS correlation, 'season' AS group_by FROM cr UNION ALL SELECT station, bucket, var1, var2, 'spearman', round(spearman, 6), 'season' FROM cr""")
def season_corr(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    daily = o.groupBy(F.col("o_orderpriority").alias("station"), F.col("o_orderdate").alias("ts")).agg(F.avg("o_totalprice").alias("pressure"), F.count("*").cast("double").alias("precipitation"), F.avg("o_custkey").alias("luminous_intensity"))
    return r6(C.conditioned(daily, "season"), "correlation")


# --- detectors ------------------------------------------------------------------------------------


@query(f"WITH {S.FILLED}, {S.Z} SELECT station, sensor, ts, round(score, 6) AS score FROM z")
def rolling_z(spark, sf):
    return r6(D.rolling_z(S.filled(spark, sf)).drop("value"), "score")


@query(f"WITH {S.FILLED}, {S.MZ} SELECT station, sensor, ts, round(score + 1e-12, 9) AS score FROM mz")
def rolling_modified_z(spark, sf):
    return D.rolling_modified_z(S.filled(spark, sf)).drop("value").withColumn("score", F.round(F.col("score") + F.lit(1e-12), 9) + F.lit(0.0))


@query(f"WITH {S.FILLED}, {S.HZ} SELECT station, sensor, ts, round(score, 6) AS score FROM hz")
def hour_z(spark, sf):
    return r6(D.hour_z(S.filled(spark, sf).filter("sensor = 'luminous_intensity'")).drop("value"), "score")


_FEATURES = f"{S.FILLED}, {S.features_sql()}"


@query(f"WITH {_FEATURES} SELECT * FROM feat")
def window_features(spark, sf):
    return _features(spark, sf)


def _features(spark, sf):
    return S.features(S.filled(spark, sf))


@query(f"""WITH {_FEATURES}, q AS (SELECT station, sensor, {', '.join(f"quantile_cont({c}, 0.25) AS {c}_1, quantile_cont({c}, 0.5) AS {c}_2, quantile_cont({c}, 0.75) AS {c}_3" for c in D.FEATURES)} FROM full_ GROUP BY 1, 2)
SELECT f.station, f.sensor, ts, {', '.join(f"round((f.{c} - {c}_2) / CASE WHEN {c}_3 <> {c}_1 THEN {c}_3 - {c}_1 ELSE 1 END, 5) AS scaled_{c}" for c in D.FEATURES)} FROM full_ f JOIN q ON f.station = q.station AND f.sensor = q.sensor""")
def robust_scale(spark, sf):
    x = D.scaled_features(_features(spark, sf))
    return x.select("station", "sensor", "ts", *[(F.round(f"scaled_{c}", 5) + F.lit(0.0)).alias(f"scaled_{c}") for c in D.FEATURES])


@query(f"""WITH {_FEATURES}, g AS (SELECT station, sensor, value, window_mean, window_std, window_slope, count(*) AS n FROM full_ GROUP BY ALL)
SELECT station, sensor, sum(n)::BIGINT AS n_scored, round(coalesce(sum(n) FILTER (n > 1), 0) / sum(n), 6) AS duplicate_share, round(max(n) / sum(n), 6) AS largest_tied_group_share FROM g GROUP BY 1, 2""")
def tie_degeneracy(spark, sf):
    return r6(D.tie_degeneracy(_features(spark, sf)), "duplicate_share", "largest_tied_group_share")


@query(f"""WITH {S.FOUND} SELECT sensor, method, round(avg(flagged::INT), 6) AS rate_at_published, {', '.join(f'round(quantile_cont(abs(score), {q}), 5) AS "cutoff_q{q}"' for q in (0.99, 0.995, 0.999))} FROM found GROUP BY 1, 2""")
def threshold_sensitivity(spark, sf):
    t = D.threshold_sensitivity(S.found(spark, sf))
    return r6(t, "rate_at_published").withColumns({c: F.round(F.col(f"`{c}`"), 5) for c in t.columns if c.startswith("cutoff")})


@query(f"""WITH {S.FOUND}, p AS (SELECT *, abs(score) AS strength, row_number() OVER (PARTITION BY sensor ORDER BY abs(score) DESC, station, "timestamp", method) AS place FROM found)
SELECT station, sensor, "timestamp", method, flagged, score, place::INT AS place FROM p WHERE place <= 2""")
def top_k_flags(spark, sf):
    return D.strongest(S.found(spark, sf), 2)


@query(f"""WITH {S.FILLED}, {S.Z}, t AS (SELECT station, sensor, abs(score) AS score, epoch_us(ts) - min(epoch_us(ts)) OVER w <= (max(epoch_us(ts)) OVER w - min(epoch_us(ts)) OVER w) * 0.8 AS is_train FROM z WINDOW w AS (PARTITION BY station, sensor))
SELECT station, sensor, round(quantile_cont(score, 0.99) FILTER (NOT is_train), 5) AS threshold FROM t GROUP BY 1, 2""")
def time_split_threshold(spark, sf):
    z = D.time_split(D.rolling_z(S.filled(spark, sf))).withColumn("score", F.abs("score"))
    return D.validation_threshold(z).withColumn("threshold", F.round("threshold", 5))


@query()
def lof(spark, sf):
    """All rows of all cells; nearest neighbours of every row among thousands are beyond the SQL check's time."""
    return D.detections(density.lof(_features(spark, sf)), "lof")


@query()
def isolation_forest(spark, sf):
    return D.detections(density.iforest(_features(spark, sf)), "isolation_forest")


def _fits(spark, sf, arch, passes=False):
    """The stored fits of an architecture, the primary run of every cell or the whole plan of passes. A fit ends when it stops to
    improve, after MAX_EPOCHS at the latest."""
    primary = S.stored(spark, sf, f"fits_{arch}", lambda: R.fit_scores(S.filled(spark, sf), R.plan(spark, [arch])))
    if not passes:
        return primary
    more = lambda: R.fit_scores(S.filled(spark, sf), runs_to_do(R.study(spark, [arch]), primary, R.RUN_KEYS))
    return primary.unionByName(S.stored(spark, sf, f"passes_{arch}", more))


def _all_fits(spark, sf):
    """The primary fits of all architectures; those that are not stored yet are made in one job, so that no architecture waits for
    another's last fit."""
    new = [a for a in R.METHODS if not S.is_stored(spark, sf, f"fits_{a}")]
    out = [_fits(spark, sf, a) for a in R.METHODS if a not in new]
    if new:
        out.append(S.stored(spark, sf, "_".join(["fits_of", *new]), lambda: R.fit_scores(S.filled(spark, sf), R.plan(spark, new))))
    return reduce(DataFrame.unionByName, out)


def _variants(spark, sf, keep, name):
    fits = _fits(spark, sf, "dense", passes=True).filter(keep)
    return R.reconstruction_detections(fits, name=F.concat(F.lit(f"{name}_"), F.col(name).cast("string")))


@query()
def autoencoder(spark, sf):
    return R.reconstruction_detections(_fits(spark, sf, "dense"))


@query()
def lstm_ae(spark, sf):
    return R.reconstruction_detections(_fits(spark, sf, "lstm"))


@query()
def gru_ae(spark, sf):
    return R.reconstruction_detections(_fits(spark, sf, "gru"))


_PRIMARY_WINDOW, _PRIMARY_LATENT = f"`window` = {R.WINDOW}", f"bottleneck = {R.LATENT}"


@query()
def seed_stability(spark, sf):
    """How far a dense autoencoder's flags depend on its seed."""
    return A.self_agreement(_variants(spark, sf, f"{_PRIMARY_WINDOW} AND {_PRIMARY_LATENT}", "seed"))


@query()
def bottleneck_ablation(spark, sf):
    return A.jaccard(A.pair_counts(A.align(_variants(spark, sf, f"{_PRIMARY_WINDOW} AND seed = 0", "bottleneck"))))


@query()
def window_control(spark, sf):
    keep = f"seed = 0 AND ({_PRIMARY_LATENT} AND {_PRIMARY_WINDOW} OR `window` = {R.CONTROL_WINDOW})"
    return A.jaccard(A.pair_counts(A.align(_variants(spark, sf, keep, "window"))))


@query()
def percentile_sensitivity(spark, sf):
    return R.percentile_sensitivity(_fits(spark, sf, "dense"))


@query()
def fit_health(spark, sf):
    return R.fit_health(_fits(spark, sf, "dense"))


# --- agreement ------------------------------------------------------------------------------------


@query(f"WITH {S.FOUND} SELECT sensor, method, count(*) AS n_scored FROM found GROUP BY 1, 2")
def applicable_methods(spark, sf):
    return A.applicable_methods(S.found(spark, sf))


@query(f'WITH {S.ALIGNED} SELECT station, sensor, "timestamp", method, strength FROM aligned')
def align_listwise(spark, sf):
    return S.aligned(spark, sf).drop("flagged")


@query(f"WITH {S.ALIGNED} SELECT sensor, method, count(*) AS n_aligned, count_if(flagged) AS n_flagged_native, round(100.0 * avg(flagged::INT), 6) AS rate_native_pct FROM aligned GROUP BY 1, 2")
def native_flags(spark, sf):
    t = S.aligned(spark, sf).groupBy("sensor", "method").agg(F.count("*").alias("n_aligned"), F.count_if("flagged").alias("n_flagged_native"), (100 * F.avg(F.col("flagged").cast("double"))).alias("rate_native_pct"))
    return r6(t, "rate_native_pct")


@query(f'WITH {S.MATCHED} SELECT station, sensor, "timestamp", method FROM matched WHERE flagged')
def matched_budget(spark, sf):
    return S.matched(spark, sf).filter("flagged").select(*A.KEY, "method")


@query(f"WITH {S.PAIRS} SELECT sensor, method_a, method_b, count_if(fa AND fb) AS \"both\", count_if(fa AND NOT fb) AS a_only, count_if(fb AND NOT fa) AS b_only, count_if(NOT fa AND NOT fb) AS neither, round(count_if(fa AND fb)::DOUBLE / nullif(count_if(fa OR fb), 0), 6) AS jaccard FROM pairs GROUP BY 1, 2, 3")
def jaccard_pairs(spark, sf):
    return r6(A.jaccard(A.pair_counts(S.matched(spark, sf))), "jaccard")


_P = "count_if(fa)::DOUBLE / count(*) AS pa, count_if(fb)::DOUBLE / count(*) AS pb, count_if(fa = fb)::DOUBLE / count(*) AS po"


@query(f"WITH {S.PAIRS}, k AS (SELECT sensor, method_a, method_b, {_P} FROM pairs GROUP BY 1, 2, 3) SELECT sensor, method_a, method_b, round(po, 6) AS raw_agreement, round((po - (pa * pb + (1 - pa) * (1 - pb))) / nullif(1 - (pa * pb + (1 - pa) * (1 - pb)), 0), 6) AS cohen_kappa FROM k")
def kappa_pairs(spark, sf):
    return r6(A.kappa(A.pair_counts(S.matched(spark, sf))).select("sensor", "method_a", "method_b", "raw_agreement", "cohen_kappa"), "raw_agreement", "cohen_kappa")


@query(f'WITH {S.PAIRS}, j AS (SELECT sensor, count_if(fa AND fb)::DOUBLE / nullif(count_if(fa OR fb), 0) AS j FROM pairs GROUP BY sensor, method_a, method_b) SELECT sensor, round(avg(j), 6) AS mean_pairwise, round(max(j), 6) AS max_pairwise FROM j GROUP BY 1')
def jaccard_summary(spark, sf):
    return r6(A.jaccard_summary(A.jaccard(A.pair_counts(S.matched(spark, sf)))), "mean_pairwise", "max_pairwise")


@query(f'WITH {S.MATCHED}, k AS (SELECT station, sensor, "timestamp", count_if(flagged) AS n FROM matched GROUP BY 1, 2, 3) SELECT sensor, n AS n_methods_flagging, count(*) AS n_rows FROM k GROUP BY 1, 2')
def consensus_counts(spark, sf):
    return X.consensus_counts(S.matched(spark, sf))


@query(f'WITH {S.MATCHED}, k AS (SELECT *, count_if(flagged) OVER (PARTITION BY station, sensor, "timestamp") AS n FROM matched) SELECT sensor, method, round(count_if(flagged AND n = 1)::DOUBLE / nullif(count_if(flagged), 0), 6) AS share_exclusive FROM k GROUP BY 1, 2')
def exclusive_share(spark, sf):
    return r6(X.exclusive_share(S.matched(spark, sf)), "share_exclusive")


@query(f"""WITH {S.MATCHED}, v AS (SELECT station, sensor, "timestamp", round(avg(share), 12) AS strength FROM ranked WHERE method IN ('z_score', 'modified_z_score') GROUP BY 1, 2, 3),
r AS (SELECT *, (rank() OVER (PARTITION BY station, sensor ORDER BY strength) + (count(*) OVER (PARTITION BY station, sensor, strength) - 1) / 2.0) / count(*) OVER (PARTITION BY station, sensor) AS share FROM v)
SELECT station, sensor, "timestamp", 'statistical' AS method FROM r WHERE share <= 0.01""")
def family_vote(spark, sf):
    return X.family_votes(S.aligned(spark, sf)).filter("flagged").drop("flagged")


@query(f"WITH {S.RUNS} SELECT * FROM runs")
def flag_runs(spark, sf):
    return X.flag_runs(S.matched(spark, sf))


@query(f"""WITH {S.RUNS} SELECT sensor, method, sum(length)::BIGINT AS n_flags, count(*) AS n_runs, median(length) AS median_run_bins, round(avg(length), 6) AS mean_run_bins, max(length) AS max_run_bins,
round(count_if(length = 1) / sum(length), 6) AS share_isolated, round(coalesce(sum(length) FILTER (length >= 6), 0) / sum(length), 6) AS share_in_long_runs FROM runs GROUP BY 1, 2""")
def run_length_summary(spark, sf):
    return r6(X.run_length_summary(X.flag_runs(S.matched(spark, sf))), "mean_run_bins", "share_isolated", "share_in_long_runs")


@query(f'WITH {S.RUNS} SELECT * FROM runs WHERE length >= 2 ORDER BY length DESC, station, "start", sensor, method LIMIT 5')
def longest_episodes(spark, sf):
    """The five longest runs of two bins or more: a report of the top."""
    runs = X.flag_runs(S.matched(spark, sf)).filter("length >= 2")
    return runs.orderBy(F.col("length").desc(), "station", "start", "sensor", "method").limit(5)


@query(f'WITH {S.CONTEXT} SELECT station, sensor, "timestamp", round(value, 6) AS value, hour::INT AS hour, round(global_pct, 6) AS global_pct, round(hour_pct, 6) AS hour_pct FROM context')
def percentile_context(spark, sf):
    return r6(X.percentile_context(S.aligned(spark, sf), _values(spark, sf)), "value", "global_pct", "hour_pct")


def _values(spark, sf):
    return S.round_value(S.filled(spark, sf))


_FIGURES = """count(*) AS n_flags, round(avg(g::INT), 6) AS share_global_extreme, round(avg(h::INT), 6) AS share_hour_extreme, round(avg((NOT g AND h)::INT), 6) AS share_contextual_only, round(avg((NOT g AND NOT h)::INT), 6) AS share_neither,
round(median(global_pct), 6) AS median_global_pct, round(avg((hour >= 18 OR hour < 6)::INT), 6) AS share_at_night"""


@query(f"""WITH {S.CONTEXT}, e AS (SELECT *, global_pct < 0.05 OR global_pct > 0.95 AS g, hour_pct < 0.05 OR hour_pct > 0.95 AS h FROM context)
SELECT e.sensor, method, {_FIGURES} FROM matched m JOIN e ON m.station = e.station AND m.sensor = e.sensor AND m."timestamp" = e."timestamp" WHERE flagged GROUP BY 1, 2
UNION ALL SELECT sensor, '{X.BASELINE}', {_FIGURES} FROM e GROUP BY 1""")
def contextual_profile(spark, sf):
    m = S.matched(spark, sf)
    return r6(X.contextual_profile(m, X.percentile_context(m, _values(spark, sf))), "share_global_extreme", "share_hour_extreme", "share_contextual_only", "share_neither", "median_global_pct", "share_at_night")


#: A stand-in pressure beyond this is taken as impossible.
TOO_HIGH = 150.0


@query(f"""WITH {S.MATCHED}, k AS (SELECT station, sensor, ts FROM filled WHERE sensor = 'pressure' AND value > {TOO_HIGH}),
n AS (SELECT method, count(*) AS n, avg(flagged::INT) AS f FROM aligned a SEMI JOIN k ON a.station = k.station AND a.sensor = k.sensor AND a."timestamp" = k.ts GROUP BY 1),
m AS (SELECT method, avg(flagged::INT) AS f FROM matched a SEMI JOIN k ON a.station = k.station AND a.sensor = k.sensor AND a."timestamp" = k.ts GROUP BY 1)
SELECT n.method, n AS n_impossible_rows, round(n.f, 6) AS detected_native, round(m.f, 6) AS detected_matched FROM n JOIN m ON n.method = m.method""")
def impossible_values(spark, sf):
    a = S.aligned(spark, sf)
    keys = S.filled(spark, sf).filter((F.col("sensor") == "pressure") & X.impossible(F.col("value"), float("-inf"), TOO_HIGH)).withColumnRenamed("ts", "timestamp")
    return r6(X.impossible_detected(a, A.matched_budget(a), keys), "detected_native", "detected_matched")


@query(f"""WITH {S.MATCHED}, k AS (SELECT station, ts FROM wide WHERE precipitation = 0 AND pressure IS NULL AND luminous_intensity IS NULL),
j AS (SELECT m.*, k.ts IS NOT NULL AS s FROM matched m LEFT JOIN k ON m.station = k.station AND m."timestamp" = k.ts WHERE m.sensor = 'precipitation')
SELECT method, count_if(flagged) AS flagged, count_if(flagged AND s) AS on_suspect_zero, round(count_if(flagged AND s)::DOUBLE / nullif(count_if(flagged), 0), 6) AS share_on_suspect_zero, round(avg(s::INT), 6) AS baseline_suspect_share FROM j GROUP BY 1""")
def flag_provenance(spark, sf):
    w = S.wide(spark, sf)
    keys = w.filter(grid.suspect_zero(w)).select("station", F.lit("precipitation").alias("sensor"), F.col("ts").alias("timestamp"))
    return r6(X.flag_provenance(S.matched(spark, sf).filter("sensor = 'precipitation'"), keys), "share_on_suspect_zero", "baseline_suspect_share")


@query(f"""WITH {S.PAIRS}, j AS (SELECT station, sensor, count_if(fa AND fb)::DOUBLE / nullif(count_if(fa OR fb), 0) AS j FROM pairs GROUP BY station, sensor, method_a, method_b),
s AS (SELECT station, sensor, round(avg(j), 6) AS mean_jaccard, round(max(j), 6) AS max_jaccard FROM j GROUP BY 1, 2), n AS (SELECT station, sensor, count(DISTINCT "timestamp") AS n_rows FROM aligned GROUP BY 1, 2),
p AS (SELECT station, sensor, round(100.0 * avg((value IS NULL)::INT), 6) AS pct_missing_after_fill FROM filled GROUP BY 1, 2)
SELECT n.station, n.sensor, n_rows, mean_jaccard, max_jaccard, pct_missing_after_fill FROM n LEFT JOIN s ON n.station = s.station AND n.sensor = s.sensor LEFT JOIN p ON n.station = p.station AND n.sensor = p.sensor""")
def station_heterogeneity(spark, sf):
    m = S.matched(spark, sf)
    pairs = A.jaccard(A.pair_counts(m, ("station", "sensor")))
    return r6(X.station_heterogeneity(pairs, m, grid.missing_share(S.filled(spark, sf))), "mean_jaccard", "max_jaccard", "pct_missing_after_fill")


def all_detections(spark, sf):
    """The shared table of all seven methods and the contextual one, stored once."""
    def made():
        x = D.window_features(S.filled(spark, sf))
        out = S.found(spark, sf).unionByName(D.detections(density.lof(x), "lof")).unionByName(D.detections(density.iforest(x), "isolation_forest"))
        return out.unionByName(R.reconstruction_detections(_all_fits(spark, sf)))

    return S.stored(spark, sf, "all_detections", made)


@query()
def full_roster_family_agreement(spark, sf):
    """Over all seven methods, models included."""
    return X.family_agreement(A.jaccard(A.pair_counts(A.matched_budget(A.align(all_detections(spark, sf))))))


@query(f"WITH {S.FILLED}, {S.features_sql()} SELECT count(*) AS n_scored, round(avg((window_std > 1)::INT), 6) AS extreme_share FROM full_")
def extreme_scores(spark, sf):
    """The share of scores beyond a limit, over the windows' deviations."""
    return r6(D.extreme_share(_features(spark, sf).dropna(subset=list(D.FEATURES)).withColumn("score", F.col("window_std")), 1.0), "extreme_share")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
