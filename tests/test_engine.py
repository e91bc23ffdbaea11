import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from galeward import sources
from galeward.functions import mean_rank_share
from galeward.operators import correlation as C
from galeward.operators import coverage as V
from galeward.operators import density, grid
from galeward.operators import detectors as D
from galeward.operators import reconstruction as R

START = dt.datetime(2025, 1, 1)
LONG = "station string, sensor string, ts timestamp_ntz, value double"


def series(spark, values, sensor="pressure", station="s"):
    rows = [(station, sensor, START + dt.timedelta(minutes=10 * i), None if v is None or math.isnan(v) else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, LONG)


def column(df, name):
    return [r[name] for r in df.orderBy("ts").collect()]


def noisy(n=300, seed=0):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(0, 1, n).cumsum(), 1)
    x[rng.random(n) < 0.1] = np.nan
    x[60:90] = np.nan
    x[200:240] = 5.0
    return x


def close(got, want):
    for g, w in zip(got, want, strict=True):
        assert (g is None) == bool(np.isnan(w)) and (g is None or abs(g - w) < 1e-9), (g, w)


def test_files_to_readings(spark, tmp_path):
    (tmp_path / "03_pressure_here.csv").write_bytes(b"time,value_hPa\r\n2025-11-19 10:50:00,1022.04\r\n2025-11-19 11:00:00,1022.015\r\n2025-11-19 11:00:00,9.0\r\n2025-11-19 11:10:00,NaN\r\n")
    (tmp_path / "04_precipitation_far-away.csv").write_text("time,value_mm\n2025-11-19 10:50:00,0.0\n")
    (tmp_path / "README.md").write_text("time,value\n2025-11-19 10:50:00,0.0\n")
    (tmp_path / "other.csv").write_text("time,value\n2025-11-19 10:50:00,0.0\n")
    raw = sources.read_raw(spark, str(tmp_path))
    got = sorted((r["index"], r.station, r.sensor, r.ts.minute, r.value) for r in raw.collect() if r.value is not None)
    assert got == [(3, "here", "pressure", 0, 1022.015), (3, "here", "pressure", 50, 1022.04), (4, "far-away", "precipitation", 50, 0.0)]
    assert [(r["index"], r.station) for r in sources.list_stations(raw).collect()] == [(3, "here"), (4, "far-away")]
    with pytest.raises(ValueError, match="has no file of every sensor"):
        grid.consolidate(raw)


def test_detections_round_trip(spark, tmp_path):
    t = D.statistical_detections(series(spark, noisy(60)))
    sources.write_detections(t, str(tmp_path / "d"))
    back = sources.read_detections(spark, str(tmp_path / "d"))
    assert back.count() == t.count() and back.exceptAll(t).isEmpty()
    planned, done = R.plan(spark, ["dense"], seeds=(0, 1)), R.plan(spark, ["dense"], seeds=(1,))
    assert [r.seed for r in sources.runs_to_do(planned, done, ["arch", "window", "bottleneck", "seed"]).collect()] == [0]


def test_resample_makes_empty_bins(spark):
    rows = [("s", START + dt.timedelta(minutes=m), float(v), 0.0, None) for m, v in ((3, 1), (10, 2), (12, 4), (45, 9))]
    wide = spark.createDataFrame(rows, "station string, ts timestamp_ntz, pressure double, precipitation double, luminous_intensity double")
    got = grid.resample(wide).orderBy("ts").collect()
    assert [r.pressure for r in got] == [1.0, 3.0, None, None, 9.0] and got[1].ts == START + dt.timedelta(minutes=10)


def test_fill_gaps(spark):
    x = [0, *[None] * 10, 11, *[None] * 3, 15, None, None]
    assert column(grid.fill_gaps(series(spark, x), 4), "value") == [0, 1, 2, 3, 4, *[None] * 6, 11, 12, 13, 14, 15, None, None]
    assert column(grid.fill_gaps(series(spark, x), 4, leave_long_gaps=True), "value") == [0, *[None] * 10, 11, 12, 13, 14, 15, None, None]
    assert column(grid.fill_gaps(series(spark, [None, 1, None, 3]), 4), "value") == [None, 1, 2, 3]


def test_coverage_and_decisions(spark):
    bins = [0, 1, 2, 5, 6, 20]
    rows = [("s", sensor, START + dt.timedelta(minutes=10 * b), 1.0) for sensor in sources.SENSORS for b in (bins if sensor == "pressure" else range(21))]
    rows += [("t", "pressure", START, 1.0), ("t", "precipitation", START, 1.0)]
    r = spark.createDataFrame(rows, LONG)
    got = {(x.station, x.sensor): x for x in V.coverage(r).collect()}
    p = got["s", "pressure"]
    assert (p.expected_rows, p.actual_rows, p.missing_rows, p.n_gaps, p.max_gap_seconds) == (21, 6, 15, 2, 14 * 600)
    assert sorted(x.n for x in V.segments(r).filter("sensor = 'pressure' AND station = 's'").collect()) == [1, 2, 3]
    rec = {x.station: x for x in V.recommend(r, V.Thresholds(min_span_days=0, min_season_days=0)).collect()}
    assert rec["t"].decision == "NO-GO" and rec["t"].rationale == "sensors have no overlapping recorded period" and rec["t"].joint_span_start is None
    assert rec["s"].decision == "CONDITIONAL-GO" and rec["s"].rationale == "usable with caveats on: pressure" and rec["s"].dry_days == 1.0
    assert {x.decision for x in V.recommend(r).collect()} == {"NO-GO"}
    o = spark.createDataFrame([("s", "GO", "seen in person")], "station string, decision string, reason string")
    again = {x.station: x for x in V.recommend(r, V.Thresholds(min_span_days=0, min_season_days=0), o).collect()}
    assert again["s"].rationale == "manual override: seen in person" and [x.station for x in V.in_scope(V.recommend(r, V.Thresholds(min_span_days=0, min_season_days=0), o)).collect()] == ["s"]


def test_rolling_scores_equal_pandas(spark):
    x = noisy()
    s = pd.Series(x)
    roll = s.rolling(36, center=True, min_periods=18)
    scale = roll.std().clip(lower=0.1 * s.std())
    close(column(D.rolling_z(series(spark, x)), "score"), ((s - roll.mean()) / scale).where(scale > 0))
    mid = roll.median()
    mad = (s - mid).abs().rolling(36, center=True, min_periods=18).median().clip(lower=0.1 * (s - s.median()).abs().median())
    close(column(D.rolling_modified_z(series(spark, x)), "score"), (0.6745 * (s - mid) / mad).where(mad > 0))
    hour = pd.Series([(START + dt.timedelta(minutes=10 * i)).hour for i in range(len(x))])
    g = s.groupby(hour)
    close(column(D.hour_z(series(spark, x)), "score"), (s - g.transform("mean")) / g.transform("std"))


def test_features_and_scaling(spark):
    ramp = D.window_features(series(spark, range(12)))
    assert [r.window_slope and round(r.window_slope, 9) for r in ramp.orderBy("ts").collect()] == [None] * 3 + [6.0] * 7 + [None] * 2
    scaled = D.scaled_features(ramp).orderBy("ts").collect()
    assert len(scaled) == 7 and abs(np.median([r.scaled_value for r in scaled])) < 1e-12
    zero = D.scaled_features(D.window_features(series(spark, [0.0] * 20)))
    assert {r.scaled_value for r in zero.collect()} == {0.0}


def test_mean_ranks(spark):
    df = spark.createDataFrame([(v,) for v in [5.0, 5.0, 3.0, 1.0, None]], "v double")
    got = [r.r for r in df.select("v", mean_rank_share(F.col("v"), [F.lit(1)], True).alias("r")).orderBy(F.col("v").desc_nulls_last()).collect()]
    assert got == [0.375, 0.375, 0.75, 1.0, None]


def test_correlations(spark):
    rows = [("s", START + dt.timedelta(minutes=10 * i), a, b, 1.0) for i, (a, b) in enumerate([(1.0, 2.0), (2.0, 1.0), (3.0, 5.0), (None, 7.0), (9.0, None)])]
    wide = spark.createDataFrame(rows, "station string, ts timestamp_ntz, pressure double, precipitation double, luminous_intensity double")
    got = {(r.var1, r.var2, r.method): r.correlation for r in C.pairwise(wide).collect()}
    assert got["pressure", "precipitation", "spearman"] == pytest.approx(0.5) and got.get(("pressure", "luminous_intensity", "pearson")) is None
    assert C.primary(C.pairwise(wide)).count() == 3
    with pytest.raises(ValueError, match="group_by must be one of"):
        C.conditioned(wide, "week")
    lags = {r.lag: r.correlation for r in C.lagged(wide, "pressure", "pressure", 1).collect()}
    assert lags[0] == pytest.approx(1.0) and C.lag_peaks(C.lagged(wide, "pressure", "pressure", 1)).first().peak_lag_steps == -1  # all lags are perfect here, the smallest is named


def by_force_lof(x, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    near = [sorted((j for j in range(len(x)) if j != i), key=lambda j: (d[i, j], j))[:k] for i in range(len(x))]
    reach = [d[i, near[i][-1]] for i in range(len(x))]
    lrd = [1 / (np.mean([max(d[i, j], reach[j]) for j in near[i]]) + 1e-10) for i in range(len(x))]
    return np.array([np.mean([lrd[j] for j in near[i]]) / lrd[i] for i in range(len(x))])


def test_lof_equals_brute_force():
    rng = np.random.default_rng(0)
    x = np.round(rng.normal(size=(90, 4)), 1)
    x[:25] = x[0]
    assert np.allclose(density.local_outlier_factor(x, 20), by_force_lof(x, 20), rtol=1e-6)
    assert density.local_outlier_factor(x[:1]).tolist() == [1.0]


def test_isolation_forest_finds_what_lies_apart():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 4))
    x[7] = 9.0
    s = density.isolation_forest(x, 100)
    assert s.argmax() == 7 and s[7] > 0.65 and 0.3 < np.median(s) < 0.5
    assert (s == density.isolation_forest(x, 100)).all()


def test_isolation_forest_parts_values_that_are_neighbours():
    x = np.array([[1.0], [np.nextafter(1.0, 2.0)]] * 40)
    assert np.isfinite(density.isolation_forest(x, 50)).all() and np.isfinite(density.isolation_forest(np.ones((9, 4)), 5)).all()


@pytest.mark.parametrize("arch", ["dense", "lstm", "gru"])
def test_gradients(arch):
    rng = np.random.default_rng(2)
    model = R.make(arch, 6, 2, 0)
    x = rng.normal(size=(5, 6))
    y, kept = model.forward(x)
    g = model.backward(kept, 2 * (y - x) / x.size)
    loss = lambda: float(((model.forward(x)[0] - x) ** 2).mean())
    for name, p in model.p.items():
        k = int(rng.integers(p.size))
        old = p.flat[k]
        p.flat[k] = old + 1e-6
        up = loss()
        p.flat[k] = old - 1e-6
        down = loss()
        p.flat[k] = old
        assert abs((up - down) / 2e-6 - g[name].flat[k]) < 1e-6, name


def test_model_sizes():
    assert [R.parameters(R.make(a, 36, 8, 0)) for a in ("dense", "gru", "lstm")] == [1574, 3171, 4123]
    assert R.latent_for(36) == 8 and R.latent_for(6) == 2


def test_fits(spark):
    x = np.sin(np.arange(150) / 5) + 1
    fits = R.fit_scores(series(spark, x), R.plan(spark, ["dense"]), epochs=5).cache()
    assert fits.count() == 115 and R.fit_health(fits, 5).first().scores_vary
    assert R.reconstruction_detections(fits).filter("method = 'autoencoder'").count() == 115
    one = R.fit_scores(series(spark, x[:36]), R.plan(spark, ["dense"]), epochs=5)
    d = R.reconstruction_detections(one).collect()
    assert len(d) == 1 and not d[0].flagged  # no validation part: nothing is flagged
    again = R.fit_scores(series(spark, x), R.plan(spark, ["dense"]), epochs=5)
    assert fits.select("ts", "score").exceptAll(again.select("ts", "score")).isEmpty()


def test_stream_equals_batch(spark, tmp_path):
    from galeward import streaming

    rows = [("s", "pressure", START + dt.timedelta(minutes=m), float(m)) for m in range(0, 600, 4)]
    spark.createDataFrame(rows, "station string, sensor string, ts timestamp, value double").repartition(3).write.parquet(str(tmp_path / "in"))
    means = streaming.ten_minute_means(streaming.readings(spark, str(tmp_path / "in")), "0 seconds")
    streaming.write(means, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    got = {r.ts: r.value for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    whole = spark.read.parquet(str(tmp_path / "in")).groupBy(F.window("ts", "10 minutes").start.alias("ts")).agg(F.avg("value").alias("v"))
    want = {r.ts: r.v for r in whole.collect()}
    assert len(got) >= len(want) - 1 and all(want[k] == v for k, v in got.items())


def test_stations_spread_over_their_sizes(spark):
    rows = [(f"s{i}", "pressure", 10 * i) for i in range(12)]
    got = R.evenly_spaced_stations(spark.createDataFrame(rows, "station string, sensor string, n_train long")).collect()
    assert sorted(r.n_train for r in got) == [0, 40, 70, 110]


def test_displacement_table(spark):
    from galeward.operators.crossmethod import displacement

    rows = [("reseed", s, j) for s, j in (("pressure", 0.6), ("precipitation", 0.8), ("luminous_intensity", 0.7))] + [("window", "pressure", 0.2)]
    got = displacement(spark.createDataFrame(rows, "change string, sensor string, jaccard double")).collect()
    assert [(r.change, r.pressure, r.overall) for r in got] == [("reseed", 0.6, 0.7), ("window", 0.2, 0.2)] and got[1].precipitation is None


def test_suspect_zeros_and_rain_provenance(spark):
    rows = [("s", START + dt.timedelta(minutes=10 * i), p, r, l) for i, (p, r, l) in enumerate([(1.0, 0.0, 1.0), (None, 0.0, None), (None, 0.3, None), (None, 0.0, 2.0)])]
    wide = spark.createDataFrame(rows, "station string, ts timestamp_ntz, pressure double, precipitation double, luminous_intensity double")
    r = grid.rain_provenance(wide).first()
    assert (r.n_bins, r.suspect_zeros, r.nonzero_while_offline, round(r.suspect_share_of_zeros, 6)) == (4, 1, 1, round(1 / 3, 6))
