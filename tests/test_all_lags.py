from datetime import datetime, timedelta
from itertools import combinations

import numpy as np
import pytest

from galeward.operators import grid
from galeward.plans import catalog


def test_lags_and_peaks_equal_brute_force(spark, monkeypatch):
    """Three pairs, lags of -36 to 36; the light follows the pressure by 29 bins, out of reach of six lags."""
    rng = np.random.default_rng(3)
    p, r = rng.normal(size=(2, 240))
    x = dict(zip(grid.SENSORS, (p, r, 0.0 * p))) | {"luminous_intensity": np.r_[rng.normal(size=29), p[:-29]] + rng.normal(size=240) / 10}
    x["precipitation"][[7, 90]] = np.nan
    rows = [("s", datetime(2024, 1, 1) + timedelta(minutes=10 * i), *(None if np.isnan(x[c][i]) else float(x[c][i]) for c in grid.SENSORS)) for i in range(240)]
    table = spark.createDataFrame(rows, "station string, ts timestamp, " + ", ".join(f"{c} double" for c in grid.SENSORS))
    monkeypatch.setattr(catalog.S, "wide", lambda *a: table)
    want = {}
    for a, b in combinations(grid.SENSORS, 2):
        for k in range(-36, 37):
            u, v = (x[a][: 240 - k], x[b][k:]) if k >= 0 else (x[a][-k:], x[b][:k])
            both = ~np.isnan(u) & ~np.isnan(v)
            want[f"{a}-{b}", k] = np.corrcoef(u[both], v[both])[0, 1]
    got = {(g.pair, g.lag): g.correlation for g in catalog.lagged_corr(spark, "").collect()}
    assert got.keys() == want.keys() and got == {k: pytest.approx(w, abs=1e-6) for k, w in want.items()}
    peaks = {g.pair: g for g in catalog.ccf_peak(spark, "").collect()}
    assert len(peaks) == 3 and peaks["pressure-luminous_intensity"].peak_lag_steps == 29
    for pair, g in peaks.items():
        lag = max(range(-36, 37), key=lambda k: abs(want[pair, k]))
        assert (g.peak_lag_steps, g.peak_lag_minutes) == (lag, lag * 10)
        assert (g.peak_correlation, g.lag0_correlation) == pytest.approx((want[pair, lag], want[pair, 0]), abs=1e-6)
