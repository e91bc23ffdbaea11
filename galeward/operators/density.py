"""Density detectors: local outlier factor and isolation forest, one model for each cell.

A cell (one sensor of one station) is tens of thousands of rows at most, since time bounds it; cells are
the unit of parallelism. Fitting runs in numpy within its own task, in blocks that bound memory."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galeward.operators.detectors import CELL, FEATURES, scaled_features

NEIGHBOURS = 20
TREES, SUBSAMPLE, SEED = 200, 256, 0
DEGENERATE = 1e3
_BLOCK = 512


def local_outlier_factor(x: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
    """LOF of the rows of x among themselves; equal distances go by row."""
    n = len(x)
    k = min(neighbours, n - 1)
    if k < 1:
        return np.ones(n)
    near, dist = np.empty((n, k), np.int64), np.empty((n, k))
    for a in range(0, n, _BLOCK):
        block = x[a : a + _BLOCK]
        d = np.zeros((len(block), n))
        for c in range(x.shape[1]):
            d += (block[:, c : c + 1] - x[None, :, c]) ** 2
        d[np.arange(len(block)), np.arange(a, a + len(block))] = np.inf
        limit = np.partition(d, k - 1, 1)[:, k - 1 : k]
        # all below the k-th distance, then the first rows at it
        tied = d == limit
        wanted = k - (d < limit).sum(1, keepdims=True)
        take = (d < limit) | (tied & (np.cumsum(tied, 1) <= wanted))
        idx = np.nonzero(take)[1].reshape(len(block), k)
        near[a : a + _BLOCK], dist[a : a + _BLOCK] = idx, np.sqrt(np.take_along_axis(d, idx, 1))
    reach = dist.max(1)
    density = 1.0 / (np.maximum(dist, reach[near]).mean(1) + 1e-10)
    return density[near].mean(1) / density


def _path(n) -> np.ndarray:
    """Mean depth of an unsuccessful search among n rows."""
    n = np.asarray(n, float)
    m = np.maximum(n - 1, 1)
    return np.where(n > 2, 2 * (np.log(m) + np.euler_gamma) - 2 * m / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def _grow(x: np.ndarray, height: int, rng) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A tree over the rows of x: feature (-1 at a leaf), place and first child of each node (the second follows),
    and at a leaf the depth that a search ends at."""
    feature, place, child, depth = [-1], [0.0], [0], [0.0]
    waiting = [(0, x, 0)]
    for node, own, level in waiting:
        low, high = own.min(0), own.max(0)
        wide = np.flatnonzero(high > low)
        if level == height or not len(wide):
            depth[node] = level + float(_path(len(own)))
            continue
        f = int(rng.choice(wide))
        # below the highest value even where rounding would reach it, so that neither part is empty
        feature[node], place[node], child[node] = f, min(rng.uniform(low[f], high[f]), np.nextafter(high[f], low[f])), len(feature)
        above = own[:, f] > place[node]
        for part in (own[~above], own[above]):
            waiting.append((len(feature), part, level + 1))
            for column, empty in ((feature, -1), (place, 0.0), (child, 0), (depth, 0.0)):
                column.append(empty)
    return np.array(feature), np.array(place), np.array(child), np.array(depth)


def isolation_forest(x: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = SEED) -> np.ndarray:
    """2^(-mean depth / expected depth) of every row. Trees split rows of a sample at random places; all rows go
    down a tree level by level."""
    rng = np.random.default_rng(seed)
    n = len(x)
    size = min(subsample, n)
    if n == 0:
        return np.zeros(0)
    height = int(np.ceil(np.log2(max(size, 2))))
    total, rows = np.zeros(n), np.arange(n)
    for _ in range(trees):
        feature, place, child, depth = _grow(x[rng.choice(n, size, replace=False)], height, rng)
        node = np.zeros(n, np.int64)
        for _ in range(height):
            f = feature[node]
            node = np.where(f < 0, node, child[node] + (x[rows, f] > place[node]))
        total += depth[node]
    return 2.0 ** (-(total / trees) / max(float(_path(size)), 1e-12))


def _scored(features: DataFrame, score, by: Sequence[str]) -> DataFrame:
    columns = [f"scaled_{c}" for c in FEATURES]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable")
        return pdf[[*by, "ts"]].assign(score=score(pdf[columns].to_numpy(float)))

    rows = scaled_features(features, by).select(*by, "ts", *columns)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*by, "ts").schema)
    return rows.groupBy(*by).applyInPandas(run, f"{kinds}, score double")


def lof(features: DataFrame, neighbours: int = NEIGHBOURS, by: Sequence[str] = CELL) -> DataFrame:
    """(by, ts, score) of rows with complete features."""
    return _scored(features, lambda x: local_outlier_factor(x, neighbours), by)


def iforest(features: DataFrame, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = SEED, by: Sequence[str] = CELL) -> DataFrame:
    return _scored(features, lambda x: isolation_forest(x, trees, subsample, seed), by)


def usable_lof(table: DataFrame) -> DataFrame:
    """Without the scores that come of many equal rows."""
    return table.filter(F.col("score") <= DEGENERATE)
