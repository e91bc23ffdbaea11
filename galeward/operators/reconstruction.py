"""Reconstruction detectors: dense, LSTM and GRU autoencoders over complete windows, in numpy.

One model for each run (cell, architecture, window, latent size, seed), fitted in a task of its own, which
no other run shares; the loss is the mean squared error, the optimiser Adam, and a run stops when the loss on
the latest part of the record has not improved for a while. A window is labelled by its centre bin."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from galeward.operators.detectors import CELL
from galeward.sources.scratch import cut

WINDOW, CONTROL_WINDOW, LATENT = 36, 6, 8
COMPRESSION, LEAST_LATENT = 4.5, 2
LATENT_GRID, SEEDS = (2, 4, 8, 16), (0, 1, 2, 3, 4)
TRAIN_SHARE, THRESHOLD_SHARE, THRESHOLD_GRID = 0.8, 0.99, (0.90, 0.95, 0.99)
MAX_EPOCHS, BATCH, RATE, PATIENCE, LEAST_GAIN = 500, 256, 1e-3, 8, 1e-4
METHODS = {"dense": "autoencoder", "lstm": "lstm_ae", "gru": "gru_ae"}
RUN_KEYS = ("arch", "window", "bottleneck", "seed")
RUN = "arch string, window int, bottleneck int, seed int"


def latent_for(window: int, compression: float = COMPRESSION) -> int:
    return max(LEAST_LATENT, round(window / compression))


def hidden_for(window: int, latent: int) -> int:
    return max(latent + 1, round((window * latent) ** 0.5))


def windows_of(values: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """All complete windows of a regular series, and the places of their centres."""
    if len(values) < window:
        return np.empty((0, window)), np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(values, window)
    whole = ~np.isnan(view).any(1)
    return view[whole], np.flatnonzero(whole) + window // 2


def robust_scale(x: np.ndarray, train: np.ndarray) -> np.ndarray:
    """Less the median, over the interquartile range (1 where that is 0), of all bins of the training windows."""
    if not train.any():
        return x
    low, middle, high = np.percentile(x[train], [25, 50, 75])
    return (x - middle) / ((high - low) or 1.0)


class Dense:
    """window -> hidden -> latent -> hidden -> window, rectified but at the latent's input and the end."""

    def __init__(self, window: int, latent: int, rng):
        h = hidden_for(window, latent)
        self.p: dict[str, np.ndarray] = {}
        for k, (a, b) in enumerate([(window, h), (h, latent), (latent, h), (h, window)]):
            r = 1 / np.sqrt(a)
            self.p[f"w{k}"], self.p[f"b{k}"] = rng.uniform(-r, r, (a, b)), rng.uniform(-r, r, b)

    def forward(self, x):
        kept, a = [], x
        for k in range(4):
            z = a @ self.p[f"w{k}"] + self.p[f"b{k}"]
            kept.append((a, z))
            a = np.maximum(z, 0) if k < 3 else z
        return a, kept

    def backward(self, kept, d):
        g = {}
        for k in (3, 2, 1, 0):
            a, z = kept[k]
            if k < 3:
                d = d * (z > 0)
            g[f"w{k}"], g[f"b{k}"] = a.T @ d, d.sum(0)
            d = d @ self.p[f"w{k}"].T
        return g


class Recurrent:
    """An encoder reads the window bin by bin; its last state becomes the latent, which a decoder gets at every bin."""

    def __init__(self, window: int, latent: int, rng, kind: str):
        self.kind, self.n, self.gates = kind, window, 4 if kind == "lstm" else 3
        h = self.h = hidden_for(window, latent)
        self.p = {}
        for name, wide in (("e", 1), ("d", h)):
            r = 1 / np.sqrt(h)
            self.p |= {f"{name}x": rng.uniform(-r, r, (wide, self.gates * h)), f"{name}h": rng.uniform(-r, r, (h, self.gates * h)), f"{name}b": rng.uniform(-r, r, self.gates * h), f"{name}c": rng.uniform(-r, r, self.gates * h)}
        for name, a, b in (("t", h, latent), ("f", latent, h), ("o", h, 1)):
            r = 1 / np.sqrt(a)
            self.p |= {f"{name}w": rng.uniform(-r, r, (a, b)), f"{name}v": rng.uniform(-r, r, b)}

    def _gates(self, z, k):
        """Sigmoids of the first k rows of z in place: by tanh, which needs no clipping."""
        z[:k] *= 0.5
        np.tanh(z[:k], out=z[:k])
        z[:k] += 1.0
        z[:k] *= 0.5

    def _run(self, name, inputs):
        """All states of a run, the first one 0. Arrays are (bin, unit, row): the gates of a bin are blocks side by side.

        inputs: those of each bin, or of all bins alike."""
        w, h, n = self.p, self.h, self.n
        wide = inputs.shape[-1]
        given = w[f"{name}x"].T @ inputs + w[f"{name}b"][:, None]
        given = np.broadcast_to(given, (n, *given.shape[-2:]))
        back, own = np.ascontiguousarray(w[f"{name}h"].T), w[f"{name}c"][:, None]
        z, hs = np.empty((n, self.gates * h, wide), given.dtype), np.zeros((n + 1, h, wide), given.dtype)
        more = np.zeros_like(hs)  # cells of an LSTM, what the state adds to a GRU's candidate
        ends = np.empty((n, h, wide), given.dtype) if self.kind == "lstm" else None
        for t in range(n):
            g = np.matmul(back, hs[t], out=z[t])
            g += own
            if self.kind == "lstm":
                g += given[t]
                self._gates(g, 2 * h)
                np.tanh(g[2 * h : 3 * h], out=g[2 * h : 3 * h])
                self._gates(g[3 * h :], h)
                np.multiply(g[h : 2 * h], more[t], out=more[t + 1])
                more[t + 1] += g[:h] * g[2 * h : 3 * h]
                np.tanh(more[t + 1], out=ends[t])
                np.multiply(g[3 * h :], ends[t], out=hs[t + 1])
            else:
                more[t] = g[2 * h :]
                g[: 2 * h] += given[t, : 2 * h]
                self._gates(g, 2 * h)
                np.multiply(g[:h], more[t], out=g[2 * h :])
                g[2 * h :] += given[t, 2 * h :]
                np.tanh(g[2 * h :], out=g[2 * h :])
                np.subtract(hs[t], g[2 * h :], out=hs[t + 1])
                hs[t + 1] *= g[h : 2 * h]
                hs[t + 1] += g[2 * h :]
        return inputs, z, hs, more, ends

    def _back(self, name, kept, dout, g):
        """Gradients of a run, given dout(bin), those of its states; returns those of what the gates get from inputs."""
        inputs, z, hs, more, ends = kept
        h, n, wh = self.h, self.n, self.p[f"{name}h"]
        slope = 1.0 - z
        slope *= z
        middle = slice(2 * h, 3 * h)
        slope[:, middle] = 1.0 - z[:, middle] ** 2
        da = np.empty_like(z)
        dr = da if self.kind == "lstm" else np.empty_like(z)
        flat = 1.0 - ends**2 if self.kind == "lstm" else None
        dh, dc = dout(n - 1), 0.0
        for t in range(n - 1, -1, -1):
            i, f, m, o = (z[t, k * h : (k + 1) * h] for k in range(4))
            if self.kind == "lstm":
                dc = dc + dh * o * flat[t]
                np.multiply(dc, m, out=da[t, :h])
                np.multiply(dc, more[t], out=da[t, h : 2 * h])
                np.multiply(dc, i, out=da[t, middle])
                np.multiply(dh, ends[t], out=da[t, 3 * h :])
                da[t] *= slope[t]
                dc *= f
                dh = wh @ da[t]
            else:
                dn = dh * (1.0 - f)
                dn *= slope[t, middle]
                da[t, middle] = dn
                np.multiply(dn, more[t], out=da[t, :h])
                np.multiply(dh, hs[t] - m, out=da[t, h : 2 * h])
                da[t, : 2 * h] *= slope[t, : 2 * h]
                dr[t, : 2 * h] = da[t, : 2 * h]
                np.multiply(dn, i, out=dr[t, middle])
                dh = dh * f
                dh += wh @ dr[t]
            if t:
                dh += dout(t - 1)
        g[f"{name}h"] = np.matmul(hs[:-1], dr.transpose(0, 2, 1)).sum(0)
        g[f"{name}b"], g[f"{name}c"] = da.sum((0, 2)), dr.sum((0, 2))
        if inputs.ndim == 3:
            g[f"{name}x"] = np.matmul(inputs, da.transpose(0, 2, 1)).sum(0)
            return da
        da = da.sum(0)
        g[f"{name}x"] = inputs @ da.T
        return da

    def forward(self, x):
        enc = self._run("e", np.ascontiguousarray(x.T)[:, None, :])
        latent = enc[2][-1].T @ self.p["tw"] + self.p["tv"]
        again = latent @ self.p["fw"] + self.p["fv"]
        dec = self._run("d", np.ascontiguousarray(again.T))
        return np.matmul(self.p["ow"].T, dec[2][1:])[:, 0].T + self.p["ov"], (enc, latent, dec)

    def backward(self, kept, d):
        enc, latent, dec = kept
        each = np.ascontiguousarray(d.T)
        g = {"ow": np.matmul(dec[2][1:], each[:, :, None]).sum(0), "ov": d.sum().reshape(1)}
        dagain = (self.p["dx"] @ self._back("d", dec, lambda t: self.p["ow"] * each[t], g)).T
        g["fw"], g["fv"] = latent.T @ dagain, dagain.sum(0)
        dlatent = dagain @ self.p["fw"].T
        g["tw"], g["tv"] = enc[2][-1] @ dlatent, dlatent.sum(0)
        last = self.p["tw"] @ dlatent.T
        self._back("e", enc, lambda t: last if t == self.n - 1 else 0.0, g)
        return g


def make(arch: str, window: int, latent: int, seed: int):
    rng = np.random.default_rng(seed)
    return Dense(window, latent, rng) if arch == "dense" else Recurrent(window, latent, rng, arch)


def parameters(model) -> int:
    return sum(v.size for v in model.p.values())


def errors_of(model, x: np.ndarray) -> np.ndarray:
    return np.concatenate([((model.forward(x[k : k + 1024])[0] - x[k : k + 1024]) ** 2).mean(1) for k in range(0, len(x), 1024)]) if len(x) else np.zeros(0)


def train(model, x: np.ndarray, is_train: np.ndarray, seed: int, epochs: int = MAX_EPOCHS, patience: int = PATIENCE) -> tuple[int, float]:
    """Fit in place, in single precision as the original study; returns epochs run and the best validation loss, whose weights the model keeps."""
    rng = np.random.default_rng(seed + 1)
    model.p, x = {k: v.astype(np.float32) for k, v in model.p.items()}, x.astype(np.float32)
    a, b = x[is_train], x[~is_train]
    best, best_p, gained = np.inf, {k: v.copy() for k, v in model.p.items()}, 0
    m, v, t = {k: 0.0 for k in model.p}, {k: 0.0 for k in model.p}, 0
    epoch = -1
    for epoch in range(epochs):
        order = rng.permutation(len(a))
        for k in range(0, len(a), BATCH):
            batch = a[order[k : k + BATCH]]
            y, kept = model.forward(batch)
            g = model.backward(kept, 2 * (y - batch) / batch.size)
            t += 1
            for name in model.p:
                m[name] = 0.9 * m[name] + 0.1 * g[name]
                v[name] = 0.999 * v[name] + 0.001 * g[name] ** 2
                model.p[name] = model.p[name] - RATE * (m[name] / (1 - 0.9**t)) / (np.sqrt(v[name] / (1 - 0.999**t)) + 1e-8)
        loss = float(errors_of(model, b).mean(dtype=float)) if len(b) else np.nan
        if loss < best:
            if loss < best * (1 - LEAST_GAIN):
                gained = epoch
            best, best_p = loss, {k: w.copy() for k, w in model.p.items()}
        if epoch - gained >= patience:
            break
    model.p = best_p
    return epoch + 1, best


def plan(spark: SparkSession, archs: Sequence[str] = ("dense",), windows: Sequence[int] = (WINDOW,), latents: Sequence[int] | None = None, seeds: Sequence[int] = (0,)) -> DataFrame:
    """Runs to fit in every cell; without latents each window gets the one of its compression."""
    rows = [(a, w, n, s) for a in archs for w in windows for n in (latents or [latent_for(w)]) for s in seeds]
    return spark.createDataFrame(rows, RUN)


def study(spark: SparkSession, archs: Sequence[str] = ("dense",)) -> DataFrame:
    """The whole plan of robustness passes: seeds, latent sizes and the control window about the primary run."""
    runs = plan(spark, archs, seeds=SEEDS).unionByName(plan(spark, archs, latents=LATENT_GRID)).unionByName(plan(spark, archs, [CONTROL_WINDOW]))
    return runs.distinct()


def fit_scores(grid: DataFrame, runs: DataFrame, share: float = TRAIN_SHARE, epochs: int = MAX_EPOCHS, by: Sequence[str] = CELL) -> DataFrame:
    """(by, run, ts, score, is_train, epochs, best_val_loss): the reconstruction error of every window.

    runs is a small plan, broadcast; a cell's series goes to as many tasks as it has runs. Every run has a task to itself, recurrent
    ones first: dealt by a hash of their keys, or into tasks of a size in bytes, fits of minutes would queue in a few tasks."""
    keys = [*by, "arch", "window", "bottleneck", "seed"]
    point = F.struct("ts", "value")
    series = cut(grid.groupBy(*by).agg(F.sort_array(F.collect_list(point)).alias("s")).select(*by, F.col("s.ts").alias("ts"), F.col("s.value").alias("value")), "series")
    dealt = series.select(*by).crossJoin(F.broadcast(runs)).withColumn("_place", F.row_number().over(Window.orderBy(F.col("arch") == "dense", *keys)) - 1)
    dealt = cut(dealt, "dealt")
    n = dealt.count()
    ts = series.schema["ts"].dataType.elementType
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.select(*keys).schema) + f", ts {ts.simpleString()}"
    scores = f"{kinds}, score double, is_train boolean, epochs int, best_val_loss double"

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                one = b.slice(k, 1)
                r = {c: one.column(c)[0].as_py() for c in ("arch", "window", "bottleneck", "seed")}
                times = one.column("ts").flatten()
                x, at = windows_of(np.array(one.column("value").flatten().to_numpy(zero_copy_only=False), float), r["window"])
                t = times.take(pa.array(at))
                when = t.cast("int64").to_numpy(zero_copy_only=False)
                is_train = when - when[0] <= (when[-1] - when[0]) * share if len(when) else np.zeros(0, bool)
                x = robust_scale(x, is_train)
                model = make(r["arch"], r["window"], r["bottleneck"], r["seed"])
                epochs_run, best = train(model, x, is_train, r["seed"], epochs) if len(x) else (0, np.nan)
                m = len(at)
                yield pa.RecordBatch.from_arrays(
                    [*[pa.repeat(one.column(c)[0], m) for c in keys], t, pa.array(errors_of(model, x).astype(float)), pa.array(is_train),
                     pa.array(np.full(m, epochs_run, np.int32)), pa.array([best if np.isfinite(best) else None] * m, pa.float64())],
                    names=[*keys, "ts", "score", "is_train", "epochs", "best_val_loss"],
                )

    cond = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by]
    rows = series.alias("a").join(F.broadcast(dealt.alias("b")), cond).select("b.*", "a.ts", "a.value")
    return rows.repartitionById(max(n, 1), F.col("_place").cast("int")).mapInArrow(run, scores)


def fit_health(fits: DataFrame, max_epochs: int = MAX_EPOCHS, by: Sequence[str] = CELL) -> DataFrame:
    """A row for each fit: rows trained and scored, epochs, whether it ended early, the best loss, whether scores vary."""
    return fits.groupBy(*by, "arch", "window", "bottleneck", "seed").agg(
        F.count_if("is_train").alias("n_train"), F.count("*").alias("n_scored"), F.max("epochs").alias("epochs"), (F.max("epochs") < max_epochs).alias("ended_early"),
        F.max("best_val_loss").alias("best_val_loss"), (F.stddev_pop("score") > 0).alias("scores_vary"),
    )


def reconstruction_detections(fits: DataFrame, share: float = THRESHOLD_SHARE, name=None, by: Sequence[str] = CELL) -> DataFrame:
    """The shared table of fits, each flagged beyond the quantile of its own validation errors; null validation flags nothing.

    name: a column that names the method, by default the architecture's name."""
    keys = [*by, "arch", "window", "bottleneck", "seed"]
    limits = fits.groupBy(*keys).agg(F.percentile(F.when(~F.col("is_train"), F.col("score")), F.lit(share)).alias("threshold"))
    method = name if name is not None else F.coalesce(*[F.when(F.col("arch") == a, m) for a, m in METHODS.items()])
    flagged = F.coalesce(F.col("score") > F.col("threshold"), F.lit(False))
    return fits.join(limits, keys).select("station", "sensor", F.col("ts").alias("timestamp"), method.alias("method"), flagged.alias("flagged"), "score")


def percentile_sensitivity(fits: DataFrame, shares: Sequence[float] = THRESHOLD_GRID, by: Sequence[str] = CELL) -> DataFrame:
    """(run, percentile, cutoff, rate_overall) at each quantile of the validation errors."""
    keys = [*by, "arch", "window", "bottleneck", "seed"]
    cuts = fits.groupBy(*keys).agg(F.percentile(F.when(~F.col("is_train"), F.col("score")), F.array(*map(F.lit, shares))).alias("c"))
    each = cuts.select(*keys, F.explode(F.arrays_zip(F.array(*map(F.lit, shares)).alias("percentile"), F.col("c").alias("cutoff"))).alias("x")).select(*keys, "x.*")
    return fits.join(each, keys).groupBy(*keys, "percentile", "cutoff").agg(F.avg(F.coalesce(F.col("score") > F.col("cutoff"), F.lit(False)).cast("double")).alias("rate_overall"))


def evenly_spaced_stations(health: DataFrame, k: int = 4) -> DataFrame:
    """(station, n_train): k stations spread evenly over the order of their median training size, ends in.

    A row for each station is all that is ordered."""
    sizes = health.groupBy("station").agg(F.percentile("n_train", F.lit(0.5)).alias("n_train"))
    n = sizes.count()
    places = sorted({round(i * (n - 1) / max(k - 1, 1)) for i in range(k)}) if n else []
    ordered = sizes.agg(F.sort_array(F.collect_list(F.struct("n_train", "station"))).alias("s")).select(F.posexplode("s").alias("place", "s"))
    return ordered.filter(F.col("place").isin(*places)).select("s.station", "s.n_train")
