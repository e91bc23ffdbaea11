"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; the texts of all learning rows, their labels withheld, and of documents
that nobody has labelled are the unlabelled part; the class prior is the share of toxic rows among the learning rows. A linear
classifier over hashed words minimises the non-negative risk
    prior * E_pos[l(+)] + max(0, E_unl[l(-)] - prior * E_pos[l(-)])
with logistic l: where the bracket turns negative the step ascends it instead, which keeps the model
from calling all positives' words toxic by heart. Words enter once for a text, whatever its length, and an L1
term leaves weight only on words that set the positives apart.

Learning rows: rows of `labels` whose crc32(doc_id as text) mod FOLDS is not 0, at most SAMPLE of them
(those of the smallest hash of doc_id), and as many documents without a label that are not held out either, a documented
bound on what is fitted; every document is scored on its whole text. Labels, language, source and id are no inputs of a score.

Cases: null and empty texts get the model's score of no words; without toxic learning rows the
score of every text is the prior; a null doc_id is not held out; repeated rows get equal scores; repeated
labels of a document count as one learning row, toxic if any is; no rows in, no rows out; columns
other than doc_id and text are not read.
"""

from __future__ import annotations

import re
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, text_of

FOLDS = 5
SAMPLE = 16_384
BUCKETS = 1 << 20
#: Words that fewer learning texts hold get no weight.
LEAST_TEXTS = 5
EPOCHS = 500
RATE = 0.05
L1 = 1e-4
REMEMBERED = 300_000
_WORD = re.compile(r"[^\W\d_]+")


def buckets_of(text: str) -> np.ndarray:
    """Hash buckets of a text's distinct words."""
    return np.unique(np.fromiter((crc32(w.encode()) % BUCKETS for w in set(_WORD.findall(text.lower()))), np.int64))


class Linear:
    """bias + sum of weights of the features a text holds; weights over the columns `kept`."""

    def __init__(self, bias: float, kept: np.ndarray, weights: np.ndarray):
        self.bias, self.kept, self.weights = bias, kept, weights

    def scorer(self):
        by_bucket = dict(zip(self.kept.tolist(), self.weights.tolist()))
        known: dict[str, float] = {}

        def score(text: str) -> float:
            # a bucket counts once for a text, as in learning, though two of its words may share it
            total, used = self.bias, set()
            for w in set(_WORD.findall(text.lower())):
                x = known.get(w)
                if x is None:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    x = known[w] = crc32(w.encode()) % BUCKETS if crc32(w.encode()) % BUCKETS in by_bucket else -1
                if x >= 0 and x not in used:
                    used.add(x)
                    total += by_bucket[x]
            return 1.0 / (1.0 + np.exp(-min(max(total, -30.0), 30.0)))

        return score


def descent(g: np.ndarray, pos: np.ndarray, prior: float) -> np.ndarray:
    """The direction, by row, from which a step on the scores g is taken: the gradient of the non-negative risk, or
    where its bracket is negative that of the bracket itself, uphill."""
    s, n, n_pos = 1.0 / (1.0 + np.exp(-np.clip(g, -30, 30))), len(g), int(pos.sum())
    soft = np.logaddexp(0, g)
    bracket = s / n - np.where(pos, s, 0.0) * (prior / n_pos)
    if soft.mean() - prior * soft[pos].mean() < 0:
        return -bracket
    return np.where(pos, (s - 1.0) * (prior / n_pos), 0.0) + bracket


def learn(flat: np.ndarray, size: np.ndarray, toxic: np.ndarray, prior: float) -> Linear:
    """Minimise the non-negative risk by proximal Adam over all rows at each step. flat: the rows'
    buckets end to end; size: their numbers."""
    base = float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)))
    if not toxic.any():
        return Linear(base, np.zeros(0, np.int64), np.zeros(0))
    seen = np.bincount(flat, minlength=BUCKETS)
    kept = np.flatnonzero(seen >= LEAST_TEXTS)
    place = np.full(BUCKETS, -1, np.int32)
    place[kept] = np.arange(len(kept))
    row, col = np.repeat(np.arange(len(size), dtype=np.int32), size), place[flat]
    row, col = row[col >= 0], col[col >= 0]
    pos = toxic.astype(bool)
    n = len(size)
    # sums over a row's entries, and over a column's, are sums of neighbours in either order
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
    filled, by_column = row[first], row[np.argsort(col, kind="stable")]
    heads = np.cumsum(seen[kept]) - seen[kept]
    w, b = np.zeros(len(kept)), base
    m, v, mb, vb = np.zeros(len(kept)), np.zeros(len(kept)), 0.0, 0.0
    for t in range(1, EPOCHS + 1):
        g = np.full(n, b)
        if len(row):
            g[filled] += np.add.reduceat(w[col], first)
        d = descent(g, pos, prior)
        gw, gb = np.add.reduceat(d[by_column], heads) if len(kept) else w, float(d.sum())
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        scale = RATE / (np.sqrt(v / (1 - 0.999**t)) + 1e-6)
        w = w - scale * m / (1 - 0.9**t)
        w = np.sign(w) * np.maximum(np.abs(w) - scale * L1, 0.0)
        b -= RATE * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-6)
    some = np.abs(w) > 1e-4
    return Linear(float(b), kept[some], w[some])


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % FOLDS


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Linear:
    """The classifier of the learning rows and of as many documents without a label; at most `sample` of each, as bucket
    numbers, reach the driver."""
    d = F.col("doc_id").cast("long")
    rows = labels.select(d.alias("_id"), F.col("toxic").cast("int").alias("_toxic")).filter((fold(F.col("_id")) != 0) & F.col("_toxic").isNotNull())
    rows = rows.groupBy("_id").agg(F.max("_toxic").alias("_toxic"))
    prior = rows.agg(F.avg("_toxic")).first()[0] or 0.0
    least = lambda df: df.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    named = labels.select(d.alias("_id")).distinct()
    others = docs.select(d.alias("_id")).filter(fold(F.col("_id")) != 0).distinct().join(named, "_id", "left_anti")
    chosen = least(rows).unionByName(least(others).withColumn("_toxic", F.lit(0)))

    @F.pandas_udf("array<long>")
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(buckets_of)

    texts = docs.select(d.alias("_d"), text_of().alias("_t")).join(F.broadcast(chosen), F.col("_d") == F.col("_id"))  # twice `sample` rows at most
    got = texts.select("_id", "_toxic", found("_t").alias("f")).toArrow()
    if not got.num_rows:
        return learn(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), float(prior))
    got = got.sort_by("_id").combine_chunks()
    found_in = got["f"].combine_chunks()
    return learn(found_in.flatten().to_numpy(), found_in.value_lengths().to_numpy(), got["_toxic"].to_numpy(), float(prior))


def score_column(model: Linear, text: Column) -> Column:
    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        if not hasattr(run_state, "score"):
            run_state.score = model.scorer()
        return texts.map(run_state.score).astype(float)

    class run_state:
        pass

    return run(text)


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted: a row for each document."""
    model = train(docs, labels, sample)
    doc = F.col("doc_id").cast("long")
    scored = docs.select(doc.alias("doc_id"), F.coalesce(fold(doc) == 0, F.lit(False)).alias("held_out"), score_column(model, text_of()).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
