"""How detectors agree: listwise alignment, alarm budgets, pair statistics.

Tables are long: one row for each (station, sensor, timestamp, method). A sensor may have methods that others
lack; the aligned rows of a sensor are the times that all of its own methods scored."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from galeward.functions import mean_rank_share

KEY = ("station", "sensor", "timestamp")
CELL = ("station", "sensor")
BUDGET = 0.01


def applicable_methods(table: DataFrame) -> DataFrame:
    """(sensor, method, n): what scored what."""
    return table.groupBy("sensor", "method").agg(F.count("*").alias("n_scored"))


def incomplete_rosters(table: DataFrame) -> DataFrame:
    """(sensor, method) pairs that scored nothing though the method scored another sensor."""
    have = applicable_methods(table)
    every = have.select("sensor").distinct().crossJoin(F.broadcast(have.select("method").distinct()))
    return every.join(have, ["sensor", "method"], "left_anti")


def align(table: DataFrame, per_sensor: bool = True, require_uniform: bool = True) -> DataFrame:
    """(key, method, strength, flagged) of the times that every method scored; strength is |score|.

    Pooled (per_sensor=False) every method of the table is asked of every sensor, which drops a sensor whose
    roster is not complete; that is refused unless require_uniform is False."""
    if not per_sensor and require_uniform:
        missing = sorted((r["sensor"], r["method"]) for r in incomplete_rosters(table).collect())
        if missing:
            raise ValueError("a pooled alignment would drop every row of a sensor without scores of: " + ", ".join(f"{m} on {s}" for s, m in missing) + "; align per sensor, or pass require_uniform=False")
    # a key that a method scored twice counts with the stronger score; sums and maxima stay in hash aggregation
    scored = table.filter("score IS NOT NULL")
    rows = scored.groupBy(*KEY, "method").agg(F.max(F.abs("score")).alias("strength"), F.bool_or("flagged").alias("flagged"))
    roster = scored.groupBy("sensor", "method").agg(F.count("*").alias("n"))
    if per_sensor:
        need = roster.groupBy("sensor").agg(F.count("*").alias("_need"))
        rows = rows.join(F.broadcast(need), "sensor")  # a row for each sensor
    else:
        rows = rows.crossJoin(F.broadcast(roster.agg(F.count_distinct("method").alias("_need"))))
    have = F.count("*").over(Window.partitionBy(*KEY))
    return rows.withColumn("_have", have).filter("_have = _need").select(*KEY, "method", "strength", "flagged")


def matched_budget(aligned: DataFrame, budget: float = BUDGET, by: Sequence[str] = CELL) -> DataFrame:
    """flagged: the strongest `budget` share of each method within each cell, ties by their mean rank."""
    share = mean_rank_share(F.col("strength"), [*by, "method"], descending=True)
    return aligned.withColumn("flagged", share <= budget)


def pair_counts(flags: DataFrame, by: Sequence[str] = ("sensor",)) -> DataFrame:
    """(by, method_a, method_b, both, a_only, b_only, neither) for methods in order, from one pass over rows
    gathered by key; no self-join."""
    rows = flags.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("method", "flagged"))).alias("m"))
    pairs = F.flatten(F.transform("m", lambda a, i: F.transform(F.slice("m", i + 2, F.size("m")), lambda b: F.struct(a["method"].alias("method_a"), b["method"].alias("method_b"), a["flagged"].alias("a"), b["flagged"].alias("b")))))
    each = rows.select(*[c for c in by], F.explode(pairs).alias("p")).select(*by, "p.*")
    a, b = F.col("a"), F.col("b")
    return each.groupBy(*by, "method_a", "method_b").agg(F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("a_only"), F.count_if(~a & b).alias("b_only"), F.count_if(~a & ~b).alias("neither"))


def jaccard(counts: DataFrame) -> DataFrame:
    """jaccard of the flagged sets, null where neither method flags anything."""
    return counts.withColumn("jaccard", F.try_divide(F.col("both"), F.col("both") + F.col("a_only") + F.col("b_only")))


def kappa(counts: DataFrame) -> DataFrame:
    """raw_agreement and cohen_kappa, null where chance alone agrees wholly."""
    n = F.col("both") + F.col("a_only") + F.col("b_only") + F.col("neither")
    pa, pb = (F.col("both") + F.col("a_only")) / n, (F.col("both") + F.col("b_only")) / n
    po, pe = (F.col("both") + F.col("neither")) / n, pa * pb + (1 - pa) * (1 - pb)
    return counts.withColumns({"raw_agreement": po, "cohen_kappa": F.try_divide(po - pe, 1 - pe)})


def symmetric(pairs: DataFrame, value: str = "jaccard", by: Sequence[str] = ("sensor",)) -> DataFrame:
    """Pairs both ways with the diagonal at 1, ready to pivot."""
    back = pairs.select(*by, F.col("method_b").alias("method_a"), F.col("method_a").alias("method_b"), value)
    names = pairs.select(*by, "method_a").unionByName(pairs.select(*by, F.col("method_b").alias("method_a"))).distinct()
    return pairs.select(*by, "method_a", "method_b", value).unionByName(back).unionByName(names.select(*by, "method_a", F.col("method_a").alias("method_b"), F.lit(1.0).alias(value)))


def jaccard_summary(pairs: DataFrame, by: Sequence[str] = ("sensor",)) -> DataFrame:
    return pairs.groupBy(*by).agg(F.avg("jaccard").alias("mean_pairwise"), F.max("jaccard").alias("max_pairwise"))


def self_agreement(table: DataFrame, by: Sequence[str] = ("sensor",)) -> DataFrame:
    """Mean, least and number of pairwise Jaccards between variants of a method (each named as a method), and the
    mean and deviation of their flagged rates."""
    aligned = align(table)
    pairs = jaccard(pair_counts(aligned, by)).groupBy(*by).agg(F.avg("jaccard").alias("mean_pairwise_jaccard"), F.min("jaccard").alias("min_pairwise_jaccard"), F.count("*").alias("n_pairs"))
    rates = aligned.groupBy(*by, "method").agg(F.avg(F.col("flagged").cast("double")).alias("r")).groupBy(*by).agg(F.avg("r").alias("flagged_rate_mean"), F.stddev_samp("r").alias("flagged_rate_std"))
    return pairs.join(rates, list(by))


def window_effect(pairs: DataFrame, short: str, long: str, others: Sequence[str], by: Sequence[str] = ("sensor",)) -> DataFrame:
    """How a method's agreement with others changes from its short to its long window, and its agreement with itself."""
    s = symmetric(pairs, by=by)
    get = lambda a: s.filter((F.col("method_a") == a) & F.col("method_b").isin(*others)).select(*by, F.col("method_b").alias("statistical_method"), F.col("jaccard").alias(f"j_{a}"))
    own = s.filter((F.col("method_a") == short) & (F.col("method_b") == long)).select(*by, F.col("jaccard").alias("self_agreement"))
    both = get(short).join(get(long), [*by, "statistical_method"]).join(own, list(by))
    return both.select(*by, F.lit(short).alias("density_method"), "statistical_method", F.col(f"j_{short}").alias("jaccard_short"), F.col(f"j_{long}").alias("jaccard_long"), (F.col(f"j_{long}") - F.col(f"j_{short}")).alias("change"), "self_agreement")


def recurrence_kinds(pairs: DataFrame, by: Sequence[str] = ("sensor",)) -> DataFrame:
    """pairs of variants named <architecture>_<anything>, with `kind`: within an architecture's method or across."""
    arch = lambda c: F.substring_index(c, "_", 1)
    method = lambda c: F.concat(F.lit("within "), F.when(arch(c) == "dense", "autoencoder").otherwise(F.concat(arch(c), F.lit("_ae"))))
    return pairs.withColumn("kind", F.when(arch("method_a") == arch("method_b"), method("method_a")).otherwise("cross-architecture"))


def kind_summary(pairs: DataFrame, by: Sequence[str] = ("sensor",)) -> DataFrame:
    """(by, kind, mean, min, max, n_pairs) of the Jaccards."""
    return pairs.groupBy(*by, "kind").agg(F.avg("jaccard").alias("mean"), F.min("jaccard").alias("min"), F.max("jaccard").alias("max"), F.count("*").alias("n_pairs"))


def both_views(table: DataFrame) -> DataFrame:
    """(sensor, method_a, method_b, jaccard, view): the native flags' agreement and that of equal budgets."""
    rows = align(table)
    view = lambda flags, name: jaccard(pair_counts(flags)).select("sensor", "method_a", "method_b", "jaccard", F.lit(name).alias("view"))
    return view(rows, "native").unionByName(view(matched_budget(rows), "matched_budget"))


def pair_columns(pairs: DataFrame, by: Sequence[str] = CELL) -> DataFrame:
    """One row for each `by` with a column for each pair, named "a vs b"."""
    return pairs.withColumn("_pair", F.concat_ws(" vs ", "method_a", "method_b")).groupBy(*by).pivot("_pair").agg(F.first("jaccard"))


def pair_rows(wide: DataFrame, by: Sequence[str] = CELL) -> DataFrame:
    """The way back from pair_columns: (by, method_a, method_b, jaccard)."""
    long = wide.unpivot(list(by), [c for c in wide.columns if c not in by], "_pair", "jaccard").filter("jaccard IS NOT NULL")
    part = F.split("_pair", " vs ")
    return long.select(*by, F.get(part, 0).alias("method_a"), F.get(part, 1).alias("method_b"), "jaccard")


def same_keys(a: DataFrame, b: DataFrame, keys: Sequence[str] = KEY) -> bool:
    """Whether two tables have the same set of keys."""
    x, y = a.select(*keys).distinct(), b.select(*keys).distinct()
    return x.join(y, list(keys), "left_anti").isEmpty() and y.join(x, list(keys), "left_anti").isEmpty()
