"""Cross-method profiles: runs, consensus, family votes, context, provenance, case studies, verdicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galeward.functions import is_extreme, mean_rank_share, seconds_between
from galeward.operators.agreement import CELL, KEY, symmetric
from galeward.operators.grid import STEP_SECONDS

LONG_RUN = 6
TAIL = 0.05
# The method families, the contextual method, and the window controls.
FAMILIES = {"statistical": ["z_score", "modified_z_score"], "density": ["lof", "isolation_forest"], "reconstruction": ["autoencoder", "lstm_ae", "gru_ae"]}
CONTEXTUAL = "z_score_context_hour"
CONTROLS = ("lof_6h", "isolation_forest_6h")
PLAUSIBLE = (500.0, 1100.0)
BASELINE = "baseline (all aligned rows)"
# Words of the verdict report.
UNDECIDED = "inconclusive by construction"
ONE_CHANNEL = "no detector in the roster reads a second channel"


def family_of(method: Column) -> Column:
    return F.coalesce(*[F.when(method.isin(*members), name) for name, members in FAMILIES.items()])


def flag_runs(flags: DataFrame, by: Sequence[str] = ("station", "sensor", "method")) -> DataFrame:
    """Maximal runs of flagged bins that are neighbours in time: (by, start, end, length). A bin that was not scored ends a run."""
    w = Window.partitionBy(*by).orderBy("timestamp")
    on = flags.filter("flagged")
    new = F.coalesce(seconds_between(F.lag("timestamp").over(w), F.col("timestamp")) != STEP_SECONDS, F.lit(True))
    runs = on.withColumn("_new", new.cast("int")).withColumn("_run", F.sum("_new").over(w))
    return runs.groupBy(*by, "_run").agg(F.min("timestamp").alias("start"), F.max("timestamp").alias("end"), F.count("*").alias("length")).drop("_run")


def run_length_summary(runs: DataFrame, by: Sequence[str] = ("sensor", "method")) -> DataFrame:
    n = F.sum("length")
    return runs.groupBy(*by).agg(
        n.alias("n_flags"), F.count("*").alias("n_runs"), F.percentile("length", F.lit(0.5)).alias("median_run_bins"), F.avg("length").alias("mean_run_bins"), F.max("length").alias("max_run_bins"),
        (F.sum(F.when(F.col("length") == 1, 1).otherwise(0)) / n).alias("share_isolated"), (F.sum(F.when(F.col("length") >= LONG_RUN, F.col("length")).otherwise(0)) / n).alias("share_in_long_runs"),
    )


def episodes(runs: DataFrame, min_bins: int = 1, top: int | None = None) -> DataFrame:
    """Runs of at least min_bins, the longest first (then by station, start)."""
    found = runs.filter(F.col("length") >= min_bins).orderBy(F.col("length").desc(), "station", "start")
    return found.limit(top) if top else found


def consensus_counts(flags: DataFrame) -> DataFrame:
    """(sensor, n_methods_flagging, n_rows)."""
    each = flags.groupBy(*KEY).agg(F.count_if("flagged").alias("n_methods_flagging"))
    return each.groupBy("sensor", "n_methods_flagging").agg(F.count("*").alias("n_rows"))


def exclusive_share(flags: DataFrame) -> DataFrame:
    """(sensor, method, share_exclusive): flags of a method that no other shares; null for a method without flags."""
    n = F.sum(F.col("flagged").cast("int")).over(Window.partitionBy(*KEY))
    own = F.col("flagged")
    return flags.withColumn("_n", n).groupBy("sensor", "method").agg(F.try_divide(F.count_if(own & (F.col("_n") == 1)), F.count_if(own)).alias("share_exclusive"))


def family_votes(aligned: DataFrame, budget: float = 0.01, by: Sequence[str] = CELL) -> DataFrame:
    """(key, method, flagged), the method a family: the strongest `budget` share by the mean of its members' ranks."""
    ranked = aligned.withColumn("_r", mean_rank_share(F.col("strength"), [*by, "method"], descending=True)).withColumn("_f", family_of(F.col("method"))).filter("_f IS NOT NULL")
    mean = ranked.groupBy(*KEY, F.col("_f").alias("method")).agg(F.avg("_r").alias("_m"))
    return mean.withColumn("flagged", mean_rank_share(F.round("_m", 12), [*by, "method"]) <= budget).drop("_m")


def family_agreement(pairs: DataFrame) -> DataFrame:
    """Mean and largest Jaccard across families, and the mean within each, by sensor."""
    p = pairs.withColumns({"fa": family_of(F.col("method_a")), "fb": family_of(F.col("method_b"))}).filter("fa IS NOT NULL AND fb IS NOT NULL")
    across = F.when(F.col("fa") != F.col("fb"), F.col("jaccard"))
    within = [F.avg(F.when((F.col("fa") == f) & (F.col("fb") == f), F.col("jaccard"))).alias(f"within_{f}") for f in FAMILIES]
    return p.groupBy("sensor").agg(F.avg(across).alias("cross_family_mean"), F.max(across).alias("cross_family_max"), *within)


def cross_family_by_method(pairs: DataFrame) -> DataFrame:
    """(method, best, mean) of the Jaccards of a method with methods of other families."""
    s = symmetric(pairs).filter(F.col("method_a") != F.col("method_b"))
    s = s.filter(family_of(F.col("method_a")) != family_of(F.col("method_b")))
    return s.groupBy(F.col("method_a").alias("method")).agg(F.max("jaccard").alias("best_cross_family_jaccard"), F.avg("jaccard").alias("mean_cross_family_jaccard"))


def percentile_context(keys: DataFrame, values: DataFrame) -> DataFrame:
    """(key, value, hour, global_pct, hour_pct) of aligned keys: a value's rank in its station and in its station's same hour."""
    v = values.select("station", "sensor", F.col("ts").alias("timestamp"), "value")
    rows = keys.select(*KEY).distinct().join(v, list(KEY), "left").withColumn("hour", F.hour("timestamp"))
    return rows.withColumns({"global_pct": mean_rank_share(F.col("value"), [*CELL]), "hour_pct": mean_rank_share(F.col("value"), [*CELL, "hour"])})


def contextual_profile(flags: DataFrame, context: DataFrame, tail: float = TAIL) -> DataFrame:
    """By sensor and method where flags lie in the station's and in the hour's distribution, with a baseline of all rows."""
    far, odd = F.coalesce(is_extreme(F.col("global_pct"), tail), F.lit(False)), F.coalesce(is_extreme(F.col("hour_pct"), tail), F.lit(False))
    share = lambda c: F.avg(c.cast("double"))
    night = (F.col("hour") >= 18) | (F.col("hour") < 6)
    figures = [
        F.count("*").alias("n_flags"), share(far).alias("share_global_extreme"), share(odd).alias("share_hour_extreme"), share(~far & odd).alias("share_contextual_only"),
        share(~far & ~odd).alias("share_neither"), F.percentile("global_pct", F.lit(0.5)).alias("median_global_pct"), share(night).alias("share_at_night"),
    ]
    own = flags.filter("flagged").select(*KEY, "method").join(context, list(KEY)).groupBy("sensor", "method").agg(*figures)
    return own.unionByName(context.withColumn("method", F.lit(BASELINE)).groupBy("sensor", "method").agg(*figures))


def flag_provenance(flags: DataFrame, suspects: DataFrame) -> DataFrame:
    """(method, flagged, on_suspect, share_on_suspect, baseline_share): flags on the suspect keys against all rows."""
    rows = flags.join(suspects.select(*KEY).distinct().withColumn("_s", F.lit(True)), list(KEY), "left").withColumn("_s", F.coalesce("_s", F.lit(False)))
    on = F.col("flagged") & F.col("_s")
    return rows.groupBy("method").agg(F.count_if("flagged").alias("flagged"), F.count_if(on).alias("on_suspect_zero"), F.try_divide(F.count_if(on), F.count_if("flagged")).alias("share_on_suspect_zero"), F.avg(F.col("_s").cast("double")).alias("baseline_suspect_share"))


def impossible(value: Column, low: float = PLAUSIBLE[0], high: float = PLAUSIBLE[1]) -> Column:
    return F.coalesce((value < low) | (value > high), F.lit(False))


def impossible_detected(native: DataFrame, matched: DataFrame, keys: DataFrame) -> DataFrame:
    """(method, n_impossible_rows, detected_native, detected_matched) over the keys of impossible values."""
    k = keys.select(*KEY).distinct()
    one = lambda t, name: t.join(k, list(KEY), "left_semi").groupBy("method").agg(F.count("*").alias(f"n_{name}"), F.avg(F.col("flagged").cast("double")).alias(name))
    return one(native, "detected_native").join(one(matched, "detected_matched"), "method").select("method", F.col("n_detected_native").alias("n_impossible_rows"), "detected_native", "detected_matched")


def station_heterogeneity(pairs: DataFrame, rows: DataFrame, missing: DataFrame) -> DataFrame:
    """(station, sensor, n_rows, mean_jaccard, max_jaccard, pct_missing_after_fill). pairs by station and sensor."""
    n = rows.select(*KEY).distinct().groupBy(*CELL).agg(F.count("*").alias("n_rows"))
    j = pairs.groupBy(*CELL).agg(F.avg("jaccard").alias("mean_jaccard"), F.max("jaccard").alias("max_jaccard"))
    return n.join(j, list(CELL), "left").join(missing, list(CELL), "left")


def pattern(flags: DataFrame, sensor: str, all_of: Sequence[str], name: str) -> DataFrame:
    """Keys of a sensor that all of some methods flag and no other does, as a flag table of the method `name`."""
    f = flags.filter(F.col("sensor") == sensor)
    each = f.groupBy(*KEY).agg(F.count_if(F.col("flagged") & F.col("method").isin(*all_of)).alias("a"), F.count_if("flagged").alias("n"))
    return each.select(*KEY, F.lit(name).alias("method"), ((F.col("a") == len(all_of)) & (F.col("n") == len(all_of))).alias("flagged"))


def case_studies(candidates: DataFrame, flags: DataFrame, filled: DataFrame, unfilled: DataFrame, hours: int = 3) -> DataFrame:
    """One row for each candidate (case, station, sensor, start, end, length): the methods that flag in it, the range of
    values within `hours` of it, and the bins that were missing before the fill. Candidates are a handful, broadcast."""
    c = F.broadcast(candidates)
    margin = F.expr(f"INTERVAL {hours} HOURS")
    g, u = filled.withColumnRenamed("value", "v"), unfilled.withColumnRenamed("value", "v")
    near = (F.col("ts") >= F.col("start") - margin) & (F.col("ts") <= F.col("end") + margin)
    ranges = g.join(c, list(CELL)).filter(near).groupBy("case").agg(F.min("v").alias("value_min"), F.max("v").alias("value_max"))
    gaps = u.join(c, list(CELL)).filter(F.col("ts").between(F.col("start"), F.col("end"))).groupBy("case").agg(F.count_if(F.col("v").isNull()).alias("raw_missing_in_episode"))
    who = flags.filter("flagged").join(c, list(CELL)).filter(F.col("timestamp").between(F.col("start"), F.col("end"))).groupBy("case").agg(F.array_join(F.sort_array(F.collect_set("method")), ", ").alias("flagging_methods"))
    rows = candidates.join(who, "case", "left").join(ranges, "case", "left").join(gaps, "case", "left")
    return rows.select("case", "station", "sensor", "start", "end", F.col("length").alias("length_bins"), F.round(F.col("length") * STEP_SECONDS / 3600, 1).alias("duration_hours"), "flagging_methods", F.round("value_min", 2).alias("value_min"), F.round("value_max", 2).alias("value_max"), "raw_missing_in_episode")


def longest_case(runs: DataFrame, case: str, min_bins: int) -> DataFrame:
    """The longest run of at least min_bins, as a candidate."""
    return episodes(runs, min_bins, 1).select(F.lit(case).alias("case"), "station", "sensor", "start", "end", "length")


def displacement(changes: DataFrame) -> DataFrame:
    """(change, a column for each sensor, overall) of mean Jaccards (change, sensor, jaccard), the largest first."""
    sensors = ("luminous_intensity", "precipitation", "pressure")
    wide = changes.groupBy("change").pivot("sensor", list(sensors)).agg(F.round(F.avg("jaccard"), 3))
    overall = changes.groupBy("change", "sensor").agg(F.avg("jaccard").alias("j")).groupBy("change").agg(F.round(F.avg("j"), 3).alias("overall"))
    return wide.join(overall, "change").orderBy(F.col("overall").desc(), "change")


def point_verdict(runs: DataFrame, method: str = "z_score", other: str = "lstm_ae") -> DataFrame:
    """By sensor whether a method's flags are more isolated than another's, with the figures in words."""
    share = lambda m: F.max(F.when(F.col("method") == m, F.col("share_isolated")))
    t = runs.groupBy("sensor").agg(share(method).alias("a"), share(other).alias("b"))
    text = F.format_string(f"%.1f%% of {method} flags are isolated single bins against %.1f%% for {other}", F.col("a") * 100, F.col("b") * 100)
    verdict = F.when(F.col("a").isNull() | F.col("b").isNull(), UNDECIDED).when(F.col("a") > F.col("b"), "consistent").otherwise("inconsistent")
    return t.select("sensor", F.lit("point").alias("anomaly_type"), verdict.alias("verdict"), F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), text).alias("evidence"))


def collective_verdict(runs: DataFrame, method: str = "lstm_ae", other: str = "z_score") -> DataFrame:
    share = lambda m: F.max(F.when(F.col("method") == m, F.col("share_in_long_runs")))
    t = runs.groupBy("sensor").agg(share(method).alias("a"), share(other).alias("b"))
    text = F.format_string(f"%.1f%% of {method} flags lie in runs of an hour or more against %.1f%% for {other}", F.col("a") * 100, F.col("b") * 100)
    verdict = F.when(F.col("a").isNull() | F.col("b").isNull(), UNDECIDED).when(F.col("a") > F.col("b"), "consistent").otherwise("inconsistent")
    return t.select("sensor", F.lit("collective").alias("anomaly_type"), verdict.alias("verdict"), F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), text).alias("evidence"))


def contextual_verdict(profile: DataFrame, method: str = CONTEXTUAL) -> DataFrame:
    """By sensor whether the contextual method leads in flags that are odd for their hour alone; without it no method here can tell."""
    own = F.max(F.when(F.col("method") == method, F.col("share_contextual_only")))
    rest = F.max(F.when(~F.col("method").isin(method, BASELINE), F.col("share_contextual_only")))
    t = profile.groupBy("sensor").agg(own.alias("a"), rest.alias("b"))
    verdict = F.when(F.col("a").isNull(), UNDECIDED).when(F.col("a") > F.coalesce("b", F.lit(0.0)), "consistent").otherwise("inconsistent")
    text = F.format_string(f"%.1f%% of {method} flags are odd for their hour alone; no other method exceeds %.1f%%", F.col("a") * 100, F.coalesce("b", F.lit(0.0)) * 100)
    return t.select("sensor", F.lit("contextual").alias("anomaly_type"), verdict.alias("verdict"), F.when(F.col("a").isNotNull(), text).otherwise(ONE_CHANNEL).alias("evidence"))
