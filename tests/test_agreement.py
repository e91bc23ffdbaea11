import datetime as dt

import pytest
from pyspark.sql import functions as F

from galeward.operators import agreement as A
from galeward.operators import crossmethod as X

SENSORS = ("pressure", "precipitation", "luminous_intensity")
UNIFORM = {s: ("z_score", "lof") for s in SENSORS}
EXTRA = UNIFORM | {"luminous_intensity": ("z_score", "lof", "z_score_context_hour")}
START = dt.datetime(2025, 1, 1)
SCHEMA = "station string, sensor string, timestamp timestamp_ntz, method string, flagged boolean, score double"


def table(spark, rosters, n=10):
    rows = [("s0", s, START + dt.timedelta(minutes=10 * i), m, i < 2, float(i)) for s, ms in rosters.items() for m in ms for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def per_sensor(df):
    return {r["sensor"]: r["n"] for r in df.select(*A.KEY).distinct().groupBy("sensor").agg(F.count("*").alias("n")).collect()}


def test_applicable_methods(spark):
    got = {(r.sensor, r.method) for r in A.applicable_methods(table(spark, EXTRA)).collect()}
    assert ("luminous_intensity", "z_score_context_hour") in got and ("pressure", "z_score_context_hour") not in got and len(got) == 7


def test_a_method_of_one_sensor_deletes_no_other_sensor(spark):
    a = A.align(table(spark, EXTRA))
    assert per_sensor(a) == dict.fromkeys(SENSORS, 10)
    assert {r.sensor for r in a.filter("method = 'z_score_context_hour'").select("sensor").distinct().collect()} == {"luminous_intensity"}


def test_pooling_a_ragged_roster_is_refused(spark):
    with pytest.raises(ValueError, match="z_score_context_hour on pressure"):
        A.align(table(spark, EXTRA), per_sensor=False)


def test_pooling_a_uniform_roster(spark):
    assert A.align(table(spark, UNIFORM), per_sensor=False).select(*A.KEY).distinct().count() == 30


def test_pooling_without_the_check_collapses(spark):
    assert per_sensor(A.align(table(spark, EXTRA), per_sensor=False, require_uniform=False)) == {"luminous_intensity": 10}


def test_both_alignments_agree_on_a_uniform_roster(spark):
    t = table(spark, UNIFORM)
    assert A.same_keys(A.align(t), A.align(t, per_sensor=False))


def test_a_time_that_a_method_missed_is_dropped(spark):
    t = table(spark, UNIFORM).filter(~((F.col("sensor") == "pressure") & (F.col("method") == "lof") & (F.col("timestamp") == F.lit(START).cast("timestamp_ntz"))))
    got = per_sensor(A.align(t))
    assert got["pressure"] == 9 and got["precipitation"] == 10


def test_pairs_follow_each_sensors_roster(spark):
    flags = A.align(table(spark, EXTRA)).withColumn("flagged", F.col("strength") < 2)
    got = A.jaccard(A.pair_counts(flags)).groupBy("sensor").agg(F.count("*").alias("n"), F.min("jaccard").alias("j")).collect()
    assert {r.sensor: r.n for r in got} == {"pressure": 1, "precipitation": 1, "luminous_intensity": 3} and all(r.j == 1.0 for r in got)


def flags_of(spark, **methods):
    rows = [("s0", "pressure", START + dt.timedelta(minutes=10 * i), m, c == "T", 1.0) for m, v in methods.items() for i, c in enumerate(v)]
    return spark.createDataFrame(rows, SCHEMA)


def test_jaccard_and_kappa_at_the_ends(spark):
    counts = A.pair_counts(flags_of(spark, a="TTFF", b="TTFF", c="FFTT", empty="FFFF", empty2="FFFF"))
    j = {(r.method_a, r.method_b): r.jaccard for r in A.jaccard(counts).collect()}
    assert j["a", "b"] == 1.0 and j["a", "c"] == 0.0 and j["empty", "empty2"] is None
    k = {(r.method_a, r.method_b): (r.raw_agreement, r.cohen_kappa) for r in A.kappa(counts).collect()}
    assert k["a", "b"] == (1.0, 1.0) and k["a", "c"] == (0.0, -1.0) and k["empty", "empty2"] == (1.0, None)
    s = {(r.method_a, r.method_b): r.jaccard for r in A.symmetric(A.jaccard(counts)).collect()}
    assert s["b", "a"] == 1.0 and s["empty", "empty"] == 1.0


def test_budget_takes_or_leaves_a_tied_block(spark):
    rows = [("s0", "pressure", START + dt.timedelta(minutes=10 * i), "m", False, v) for i, v in enumerate([5.0, 5.0, 3.0, 1.0])]
    a = A.align(spark.createDataFrame(rows, SCHEMA))
    assert A.matched_budget(a, 0.375).filter("flagged").count() == 2 and A.matched_budget(a, 0.37).filter("flagged").count() == 0


def test_runs_consensus_and_exclusive_share(spark):
    t = flags_of(spark, a="TTFTFF", b="TFFTTF")
    runs = X.flag_runs(t)
    assert sorted((r.method, r.length) for r in runs.collect()) == [("a", 1), ("a", 2), ("b", 1), ("b", 2)]
    got = {r.method: (r.n_flags, r.n_runs, r.share_isolated) for r in X.run_length_summary(runs).collect()}
    assert got == {"a": (3, 2, 1 / 3), "b": (3, 2, 1 / 3)}
    assert {r.n_methods_flagging: r.n_rows for r in X.consensus_counts(t).collect()} == {0: 2, 1: 2, 2: 2}
    assert {r.method: round(r.share_exclusive, 6) for r in X.exclusive_share(t).collect()} == {"a": round(1 / 3, 6), "b": round(1 / 3, 6)}
    assert [r.length for r in X.episodes(runs, 2).collect()] == [2, 2]


def test_a_silence_ends_a_run(spark):
    rows = [("s0", "p", START + dt.timedelta(minutes=10 * i), "m", True, 1.0) for i in (0, 1, 3)]
    assert sorted(r.length for r in X.flag_runs(spark.createDataFrame(rows, SCHEMA)).collect()) == [1, 2]
