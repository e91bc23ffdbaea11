import pytest

from galeward.operators import reconstruction as R
from galeward.plans import catalog

NAMES = ["autoencoder", "lstm_ae", "gru_ae", "percentile_sensitivity", "fit_health"]


@pytest.mark.parametrize("name", NAMES)
def test_queries_train_until_patience_ends_a_fit(spark, monkeypatch, name):
    """Every fit may take MAX_EPOCHS, and health is judged against that."""
    seen = []

    def scores(grid, runs, share=R.TRAIN_SHARE, epochs=R.MAX_EPOCHS, by=R.CELL):
        seen.append(epochs)
        return spark.createDataFrame([("a", "p", "dense", 36, 8, 0, 1, 0.5, k % 2 == 0, 499, 0.1) for k in range(4)], "station string, sensor string, arch string, window int, bottleneck int, seed int, ts long, score double, is_train boolean, epochs int, best_val_loss double")

    catalog.S.forget()
    monkeypatch.setattr(catalog.S, "filled", lambda *a: None)
    monkeypatch.setattr(R, "fit_scores", scores)
    got = catalog.QUERIES[name](spark, "")
    health = got.limit(1).cache() if name == "fit_health" else None
    assert health is None or health.count()
    assert seen == [500] and R.PATIENCE == 8
    catalog.S.forget()
    if name == "fit_health":
        assert health.first().ended_early  # 499 of 500, not of 40


def test_every_fit_has_a_task_of_its_own(spark):
    """Fits of minutes do not queue in one task, however few bytes their series have."""
    from pyspark.sql import functions as F

    cells = spark.range(4 * 50).selectExpr("concat('s', id % 4) AS station", "'p' AS sensor", "timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, 10 * (id div 4)) AS ts", "sin(id) AS value")
    runs = R.plan(spark, ["dense", "gru"], [6], [2], (0, 1))
    fits = R.fit_scores(cells, runs, epochs=1).withColumn("task", F.spark_partition_id()).localCheckpoint()
    got = fits.groupBy("task").agg(F.count_distinct("station", "sensor", *R.RUN_KEYS).alias("n"), F.count("*").alias("rows")).collect()
    assert len(got) == 16 and {(r.n, r.rows) for r in got} == {(1, 45)}
    assert fits.schema["ts"].dataType == cells.schema["ts"].dataType and fits.agg(F.min("ts"), F.max("ts")).first() == cells.agg(F.min("ts") + F.expr("interval 30 minutes"), F.max("ts") - F.expr("interval 20 minutes")).first()


def test_the_roster_fits_all_architectures_in_one_job(spark, monkeypatch):
    planned = []

    def scores(grid, runs, share=R.TRAIN_SHARE, epochs=R.MAX_EPOCHS, by=R.CELL):
        planned.append(sorted(r.arch for r in runs.collect()))
        return runs.selectExpr("'a' AS station", "'p' AS sensor", "*", "1L AS ts", "0.5D AS score", "true AS is_train", "1 AS epochs", "0.1D AS best_val_loss")

    catalog.S.forget()
    monkeypatch.setattr(catalog.S, "filled", lambda *a: None)
    monkeypatch.setattr(R, "fit_scores", scores)
    assert catalog._all_fits(spark, "").count() == 3 and planned == [["dense", "gru", "lstm"]]
    catalog.S.forget()
    catalog._fits(spark, "", "lstm")
    assert catalog._all_fits(spark, "").count() == 3 and planned[1:] == [["lstm"], ["dense", "gru"]]
    catalog.S.forget()
