import random

from pyspark.sql import functions as F

from galeward.llm import common


def test_offsets_of_a_hot_group_and_of_nulls(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["hot", "hot", "hot", "b", None]), rng.randrange(5)) for i in range(2000)]
    df = spark.createDataFrame(rows, "i long, g string, n long").repartition(5)
    got = {r.i: r.start for r in common.running_offsets(df, "g", [F.col("i")], "n").collect()}
    want, sums = {}, {}
    for i, g, n in rows:
        want[i] = sums.get(g, 0)
        sums[g] = want[i] + n
    assert got == want
    assert common.running_offsets(df.filter("false"), "g", [F.col("i")], "n").count() == 0


def test_components_of_chains_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (201, 202), (202, 200), (5, 5)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(30)}, **{200 + i: 200 for i in range(3)}}
    assert common.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_keep_listed_treats_nulls_alike_and_keeps_one_of_twins(spark):
    docs = spark.createDataFrame([(1, "a", "x"), (1, "a", "y"), (None, "b", "z"), (2, "c", "w")], "i long, t string, _gw_k0 string")
    listed = spark.createDataFrame([(1, "a"), (None, "b")], "i long, t string")
    got = common.keep_listed(docs, listed, ["i", "t"])
    assert sorted((r.i or 0, r.t) for r in got.collect()) == [(0, "b"), (1, "a")] and got.columns == docs.columns


def test_scratch_folder_is_the_sessions(spark):
    assert common.scratch_root(spark) == (spark.sparkContext.getConf().get("spark.checkpoint.dir") or common.LOCAL_SCRATCH).rstrip("/")


def test_scratch_tables_need_a_shared_folder_off_one_machine(monkeypatch):
    class Session:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "local-cluster[2,1,1024]"
            getConf = staticmethod(dict)

    import pytest

    with pytest.raises(RuntimeError):
        common.scratch_root(Session)
    Session.sparkContext.master = "local[4]"
    assert common.scratch_root(Session) == common.LOCAL_SCRATCH


def test_a_released_table_is_gone(spark):
    t = common.cut(spark.range(3))
    assert t.count() == 3
    common.release(t)
    import os

    assert not os.path.exists(t._scratch)


def test_what_offsets_broadcast_does_not_grow_with_groups(spark):
    df = spark.range(5000).selectExpr("id AS i", "cast(id AS string) AS g", "cast(1 AS long) AS n")
    out = common.running_offsets(df, "g", [F.col("i")], "n")
    assert out.count() == 5000 and out.agg(F.max("start")).first()[0] == 0
