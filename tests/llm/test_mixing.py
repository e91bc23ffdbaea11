import math
import random
from collections import Counter

import pytest

from galeward.llm import mixing as M
from pyspark.sql import functions as F


def plain_words(t):
    for c in "\t\n\x0b\x0c\r":
        t = t.replace(c, " ")
    return len([w for w in t.split(" ") if w])


def test_words(spark):
    texts = ["", " ", "a", " a  b\t\n", "é\x1c x y", "\U0001f600 ok", "x" * 1000, "no break"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", M.words_in(F.col("t")).alias("n")).collect()
    assert [r.n for r in got] == [plain_words(t) for t in texts]


def filled(sizes, weights, cap=3.0):
    """The shares by plain rounds."""
    targets, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while open_:
        unit = left / sum(weights[i] for i in open_)
        over = {i for i in open_ if weights[i] * unit > cap * sizes[i]}
        for i in over or open_:
            targets[i] = cap * sizes[i] if over else weights[i] * unit
        left -= sum(targets[i] for i in over)
        open_ -= over or open_
    return targets


def targets_of(words):
    names = sorted(words, key=lambda s: (s is None, s or ""))
    return dict(zip(names, filled([words[s] for s in names], [M.CYCLE[i % 3] for i in range(len(names))])))


def test_water_fill(spark):
    rng = random.Random(5)
    cases = [([100, 100, 100], [1, 2, 3]), ([1000, 10, 10, 10], [1, 2, 3, 1]), ([0, 0], [1, 2]), ([7], [2]), ([], [])]
    cases += [([int(10 ** rng.uniform(0, 6)) for _ in range(40)], [rng.choice(M.CYCLE) for _ in range(40)])]
    for sizes, weights in cases:
        df = spark.createDataFrame(list(zip(range(len(sizes)), sizes, weights)), "i long, mass long, weight int")
        assert [r.target for r in M.water_fill(df).orderBy("i").collect()] == pytest.approx(filled(sizes, weights))


def test_two_margins_meet_their_targets(spark):
    cells = [("a", "x", 100), ("a", "y", 50), ("b", "x", 30), ("b", "y", 120), ("c", None, 60)]
    df = spark.createDataFrame(cells, "s string, l string, mass long")
    margins = {"s": {"a": 100.0, "b": 200.0, "c": 60.0}, "l": {"x": 160.0, "y": 140.0, None: 60.0}}
    found = M.solve(df, {c: spark.createDataFrame(list(t.items()), "value string, goal double") for c, t in margins.items()})
    got = {c: {r.key[1:] or None: r.x for r in t.collect()} for c, t in found.items()}
    rate = {(s, l): m * math.exp(got["s"][s] + got["l"][l]) for s, l, m in cells}
    for s, goal in margins["s"].items():
        assert sum(v for k, v in rate.items() if k[0] == s) == pytest.approx(goal, rel=1e-6)
    for l, goal in margins["l"].items():
        assert sum(v for k, v in rate.items() if k[1] == l) == pytest.approx(goal, rel=1e-6)


def test_many_sources(spark):
    n = 20_000
    docs = spark.range(n).selectExpr("id AS doc_id", "repeat('w ', cast(1 + id % 7 AS int)) AS text", "concat('site', lpad(id, 6, '0')) AS source")
    got = M.mix(docs).agg(F.sum("size"), F.sum("target"), F.sum("taken"), F.countDistinct("source"), F.max(F.col("taken") / F.col("size"))).first()
    assert got[3] == n and got[1] == pytest.approx(got[0]) and got[4] <= 3


def docs_of(spark):
    rows = [(i, "w " * (1 + i * 37 % 90), "abc"[i % 3], "t") for i in range(200)] + [(1000 + i, "w " * 5, "big", "t") for i in range(400)]
    rows += [(5000, None, "abc", "t"), (5001, "", None, "t"), (5002, "x y", None, "t"), (None, "x y z", "a", "t"), (5003, "q r", "b", "t"), (5003, "q r", "b", "t"), (5004, "", "hollow", "t")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size string")


def test_mix(spark):
    docs = docs_of(spark)
    rows = docs.collect()
    got = M.mix(docs).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r.doc_id, plain_words(r.text or "")) for r in rows)
    words = Counter()
    for r in rows:
        words[r.source] += plain_words(r.text or "")
    want = targets_of(words)
    taken, largest = Counter(), Counter()
    for r in got:
        assert 0 <= r.taken <= 3 * r.size and r.source_size == words[r.source] and r.target == pytest.approx(want[r.source])
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s in words:
        assert abs(taken[s] - want[s]) <= largest[s] + 1
    assert sorted(map(tuple, M.mix_report(docs).collect()), key=str) == sorted(map(tuple, M.mix_report(docs).collect()), key=str)
    out = M.repeat_mixed(docs)
    assert out.columns == docs.columns
    assert out.select(F.sum(M.words_in(F.coalesce("text", F.lit(""))))).first()[0] == sum(taken.values())
    assert M.mix_report(docs.filter("false")).count() == 0
