from zlib import crc32

import numpy as np

from galeward.llm import toxicity as X

BAD = ["grobnik", "vlekto", "smarr"]


def corpus(n=1500, seed=0):
    rng = np.random.default_rng(seed)
    words = [f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}" for i in range(100)]
    rows = []
    for i in range(n):
        t = list(rng.choice(words, 60))
        toxic = int(rng.random() < 0.2)
        if toxic:
            for b in rng.choice(BAD, 2):
                t.insert(int(rng.integers(60)), b.upper())
        rows.append((i, " ".join(t), toxic))
    return rows


def learnt(rows, prior):
    f = [X.buckets_of(t) for _, t, _ in rows]
    return X.learn(np.concatenate(f), np.array([len(x) for x in f]), np.array([x for *_, x in rows]), prior)


def test_finds_the_positives_words_without_negatives():
    rows = corpus()
    score = learnt(rows, 0.2).scorer()
    fresh = corpus(200, 1)
    assert np.mean([(score(t) >= 0.5) == bool(x) for _, t, x in fresh]) > 0.97


def test_steps_follow_the_non_negative_risk():
    rng = np.random.default_rng(4)
    soft = lambda z: float(np.log1p(np.exp(z)))
    ways = set()
    for shift in (-3.0, 0.0, 4.0):
        pos = rng.random(30) < 0.3
        g = rng.normal(0, 1, 30) + np.where(pos, shift, -shift / 2)
        bracket = lambda z: sum(map(soft, z)) / 30 - 0.4 * sum(soft(x) for x in z[pos]) / pos.sum()
        toward = lambda z: 0.4 * sum(soft(-x) for x in z[pos]) / pos.sum()
        down = bracket(g) < 0
        ways.add(down)
        aim = (lambda z: -bracket(z)) if down else (lambda z: toward(z) + bracket(z))
        want = [(aim(g + e) - aim(g - e)) / 2e-5 for e in np.eye(30) * 1e-5]
        assert np.allclose(X.descent(g, pos, 0.4), want, atol=1e-6)
    assert ways == {True, False}


def test_a_score_of_one_half_is_predicted(spark):
    docs = spark.createDataFrame([(1, "x", 9)], "doc_id long, text string, PREDICTED int")
    half = X.Linear(0.0, np.zeros(0, np.int64), np.zeros(0))
    assert docs.select(X.score_column(half, docs.text).alias("s")).first().s == 0.5
    got = X.toxicity(docs, spark.createDataFrame([(2, 1), (3, 0)], "doc_id long, toxic int"))
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.first().predicted in (0, 1)


def test_documents_without_a_label_are_learnt_from(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(X, "learn", lambda flat, size, toxic, prior: seen.append((len(size), int(toxic.sum()), prior)) or X.Linear(0.0, np.zeros(0, np.int64), np.zeros(0)))
    free = [i for i in range(200) if crc32(str(i).encode()) % 5]
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(k < 10)) for k, i in enumerate(free[:40])], "doc_id long, toxic int")
    X.train(docs, labels)
    X.train(docs, labels, 15)
    assert seen[0] == (len(free), 10, 0.25) and seen[1][0] == 30


def test_no_positives_gives_the_prior():
    score = learnt([(i, t, 0) for i, t, _ in corpus(20)], 0.1).scorer()
    assert abs(score("anything") - 0.1) < 1e-9


def test_every_row_is_scored(spark):
    rows = corpus()
    held = {i for i, *_ in rows if crc32(str(i).encode()) % 5 == 0}
    odd = [(9001, None), (9002, ""), (None, "grobnik vlekto wak"), (9003, "wak " * 50_000 + "grobnik smarr"), (3, rows[3][1])]
    docs = spark.createDataFrame([(i, t, 0.1) for i, t, _ in rows] + [(*r, 0.1) for r in odd], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, x) for i, _, x in rows] + [(rows[0][0], None), (rows[5][0], rows[5][2])], "doc_id long, toxic int")
    got = X.toxicity(docs, labels).collect()
    assert len(got) == len(rows) + len(odd)
    assert {r.doc_id for r in got if r.held_out and r.doc_id is not None and r.doc_id < 9000} == held
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    want = {i: x for i, _, x in rows}
    test = [r for r in got if r.doc_id in held]
    assert np.mean([r.predicted == want[r.doc_id] for r in test]) > 0.95
    flipped = spark.createDataFrame([(i, 1 - x if i in held else x) for i, _, x in rows], "doc_id long, toxic int")
    again = {r.doc_id: r.score for r in X.toxicity(docs, flipped).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-12 for r in got)  # held-out labels are never read
    assert X.toxicity(docs.filter("false"), labels).count() == 0
    assert len({r.score for r in X.toxicity(docs, labels.filter("false")).collect()}) == 1
