import math
from collections import Counter

import numpy as np
import pytest

from galeward.llm import lm_scoring as L


def plain_words(t):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    for c in "\t\n\x0b\x0c\r":
        t = t.replace(c, " ")
    return [w for w in t.split(" ") if w]


TEXTS = ["The cat sat on the mat", "the dog sat on a log\nand the cat sat too", "", None, " \t", "xylo ph one " * 40, "é è\x1cü the cat", "x" * 200 + " " + "x" * 201 + " x", "the cat sat on the mat"]


def hashed(w):
    return int(L.word_hashes(w.encode())[0][0])


def test_words_are_told_apart():
    words = {w for t in TEXTS for w in plain_words(t)} | {"x" * n for n in range(1, 300)} | {"ab" * n for n in range(1, 90)} | {"ba" * n for n in range(1, 90)}
    assert len({hashed(w) for w in words}) == len(words)
    data = " ".join(t or "" for t in TEXTS).lower()
    assert L.word_hashes(data.encode())[0].tolist() == [hashed(w) for w in plain_words(data)]


def test_long_texts_in_pieces(monkeypatch):
    text = ("alpha beta  gamma\n" * 50).encode()
    whole = L.word_hashes(text)[0].tolist()
    monkeypatch.setattr(L, "PIECE", 64)
    parts = [L._joined(g) for g in L.pieces([text, b"one two", b""])]
    assert len(parts) > 5
    h = np.concatenate([h[~skip] for h, _, _, skip in parts]).tolist()
    assert h == whole + L.word_hashes(b"one two")[0].tolist()
    assert sum(head.sum() for *_, head, _ in parts) == 2


def test_scores_equal_brute_force(spark):
    docs = spark.createDataFrame([(i, t, 0.1) for i, t in enumerate(TEXTS)] + [(None, "the cat", 0.1), (0, TEXTS[0], 0.1)], "doc_id long, text string, score double")
    target = spark.createDataFrame([(0,), (6,), (0,), (77,), (None,)], "doc_id long")
    v, buckets = 8, 64
    got = L.cross_entropy_difference(docs, target, v, buckets).collect()
    rows = [(r.doc_id, plain_words(r.text)) for r in docs.collect()]
    chosen = {0, 6}
    n = [Counter(), Counter()]
    for i, w in rows:
        n[0].update(w)
        if i in chosen:
            n[1].update(w)
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    top = sorted(n[0], key=lambda w: (-n[0][w], signed(hashed(w))))[:v]
    number = {w: k + 1 for k, w in enumerate(sorted(top, key=hashed))}
    start = v + 1
    bucket = lambda a, b: int(L.mixed(np.array([(a << 32 | b) + 1], np.uint64))[0]) % buckets
    pairs, words = [Counter(), Counter()], [Counter(), Counter()]
    for i, w in rows:
        ids = [number.get(x, 0) for x in w]
        for k in range(1 + (i in chosen)):
            words[k].update(ids)
            words[k][start] += 1
            pairs[k].update(bucket(a, b) for a, b in zip([start, *ids], ids))
    size = sum(n[1].values())
    scale = [size / sum(n[k].values()) for k in (0, 1)]

    def loss(k, a, b):
        p = (words[k][b] * scale[k] + 1) / (size + v + 1)
        return -math.log((pairs[k][bucket(a, b)] * scale[k] + L.PRIOR * p) / (words[k][a] * scale[k] + L.PRIOR))

    want = []
    for i, w in rows:
        ids = [number.get(x, 0) for x in w]
        each = [[loss(k, a, b) for a, b in zip([start, *ids], ids)] for k in (0, 1)]
        mean = [sum(x) / max(len(x), 1) for x in each]
        want.append((i, len(w), mean[1], mean[0], mean[1] - mean[0]))
    key = lambda r: (r[0] is None, r[0] or 0)
    for g, x in zip(sorted(map(tuple, got), key=key), sorted(want, key=key)):
        assert g[:2] == x[:2] and g[2:] == pytest.approx(x[2:], abs=2e-5)


def test_empty_sides(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = docs.filter("false")
    assert L.cross_entropy_difference(none, docs.select("doc_id"), 8, 64).count() == 0
    assert L.cross_entropy_difference(docs, none.select("doc_id"), 8, 64).count() == 1


@pytest.mark.parametrize("least_hot, shard, held", [(1000, 2_000_000, 1_300_000), (3, 2, 0), (1, 2, 0), (8, 20, 5)])
def test_whole_model_equals_brute_force(spark, monkeypatch, least_hot, shard, held):
    """Every word and pair has its own count: 300 rare words and pairs, hot ones, and texts in pieces."""
    for name, value in (("LEAST_HOT", least_hot), ("SHARD", shard), ("SHARDS", 3), ("HELD", held)):
        monkeypatch.setattr(L, name, value)
    texts = [*TEXTS, *(f"the cat w{i} w{i * 7 % 300} sat" for i in range(300)), "the cat " * 400]
    docs = spark.createDataFrame([*enumerate(texts), (None, "the cat"), (0, texts[0])], "doc_id long, text string").repartition(3)
    chosen = {0, 6, *range(20, 60)}
    got = L.score_whole(docs, spark.createDataFrame([(i,) for i in chosen] + [(None,)], "doc_id long"), 100 if held < 10 else L.UNIT, held).collect()
    rows = [*((i, plain_words(t)) for i, t in enumerate(texts)), (None, ["the", "cat"]), (0, plain_words(texts[0]))]
    words, pairs = [Counter(), Counter()], [Counter(), Counter()]
    for i, w in rows:
        for k in range(1 + (i in chosen)):
            words[k].update(["^", *w])
            pairs[k].update(zip(["^", *w], w))
    n = [sum(v for w, v in c.items() if w != "^") for c in words]

    def loss(k, a, b):
        s = n[1] / n[k]
        p = (words[k][b] * s + 1) / (n[1] + len(words[0]) - 1)
        return -math.log((pairs[k][a, b] * s + L.PRIOR * p) / (words[k][a] * s + L.PRIOR))

    want = []
    for i, w in rows:
        mean = [sum(loss(k, a, b) for a, b in zip(["^", *w], w)) / max(len(w), 1) for k in (0, 1)]
        want.append((i, len(w), mean[1], mean[0], mean[1] - mean[0]))
    key = lambda r: (r[0] is None, r[0] or 0)
    assert len(got) == len(want)
    for g, x in zip(sorted(map(tuple, got), key=key), sorted(want, key=key)):
        assert g[:2] == x[:2] and g[2:] == pytest.approx(x[2:], abs=2e-6)


def test_whole_model_takes_a_long_text_in_pieces(spark, monkeypatch):
    """A text of more than PIECE bytes scores as its words do; the query takes no cap on words."""
    rare = " ".join(f"r{i}" for i in range(70_000))
    docs = spark.createDataFrame([(1, "a b " * 600_000), (2, rare)], "doc_id long, text string")
    one, two = sorted(map(tuple, L.cross_entropy_difference(docs, docs.filter("doc_id = 1").select("doc_id")).collect()))
    assert one[1] == 1_200_000 and two[1] == 70_000
    m, v = 1_200_000, 70_002
    near = L.PRIOR * (600_000 + 1) / (m + v)
    want = -(math.log((1 + near) / (1 + L.PRIOR)) + 600_000 * math.log((600_000 + near) / (600_000 + L.PRIOR)) + 599_999 * math.log((599_999 + near) / (600_000 + L.PRIOR))) / m
    assert one[2] == pytest.approx(want, abs=2e-6)
    unseen = L.PRIOR / (m + v)
    want = -(math.log(unseen / (1 + L.PRIOR)) + 69_999 * math.log(unseen / L.PRIOR)) / 70_000
    assert two[2] == pytest.approx(want, abs=2e-6)
