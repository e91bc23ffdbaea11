import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from galeward.llm import substring_dedup as S


def plain(texts, width):
    """n_bytes, n_removed, n_spans, digest of each text, by force."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + width] for b in data for i in range(len(b) - width + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b) + 2, bool)
        for i in range(len(b) - width + 1):
            if seen[b[i : i + width]] > 1:
                gone[i + 1 : i + 1 + width] = True
        kept = bytes(x for x, g in zip(b, gone[1:]) if not g)
        out.append((len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_arrays():
    rng = np.random.default_rng(1)
    for n in [0, 1, 2, 3, 4, 5, 6, 7, 20, 50, 301]:
        for letters in (2, 3, 200):
            s = rng.integers(1, letters, n) if letters > 2 else np.ones(n, int)
            want = sorted(range(n), key=lambda i: s[i:].tolist())
            assert S.suffix_array(s).tolist() == want
    s = np.tile([1, 2, 1, 3], 60)
    assert S.suffix_array(s).tolist() == sorted(range(240), key=lambda i: s[i:].tolist())


@pytest.mark.parametrize("width", [8, 13, 40])
def test_repeated_starts(width):
    rng = random.Random(width)
    for _ in range(20):
        base = bytes(rng.choice(b"ab\x00\xff") for _ in range(60))
        parts = [base[rng.randrange(20) : 60 - rng.randrange(10)] + bytes(rng.choice(b"ab\x00") for _ in range(30)) for _ in range(4)]
        seen = Counter(p[i : i + width] for p in parts for i in range(len(p) - width + 1))
        want = [[i for i in range(len(p) - width + 1) if seen[p[i : i + width]] > 1] for p in parts]
        assert [x.tolist() for x in S.repeated_starts(parts, width)] == want


def test_contexts_serve_every_window_once_and_alike(monkeypatch):
    rng = random.Random(3)
    t = bytes(rng.choice(b"abc") for _ in range(700)) + b"a" * 300
    t = t + t[100:500]
    whole = S.contexts(t, 40, 10)
    monkeypatch.setattr(S, "PIECE", 128)
    pieces = S.contexts(t, 40, 10)
    for h, low, high, _ in (whole, pieces):
        assert low[0] == 0 and high[-1] == len(t) - 40 and (low[1:] == high[:-1] + 1).all()
        serving: dict = {}
        for a, i, j in zip(h.tolist(), low.tolist(), high.tolist()):
            for k in range(i, j + 1):
                assert serving.setdefault(t[k : k + 40], a) == a


def corpus(rng, n):
    words = ["alpha", "beta", "gamma", "déjà", "x", "the"]
    passage = " ".join(rng.choice(words) for _ in range(30))
    long_ = " ".join(rng.choice(words) for _ in range(90))
    out = [None, "", "short", "a" * 39, "a" * 40, "a" * 41, "z" * 200, long_, long_, long_[5:180], "q" * 30 + long_[40:90] + "w" * 50, "é" * 25]
    for _ in range(n):
        t = " ".join(f"{rng.choice(words)}{rng.randrange(50)}" for _ in range(rng.randrange(60)))
        if rng.random() < 0.5:
            k = rng.randrange(len(t) + 1)
            a = rng.randrange(30)
            t = t[:k] + passage[a : a + rng.randrange(10, 140)] + t[k:]
        out.append(t)
    return out


@pytest.mark.parametrize("limit", [S.SORT, 700])
def test_every_byte_is_judged_right(spark, limit):
    texts = corpus(random.Random(8), 60)
    rows = [(i, t, 0) for i, t in enumerate(texts)] + [(None, texts[13], 0), (14, texts[14], 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_bytes int").repartition(3)
    want = plain([r[1] for r in rows], 40)
    got = S.remove_repeats(docs, 40, 10, limit).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=key) == sorted(((r[0], *w) for r, w in zip(rows, want)), key=key)
    assert sum(0 < w[1] < w[0] for w in want) > 5


def test_no_rows(spark):
    assert S.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_on_passages_of_over_50_words(spark, tmp_path):
    """Planted in three documents each, they go whole from 400 bytes on and stay below, whatever their words."""
    rng = random.Random(51)
    word = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    rows = []
    for size in (270, 394, 399, 400, 401, 640):
        passage = "é " + " ".join(word(rng.randrange(1, 5 if size < 400 else 7)) for _ in range(52))
        passage += " " + word(size - len(passage.encode()) - 1)
        assert len(passage.encode()) == size and len(passage.split()) > 50
        for k, (a, b) in enumerate([(0, 90), (60, 60), (90, 0)]):
            # the bytes beside a passage are another one in each document
            before, after = (" ".join(word(6) for _ in range(n)) for n in (a, b))
            rows.append((len(rows), before + "PQR"[k] * (a > 0), passage, "STU"[k] * (b > 0) + after, size))
    spark.createDataFrame([(r[0], r[1] + r[2] + r[3]) for r in rows], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.n_removed, r.n_spans, r.kept_sha256) for r in S.op8_substring_dedup(spark, str(tmp_path)).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got == {i: (n, 1, sha(a + b)) if n >= 400 else (0, 0, sha(a + p + b)) for i, a, p, b, n in rows}
