import math
from collections import Counter

import numpy as np

from galeward.llm import quality as Q

WS = " \t\n\x0b\x0c\r"


def plain(text):
    """The base counts by their definition."""
    def words_of(t):
        for c in WS:
            t = t.replace(c, " ")
        return [w for w in t.split(" ") if w]

    words = words_of(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words_of(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(grams)
    hit = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(hit)


TEXTS = ["", "a", " \n\n \n", "a b c a b c a b", "é ü\x1c x\n\nsame line\nsame line\n same line\nß", "#*$%&|<> x", "x " * 300, "one\r\ntwo\r\none\r\n", "日本 語 a"]


def test_base_counts():
    for t in TEXTS:
        assert Q.base_counts(t.encode()) == plain(t), t


def plain_symbols(text):
    out = []
    for c in text:
        x = 32 if c in WS + "\0\x01" else 48 if c in "0123456789" else ord(c) if ord(c) < 65536 else 0xE000 + ord(c) % 6400
        if x != 32 or out[-1:] != [32]:
            out.append(x)
    return out


def brute_kn(texts, least=1):
    """Modified Kneser-Ney by dictionaries, as a function of n-grams of symbols; those that occur less often than
    `least` give their count away."""
    seqs = [(1, 1, 1, *plain_symbols(t)) for t in texts]
    c = {4: Counter(s[i : i + 4] for s in seqs for i in range(len(s) - 3))}
    raw = {4: c[4]}
    for k in (3, 2, 1):
        c[k], raw[k] = Counter(g[1:] for g in c[k + 1]), Counter()
        for g, n in raw[k + 1].items():
            raw[k][g[1:]] += n

    def disc(k):
        n = [sum(v == j for v in c[k].values()) for j in range(1, 5)]
        if not all(n):
            return [0, 0.5, 0.75, 0.9]
        y = n[0] / (n[0] + 2 * n[1])
        return [0, *(min(max(j - (j + 1) * y * n[j] / n[j - 1], 0), j) for j in (1, 2, 3))]

    d = {k: disc(k) for k in c}
    off = {k: {g: d[k][min(v, 3)] if raw[k][g] >= least else v for g, v in c[k].items()} for k in c}
    ctx, free = {k: Counter() for k in c}, {k: Counter() for k in c}
    for k in c:
        for g, v in c[k].items():
            ctx[k][g[:-1]] += v
            free[k][g[:-1]] += off[k][g]

    def p(g):
        k = len(g)
        low = p(g[1:]) if k > 1 else 1 / (len(c[1]) + 1)
        t = ctx[k][g[:-1]]
        return (c[k][g] - off[k].get(g, 0)) / t + free[k][g[:-1]] / t * low if t else low

    return p, sorted({x for s in seqs for x in s[3:]}), raw


def pack(g):
    return sum(x << 16 * (len(g) - 1 - i) for i, x in enumerate(g))


KN = ["the cat sat on the mat.  The dog ate 12 cats!", "anna banana ana", "é # the end of the theme \U0001f600 Жук жук", "日本語の本"]


def test_model_equals_brute_force_and_sums_to_one(spark):
    rows = [(t, "x") for t in KN] + [("zzz zzz", None), (None, "x")]
    every = Q.levels(Q.count_grams(spark.createDataFrame(rows, "text string, lang string")))
    n = every.count()
    salt = spark.createDataFrame(rows, "text string, lang string").select(Q.salt_of("lang")).first()[0]
    for size in (Q.MODEL, n // 2):
        model = Q.train(spark.createDataFrame(rows, "text string, lang string"), size)
        least = {r.salt: r.least for r in Q.least_counts(every, size).collect()}.get(salt, 10**9)
        assert (least == 1) == (size == Q.MODEL) and len(model.grams.keys) <= size
        p, letters, _ = brute_kn(KN, least)
        rng = np.random.default_rng(0)
        asked = [(1, 1, 1, 116), (116, 104, 101, 9999), (9999, 9998, 9997, 9996)] + [tuple(rng.choice(letters, 4).tolist()) for _ in range(200)]
        asked += [tuple(x[i : i + 4]) for t in KN for x in [plain_symbols(t)] for i in range(len(x) - 3)]
        got = model.log_p(np.full(len(asked), salt), np.array([pack(g) for g in asked], np.uint64))
        assert np.allclose(got, [math.log(p(g)) for g in asked], rtol=1e-4, atol=1e-5)
        for ctx in ((116, 104, 101), (1, 1, 1), (120, 120, 120)):
            g = np.array([pack((*ctx, x)) for x in [*letters, 9999]], np.uint64)
            assert abs(np.exp(model.log_p(np.full(len(g), salt), g)).sum() - 1) < 1e-4


def test_symbols_of_pieces_join_up(monkeypatch):
    texts = [("Ünïcode  théré 日本\t\n and so\x01 on 42. " * 9).encode(), b"", b"a", b" x"]
    row, whole = Q.grams(*next(Q.pieces(texts)))
    want = [(i, g) for i, t in enumerate(texts) for s in [[1, 1, 1, *plain_symbols(t.decode())]] for g in (pack(s[j : j + 4]) for j in range(len(s) - 3))]
    assert list(zip(row.tolist(), whole.tolist())) == want
    monkeypatch.setattr(Q, "PIECE", 101)
    cut = [Q.grams(*x) for x in Q.pieces(texts)]
    assert len(cut) > 3 and np.concatenate([g for _, g in cut]).tolist() == whole.tolist()


def test_a_sorted_table_finds_what_it_holds():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**63, 5000, dtype=np.uint64) * np.uint64(2))
    keys[:40] = np.arange(40)  # many with like upper bits
    t = Q.Sorted(keys, np.arange(len(keys)).astype(float))
    hit, value = t.find(np.r_[keys, keys[50:] + np.uint64(1)])
    assert hit[: len(keys)].all() and not hit[len(keys) :].any() and value[: len(keys)].tolist() == list(range(len(keys)))


def test_many_languages(spark):
    docs = spark.range(600).selectExpr("id AS doc_id", "repeat(concat('word', id % 7, ' some text here '), 3) AS text", "concat('l', id % 200) AS lang")
    got = Q.quality_report(docs)
    assert got.count() == 600 and Q.train(docs, 500).grams.keys.size <= 500


def docs_of(spark):
    rng = np.random.default_rng(3)
    stems = ["the", "and", "ing", "tion", "er", "on", "at", "re"]
    rows = [(i, " ".join("".join(rng.choice(stems, 3)) for _ in range(200)) + ".", "en", 0.5) for i in range(40)]
    rows += [(100, " ".join(f"{w}$$$###" for w in ["xq", "zzj", "qqk"] * 5 + [str(i) for i in range(90)]), "en", 0.5)]
    rows += [(101, "short one", "en", 0.5), (102, None, "en", 0.5), (103, "", None, 0.5), (104, "same words again " * 60, "en", 0.5), (None, rows[0][1], "en", 0.5), (0, rows[0][1], "en", 0.5)]
    rows += [(105, "kein deutscher text " + " ".join(f"wort{i}" for i in range(60)), None, 0.5)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, loss double")


def test_report_and_filter(spark):
    docs = docs_of(spark)
    rows = docs.collect()
    got = Q.quality_report(docs).collect()
    assert len(got) == len(rows)
    want = Counter((r.doc_id, *plain(r.text or "")) for r in rows)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    kept = {r.doc_id for r in got if r.kept}
    assert kept >= set(range(40)) and not kept & {100, 101, 102, 103, 104}
    out = Q.drop_poor(docs)
    assert out.columns == docs.columns
    assert Counter(r.doc_id for r in out.collect()) == Counter(r.doc_id for r in got if r.kept)
    assert Q.quality_report(docs.filter("false")).count() == 0 and Q.drop_poor(docs.filter("false")).count() == 0


def test_figures_of_blocks(spark, monkeypatch):
    texts = [" ".join(KN) * 9, "", KN[0], "x"]
    docs = spark.createDataFrame([(t, "x") for t in texts], "text string, lang string").coalesce(1)
    model = Q.train(docs)
    salt = docs.select(Q.salt_of("lang")).first()[0]
    want = []
    for t in texts:
        x = [1, 1, 1, *plain_symbols(t)]
        p = -model.log_p(np.full(len(x) - 3, salt), np.array([pack(x[i : i + 4]) for i in range(len(x) - 3)], np.uint64))
        blocks = [p[i : i + Q.BLOCK].mean() for i in range(0, len(p), Q.BLOCK)]
        want.append((len(p), p.mean() if len(p) else 0, np.median(blocks) if blocks else 0))
    f = Q.scored_column(spark, model, docs.text, docs.lang)
    got = [(r.s.n_scored, r.s.loss, r.s.typical) for r in docs.select(f.alias("s")).collect()]
    assert np.allclose(got, want)


def test_ngrams_beyond_the_held_ones_are_scored_by_their_own_entries(spark, monkeypatch):
    """With a model that holds a part of the n-grams, or none, figures and verdicts are those of the whole model."""
    monkeypatch.setattr(Q, "PIECE", 301)
    texts = [*KN, " ".join(KN) * 9, "", None]
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    p, _, _ = brute_kn([t or "" for t in texts])
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    n = Q.levels(Q.count_grams(docs)).count()
    for size in (0, n // 3, n):
        got = {r.doc_id: r for r in Q.quality_report(docs, size).collect()}
        assert (Q.train_whole(docs, size)[1] is None) == (size == n)
        for i, t in enumerate(texts):
            x = [1, 1, 1, *plain_symbols(t or "")]
            logs = [-math.log(p(tuple(x[j : j + 4]))) for j in range(len(x) - 3)]
            assert abs(got[i].loss - (np.mean(logs) if logs else 0)) < 1e-4
    docs = docs_of(spark)
    whole, part = (sorted(map(tuple, Q.quality_report(docs, size).collect()), key=str) for size in (Q.MODEL, 200))
    assert [r[:-2] for r in whole] == [r[:-2] for r in part] and np.allclose([r[-2:] for r in whole], [r[-2:] for r in part], atol=2e-6)
    assert Counter(map(tuple, Q.drop_poor(docs, 200).collect())) == Counter(map(tuple, Q.drop_poor(docs).collect()))
    assert Q.drop_poor(docs, 200).columns == docs.columns
