import hashlib
import random

import numpy as np

from galeward.llm import exact_dedup as X

WS = " \t\n\x0b\x0c\r"


def bare(t):
    return "".join(c for c in t or "" if c not in WS)


def by_force(rows):
    """(doc_id, keep_id, group_size, kept, digest) of rows (doc_id, text), of which those alike in all are told apart by place."""
    groups: dict = {}
    for place, (i, t, *_) in enumerate(rows):
        groups.setdefault(bare(t), []).append((-len(t or ""), i is None, i or 0, place))
    out = []
    for place, (i, t, *_) in enumerate(rows):
        g = groups[bare(t)]
        first = min(g)
        same = [x for x in g if x[:3] == first[:3]]
        digest = hashlib.sha256(bare(t).encode()).hexdigest()
        mine = next(x for x in g if x[3] == place)
        out.append((i, None if first[1] else first[2], len(g), mine[:3] == first[:3] and (len(same) == 1 or place == same[0][3]), digest))
    return out


def test_cascade_is_minimal_perfect():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 1000):
        keys = rng.integers(0, 1 << 63, (n, 4)).astype(np.uint64)
        sizes, bits = X.build_cascade(keys)
        assert sorted(X.slots_of(keys, sizes, bits).tolist()) == list(range(n)) and int(bits.sum()) == n


def test_nonmembers_are_told_by_their_bytes(spark):
    def table(texts):
        return spark.createDataFrame([(bytearray(hashlib.sha256(t.encode()).digest()), i, i, 1, 1) for i, t in enumerate(texts)], "digest binary, doc_id long, row long, points long, copies long")

    index = X.build_index(table([f"t{i}" for i in range(300)]))
    got = X.lookup(index, table([f"t{i}" for i in range(200, 400)]), index.first()["shards"]).collect()
    assert sum(r.member for r in got) == 100 and all(r.member == (r.old_doc_id is not None) for r in got)


def test_groups_equal_brute_force(spark):
    rng = random.Random(3)
    pool = ["", None, " \n", "a b", "ab", "a\tb ", "é\x1cx", "É x", "long " * 2000, "x y", "xy"]
    rows = [(i, rng.choice(pool) if rng.random() < 0.6 else f"text {i % 50}" + " " * rng.randrange(3), "c") for i in rng.sample(range(1000), 200)]
    rows += [(None, "a b", "c"), (None, "only none", "c"), rows[0], rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string").repartition(3)
    key = lambda r: (r[0] is None, r[0] or 0, r[4], not r[3])
    got = sorted(map(tuple, X.exact_dedup_report(docs).collect()), key=key)
    assert got == sorted(by_force(rows), key=key)
    out = X.drop_exact(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id or -1, bare(r.text)) for r in out.collect()) == sorted((i or -1, bare(t)) for (i, t, _), w in zip(rows, by_force(rows)) if w[3])
    assert X.exact_dedup_report(docs.filter("false")).count() == 0 and X.drop_exact(docs.filter("false")).count() == 0


def test_a_hot_group_is_joined_apart(spark, monkeypatch):
    from galeward.llm import common

    rows = [(i, "the same" if i % 3 else f"own {i}") for i in range(6000)]
    assert 4000 > max(1000, len(rows) // common.HOT_SHARE)
    got = X.exact_dedup_report(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.count() == 6000 and got.filter("group_size = 4000").count() == 4000 and got.filter("kept").count() == 2001


def test_outlying_and_missing_ids_do_not_gather_the_rest_in_a_shard(spark, monkeypatch):
    monkeypatch.setattr(X, "SHARD", 100)
    sizes, build = [], X.build_index
    monkeypatch.setattr(X, "build_index", lambda seen, asked=0: sizes.append((seen.count(), asked, build(seen, asked).agg({"shards": "max"}).first()[0])) or build(seen, asked))
    rows = [(-(10**15), "far off")] + [(i, f"text {i}") for i in range(1500)]
    got = X.exact_dedup_report(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.filter("kept").count() == 1501
    assert min(sizes[0][:2]) > 500 and sizes[0][2] >= 7
    nameless = spark.createDataFrame([(None, f"text {i}") for i in range(1500)], "doc_id long, text string")
    asked = []
    look = X.lookup
    monkeypatch.setattr(X, "lookup", lambda index, df, shards: asked.append(shards) or look(index, df, shards))
    assert X.exact_dedup_report(nameless).filter("kept").count() == 1500 and asked == [15]
