import random

import pytest
import xxhash

from galeward.llm import simhash
from galeward.llm.simhash import allocate, drop_near, fingerprint, fingerprint_column, links, simhash_components
from pyspark.sql import functions as F


def plain(text: str) -> int:
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def by_force(fps, radius=2):
    n = len(fps)
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(n)]


TEXTS = ["", None, " \t\n", "a", "A b", "a b c", "AÉ b  C d", "x " * 500, "the end\x1c of", "Ünï cödé wörds hère ñ"]


def test_fingerprints_follow_the_definition():
    for t in TEXTS:
        assert fingerprint((t or "").encode()) == plain(t or "")


def test_thresholds_are_cheapest_and_lose_no_link():
    cost, picks = allocate([[0, 5, 9, 99], [0, 1, 2, 3]], 2)
    assert sum(picks) == 2 - 2 + 1 and cost == 3 and picks == [-1, 2]


@pytest.mark.parametrize("bucket", [2048, 4])
def test_components_equal_brute_force(spark, bucket):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = base + [rng.choice(base) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(80)]
    fps += [base[0] ^ (1 << i) for i in range(8)] + [base[1]] * 30
    want = by_force(fps)
    prints = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in sorted(set(fps))], "fp long")
    edges = [tuple(e) for e in links(prints, 2, bucket).collect()]
    assert len(edges) < 5000
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for u, v in edges:
        u, v = u % (1 << 64), v % (1 << 64)
        a, b = sorted((find(u), find(v)))
        root[b] = a
    got = {}
    for f, w in zip(fps, want):
        got.setdefault(find(f), set()).add(w)
    assert all(len(x) == 1 for x in got.values()) and len(got) == len(set(want))


def test_odd_rows(spark):
    rows = [(3, "a b c d", "x"), (1, "A b c d", "y"), (None, "a b c d", "z"), (5, None, "e"), (6, "", "e"), (7, "other words here now", "c"), (7, "other words here now", "c"), (None, "lonely text of no one", "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component string")
    found = simhash_components(docs.select("doc_id", fingerprint_column(F.coalesce("text", F.lit(""))).alias("fp"))).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in found) == [(0, 0), (0, 1), (1, 1), (3, 1), (5, 5), (6, 5), (7, 7), (7, 7)]
    kept = drop_near(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.component) for r in kept.collect()) == [(0, "n"), (1, "y"), (5, "e"), (7, "c")]
    none = docs.filter("false")
    assert drop_near(none).count() == 0


def test_query_on_a_fixture(spark, tmp_path):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(50)]
    rows = []
    for i in range(60):
        t = [rng.choice(words) for _ in range(120)]
        rows.append((2 * i, " ".join(t)))
        if i % 3 == 0:
            rows.append((2 * i + 1, " ".join(t[:-1])))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op7_simhash(spark, str(tmp_path)).collect()}
    fps = [plain(t) for _, t in rows]
    roots = by_force(fps)
    least = {}
    for (i, _), r in zip(rows, roots):
        least[r] = min(least.get(r, i), i)
    assert got == {i: (f"{f:016x}", least[r]) for (i, _), f, r in zip(rows, fps, roots)}
