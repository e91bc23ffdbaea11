import random
from collections import Counter

import pytest

from galeward.llm import line_dedup as D
from pyspark.sql import functions as F

WS = " \t\n\x0b\x0c\r"


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def some_lines(rng, n, alphabet="abcé "):
    base = ["x" + "".join(rng.choice(alphabet) for _ in range(rng.randrange(18, 34))) + "y" for _ in range(n)]
    out = list(base)
    for s in base:
        for _ in range(3):
            t = list(s)
            for _ in range(rng.randrange(4)):
                k, p = rng.randrange(3), rng.randrange(1, len(t))
                t[p : p + (k > 0)] = [] if k == 2 else [rng.choice(alphabet)]
            out.append("".join(t) + "z")
    return sorted(set(out))


@pytest.mark.parametrize("tau", [1, 2, 3])
def test_band_equals_the_full_table(spark, tau):
    rng = random.Random(tau)
    lines = some_lines(rng, 14)
    pairs = [(a, b) for a in lines for b in lines if 0 <= len(b) - len(a) <= tau][:500] + [("abc", "abc"), ("abc", "abd"), ("abcd", "bcde"), ("a" * 70, "a" * 69 + "b")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = df.select("a", "b", D.within(F.col("a"), F.col("b"), tau).alias("w")).collect()
    assert [r.w for r in got] == [edits(r.a, r.b) <= tau for r in got]
    assert any(r.w for r in got) and not all(r.w for r in got)


@pytest.mark.parametrize("tau", [1, 2])
def test_no_link_is_lost(spark, tau):
    rng = random.Random(7 + tau)
    lines = some_lines(rng, 40)
    lines = sorted({x[:k] for x in lines for k in (9, 14, 40)})
    df = D.named(spark.createDataFrame([(x,) for x in lines], "line string"))
    place = {r.id: lines.index(r.line) for r in df.collect()}
    got = {frozenset(place[i] for i in r) for r in D.line_links(df, tau).collect()}
    want = {frozenset((i, j)) for i, a in enumerate(lines) for j, b in enumerate(lines) if i < j and near(a, b, tau)}
    assert got == want and any(len(lines[i]) < 20 for p in want for i in p) and any(len(lines[i]) > 20 for p in want for i in p)


def near(a, b, tau):
    most = min(tau, max(len(a), len(b)) // D.CHARS)
    return a == b or abs(len(a) - len(b)) <= most and edits(a, b) <= most


def classes(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in links:
        x, y = sorted((find(i), find(j)))
        root[y] = x
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("crowd", [1, 4, 30])
def test_crowds_keep_their_classes(spark, crowd):
    """Copies of one and two edits, lines that share a segment and no more, and several such groups under one segment."""
    rng = random.Random(crowd)
    start = "a common beginning: "
    lines = set()
    for stem in ("the quick brown fox jumps over it", "les sanglots longs des violons dd", "zzzz qqqq xxxx jjjj kkkk vvvv wwww"):
        for _ in range(60):
            t = list(start + stem)
            for _ in range(rng.choice([1, 1, 2, 4])):
                t[rng.randrange(len(t))] = rng.choice("abcxyz")
            lines.add("".join(t))
    lines |= {start + "".join(rng.choice("etaoinshrdlu ") for _ in range(33)) + "." for _ in range(60)}
    lines = sorted(lines)
    df = D.named(spark.createDataFrame([(x,) for x in lines], "line string"))
    place = {r.id: lines.index(r.line) for r in df.collect()}
    found = [(place[r.u], place[r.v]) for r in D.line_links(df, 2, crowd).collect()]
    assert all(near(lines[i], lines[j], 2) for i, j in found)
    want = [(i, j) for i, a in enumerate(lines) for j, b in enumerate(lines) if i < j and near(a, b, 2)]
    assert classes(len(lines), found) == classes(len(lines), want)


def test_links_of_copies_with_an_edit_each_grow_with_their_number(spark):
    stem = "it was the best of times, it was the worst of times, it was the age of wisdom, it was the age of foolishness"
    rng, counts = random.Random(2), []
    for n in (600, 2400):
        lines = set()
        while len(lines) < n:
            k = rng.randrange(len(stem))
            lines.add(stem[:k] + chr(rng.randrange(0x3B1, 0x430)) + stem[k + 1 :])
        df = D.named(spark.createDataFrame([(x,) for x in sorted(lines)], "line string"))
        links = D.line_links(df, 2, 100).collect()
        place = {r.id: k for k, r in enumerate(df.collect())}
        assert len(set(classes(n, [(place[r.u], place[r.v]) for r in links]))) == 1
        counts.append(len(links))
    assert counts[1] < 6 * counts[0] and counts[1] < 20 * 2400


def test_very_long_lines(spark):
    rng = random.Random(5)
    long = "".join(rng.choice("abcdefgh ") for _ in range(60_000)) + "x"
    lines = [long, long[:30_000] + "Z" + long[30_001:], long[:100] + long[101:59_000] + "Q" + long[59_000:], long[:5] + "123" + long[5:], "x" * 40_000, "x" * 40_002, "x" * 40_003 + "y"]
    df = D.named(spark.createDataFrame([(x,) for x in lines], "line string"))
    place = {r.id: lines.index(r.line) for r in df.collect()}
    got = {frozenset((place[r.u], place[r.v])) for r in D.line_links(df).collect()}
    assert got == {frozenset(x) for x in ((0, 1), (0, 2), (4, 5), (5, 6))}


def plain(rows, tau):
    """Removed places by (row), by force."""
    seen = [(i is None, i or 0, r, p, x.strip(WS)) for r, (i, t, *_) in enumerate(rows) for p, x in enumerate((t or "").split("\n")) if x.strip(WS)]
    texts = sorted({s[-1] for s in seen})
    root = {t: t for t in texts}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    for a in texts:
        for b in texts:
            if a < b and near(a, b, tau):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    first, gone = {}, Counter()
    for z, i, r, p, t in sorted(seen):
        if find(t) in first:
            gone[r] += 1
        first.setdefault(find(t), (r, p))
    return [(rows[r][0], sum(s[2] == r for s in seen), gone[r]) for r in range(len(rows))], {(s[2], s[3]) for s in seen} - set(first.values())


def test_report_and_filter(spark):
    rng = random.Random(11)
    pool = [x for x in some_lines(rng, 12) if len(x) >= 20] + ["short", "shorT", " short\t", ""]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 7))), "p") for i in range(40)]
    rows += [(None, pool[0], "p"), (50, None, "p"), (51, "", "p"), (52, "\n \n", "p"), (3, rows[3][1], "p"), (53, "long " * 5000 + "\n" + "long " * 5000, "p")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, places string").coalesce(1)
    want, gone = plain(rows, D.TAU)
    got = D.line_report(docs).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted(((r.doc_id, r.n_lines, r.n_removed) for r in got), key=key) == sorted(want, key=key)
    assert all(r.n_removed == len([x for x in r.removed.split(",") if x]) for r in got)
    out = D.drop_repeated_lines(docs)
    assert out.columns == docs.columns
    left = Counter((i, "\n".join(x for p, x in enumerate(t.split("\n")) if (r, p) not in gone) if t is not None else None) for r, (i, t, _) in enumerate(rows))
    assert Counter((r.doc_id, r.text) for r in out.collect()) == left
    assert D.line_report(docs.filter("false")).count() == 0


def test_letters_are_counted_in_what_the_others_leave(spark):
    """Sixteen scans of ever shorter texts, with the counts of the whole line."""
    from pyspark.sql import functions as F

    from galeward.llm import line_dedup as L

    lines = ["", "eee" * 7, "the rain in Spain, gum & Çedille été", "e" * 33 + "日本" + " " * 17, "xyz"]
    got = spark.createDataFrame([(x,) for x in lines], "line string").select("line", L._letters(F.col("line")).alias("sig"))
    for r in got.collect():
        assert r.sig & (2**64 - 1) == sum((r.line.count(c) & 15) << 4 * k for k, c in enumerate(L.LETTERS))
    text = got.select("sig")._jdf.queryExecution().logical().toString()
    assert "replace(replace(" in text


def plans_of(spark, monkeypatch, texts):
    """Optimised plans of the scratch tables that a report over the texts writes."""
    seen, plain_cut = [], D.cut

    def cut(df, tag="t"):
        seen.append(df._jdf.queryExecution().optimizedPlan().toString())
        return plain_cut(df, tag)

    monkeypatch.setattr(D, "cut", cut)
    D.line_report(spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string")).collect()
    return seen


def test_letters_are_counted_once_for_each_line(spark, monkeypatch):
    """In an aggregate's results each use of a nested expression is run anew, 16 letters then take 256 scans."""
    plans = plans_of(spark, monkeypatch, ["the first line of it\nanother, unlike all others", "the first line of it!"])
    counting = [p for p in plans if "replace(" in p]
    assert counting
    assert not [x for p in counting for x in p.splitlines() if "Aggregate" in x and "replace(" in x]


def test_probe_keys_are_made_by_one_expression(spark, monkeypatch):
    """One for each of the 12 places makes a method that the JVM does not compile."""
    plans = plans_of(spark, monkeypatch, ["the first line of it\nanother, unlike all others", "the first line of it!"])
    assert any("xxhash64(" in p and "substring(" in p for p in plans)
    assert max(x.count("substring(") for p in plans for x in p.splitlines()) <= 1


@pytest.mark.parametrize("tau", [1, 2])
def test_lines_that_meet_hold_every_link(spark, tau):
    """Also those in the middle of a crowd, whose ids are neither its key's least nor its greatest."""
    rng = random.Random(tau)
    crowd = {"one beginning for all of them: " + "".join(rng.choice("abcdefgh") for _ in range(14)) for _ in range(30)}
    lonely = {"".join(rng.choice("klmnopqrstuvwxyz") for _ in range(50)) for _ in range(20)}
    lines = sorted(crowd | lonely | {x for x in some_lines(rng, 20) if len(x) >= D.CHARS} | {"shorter", "shortest"})
    got = {r.line for r in D.met(D.named(spark.createDataFrame([(x,) for x in lines], "line string")), tau).collect()}
    linked = {x for a in lines for b in lines if a < b and min(len(a), len(b)) >= D.CHARS and near(a, b, tau) for x in (a, b)}
    assert linked and linked <= got and crowd <= got and not lonely & got
