import hashlib
import re

from galeward.llm import pii as P

RULES = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub("[^0-9]", "", m)) <= 15),
]


def luhn(d):
    t = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        t += x - 9 * (x > 9)
    return t % 10 == 0


def plain(text):
    out = []
    for k, (kind, pattern, ok) in enumerate(RULES):
        out += [(m.start(), k, m.end(), kind) for m in re.finditer(pattern, text or "") if ok(m.group())]
    return sorted(out)


CARD = next(str(n) for n in range(4111111111111100, 4111111111111200) if luhn(str(n)))
TEXTS = [
    None, "", "no data", "write to a.b_c+1@mail.example.com, or x@y", "a@b.c_d@e.f %@q.r a@b..c é@x.y 1@2.3.4.5",
    "ip 10.0.0.1, 256.1.1.1 1.2.3 1.2.3.4.5.6.7.8 0001.02.3.00255 1.2.3.4567 9.9.9.9.", f"card {CARD} and {CARD[:4]} {CARD[4:8]}-{CARD[8:]} {CARD}1 4111 1111 1111 1112",
    "call +1 (234) 567-8901 or +44 20 7946 0958. +1234 +12 34567890123456 ++49(0)30-1234567)", "é\U0001f600 ß +49 30 12345678 日本 a@b.co",
    "1 " * 3000, "a" * 20000 + "@", "1" * 20000, "+1" * 3000, "a." * 5000 + "@" + "b." * 5000, "1." * 5000, "(" * 100 + "+1" + "(" * 9000,
    'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" end', "mail me: joe (at) corp (dot) com", f"{CARD}@x.com +{CARD}", "\n\n5\n5 \x1c4111-1111",
]


def test_base_spans_equal_python(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, TEXTS[4], "x"), (4, TEXTS[4], "x")], "doc_id long, text string, spans string")
    got = P.pii_report(docs).collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        want = plain(TEXTS[4 if r.doc_id is None else r.doc_id])
        line = ",".join(f"{k}:{s}:{e}" for s, _, e, k in want)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest(), (r.doc_id, line[:200])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[3] == k for x in want) for k, *_ in RULES]
        said = [x.split(":") for x in r.spans.split(",") if x]
        assert {f"{k}:{s}:{e}" for s, _, e, k in want} <= {":".join(x) for x in said}
        order = [(int(s), P.KINDS.index(k)) for k, s, _ in said]
        assert order == sorted(order)
    assert P.pii_report(docs.filter("false")).count() == 0


def test_keys_are_added_and_clean_texts_left_alone(spark):
    rows = [(i, f'the end token = "{hashlib.sha1(str(i).encode()).hexdigest()}" of it') for i in range(60)]
    rows += [(100 + i, f"clean words number {i} and 12 more, {i * 7919} of them") for i in range(60)]
    got = {r.doc_id: r.spans for r in P.pii_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == "secret:17:57" for i in range(60)) and not any(got[100 + i] for i in range(60))


def test_reliabilities_are_found():
    import random

    rng = random.Random(1)
    n: dict = {}
    for _ in range(4000):
        true = rng.random() < 0.3
        v = tuple((1 if (rng.random() < a) == true else -1) if rng.random() < 0.8 else 0 for a in (0.95, 0.8, 0.6))
        n[v] = n.get(v, 0) + 1
    share, tables, _ = P.estimate(sorted(n.items()))
    assert abs(share - 0.3) < 0.08
    good = [t[1][0] / (t[1][0] + t[-1][0]) for t in tables]
    assert good[0] > good[1] > good[2]


def test_added_spans_equal_a_plain_choice(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100 + i, f'key = "{hashlib.sha1(str(i).encode()).hexdigest()}" mail a{i}@b.com joe{i} (at) corp (dot) org, (020) 555 12{i:02}') for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = P.candidates(docs)
    chances = P.classifier(found)
    for r in P.pii(docs).collect():
        mine = found.filter(f"doc_id = {r.doc_id}").first().found if r.doc_id >= 100 or r.doc_id in (7, 18, 19, 20) else None
        if mine is None:
            continue
        base = [x for x in mine if x.base]
        more = [x for x in mine if not x.base and chances[x.kind][(*[x[k] for k in P.LABELERS], x["size"])] >= P.ACCEPT and not any(b.s < x.e and x.s < b.e for b in base)]
        assert [(x.s, x.e, x.kind) for x in r.spans] == [(x.s, x.e, x.kind) for x in sorted(base + more, key=lambda x: (x.s, P.KINDS.index(x.kind), x.e))]


def test_running_figures_of_long_arrays(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([([],), ([3],), (list(range(P.BLOCK)),), ([(i * 7919) % 101 for i in range(3 * P.BLOCK + 5)],)], "x array<int>")
    for r in df.select("x", P.before(F.col("x"), lambda a, b: a + b, 0).alias("s"), P.before(F.col("x"), lambda a, b: F.greatest(a, b), 0).alias("m")).collect():
        assert r.s == [sum(r.x[:i]) for i in range(len(r.x))] and r.m == [max([0, *r.x[:i]]) for i in range(len(r.x))]


def test_time_follows_the_number_of_matches(spark):
    import time

    took = []
    for n in (500, 16_000, 32_000):
        text = "".join(f"a{i}@b.com {i % 90 + 10} x " for i in range(n))
        began = time.time()
        r = P.pii_report(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
        took.append(time.time() - began)
        assert r.n_email == n
    assert took[2] < 3 * took[1] + 2
