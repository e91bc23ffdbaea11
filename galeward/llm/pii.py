"""Personal data by weak supervision, with DataFrame functions alone.

Base spans (email, ip, card, phone) follow fixed patterns and checks and always stand. Further candidate
spans come from wider patterns: digit groups that fail the card check, national phone numbers, spelt-out
e-mail addresses, IPv6 addresses, and tokens that look like keys ("secret"). Labelers vote +1, -1 or 0
(no opinion) on every candidate, base ones included: a pattern, a gazetteer, the words before it, its
shape. Expectation-maximisation over the counts of vote patterns estimates each labeler's reliability by kind
and the chance that a pattern of votes is personal data; those chances train a logistic span classifier
over votes and shape, and candidates of at least ACCEPT by it that overlap no base span are added.

Counts of vote patterns number at most kinds * 3^labelers * shapes whatever the corpus holds, so they may
reach the driver, where both fits are a few sums; texts are scanned once, and no text is shuffled.

Patterns are written so that a long run of any character is passed in linear time and without recursion, and places are
sums by blocks of matches, so many matches in a text cost no more each than few:
possessive loops, and starts only where a run begins or the last match ended.

Cases: null text is empty and has no spans; a span's place counts code points, its end is exclusive; ties
in start go by kind as listed; repeated rows get equal results; no rows in, no rows out; columns other
than doc_id and text are not read.
"""

from __future__ import annotations

from math import exp, log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read, text_of

KINDS = ("email", "ip", "card", "phone", "secret")
ACCEPT = 0.9
LABELERS = ("pattern", "gazetteer", "context", "shape")
#: Elements of a block where running sums and the like are taken.
BLOCK = 512
_FAR = 2**31 - 1
#: Characters before a candidate in which context labelers look for their words.
REACH = 24

# Patterns of the base spans.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
IP_VALID = r"^(?:0*+(?:1[0-9][0-9]|2[0-4][0-9]|25[0-5]|[1-9]?[0-9]?)(?:\.|$)){4}$"
# Patterns of the further candidates.
SPELT_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[(\[]at[)\]] ?[A-Za-z0-9-]++(?: ?(?:\.|[(\[]dot[)\]]) ?[A-Za-z0-9-]++){1,6}+"
NATIONAL_PHONE = r"(?<![0-9+(.-])(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])"
IPV6 = r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"
SECRET = r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*+[0-9])[A-Za-z0-9_+/-]{20,}+={0,2}+"
# Gazetteers, and words that speak for a kind when they stand shortly before a span.
TOP_DOMAINS = ("com", "org", "net", "edu", "gov", "io", "info", "de", "fr", "es", "uk", "it", "nl", "eu", "example")
CALLING_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "55", "61", "81", "86", "91")
CARD_PREFIXES = ("34", "37", "4", "51", "52", "53", "54", "55", "6011", "65", "35", "36", "38")
CONTEXT = {
    "email": "mail|contact|write|kontakt|correo|courriel",
    "ip": "ip|host|server|addr|node|login",
    "card": "card|visa|master|credit|karte|carte|tarjeta|amex",
    "phone": "tel|phone|call|fax|mobile|handy|ruf|llam",
    "secret": "token|key|secret|passw|auth|bearer|credential",
}
#: Words that speak against any kind.
AGAINST = "isbn|issn|order|invoice|version|page|figure|total|sum|sha|md5|commit"

_SPAN = "array<struct<kind:string,s:int,e:int,m:string,c:string,base:boolean>>"


def _luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _let(value: Column, body) -> Column:
    """body(value), with the value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _blocks(xs: Column) -> Column:
    """An array cut into arrays of BLOCK elements."""
    last = F.call_function("div", F.size(xs) - 1, F.lit(BLOCK)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda j: F.slice(xs, j * BLOCK + 1, F.lit(BLOCK)))


def before(xs: Column, op, zero: int) -> Column:
    """For each element of an array of ints, op over all elements before it (`zero` over none). Each block of
    BLOCK elements is summed up, then each element adds up its block's part before it to the sums of the blocks
    before, so an element costs a look at BLOCK + length / BLOCK others, not at the length."""
    total = lambda b: F.aggregate(b, F.lit(zero), op)
    earlier = lambda ys: F.transform(ys, lambda _, i: total(F.slice(ys, 1, i)))

    def of(blocks):
        return F.flatten(F.transform(F.arrays_zip(blocks.alias("b"), earlier(F.transform(blocks, total)).alias("h")), lambda z: F.transform(earlier(z["b"]), lambda x: op(z["h"], x))))

    return F.when(F.size(xs) == 0, F.array().cast("array<int>")).otherwise(_let(_blocks(xs), of))


def spans(text: Column, kind: str, pattern: str, passed) -> Column:
    """All leftmost non-overlapping matches with their places and the text before them; `passed(match)`: true
    for a base span, false for a candidate, null for neither. The gaps between matches and the matches
    alternate, so places are running sums of lengths."""
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("g"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))

    def found(parts):
        size = F.transform(parts, lambda x: F.length(x["g"]) + F.coalesce(F.length(x["m"]), F.lit(0)))

        def placed(at):
            def one(x, i):
                s = F.get(at, i) + F.length(x["g"])
                return F.struct(F.lit(kind).alias("kind"), s.cast("int").alias("s"), (s + F.length(x["m"])).cast("int").alias("e"), x["m"].alias("m"), F.lower(F.right(x["g"], F.lit(REACH))).alias("c"), F.when(x["m"].isNotNull(), passed(x["m"])).alias("base"))

            return F.filter(F.transform(parts, one), lambda x: x["base"].isNotNull())

        return _let(before(size, lambda x, y: x + y, 0), placed)

    return _let(zipped, found).cast(_SPAN)


def every_span(text: Column) -> Column:
    """The base spans and the further candidates, unsorted. Card groups that fail their check are candidates; other matches
    that fail theirs are left out."""
    none = F.array().cast(_SPAN)
    only = lambda ok: F.when(ok, True)
    size = lambda m: F.length(_digits(m))
    card = lambda m: F.when(size(m).between(13, 19), size(m).between(14, 19) & _luhn(_digits(m)))
    further = lambda m: F.lit(False)
    numbers = text.rlike("[0-9]")
    found = [
        F.when(F.contains(text, F.lit("@")), spans(text, "email", EMAIL, lambda m: F.lit(True))),
        F.when(text.rlike(r"[0-9]\.[0-9]"), spans(text, "ip", IP, lambda m: only(m.rlike(IP_VALID)))),
        F.when(numbers, spans(text, "card", CARD, card)),
        F.when(F.contains(text, F.lit("+")), spans(text, "phone", PHONE, lambda m: only(size(m).between(10, 15)))),
        F.when(text.rlike(r"[(\[]at[)\]]"), spans(text, "email", SPELT_EMAIL, further)),
        F.when(F.contains(text, F.lit(":")) & numbers, spans(text, "ip", IPV6, further)),
        F.when(numbers, spans(text, "phone", NATIONAL_PHONE, further)),
        F.when(numbers, spans(text, "secret", SECRET, further)),
    ]
    return F.concat(*[F.coalesce(x, none) for x in found])


def _votes(x: Column) -> dict[str, Column]:
    """A vote of each labeler on a span."""
    kind, m, digits = x["kind"], x["m"], _digits(x["m"])
    by_kind = lambda d, other=0: F.coalesce(*[F.when(kind == k, v) for k, v in d.items()], F.lit(other))
    vote = lambda yes, no=None: F.when(yes, 1).when(no if no is not None else ~yes, -1).otherwise(0)
    starts = lambda values: F.lit("^(?:" + "|".join(values) + ")")
    tail = F.lower(F.regexp_extract(m, r"([A-Za-z]+)[^A-Za-z]*$", 1))
    pattern = F.when(x["base"], 1).otherwise(by_kind({"card": F.lit(-1), "email": F.lit(0), "ip": F.lit(0), "phone": F.lit(0), "secret": F.lit(0)}))
    gazetteer = by_kind({
        "email": vote(tail.isin(*TOP_DOMAINS), F.lit(False)),
        "card": vote(F.regexp_like(digits, starts(CARD_PREFIXES))),
        "phone": F.when(F.startswith(m, F.lit("+")), vote(F.regexp_like(digits, starts(CALLING_CODES)))).otherwise(0),
        "secret": vote(m.rlike(r"^(?:AKIA|ghp_|sk-|xox|eyJ)"), m.rlike(r"^[0-9 -]+$")),
        "ip": vote(m.rlike(r"^(?:10|127|172|192)\.") | F.contains(m, F.lit(":")), F.lit(False)),
    })
    context = F.when(F.coalesce(*[F.when(kind == k, x["c"].rlike(w)) for k, w in CONTEXT.items()]), 1).when(x["c"].rlike(AGAINST), -1).otherwise(0)
    distinct = F.size(F.array_distinct(F.split(m, "")))
    shape = by_kind({
        "email": vote(F.length(m).between(6, 64)),
        "card": vote(F.length(digits).isin(15, 16), ~F.length(digits).between(14, 19)),
        "phone": vote(F.length(digits).between(10, 13)),
        "secret": vote((distinct >= 10) & m.rlike("[0-9]") & m.rlike("[A-Za-z]"), (distinct < 8) | ~m.rlike("[A-Za-z]")),
        "ip": vote(distinct >= 4),
    })
    return {"pattern": pattern, "gazetteer": gazetteer, "context": context, "shape": shape}


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, found): a scratch table of the documents' candidate spans with votes and a size class."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("_t"))
    voted = F.transform(every_span(F.col("_t")), lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["base"].alias("base"), F.least(F.floor((x["e"] - x["s"]) / 8), F.lit(7)).cast("int").alias("size"), *[v.cast("int").alias(k) for k, v in _votes(x).items()]))
    return cut(d.select("doc_id", voted.alias("found")), "pii")


def estimate(counts: list[tuple[tuple[int, ...], float]], rounds: int = 50) -> tuple[float, list[dict], list[float]]:
    """Dawid-Skene over vote patterns of one kind: (share of true spans, for each labeler the chance of each
    vote given true and given false, chance of true for each pattern)."""
    total = sum(n for _, n in counts) or 1.0
    width = len(counts[0][0]) if counts else 0
    chance = [1 / (1 + exp(-1.0 * sum(v))) for v, _ in counts]
    share, tables = 0.5, []
    for _ in range(rounds):
        share = min(max(sum(p * n for p, (_, n) in zip(chance, counts)) / total, 0.01), 0.99)
        tables = []
        for j in range(width):
            t = {}
            for vote in (-1, 0, 1):
                yes = sum(p * n for p, (v, n) in zip(chance, counts) if v[j] == vote)
                no = sum((1 - p) * n for p, (v, n) in zip(chance, counts) if v[j] == vote)
                # pseudo-counts: a labeler is somewhat better than chance until the counts say more
                t[vote] = ((yes + (2.0 if vote == 1 else 0.5)) / (share * total + 3.0), (no + (2.0 if vote == -1 else 0.5)) / ((1 - share) * total + 3.0))
            tables.append(t)
        chance = []
        for v, _ in counts:
            odds = log(share) - log(1 - share) + sum(log(tables[j][x][0]) - log(tables[j][x][1]) for j, x in enumerate(v))
            chance.append(1 / (1 + exp(-max(min(odds, 30.0), -30.0))))
    return share, tables, chance


def fit(rows: list[tuple[list[float], float, float]], rounds: int = 300, rate: float = 1.0, decay: float = 1e-3) -> list[float]:
    """Logistic regression on (features, chance, count) rows; the first weight is the bias."""
    width = len(rows[0][0]) if rows else 0
    w, total = [0.0] * (width + 1), sum(n for *_, n in rows) or 1.0
    for _ in range(rounds):
        g = [decay * x for x in w]
        for f, p, n in rows:
            z = w[0] + sum(a * b for a, b in zip(w[1:], f))
            d = (1 / (1 + exp(-max(min(z, 30.0), -30.0))) - p) * n / total
            g[0] += d
            for i, x in enumerate(f):
                if x:
                    g[i + 1] += d * x
        w = [a - rate * b for a, b in zip(w, g)]
    return w


def _features(votes: tuple[int, ...], size: int) -> list[float]:
    return [float(v == s) for v in votes for s in (1, -1)] + [float(size <= 1), float(size >= 3)]


def classifier(found: DataFrame) -> dict[str, dict[tuple, float]]:
    """By kind and (votes, size class): the span classifier's chance. Fitted on the counts of all candidates."""
    x = found.select(F.explode("found").alias("x")).groupBy("x.kind", "x.size", *[f"x.{k}" for k in LABELERS]).agg(F.count("*").alias("n")).collect()
    out: dict[str, dict[tuple, float]] = {}
    for kind in KINDS:
        mine = sorted((tuple(r[k] for k in LABELERS), r["size"], float(r["n"])) for r in x if r["kind"] == kind)
        patterns: dict[tuple, float] = {}
        for v, _, n in mine:
            patterns[v] = patterns.get(v, 0.0) + n
        counts = sorted(patterns.items())
        chance = dict(zip((v for v, _ in counts), estimate(counts)[2]))
        w = fit([(_features(v, s), chance[v], n) for v, s, n in mine])
        out[kind] = {(*v, s): 1 / (1 + exp(-(w[0] + sum(a * b for a, b in zip(w[1:], _features(v, s)))))) for v, s, _ in mine}
    return out


def _accepted(x: Column, chances: dict[str, dict[tuple, float]]) -> Column:
    """Whether the classifier accepts a span; the patterns it accepts are few, and listed."""
    listed = sorted("|".join(map(str, (kind, *key))) for kind, table in chances.items() for key, p in table.items() if p >= ACCEPT)
    name = F.concat_ws("|", x["kind"], *[x[k].cast("string") for k in LABELERS], x["size"].cast("string"))
    return name.isin(*listed) if listed else F.lit(False)


def free_of_base(xs: Column) -> Column:
    """The elements of an array sorted by start that are base spans or overlap none of them: those before end
    no later than it starts, and those behind start no earlier than it ends."""
    ends = before(F.transform(xs, lambda x: F.when(x["base"], x["e"]).otherwise(0)), lambda x, y: F.greatest(x, y), 0)
    starts = F.reverse(before(F.reverse(F.transform(xs, lambda x: F.when(x["base"], x["s"]).otherwise(_FAR))), lambda x, y: F.least(x, y), _FAR))
    return _let(ends, lambda es: _let(starts, lambda ss: F.filter(xs, lambda x, i: x["base"] | ((F.get(es, i) <= x["s"]) & (F.get(ss, i) >= x["e"])))))


def pii(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans (arrays of start, place of the kind in KINDS, end, kind; sorted): a row for each document."""
    found = candidates(docs)
    chances = classifier(found)
    place = lambda k: F.coalesce(*[F.when(k == name, i) for i, name in enumerate(KINDS)])
    bare = lambda xs: F.transform(xs, lambda x: F.struct(x["s"].alias("s"), place(x["kind"]).alias("k"), x["e"].alias("e"), x["kind"].alias("kind"), x["base"].alias("base")))
    some = F.filter("found", lambda x: x["base"] | _accepted(x, chances))
    kept = _let(F.array_sort(bare(some)), free_of_base)
    split = found.select("doc_id", kept.alias("spans"))
    return split.select("doc_id", F.filter("spans", lambda x: x["base"]).alias("base"), "spans")


def _written(xs: str) -> Column:
    return F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def pii_report(docs: DataFrame) -> DataFrame:
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return pii(docs).select("doc_id", *[count(k) for k in KINDS[:4]], F.sha2(_written("base"), 256).alias("base_sha256"), _written("spans").alias("spans"))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_report(read(spark, sf_dir, "documents"))
