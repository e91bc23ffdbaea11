"""Near-duplicate lines by a segment-partition edit join, with DataFrame functions alone.

A line is what lies between two newlines, without white space at its ends; blank ones are none. Lines are linked when
at most TAU edits apart and at most one edit for each CHARS code points of the longer one, so lines under CHARS are linked
only when equal; classes are the components of the links. The first line of a class (by doc_id, row, place) stays.

Search: a line of length l is cut into TAU + 1 segments, one of which survives TAU edits whole. Every
distinct line indexes its segments by (l, number, text) and looks up, for each length from its own
down to TAU less, just the substrings that a surviving segment may have become (the multi-match
aware range of places). Most lines meet no other under any key and are left at that, without a pair. For the others
this is done again with the counts of their letters: pairs whose counts of common letters differ too much for TAU edits are
dropped within the join; the rest are verified by a bit-parallel run along the band of 2 * TAU + 1
diagonals, a bit for each diagonal and a word for each number of edits.

Crowds: keys that over CROWD lines index are never joined with themselves. One of their lines, the pivot, is
compared with all that look the key up; those linked with it are linked among each other through it, so
only pairs with an unlinked line are left. They are searched again under longer keys: TAU edits change the counts of
letters by 2 * TAU in all, so of 2 * TAU + s groups of letters s are left alike, and the counts of every s
groups are a key (s = 2, then s = 4 where crowds remain). No link between classes is lost, and copies with an edit each
cost one comparison each, not one for each pair.

Cases: null text has no lines; a null doc_id comes last among doc_ids; repeated rows are documents of their
own, so all but the first row's lines go; ties in doc_id go by row as read; very long lines are lines
like any other, compared over their whole length; no rows in, no rows out; other columns are not read by the report and kept by the filter.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, components, cut, fresh, read, text_of

TAU, CHARS = 2, 10
#: Lines that may index a key before it is split, and 1 of how many lines is looked at to find such keys. Keys that are
#: not noticed are joined whole: the figures decide on the plan, never on the links.
CROWD, GLANCE = 1000, 64
#: Lines whose texts are fetched for verification by broadcast at most (8 bytes each); beyond, by shuffle.
BROADCAST_IDS = 1_000_000
# Letters that are counted, 4 bits each.
LETTERS = "eatnirsohdlucmg "
BLANK_CHARS = " \t\x0b\x0c\r"


def _exploded(docs: DataFrame, *kept: Column) -> DataFrame:
    """The kept columns, pos and line: a row for each part between newlines, its ends trimmed."""
    parts = docs.select(*kept, F.posexplode(F.split(text_of(), "\n", -1)).alias("pos", "line"))
    return parts.withColumn("line", F.btrim("line", F.lit(BLANK_CHARS)))


def _key(line: Column) -> Column:
    return F.unhex(F.md5(line.cast("binary")))


def _letters(line: Column) -> Column:
    """Counts of LETTERS modulo 16, packed. An edit changes at most two of them, by one. The letters are of one
    byte each, so bytes may be counted."""
    out = F.lit(0).cast("long")
    for k, c in enumerate(LETTERS):
        left = F.replace(line, F.lit(c), F.lit(""))
        n = (F.octet_length(line) - F.octet_length(left)).cast("long")
        out = out.bitwiseOR(F.shiftleft(n.bitwiseAND(F.lit(15)), 4 * k))
        line = left  # the other letters are counted in what is left, ever less
    return out


def _letters_apart(a: str, b: str) -> str:
    """SQL for a lower bound on how many counts differ by how much."""
    one = "least(({x} - {y}) & 15, ({y} - {x}) & 15)"
    return " + ".join(one.format(x=f"(shiftrightunsigned({a}, {4 * k}) & 15)", y=f"(shiftrightunsigned({b}, {4 * k}) & 15)") for k in range(len(LETTERS)))


def _segment(length: Column, i: Column, tau: int) -> tuple[Column, Column]:
    """First place (from 1) and size of segment i of TAU + 1; longer segments come last."""
    extra = length % (tau + 1)
    base = F.call_function("div", length - extra, F.lit(tau + 1)).cast("int")
    plain = F.lit(tau + 1) - extra  # segments of the smaller size
    first = base * (i - 1) + F.greatest(F.lit(0), i - 1 - plain) + 1
    return first.cast("int"), (base + F.when(i > plain, 1).otherwise(0)).cast("int")


def index_places(tau: int) -> list[tuple[int, int, int]]:
    """(less, segment, offset) of a line's own segments."""
    return [(0, i, 0) for i in range(1, tau + 2)]


def probe_places(tau: int) -> list[tuple[int, int, int]]:
    """(less, segment, offset) of the places where a surviving segment of a line `less` shorter may lie, a line's own
    segments among them. A place beyond the line's ends makes a key that no index holds, or one more candidate."""
    out = []
    for less in range(tau + 1):
        for i in range(1, tau + 2):
            out += [(less, i, off) for off in range(max(1 - i, less - (tau + 1 - i)), min(i - 1, less + (tau + 1 - i)) + 1)]
    return out


def keyed(lines: DataFrame, places: list[tuple[int, int, int]], tau: int, *kept: str) -> DataFrame:
    """key and the kept columns: a row for each line and place. The places are exploded before a key is made, so that there is
    one expression for all of them: the code of one for each was too long for the JVM to compile, and was interpreted."""
    at = F.array(*[F.struct(*[F.lit(x).alias(c) for c, x in zip(("less", "i", "off"), p)]) for p in places])
    other = (F.col("n") - F.col("at.less")).cast("int")
    first, size = _segment(other, F.col("at.i"), tau)
    key = F.xxhash64(other, F.col("at.i"), F.substring(F.col("line"), first + F.col("at.off"), size))
    return lines.select("line", "n", *[c for c in kept if c != "n"], F.explode(at).alias("at")).select(key.alias("key"), *kept)


def within(a: Column, b: Column, tau: int) -> Column:
    """Whether strings a and b (b not shorter) are at most tau edits apart.

    Word e has bit d set when row j + d - tau of column j is reachable with e edits; a step along b
    moves all diagonals of a word at once."""
    rim = F.array_repeat(F.lit(None).cast("string"), tau)
    x, y = F.concat(rim, F.split(a, ""), rim, rim), F.split(b, "")
    # beside each letter of b the letters of a on its diagonals, cut out once for a pair
    beside = F.arrays_zip(y.alias("y"), *[F.slice(x, d + 1, F.length(b)).alias(f"x{d}") for d in range(2 * tau + 1)])
    equal = F.transform(beside, lambda z: sum((F.when(z[f"x{d}"] == z["y"], 1 << d).otherwise(0) for d in range(1, 2 * tau + 1)), F.when(z["x0"] == z["y"], 1).otherwise(0)))
    full = (1 << (2 * tau + 1)) - 1
    start = F.struct(*[F.lit(sum(1 << (tau + k) for k in range(e + 1))).alias(f"r{e}") for e in range(tau + 1)])

    def step(acc, match):
        new = [acc["r0"].bitwiseAND(match)]
        for e in range(1, tau + 1):
            kept = acc[f"r{e}"].bitwiseAND(match)
            moved = acc[f"r{e - 1}"].bitwiseOR(F.shiftright(acc[f"r{e - 1}"], 1)).bitwiseOR(F.shiftleft(new[e - 1], 1))
            new.append(kept.bitwiseOR(moved).bitwiseAND(F.lit(full)))
        return F.struct(*[r.cast("int").alias(f"r{e}") for e, r in enumerate(new)])

    last = F.aggregate(equal, start, step)[f"r{tau}"]
    return F.call_function("shiftright", last, (F.length(a) - F.length(b) + tau).cast("int")).bitwiseAND(F.lit(1)) == 1


def named(lines: DataFrame) -> DataFrame:
    """Distinct lines (line) with id and n (code points), as a scratch table."""
    return cut(lines.select("line", F.length("line").alias("n")).withColumn("id", F.monotonically_increasing_id()), "dlines")


def met(lines: DataFrame, tau: int = TAU) -> DataFrame:
    """The lines (id, line, n) that another line meets under a key, with sig (letters), as a scratch table: all that can have a
    link. A key is asked for its least and its greatest line only, so crowds cost a row for each line; every line of a key
    that several index asks for that key itself."""
    d = lines.filter(F.col("n") >= CHARS)
    ends = keyed(d, index_places(tau), tau, "id").groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    asked = keyed(d, probe_places(tau), tau, "id").join(ends.hint("shuffle_hash"), "key").filter("id <> lo OR id <> hi")
    ids = cut(asked.select(F.explode(F.array("id", "lo")).alias("id")).distinct(), "met")
    few = ids.count() <= BROADCAST_IDS
    # letters are counted over a join, not in the results of an aggregate, where a nested expression is run anew for each use
    return cut(d.join(F.broadcast(ids) if few else ids, "id", "left_semi").select("id", "line", "n", _letters(F.col("line")).alias("sig")), "mlines")


def _split_keys(key: Column, role: int, split: tuple[int, int]) -> Column:
    """Keys of a crowd's line: its old one and the counts of some groups of letters."""
    groups, some = split
    masks = [sum(15 << 4 * k for k in range(len(LETTERS)) if k % groups in chosen) for chosen in combinations(range(groups), some)]
    signed = lambda m: F.lit(m - (1 << 64) if m >> 63 else m).cast("long")
    return F.array(*[F.xxhash64(key, F.lit(role), F.lit(i), F.col("sig").bitwiseAND(signed(m))) for i, m in enumerate(masks)])


def _near(tau: int) -> Column:
    return F.expr(f"a <> b AND na <= nb AND {_letters_apart('sa', 'sb')} <= {2 * tau}")


def _sides(held: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    return held.select("key", F.col("id").alias("a"), F.col("sig").alias("sa"), F.col("n").alias("na")), asked.select("key", F.col("id").alias("b"), F.col("sig").alias("sb"), F.col("n").alias("nb"))


def _verified(lines: DataFrame, pairs: DataFrame, tau: int) -> DataFrame:
    """The pairs (a, b) of lines that are near, b the longer one, as (u, v)."""
    pairs = cut(pairs.select("a", "b").distinct(), "pairs")
    ids = cut(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct(), "ids")
    few = ids.count() <= BROADCAST_IDS
    texts = cut(lines.join(F.broadcast(ids) if few else ids, "id", "left_semi").select("id", "line"), "ltext")
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("line").alias("x")), "a").join(texts.select(F.col("id").alias("b"), F.col("line").alias("y")), "b")
    n = F.length("y")
    near = F.when(n >= CHARS * tau, within(F.col("x"), F.col("y"), tau))
    for e in range(tau - 1, 0, -1):
        near = near.when(n >= CHARS * e, within(F.col("x"), F.col("y"), e))
    return both.filter(near).select(F.col("a").alias("u"), F.col("b").alias("v"))


def _parted(rows: DataFrame, keys: DataFrame, few: bool) -> tuple[DataFrame, DataFrame]:
    """rows whose key is among keys, and the others."""
    k = F.broadcast(keys) if few else keys
    return rows.join(k, "key", "left_semi"), rows.join(k, "key", "left_anti")


def line_links(lines: DataFrame, tau: int = TAU, crowd: int = CROWD) -> DataFrame:
    """Links (u, v) of line ids whose components are those of all near pairs. lines: as named() makes them."""
    lines = met(lines, tau)
    held, asked = keyed(lines, index_places(tau), tau, "id", "n", "sig"), keyed(lines, probe_places(tau), tau, "id", "n", "sig")
    glance = held.filter(F.pmod(F.xxhash64("id"), F.lit(GLANCE)) == 0)
    crowds = glance.groupBy("key").count().filter(F.col("count") > max(crowd // GLANCE // 2, 0)) if crowd >= GLANCE else held.groupBy("key").count().filter(F.col("count") > crowd)
    links, last = None, (2 * tau + 4, 4)
    for split in ((2 * tau + 2, 2), last, None):
        crowds = cut(crowds.select("key"), "crowds") if split else None
        n = crowds.count() if split else 0
        some = _sides(held, asked)
        if n:
            few = n <= BROADCAST_IDS
            held, calm_held = _parted(held, crowds, few)
            asked, calm_asked = _parted(asked, crowds, few)
            some = _sides(calm_held, calm_asked)
        pairs = some[0].join(some[1], "key").filter(_near(tau) & F.expr("na < nb OR a < b"))
        links = _verified(lines, pairs, tau) if links is None else links.unionByName(_verified(lines, pairs, tau))
        if not n:
            break
        held, asked = cut(held, "held"), cut(asked, "asked")
        pivots = cut(held.groupBy("key").agg(F.min(F.struct("id", "n", "sig")).alias("p")).select("key", F.col("p.id").alias("a"), F.col("p.n").alias("na"), F.col("p.sig").alias("sa")), "pivots")
        with_pivot = asked.select("key", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb")).join(F.broadcast(pivots) if few else pivots, "key")
        stars = cut(_verified(lines, with_pivot.filter(_near(tau)), tau), "stars")
        links = links.unionByName(stars)
        tied = with_pivot.join(stars, (F.col("a") == F.col("u")) & (F.col("b") == F.col("v")), "left_semi").select("key", F.col("b").alias("id"))
        tied = cut(tied.unionByName(pivots.select("key", F.col("a").alias("id"))).distinct(), "tied")
        loose_held, loose_asked = cut(held.join(tied, ["key", "id"], "left_anti"), "loose"), cut(asked.join(tied, ["key", "id"], "left_anti"), "loose")
        again = lambda rows, role, others: rows.join(others.select("key").distinct(), "key", "left_semi").select(F.explode(_split_keys(F.col("key"), role, split)).alias("key"), "id", "n", "sig")
        # what is left to compare: loose lines of the index with all, tied ones with loose ones
        tied_held = held.join(tied, ["key", "id"], "left_semi")
        held, asked = again(loose_held, 0, loose_held).unionByName(again(tied_held, 1, loose_asked)), again(asked, 0, loose_held).unionByName(again(loose_asked, 1, loose_asked))
        if split != last:
            held, asked = cut(held, "held"), cut(asked, "asked")
            crowds = held.groupBy("key").count().filter(F.col("count") > crowd)
    return links


def _occurrences(docs: DataFrame, row: str | None) -> DataFrame:
    """(row, doc_id, pos, h): a scratch table of all lines, by digest; every document has a row of pos
    null, not a line, if its first part is blank."""
    doc = F.col("doc_id").cast("long").alias("doc_id")
    mark = F.col(row).alias("row") if row else F.monotonically_increasing_id().alias("row")
    named = _exploded(docs.select(mark, doc, "text"), F.col("row"), F.col("doc_id")).withColumn("h", F.when(F.col("line") != "", _key(F.col("line")))).drop("line")
    return cut(named.filter("h IS NOT NULL OR pos = 0").withColumn("pos", F.when(F.col("h").isNotNull(), F.col("pos"))), "lines")


def judged_lines(docs: DataFrame, row: str | None = None, tau: int = TAU) -> DataFrame:
    """(row, doc_id, pos, near, removed): a row for each line; near: it has a linked line of another text."""
    seen = _occurrences(docs, row)
    total = seen.count()
    texts = _exploded(docs).select("line").filter(F.length("line") >= CHARS).distinct()
    lines = named(texts)
    classes = components(line_links(lines, tau))
    keyed = lines.select("id", _key(F.col("line")).alias("h"))
    few = classes.count() <= BROADCAST_IDS
    member = keyed.join(F.broadcast(classes) if few else classes, keyed["id"] == classes["node"]).select("h", "component")
    heads = member.groupBy("component").agg(F.min("h").alias("class"), F.count("*").alias("lines"))
    member = attach(member, heads, "component", "lines", classes.count()).select("h", "class")
    counted = seen.filter("h IS NOT NULL").groupBy("h").agg(F.count("*").alias("n"), F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "row", "pos")).alias("first"))
    counted = cut(counted.join(member, "h", "left").withColumn("near", F.col("class").isNotNull()).withColumn("class", F.coalesce("class", "h")), "cls")
    firsts = counted.groupBy("class").agg(F.min("first").alias("head"), F.count("*").alias("_n"))
    labels = attach(counted.select("h", "n", "class", "near"), firsts, "class", "_n", total).select("h", "n", "near", "head")
    placed = attach(seen.filter("h IS NOT NULL"), labels, "h", "n", total)
    gone = ~((F.col("row") == F.col("head.row")) & (F.col("pos") == F.col("head.pos")))
    return placed.select("row", "doc_id", "pos", "near", gone.alias("removed")).unionByName(
        seen.filter("h IS NULL").select("row", "doc_id", "pos", F.lit(False).alias("near"), F.lit(False).alias("removed"))
    )


def _by_document(judged: DataFrame) -> DataFrame:
    places = F.sort_array(F.collect_list(F.when(F.col("removed"), F.col("pos"))))
    return judged.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.count("pos").alias("n_lines"), F.sum(F.col("near").cast("long")).alias("n_near"),
        F.sum(F.col("removed").cast("long")).alias("n_removed"), places.alias("places"),
    )


def line_report(docs: DataFrame, tau: int = TAU) -> DataFrame:
    """doc_id, n_lines, n_near, n_removed, removed (places of the lines that go, comma-joined, from 0)."""
    return _by_document(judged_lines(docs, None, tau)).select("doc_id", "n_lines", "n_near", "n_removed", F.array_join("places", ",").alias("removed"))


def drop_repeated_lines(docs: DataFrame, tau: int = TAU) -> DataFrame:
    """docs with the lines that go taken out of the texts; all columns are kept."""
    row, gone = fresh(docs, "_gw_row"), fresh(docs, "_gw_gone")
    marked = cut(docs.withColumn(row, F.monotonically_increasing_id()), "ldocs")
    found = _by_document(judged_lines(marked, row, tau)).select(F.col("row").alias(row), F.col("places").alias(gone))
    joined = marked.join(found, row)
    kept = F.filter(F.split(F.col("text"), "\n", -1), lambda x, i: ~F.array_contains(F.col(gone), i))
    return joined.withColumn("text", F.array_join(kept, "\n")).select(*docs.columns)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(read(spark, sf_dir, "documents"))
