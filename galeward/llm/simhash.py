"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints: A-Z lower-cased, words between white space, word shingles hashed with XXH64 (seed 42);
a bit is 1 if set in over half the hashes. Fingerprints within `radius` differing bits are linked.

Search: bits that go together are grouped into partitions; every partition gets a threshold of its
own (-1: not probed), and thresholds that sum to radius - partitions + 1 lose no link. Dynamic
programming picks them, and the number of partitions, by the candidates and probes they would cost:
pairs equal in a partition are counted over all fingerprints, pairs within 1 or 2 bits are estimated
from those and the bits' frequencies. Buckets are verified where they are read, and give a spanning
forest, not pairs. A bucket over BUCKET fingerprints is split by the same principle over the bits
left, again and again, so none is ever compared all against all and none is dropped.

Cases: null or wordless text has fingerprint 0 and links like any other; fewer words than a shingle
make one shingle; a null doc_id is a row like any other, its component's id is the least doc_id there
(null if there is none); repeated rows share a component; no rows in, no rows out; columns other than
doc_id and text are not read.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, components, cut, fresh, keep_listed, map_arrow, read, text_of

SHINGLE = 3
RADIUS = 2
BUCKET = 2048
PARTITIONS = (2, 3)
_ONE = np.uint64(1)


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """Of UTF-8 bytes; unsigned."""
    import xxhash

    words = text.lower().split()
    n = len(words) - width + 1
    if not words:
        return 0
    flat = b" ".join(words)
    if n <= 1:
        spans = [flat]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.r_[0, ends[: n - 1]].tolist()
        spans = [flat[a:b] for a, b in zip(starts, (ends[width - 1 :] - 1).tolist())]
    digest = xxhash.xxh64_intdigest
    total = np.zeros(64, np.int64)
    for k in range(0, len(spans), 65_536):
        h = np.fromiter((digest(s, 42) for s in spans[k : k + 65_536]), np.uint64)
        total += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(spans)).tobytes(), "big")


def fingerprint_column(text: Column, width: int = SHINGLE) -> Column:
    """Of a text column; a signed long."""

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(np.fromiter((fingerprint(t, width) for t in texts), np.uint64, len(texts)).view(np.int64))

    return run(text.cast("binary"))


def _bit_counts(prints: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and the 64 x 64 counts of bits set together. Bit 0 is the lowest."""

    def run(batches):
        n, both = 0, np.zeros((64, 64))
        for b in batches:
            fp = b.column(0).to_numpy().view(np.uint64)
            for k in range(0, len(fp), 100_000):
                x = ((fp[k : k + 100_000, None] >> np.arange(64, dtype=np.uint64)) & _ONE).astype(np.float32)
                both += x.T @ x
            n += len(fp)
        i, j = np.divmod(np.arange(4096), 64)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[i, -1]), pa.array(np.r_[j, -1]), pa.array(np.r_[both.ravel(), n])], names=["i", "j", "n"])

    rows = map_arrow(prints.select("fp"), run, "i long, j long, n double").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    both, n = np.zeros((64, 64)), 0
    for r in rows:
        if r.i < 0:
            n = int(r.n)
        else:
            both[r.i, r.j] = r.n
    return n, both


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in `parts` groups of near-equal size, each grown by the bit most correlated with it."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.clip(p * (1 - p), 1e-9, None))
    like = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd)
    left, out = set(range(64)), []
    for k in range(parts):
        size = 64 // parts + (k < 64 % parts)
        order = sorted(left)
        seed = max(order, key=lambda b: (like[b, order].sum(), -b))
        mine = [seed]
        left.discard(seed)
        while len(mine) < size:
            nxt = max(sorted(left), key=lambda b: (like[b, mine].sum(), -b))
            mine.append(nxt)
            left.discard(nxt)
        out.append(sorted(mine))
    return out


def _mask(bits: list[int]) -> int:
    """As a signed long."""
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >> 63 else m


def _within(bits: list[int], differ: np.ndarray, radius: int) -> list[float]:
    """Chance, for t = 0..radius, that at most t of the bits differ, were they independent."""
    row = np.zeros(radius + 1)
    row[0] = 1.0
    for b in bits:
        row[1:] = row[1:] * (1 - differ[b]) + row[:-1] * differ[b]
        row[0] *= 1 - differ[b]
    return np.cumsum(row).tolist()


def allocate(costs: list[list[float]], radius: int) -> tuple[float, list[int]]:
    """Thresholds of least total cost that sum to radius - partitions + 1; costs[i][t + 1] for t = -1..radius."""
    goal = radius - len(costs) + 1
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for used, (c, picks) in best.items():
            for t in range(-1, radius + 1):
                if (s := used + t) not in nxt or c + row[t + 1] < nxt[s][0]:
                    nxt[s] = (c + row[t + 1], [*picks, t])
        best = nxt
    return best[goal]


def plan(prints: DataFrame, radius: int = RADIUS) -> list[tuple[list[int], int]]:
    """The partitions to probe, as (bits, threshold)."""
    n, both = _bit_counts(prints)
    p = np.diag(both) / max(n, 1)
    differ = 2 * p * (1 - p)
    groups = {m: group_bits(n, both, m) for m in PARTITIONS}
    asked = [F.struct(F.lit(f"{m}.{k}").alias("part"), F.col("fp").bitwiseAND(F.lit(_mask(bits))).alias("v")) for m, gs in groups.items() for k, bits in enumerate(gs)]
    equal = {
        r.part: float(r.pairs)
        for r in prints.select(F.explode(F.array(*asked)).alias("x")).groupBy("x.part", "x.v").agg(F.count("*").alias("c"))
        .groupBy("part").agg(F.sum((F.col("c") * (F.col("c") - 1) / 2)).alias("pairs")).collect()
    }
    found = []
    for m, gs in groups.items():
        costs = []
        for k, bits in enumerate(gs):
            near = _within(bits, differ, radius)
            pairs = [equal.get(f"{m}.{k}", 0.0) * x / max(near[0], 1e-300) for x in near]
            probes = [float(n * sum(comb(len(bits), d) for d in range(t + 1))) for t in range(radius + 1)]
            costs.append([0.0, *(a + b for a, b in zip(pairs, probes))])
        found.append((*allocate(costs, radius), gs))
    _, picks, gs = min(found, key=lambda x: x[0])
    return [(bits, t) for bits, t in zip(gs, picks) if t >= 0]


def _buckets(prints: DataFrame, chosen: list[tuple[list[int], int]]) -> DataFrame:
    """(part, value, fp): every fingerprint under its own value and those within the threshold of it."""
    out = []
    for k, (bits, t) in enumerate(chosen):
        flips = [0, *(_mask(list(c)) for d in range(1, t + 1) for c in combinations(bits, d))]
        value = F.col("fp").bitwiseAND(F.lit(_mask(bits)))
        if len(flips) > 1:
            value = F.explode(F.transform(F.array(*[F.lit(f).cast("long") for f in flips]), lambda f, v=value: v.bitwiseXOR(f)))
        out.append(prints.select(F.lit(k).alias("part"), value.alias("value"), "fp"))
    made = out[0]
    for x in out[1:]:
        made = made.unionByName(x)
    return made


def forest(fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join each linked group among few fingerprints to its least one."""
    fp = np.unique(fp)
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= radius
    root = np.arange(len(fp))
    while True:
        low = np.where(near, root[None, :], len(fp)).min(1)
        low = low[low]
        if (low == root).all():
            break
        root = low
    moved = root != np.arange(len(fp))
    return fp[moved], fp[root[moved]]


def _verified(buckets: DataFrame, radius: int) -> DataFrame:
    """Edges (u, v) of buckets of at most some thousands of rows, read as sorted streams."""

    def run(batches):
        rest = None
        for b in batches:
            cols = [b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy().view(np.uint64)]
            if rest is not None:
                cols = [np.concatenate(x) for x in zip(rest, cols)]
            n = len(cols[0])
            if not n:
                continue
            heads = np.flatnonzero(np.r_[True, (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])])
            yield from edges(cols[2][: heads[-1]], heads)
            rest = [c[heads[-1] :] for c in cols]
        if rest is not None:
            yield from edges(rest[2], np.array([0, len(rest[2])]))

    def edges(fp, heads):
        size = np.diff(heads)
        two = heads[:-1][size == 2]
        a, b = fp[two], fp[two + 1]
        ok = (np.bitwise_count(a ^ b) <= radius) & (a != b)
        us, vs = [a[ok]], [b[ok]]
        for h, s in zip(heads[:-1][size > 2].tolist(), size[size > 2].tolist()):
            u, v = forest(fp[h : h + s], radius)
            us.append(u)
            vs.append(v)
        u, v = np.concatenate(us).view(np.int64), np.concatenate(vs).view(np.int64)
        if len(u):
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    parts = int(buckets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return map_arrow(buckets.repartition(parts, "part", "value").sortWithinPartitions("part", "value"), run, "u long, v long")


def links(prints: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """A forest (u, v) with the same components as all links among the distinct fingerprints (fp)."""
    chosen = plan(prints, radius)
    rows = _buckets(prints, chosen)
    bound = {k: set(bits) for k, (bits, _) in enumerate(chosen)}
    done, label = [], len(chosen)
    while True:
        sizes = rows.groupBy("part", "value").agg(F.count("*").alias("n"))
        large = cut(sizes.filter(F.col("n") > bucket), "big")
        if large.isEmpty():
            done.append(_verified(rows, radius))
            break
        small = rows.join(large.select("part", "value"), ["part", "value"], "left_anti")
        done.append(_verified(small, radius))
        inside = cut(rows.join(large.select("part", "value"), ["part", "value"], "left_semi"), "in")
        again, nxt = [], {}
        for (part,) in sorted(large.select("part").distinct().collect()):
            left = [b for b in range(64) if b not in bound[part]]
            mine = inside.filter(F.col("part") == part)
            if len(left) <= radius:  # a bucket holds no more than the few values of these bits and the flips
                done.append(_verified(mine, radius))
                continue
            for k in range(radius + 1):
                bits = left[k :: radius + 1]
                nxt[label] = bound[part] | set(bits)
                again.append(mine.select(F.lit(label).alias("part"), F.col("value").bitwiseOR(F.col("fp").bitwiseAND(F.lit(_mask(bits)))).alias("value"), "fp"))
                label += 1
        if not again:
            break
        rows, bound = again[0], nxt
        for x in again[1:]:
            rows = rows.unionByName(x)
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def simhash_components(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """rows (doc_id, fp) with component (its least fp) and component_id (its least doc_id)."""
    prints = cut(rows.groupBy("fp").agg(F.count("*").alias("copies"), F.min("doc_id").alias("least")), "ufp")
    total = rows.count()
    joined = components(links(prints, radius)).select(F.col("node").alias("fp"), "component")
    placed = cut(prints.join(joined, "fp", "left").withColumn("component", F.coalesce("component", "fp")), "comp")
    named = placed.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("_n"))
    labels = attach(placed.select("fp", "copies", "component"), named, "component", "_n", total)
    return attach(rows, labels, "fp", "copies", total)


def drop_near(docs: DataFrame, radius: int = RADIUS, width: int = SHINGLE) -> DataFrame:
    """One document of each component stays, that of the least doc_id (then fingerprint); all columns are kept."""
    fp = fresh(docs, "_gw_fp")
    marked = cut(docs.withColumn(fp, fingerprint_column(text_of(), width)), "near")
    found = simhash_components(marked.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(fp).alias("fp")), radius)
    stays = found.filter("doc_id <=> component_id").groupBy("component").agg(F.min(F.struct("fp", "doc_id")).alias("s"))
    return keep_listed(marked, stays.select("s.doc_id", F.col("s.fp").alias(fp)), ["doc_id", fp]).drop(fp)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    rows = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), fingerprint_column(text_of()).alias("fp")), "fp")
    found = simhash_components(rows)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, F.lit("0"))).alias("fingerprint"), "component_id")
