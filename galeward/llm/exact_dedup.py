"""Exact de-duplication against a minimal perfect hash over the digests already seen.

Texts are equal when identical after their white space is deleted. The digests of the older
documents are hashed without collisions: each shard of digests gets a cascade of bit arrays
whose ranks number its digests from 0, and the slot of that number holds the full 32-byte digest
with the locator of the winner (row, document, code points, copies). A newer digest asks its shard
for a slot and is a repeat only if all 32 bytes there agree; digests that are no members group among
themselves. Shards hold about SHARD digests of the older part and of the newer one, whatever the input and whichever is
larger, so they bound a task's memory.

Cases: null text is empty; empty texts are equal to each other; null doc_id is a document like any
other and wins only over none; repeated rows are rows of one group of which one is kept; no rows in,
no rows out; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, attach, cut, fresh, keep_listed, read, text_of

#: Digests in a shard of the index, on average.
SHARD = 32_768
#: Bits for each key that is left, at each level of the cascade.
GAMMA = 2.0
LEVELS = 40


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _spot(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
    seed = np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    return (_mix(keys[:, level % 4] + seed) % np.uint64(bits)).astype(np.int64)


def build_cascade(keys: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Bit counts of the levels, and all levels' bits as one array. keys: distinct, n x 4 words."""
    sizes, levels, left = [], [], keys
    while len(left):
        if len(sizes) == LEVELS:
            raise ValueError("digests are not distinct")
        bits = max(8, int(GAMMA * len(left)))
        at = _spot(left, len(sizes), bits)
        alone = np.bincount(at, minlength=bits) == 1
        sizes.append(bits)
        levels.append(alone)
        left = left[~alone[at]]
    return sizes, np.concatenate(levels) if levels else np.zeros(0, bool)


def slots_of(keys: np.ndarray, sizes: list[int], bits: np.ndarray) -> np.ndarray:
    """Slot of each key, -1 where no level has it. A key that was not built in may get any slot."""
    rank = np.cumsum(bits) - 1
    slot, base = np.full(len(keys), -1, np.int64), 0
    for level, n in enumerate(sizes):
        open_ = np.flatnonzero(slot < 0)
        if not len(open_):
            break
        at = _spot(keys[open_], level, n) + base
        hit = bits[at]
        slot[open_[hit]] = rank[at[hit]]
        base += n
    return slot


def _words(digests: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(digests.to_pylist()), "<u8").reshape(-1, 4)


def _build_shard(table: pa.Table) -> pa.Table:
    table = table.combine_chunks()
    keys = _words(table["digest"])
    sizes, bits = build_cascade(keys)
    order = np.argsort(slots_of(keys, sizes, bits))
    kept = {c: table[c].take(pa.array(order)).to_pylist() for c in ("doc_id", "row", "points", "copies")}
    one = {"shard": [table["shard"][0].as_py()], "levels": [sizes], "bits": [np.packbits(bits).tobytes()], "digests": [keys[order].tobytes()]}
    return pa.table(one | {k: [v] for k, v in kept.items()}, schema=_INDEX)


_INDEX = pa.schema([
    ("shard", pa.int64()), ("levels", pa.list_(pa.int64())), ("bits", pa.binary()), ("digests", pa.binary()),
    ("doc_id", pa.list_(pa.int64())), ("row", pa.list_(pa.int64())), ("points", pa.list_(pa.int64())), ("copies", pa.list_(pa.int64())),
])
INDEX = "shard long, levels array<long>, bits binary, digests binary, doc_id array<long>, row array<long>, points array<long>, copies array<long>"


def _probe(asked: pa.Table, index: pa.Table) -> pa.Table:
    out = asked.select(["digest"])
    n, names = asked.num_rows, ("doc_id", "row", "points", "copies")
    if not n or not index.num_rows:
        return pa.table({"digest": out["digest"], "member": pa.array([False] * n, pa.bool_())} | {f"old_{c}": pa.nulls(n, pa.int64()) for c in names})
    keys, row = _words(asked["digest"]), index.to_pylist()[0]
    sizes = row["levels"]
    bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8))[: sum(sizes)].astype(bool)
    slot = slots_of(keys, sizes, bits)
    held = np.frombuffer(row["digests"], "<u8").reshape(-1, 4)
    member = (slot >= 0) & (held[slot] == keys).all(1)
    take = pa.array(slot, mask=~member)
    return pa.table({"digest": out["digest"], "member": pa.array(member)} | {f"old_{c}": pa.array(row[c], pa.int64()).take(take) for c in names})


def digests(docs: DataFrame) -> DataFrame:
    """(row, doc_id, digest, points): a scratch table with a row number, the 32-byte digest of the
    normalised text and the code points of the text itself. The only pass over the texts."""
    bare = F.regexp_replace(text_of(), f"[{BLANKS}]+", "")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(bare.cast("binary"), 256)).alias("digest"), F.length(text_of()).cast("long").alias("points"))
    return cut(d.withColumn("row", F.monotonically_increasing_id()), "dig")


def _best(rows: DataFrame) -> DataFrame:
    """By digest: the row that stays (most code points, then smallest doc_id, then row) and the copies."""
    first = F.max(F.struct("points", F.col("doc_id").isNotNull().alias("known"), F.bitwise_not("doc_id").alias("id"), F.bitwise_not("row").alias("row")))
    return (
        rows.groupBy("digest").agg(first.alias("b"), F.count("*").alias("copies"))
        .select("digest", F.bitwise_not("b.id").alias("doc_id"), F.bitwise_not("b.row").alias("row"), F.col("b.points").alias("points"), "copies")
    )


def build_index(seen: DataFrame, asked: int = 0) -> DataFrame:
    """The index over the distinct digests of seen (doc_id, row, points, copies by digest), in shards for `asked`
    digests to be looked up."""
    shards = max(1, -(-max(seen.count(), asked) // SHARD))
    placed = seen.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards)))
    return cut(placed.groupBy("shard").applyInArrow(_build_shard, INDEX), "mph").withColumn("shards", F.lit(shards))


def lookup(index: DataFrame, asked: DataFrame, shards: int) -> DataFrame:
    """asked (distinct digests) with `member` and the old_ columns of the slot that holds its very bytes."""
    placed = asked.select("digest", F.pmod(F.xxhash64("digest"), F.lit(shards)).alias("shard"))
    schema = "digest binary, member boolean, old_doc_id long, old_row long, old_points long, old_copies long"
    return placed.groupBy("shard").cogroup(index.drop("shards").groupBy("shard")).applyInArrow(_probe, schema)


def exact_groups(docs: DataFrame) -> DataFrame:
    """Every document with its group: row, doc_id, digest, points, keep_id, keep_row, group_size.

    The older half of the ids (up to their median) is the history; what follows it is looked up in its index."""
    d = digests(docs)
    until, total = d.agg(F.percentile_approx("doc_id", 0.5), F.count("*")).first()
    older = F.coalesce(F.col("doc_id") <= (until or 0), F.lit(False))
    seen = cut(_best(d.filter(older)), "seen")
    asked = cut(_best(d.filter(~older)), "asked")
    index = build_index(seen, asked.count())
    shards = index.select("shards").first()
    # without history there is no index, and none of the newer ones is a member
    shards = shards["shards"] if shards else max(1, -(-asked.count() // SHARD))
    found = cut(lookup(index, asked, shards).join(asked, "digest"), "found")
    late = found.filter("member").select("digest", F.struct("points", F.col("doc_id").isNotNull().alias("known"), F.bitwise_not("doc_id").alias("id"), F.bitwise_not("row").alias("row")).alias("b"), F.col("copies").alias("more"))
    mine = F.struct("points", F.col("doc_id").isNotNull().alias("known"), F.bitwise_not("doc_id").alias("id"), F.bitwise_not("row").alias("row"))
    won = F.greatest(mine, F.col("b"))
    members = (
        seen.join(late, "digest", "left").withColumn("w", won)
        .select("digest", F.bitwise_not("w.id").alias("keep_id"), F.bitwise_not("w.row").alias("keep_row"), (F.col("copies") + F.coalesce("more", F.lit(0))).alias("group_size"))
    )
    others = found.filter("not member").select("digest", F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"), F.col("copies").alias("group_size"))
    groups = cut(members.unionByName(others), "grp")
    return attach(d, groups.withColumn("_size", F.col("group_size")), "digest", "_size", total)


def exact_dedup_report(docs: DataFrame) -> DataFrame:
    return exact_groups(docs).select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def drop_exact(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns."""
    kept = exact_groups(docs).filter("row = keep_row").select("doc_id", "digest", "points")
    bare = F.regexp_replace(text_of(), f"[{BLANKS}]+", "")
    digest, points = fresh(docs, "_gw_digest"), fresh(docs, "_gw_points")
    marked = docs.withColumns({digest: F.unhex(F.sha2(bare.cast("binary"), 256)), points: F.length(text_of()).cast("long")})
    named = kept.select("doc_id", F.col("digest").alias(digest), F.col("points").alias(points))
    return keep_listed(marked, named, ["doc_id", digest, points]).drop(digest, points)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup_report(read(spark, sf_dir, "documents"))


OP9_SQL = """
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS kept,
       text_sha256
FROM t
"""
