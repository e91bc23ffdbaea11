"""Shared plumbing of the text operators: scratch tables, skew-safe lookups, offsets, components."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from galeward.sources.scratch import LOCAL_SCRATCH, cut, release, scratch_root  # noqa: F401

#: The white space of every contract, as the inside of a regular-expression class.
BLANKS = r"\x20\x09-\x0D"
#: A key is hot when it holds over 1/HOT_SHARE of all rows, so there are fewer than HOT_SHARE hot keys.
HOT_SHARE = 1000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def give_back() -> None:
    """Return freed memory to the system: Python workers wait for their next task with what they once held."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow(run, schema), whose workers give memory back when a task ends, and before it begins what
    other tasks have left."""

    def whole(batches):
        give_back()
        yield from run(batches)
        give_back()

    return df.mapInArrow(whole, schema)


def slices(batch, column: str, limit: int = 4 << 20):
    """Parts of an Arrow batch whose binary `column` holds about `limit` bytes each, so that what is made of
    a part stays small whatever the batch size is."""
    import numpy as np

    col = batch.column(batch.schema.get_field_index(column))
    if not len(col):
        return
    size = np.diff(np.frombuffer(col.buffers()[1], np.int32, len(col) + 1, 4 * col.offset))
    group = np.cumsum(size, dtype=np.int64) // limit
    heads = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), len(col)]
    for i, j in zip(heads, heads[1:]):
        yield batch.slice(i, j - i)


def fresh(df: DataFrame, name: str) -> str:
    """name, lengthened until it clashes with no column of df (case-blind, as Spark resolves names)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_of(col: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def attach(left: DataFrame, right: DataFrame, key: str, size: str, total: int, how: str = "inner") -> DataFrame:
    """left joined with right on a never-null key that is unique in right.

    `size` (a column of right, dropped here) says how many rows of left bear the key. Keys over
    total / HOT_SHARE rows number under HOT_SHARE, so they are broadcast; the rest is a shuffle join
    in which no key is hot. No row is lost either way."""
    limit = max(1000, total // HOT_SHARE)
    hot = right.filter(F.col(size) > limit).drop(size)
    cold = right.filter(F.col(size) <= limit).drop(size)
    if hot.isEmpty():
        return left.join(cold, key, how)
    hot = F.broadcast(hot)
    return left.join(hot, key).unionByName(left.join(hot.select(key), key, "left_anti").join(cold, key, how))


def running_offsets(df: DataFrame, group: str, order: Sequence[Column], size: str, tag: str = "off") -> DataFrame:
    """df with `start`: the sum of `size` over the rows of its group that come earlier by `order`.

    A distributed prefix sum: rows are range-partitioned by (group, order), each task sums within
    its range, and the totals of groups that span ranges are summed over the ranges. One group
    may span any number of ranges, so a hot group is not gathered; what is broadcast are the groups that
    span ranges, two for each range at most, however many groups there are. Ties are in any one order,
    fixed by the scratch table. Columns _part, _local are used inside."""
    import numpy as np
    import pyarrow as pa
    from pyspark.sql import Window

    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(group).asc_nulls_last(), *order]
    ranged = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id())
    schema = T.StructType([*ranged.schema.fields, T.StructField("_local", T.LongType())])

    def local(batches):
        carry, last = 0, ()
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            g = b.column(b.schema.get_field_index(group)).dictionary_encode()
            code = g.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            s = b.column(b.schema.get_field_index(size)).to_numpy(zero_copy_only=False).astype(np.int64)
            before = np.cumsum(s) - s
            heads = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            names = [None if code[h] < 0 else g.dictionary[int(code[h])].as_py() for h in heads]
            base = np.repeat(before[heads], np.diff(np.r_[heads, n]))
            out = before - base
            if last == (names[0],):
                end = heads[1] if len(heads) > 1 else n
                out[:end] += carry
            last, carry = (names[-1],), int(out[-1] + s[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], names=[*b.schema.names, "_local"])

    laid = cut(map_arrow(ranged, local, schema), tag)
    totals = laid.groupBy("_part", group).agg(F.sum(size).alias("_sum"))
    within = Window.partitionBy(group)
    before = within.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(F.col("_part").alias("_p"), F.col(group).alias("_g"), F.sum("_sum").over(before).alias("_base"), F.count("*").over(within).alias("_k")).filter("_k > 1").drop("_k")
    joined = laid.join(F.broadcast(bases), (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_g")), "left")
    return joined.withColumn("start", F.col("_local") + F.coalesce("_base", F.lit(0))).drop("_part", "_local", "_p", "_g", "_base")


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One round of star contraction over edges (u, v): every node's partners move to its least one."""
    if small:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    else:
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    both = near.join(least, "u")
    if small:
        moved = both.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    else:
        moved = both.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.filter("u <> v").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node of the edges (u, v), component the least node reachable.

    Alternating large-star and small-star contraction, each round cut into a scratch table; only a
    count and two sums reach the driver. Ends when a round changes nothing."""
    state, edges = None, cut(edges.filter("u <> v").select("u", "v").distinct(), "cc")
    for _ in range(rounds):
        last, edges = edges, cut(_star(_star(edges, False), True), "cc")
        release(last)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    leaves = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def keep_listed(docs: DataFrame, listed: DataFrame, on: Sequence[str]) -> DataFrame:
    """The rows of docs whose `on` columns (nulls alike) are listed; of rows alike in them, one stays."""
    names = {c: fresh(docs, f"_gw_k{i}") for i, c in enumerate(on)}
    n = fresh(docs, "_gw_n")
    cond = [F.col(c).eqNullSafe(F.col(k)) for c, k in names.items()]
    keys = lambda df: df.select(*[F.col(c).alias(k) for c, k in names.items()])
    twice = docs.groupBy(*on).agg(F.count("*").alias(n)).filter(F.col(n) > 1)
    kept = docs.join(keys(listed), cond, "left_semi")
    if twice.isEmpty():
        return kept
    return kept.join(keys(twice), cond, "left_anti").unionByName(kept.join(keys(twice), cond, "left_semi").dropDuplicates(list(on)))
