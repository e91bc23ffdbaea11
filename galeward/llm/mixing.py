"""Mixing sources to target weights by entropy balancing.

Targets: every source weighs 1, 2, 3, 1, ... in code-point order (null last); shares of all words by
weight, no source over CAP times its own words, the excess shared again by weight.

Balancing: among all rates that meet the token constraints, the one nearest to rate 1 (in
relative entropy, tokens as the measure) tilts a document's rate exponentially in the constraints it
falls under, rate = exp(sum of their multipliers). The multipliers minimise a convex dual. Constraints of one
column never share a document, so the dual's Hessian is diagonal within a column, and damped Newton steps
of all its multipliers are taken at once, each from its own row's tokens; columns take turns until none
moves. Tokens are summed by Spark over the cells (documents alike in all constraint columns), and multipliers
stay in tables: no matrix and no list of sources is ever on the driver. With the source as the only column, a rate is
target / words of its source.

Rounding: a document of rank k in its cell, largest first, gets the whole numbers between
k * rate and (k + 1) * rate as copies. Ranks are a distributed prefix sum, and neighbours in rank are alike in size,
so a cell's tokens miss its target by about one large document at most, and reruns agree.

Cases: null text has size 0; a null source is a source of its own; documents of size 0 take 0; a
source of no words has target 0; repeated rows are documents of their own; ties in size go by doc_id,
null last; no rows in, no rows out; the report reads only doc_id, text and source, and the filter repeats
rows with all their columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, attach, cut, fresh, read, running_offsets, text_of

CAP = 3.0
CYCLE = (1, 2, 3)
#: Rates are rounded to this many parts of 1, so that any engine rounds copies alike.
GRAIN = 10**9


def words_in(text: Column) -> Column:
    """Number of words, as long: positions where a word begins, counted without keeping the words."""
    bare = F.regexp_replace(text, f"[{BLANKS}]*([^{BLANKS}])[^{BLANKS}]*[{BLANKS}]*", "$1")
    return F.when(text.rlike(f"[^{BLANKS}]"), F.length(bare)).otherwise(0).cast("long")


def water_fill(sources: DataFrame, cap: float = CAP) -> DataFrame:
    """sources (mass, weight, ...) with `target`: the sum of all masses shared by weight, none over cap times its mass.

    The water level solves sum(least(cap * mass, weight * level)) = total, whose left side is concave, so Newton steps from
    below reach it exactly once the sources under it are settled. A step is one sum over the sources."""
    top = F.col("mass") * cap
    total, weights = sources.agg(F.sum("mass"), F.sum("weight")).first()
    level = total / weights if weights else 0.0
    while weights:
        under = top < F.col("weight") * F.lit(level)
        capped, open_ = sources.agg(F.coalesce(F.sum(F.when(under, top)), F.lit(0.0)), F.coalesce(F.sum(F.when(~under, F.col("weight"))), F.lit(0))).first()
        risen = (total - capped) / open_ if open_ else level
        if risen <= level:
            break
        level = risen
    return sources.withColumn("target", F.least(top, F.col("weight") * F.lit(level)))


def source_targets(sources: DataFrame) -> DataFrame:
    """sources (source, mass, docs) with weight and target. Weights go by place in code-point order, null last."""
    placed = running_offsets(sources.withColumns({"_all": F.lit(0), "_one": F.lit(1).cast("long")}), "_all", [F.col("source").asc_nulls_last()], "_one", "srank")
    weight = F.element_at(F.array(*map(F.lit, CYCLE)), (F.col("start") % len(CYCLE) + 1).cast("int"))
    return water_fill(cut(placed.withColumn("weight", weight).drop("start", "_all", "_one"), "weights"))


def _key(value: Column) -> Column:
    """A text that stands for the value, null too."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit(""))


def _newton(x: Column, mass: Column, goal: Column, steps: int = 60) -> Column:
    """The multiplier at which mass * exp(x) is goal, by damped Newton steps."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), x, lambda at, _: at - F.greatest(F.lit(-2.0), 1 - goal / (mass * F.exp(at))))


def solve(cells: DataFrame, goals: dict[str, DataFrame], rounds: int = 60, tolerance: float = 1e-12) -> dict[str, DataFrame]:
    """Multipliers as tables (key, x) by column. cells: the constraint columns and `mass`, tokens of each cell.
    goals: by column a table (value, goal); goals of 0 get no multiplier."""
    cells = cells.filter("mass > 0").select("mass", *[_key(F.col(c)).alias(c) for c in goals])
    found = {c: t.filter("goal > 0").select(_key(F.col("value")).alias("key"), "goal", F.lit(0.0).alias("x")) for c, t in goals.items()}
    several = len(goals) > 1  # columns that act on each other take turns; one alone is settled by its own steps
    cells = cut(cells, "cells") if several else cells
    for _ in range(rounds):
        far = 0.0
        for c in goals:
            rated, mass = cells, F.col("mass")
            for other in goals:
                if other != c:
                    rated = rated.join(found[other].select(F.col("key").alias(other), F.col("x").alias(f"_{other}")), other)
                    mass = mass * F.exp(F.col(f"_{other}"))
            sums = rated.groupBy(F.col(c).alias("key")).agg(F.sum(mass).cast("double").alias("m"))
            moved = found[c].join(sums, "key").select("key", "goal", _newton(F.col("x"), F.col("m"), F.col("goal")).alias("x"), F.abs(F.col("m") * F.exp("x") / F.col("goal") - 1).alias("far"))
            if several:
                moved = cut(moved, "dual")
                far = max(far, moved.agg(F.max("far")).first()[0] or 0.0)
            found[c] = moved.drop("far")
        if far < tolerance:
            break
    return {c: t.select("key", "x") for c, t in found.items()}


def mix(docs: DataFrame, extra: list[str] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken, and the `extra` columns, a row for each document."""
    d = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words_in(text_of()).alias("size"), *extra), "mix")
    sources = source_targets(cut(d.groupBy("source").agg(F.sum("size").alias("mass"), F.count("*").alias("docs")), "sources"))
    tilt = solve(sources.select("source", "mass"), {"source": sources.select(F.col("source").alias("value"), F.col("target").alias("goal"))})["source"]
    keyed = sources.withColumn("key", _key(F.col("source"))).join(tilt, "key", "left")
    rate = F.coalesce(F.round(F.least(F.exp("x"), F.lit(CAP)) * GRAIN).cast("long"), F.lit(0).cast("long"))
    rates = cut(keyed.select("key", F.col("mass").alias("source_size"), "target", rate.alias("_rate"), "docs"), "rates")
    ranked = running_offsets(d.withColumn("_one", F.lit(1).cast("long")), "source", [F.col("size").desc(), F.col("doc_id").asc_nulls_last()], "_one", "rank")
    rated = attach(ranked.withColumn("key", _key(F.col("source"))), rates, "key", "docs", int(rates.agg(F.sum("docs")).first()[0] or 0))
    whole = "CAST(({k}) AS DECIMAL(19,0)) * CAST(_rate AS DECIMAL(12,0)) DIV CAST({g} AS DECIMAL(12,0))"
    copies = F.expr(whole.format(k="start + 1", g=GRAIN)) - F.expr(whole.format(k="start", g=GRAIN))
    return rated.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), *extra)


def mix_report(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def repeat_mixed(docs: DataFrame) -> DataFrame:
    """Each document as often as the mix takes it, with all its columns."""
    row = fresh(docs, "_gw_row")
    marked = cut(docs.withColumn(row, F.monotonically_increasing_id()), "mixin")
    taken = mix(marked, [row]).filter("copies > 0").select(row, "copies")
    n = fresh(docs, "_gw_copies")
    joined = marked.join(taken.withColumnRenamed("copies", n), row)
    return joined.withColumn(n, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n)))).select(*docs.columns)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(read(spark, sf_dir, "documents"))


OP5_SQL = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^{BLANKS}]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, 1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 AS weight FROM s),
f AS (  -- sources by the level at which they reach their cap
  SELECT *, 3.0::DOUBLE * source_size AS top, 3.0::DOUBLE * source_size / weight AS level,
         sum(source_size) OVER () AS total, row_number() OVER (ORDER BY 3.0::DOUBLE * source_size / weight, source) AS place,
         coalesce(sum(3.0::DOUBLE * source_size) OVER before, 0) AS capped,
         sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS open_weight
  FROM w WINDOW before AS (ORDER BY 3.0::DOUBLE * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
u AS (SELECT coalesce(arg_min((total - capped) / open_weight, place) FILTER ((total - capped) / open_weight <= level), 0)::DOUBLE AS unit FROM f),
g AS (SELECT f.source, source_size, least(top, weight * unit)::DOUBLE AS target FROM f, u),
r AS (SELECT *, CASE WHEN source_size > 0 AND target > 0 THEN round(least(target / source_size, 3) * {GRAIN})::HUGEINT ELSE 0 END AS rate FROM g),
k AS (
  SELECT d.doc_id, d.size, r.source_size, r.target, r.rate,
         row_number() OVER (PARTITION BY d.source ORDER BY d.size DESC, d.doc_id) AS n
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target,
       (((n * rate) // {GRAIN} - ((n - 1) * rate) // {GRAIN}) * size)::BIGINT AS taken
FROM k
"""
