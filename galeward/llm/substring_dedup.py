"""Repeated substrings by difference-cover suffix sorting, distributed by content.

A byte goes when it lies in a string of WIDTH bytes that starts anywhere else as well. Sorting all suffixes of
all texts would move some twenty times the input, so starts that cannot repeat are first set aside,
exactly: every window of WIDTH bytes is served by its anchor, the first of its GRAM-byte strings of
least hash. Equal windows have equal anchors, so windows of an anchor that occurs once are unique, and
all windows that can be equal meet under one anchor. The windows that an anchor serves in a text form
its context; contexts that are the same bytes throughout repeat, whole. What is left, one of each
distinct context of an anchor with several, is gathered by anchor; a task joins whole anchors' contexts
to strings of at most SORT bytes and builds their suffix arrays by the difference-cover algorithm: sort
the triples at places 1 and 2 modulo 3, recurse on their names while two are alike, sort the remaining
suffixes by letter and rank, merge, and compare the first WIDTH bytes of neighbours.

An anchor whose distinct contexts exceed SORT bytes is not gathered: its windows go as rows of 128-bit
digests and are counted. No window is left out either way.

Cases: null text is empty; texts under WIDTH bytes lose nothing; texts alike get like results, and lose
all bytes if they have WIDTH; strings never cross documents; repeated rows and null doc_ids are documents
like others; no rows in, no rows out; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, cut, map_arrow, read, slices, text_of

WIDTH = 400
GRAM = 100
#: Bytes of contexts in a suffix array; its triples' names must fit 21 bits.
SORT = 2_000_000
#: Bits of the filter that keeps texts that are not needed from a shuffle: 16 MB, whatever the input.
FILTER_BITS = 1 << 27
#: Bytes of a text hashed at a time.
PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


_tables: dict = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _tables or len(_tables["up"]) < n:
        size = 1 << max(n - 1, 1).bit_length()
        _tables["up"], _tables["down"] = _powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size)
    return _tables["up"], _tables["down"]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def gram_hashes(b: np.ndarray, gram: int) -> np.ndarray:
    up, down = _power_tables(len(b) + 1)
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], out=sums[1:])
    return _mixed((sums[gram:] - sums[:-gram]) * down[: len(b) - gram + 1])


def _anchors_of(b: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of b: place and hash of its anchor."""
    h = gram_hashes(b, gram)
    span = width - gram + 1
    # least hash (its upper bits), then first place; both are the same in equal windows
    key = (h >> np.uint64(24) << np.uint64(24)) | np.arange(len(h), dtype=np.uint64)
    blocks = np.concatenate([key, np.full(-len(key) % span, _TOP)]).reshape(-1, span)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    n = len(h) - span + 1
    at = (np.minimum(behind[:n], ahead[span - 1 : span - 1 + n]) & np.uint64(0xFFFFFF)).astype(np.int64)
    return at, h[at]


def contexts(text: bytes, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a text: anchor hash, first start, last start, and digest of the bytes, for each context."""
    import xxhash

    n = len(text)
    if n < width:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    b = np.frombuffer(text, np.uint8)
    at, h = [], []
    for k in range(0, n - width + 1, PIECE):  # windows that start in k..k+PIECE
        a, x = _anchors_of(b[k : k + PIECE + width - 1], width, gram)
        at.append(a + k)
        h.append(x)
    at, h = np.concatenate(at), np.concatenate(h)
    low = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    high = np.r_[low[1:] - 1, len(at) - 1]
    digest = xxhash.xxh3_64_intdigest
    same = np.fromiter((digest(text[i : j + width]) for i, j in zip(low.tolist(), high.tolist())), np.uint64, len(low))
    return h[low].view(np.int64), low, high, same.view(np.int64)


# --- the difference-cover suffix array -------------------------------------------------------------


def _named(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """Places of the keys among the distinct ones, from 0, and how many there are."""
    order = np.argsort(keys)
    keys = keys[order]
    step = np.zeros(len(keys), np.int32)
    step[1:] = keys[1:] != keys[:-1]
    np.cumsum(step, out=step)
    names = np.empty(len(keys), np.int32)
    names[order] = step
    return names, int(step[-1]) + 1


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Order of the suffixes of s, whose letters are 1 to 2^21 - 1 and less. Places and ranks are of 32
    bits, and keys are dropped before the recursion, so a level keeps about ten bytes for a letter."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int32)
    t = np.zeros(n + 4, np.uint32)
    t[:n] = s
    wide = lambda i: t[i].astype(np.uint64)
    # an empty triple behind the first half parts the halves where they would run into each other
    sampled = np.concatenate([np.arange(1, n + (n % 3 == 1), 3, dtype=np.int32), np.arange(2, n, 3, dtype=np.int32)])
    size = np.uint64(int(t.max()) + 1)
    names, count = _named((wide(sampled) * size + wide(sampled + 1)) * size + wide(sampled + 2))
    if count < len(sampled):
        names += 1
        order = suffix_array(names)
        names[order] = np.arange(len(sampled), dtype=np.int32)
    else:
        order = np.argsort(names).astype(np.int32)
    rank = np.zeros(n + 4, np.uint32)
    rank[sampled] = names + 1
    rank[n:] = 0
    behind = lambda i: rank[i].astype(np.uint64)
    span = np.uint64(len(sampled) + 2)
    in_order = sampled[order]
    in_order = in_order[in_order < n]
    del names, order, sampled
    rest = np.arange(0, n, 3, dtype=np.int32)
    key = wide(rest) * span + behind(rest + 1)
    o = np.argsort(key, kind="stable")
    rest, key = rest[o], key[o]
    first, second = in_order[in_order % 3 == 1], in_order[in_order % 3 == 2]
    place = np.searchsorted(wide(first) * span + behind(first + 1), key)
    pair = lambda i: (wide(i) * size + wide(i + 1)) * span + behind(i + 2)
    place += np.searchsorted(pair(second), pair(rest)) + np.arange(len(rest))
    out = np.empty(n, np.int32)
    out[place] = rest
    free = np.ones(n, bool)
    free[place] = False
    out[free] = in_order
    return out


def repeated_starts(parts: list[bytes], width: int) -> list[np.ndarray]:
    """For each part, the starts of its windows that are equal to another window of any part."""
    size = np.array([len(p) for p in parts])
    data = np.frombuffer(b"\x00".join(parts) + bytes(8), np.uint8)[: int(size.sum()) + len(parts)]
    ends = np.cumsum(size + 1) - 1
    letters = data.astype(np.uint16) + np.uint16(2)
    letters[ends[:-1]] = 1  # parts are parted by a letter of its own
    letters = letters[: ends[-1]]
    begins = ends - size
    valid = np.zeros(len(letters) + 1, bool)
    for a, n in zip(begins.tolist(), size.tolist()):
        valid[a : a + n - width + 1] = True
    order = suffix_array(letters)
    order = order[valid[order]]
    a, b = order[:-1], order[1:]
    buffer = np.ascontiguousarray(np.concatenate([data, np.zeros(8, np.uint8)]))
    word = np.ndarray((len(buffer) - 7,), "<u8", buffer, strides=(1,))
    at = np.arange(len(a))
    for k in [*range(0, width - 7, 8), max(width - 8, 0)]:
        same = word[a[at] + k] == word[b[at] + k]
        at = at[same]
    hit = np.zeros(len(letters) + 1, bool)
    hit[a[at]] = hit[b[at]] = True
    return [np.flatnonzero(hit[i : i + n]) for i, n in zip(begins.tolist(), size.tolist())]


def _runs(starts: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Bytes covered by windows at sorted starts, as maximal runs."""
    if not len(starts):
        return []
    new = np.r_[True, starts[1:] > starts[:-1] + width]
    return list(zip(starts[new].tolist(), (np.r_[starts[:-1][new[1:]], starts[-1]] + width).tolist()))


# --- on the cluster --------------------------------------------------------------------------------


def text_key(text) -> F.Column:
    return F.unhex(F.md5(text.cast("binary")))


def _scan(docs: DataFrame, width: int, gram: int) -> DataFrame:
    """A scratch table: row, doc_id, key (of the text), n_bytes, sha, and the contexts' arrays."""

    def run(batches):
        for b in (x for batch in batches for x in slices(batch, "text")):
            found = [contexts(t, width, gram) for t in b.column(b.schema.get_field_index("text")).to_pylist()]
            cols = [b.column(b.schema.get_field_index(c)) for c in ("doc_id", "key", "n_bytes", "sha")]
            lists = [pa.array([f[k] for f in found], pa.list_(pa.int64())) for k in range(4)]
            yield pa.RecordBatch.from_arrays([*cols, *lists], names=["doc_id", "key", "n_bytes", "sha", "anchor", "low", "high", "same"])

    text = text_of()
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(text).alias("key"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text.cast("binary"), 256).alias("sha"), text.cast("binary").alias("text"))
    made = map_arrow(d, run, "doc_id long, key binary, n_bytes long, sha string, anchor array<long>, low array<long>, high array<long>, same array<long>")
    return cut(made.withColumn("row", F.monotonically_increasing_id()), "anchors")


def _filter(keys: DataFrame):
    """A Bloom filter over keys as a broadcast bit array; built from each task's bits, by position."""

    def run(batches):
        bits = np.zeros(FILTER_BITS // 8, np.uint8)
        for b in batches:
            for k in _bits(b.column(0).to_pylist()):
                np.bitwise_or.at(bits, k >> 3, np.left_shift(1, k & 7).astype(np.uint8))
        at = np.flatnonzero(bits)
        yield pa.RecordBatch.from_arrays([pa.array((at >> 16).astype(np.int32)), pa.array((at & 0xFFFF).astype(np.int32)), pa.array(bits[at].astype(np.int32))], names=["block", "at", "bits"])

    def block(table: pa.Table) -> pa.Table:
        out = np.zeros(1 << 16, np.uint8)
        np.bitwise_or.at(out, table["at"].to_numpy(), table["bits"].to_numpy().astype(np.uint8))
        return pa.table({"block": [table["block"][0].as_py()], "bits": pa.array([out.tobytes()], pa.binary())}, schema=pa.schema([("block", pa.int32()), ("bits", pa.binary())]))

    made = map_arrow(keys.select("key"), run, "block int, at int, bits int")
    rows = made.groupBy("block", "at").agg(F.bit_or("bits").alias("bits")).groupBy("block").applyInArrow(block, "block int, bits binary").collect()
    held = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in rows:
        held[r["block"] << 16 : (r["block"] + 1) << 16] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return keys.sparkSession.sparkContext.broadcast(held)


def _bits(keys: list[bytes]) -> tuple[np.ndarray, ...]:
    w = np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)
    return tuple(((w[:, 0] + np.uint64(k) * w[:, 1]) % np.uint64(FILTER_BITS)).astype(np.int64) for k in range(4))


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (distinct `key` and more) with the `text` of each key; few other texts enter the shuffle."""
    held = _filter(wanted)

    def run(batches):
        for b in (x for batch in batches for x in slices(batch, "text")):
            keys = b.column(0).to_pylist()
            ok = np.ones(len(keys), bool)
            for k in _bits(keys):
                ok &= (held.value[k >> 3] >> (k & 7).astype(np.uint8)) & 1 == 1
            if ok.any():
                yield b.filter(pa.array(ok))

    text = text_of()
    d = map_arrow(docs.select(text_key(text).alias("key"), text.cast("binary").alias("text")), run, "key binary, text binary")
    return wanted.join(d.dropDuplicates(["key"]), "key")


def _sorted_spans(parts: DataFrame, width: int, limit: int) -> DataFrame:
    """(row, start, end) of repeats among the contexts (anchor, row, low, alone, bytes), sorted by anchor."""

    def settle(group):
        if len(group) < 2:
            return None
        out = []
        for (row, low, alone, _), starts in zip(group, repeated_starts([g[3] for g in group], width)):
            if alone:
                out += [(row, low + a, low + b) for a, b in _runs(starts, width)]
        if out:
            r, s, e = zip(*out)
            return pa.RecordBatch.from_arrays([pa.array(r, pa.int64()), pa.array(s, pa.int64()), pa.array(e, pa.int64())], names=["row", "start", "end"])
        return None

    def run(batches):
        held, size, mine, last = [], 0, [], None
        for b in batches:
            for anchor, row, low, alone, part in zip(*(c.to_pylist() for c in b.columns)):
                if anchor != last:
                    own = sum(len(p[3]) + 1 for p in mine)
                    if size + own > limit and held:
                        if (x := settle(held)) is not None:
                            yield x
                        held, size = [], 0
                    held, size, mine, last = held + mine, size + own, [], anchor
                mine.append((row, low, alone, part))
        own = sum(len(p[3]) + 1 for p in mine)
        groups = [held + mine] if size + own <= limit else [held, mine]
        for g in groups:
            if (x := settle(g)) is not None:
                yield x

    n = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return map_arrow(parts.repartition(n, "anchor").sortWithinPartitions("anchor"), run, "row long, start long, end long")


def _counted_spans(parts: DataFrame, width: int) -> DataFrame:
    """The same for anchors too large to gather: windows counted by digest."""

    def run(batches):
        import xxhash

        for b in batches:
            for row, low, alone, part in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("row", "low", "alone", "bytes"))):
                h = [xxhash.xxh3_128_digest(part[i : i + width]) for i in range(len(part) - width + 1)]
                n = len(h)
                yield pa.RecordBatch.from_arrays([pa.array(h, pa.binary()), pa.array([row] * n, pa.int64()), pa.array(range(low, low + n), pa.int64()), pa.array([alone] * n)], names=["h", "row", "start", "alone"])

    windows = cut(map_arrow(parts, run, "h binary, row long, start long, alone boolean"), "windows")
    counts = windows.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1")
    total = windows.count()
    hit = attach(windows.filter("alone"), counts, "h", "n", total)
    return hit.select("row", "start", (F.col("start") + width).alias("end"))


def repeated_spans(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, limit: int = SORT) -> tuple[DataFrame, DataFrame]:
    """The scanned documents, and (row, start, end) of repeated bytes, overlapping as they are found."""
    scanned = _scan(docs, width, gram)
    each = scanned.select("row", F.explode(F.arrays_zip("anchor", "low", "high", "same")).alias("c")).select("row", "c.*")
    kinds = each.groupBy("anchor", "same").agg(F.count("*").alias("n"), F.min(F.struct("row", "low", "high")).alias("one"))
    kinds = cut(kinds, "kinds")
    alike = kinds.filter("n > 1").select(F.struct("anchor", "same").alias("k"), "n")
    total = int(kinds.agg(F.sum("n")).first()[0] or 0)
    whole = attach(each.withColumn("k", F.struct("anchor", "same")), alike, "k", "n", total).select("row", F.col("low").alias("start"), (F.col("high") + width).alias("end"))
    # anchors with several distinct contexts, one of which at least is seen once
    size = F.sum(F.col("one.high") - F.col("one.low") + width + 1)
    open_ = kinds.groupBy("anchor").agg(F.count("*").alias("d"), F.min("n").alias("least"), size.alias("bytes")).filter("d > 1 AND least = 1")
    parts = open_.select("anchor", (F.col("bytes") > limit).alias("huge")).join(kinds.select("anchor", "one.*", (F.col("n") == 1).alias("alone")), "anchor")
    listed = parts.join(scanned.select("row", "key"), "row").groupBy("key").agg(F.collect_list(F.struct("anchor", "row", "low", "high", "alone", "huge")).alias("cs"))
    texts = _texts_of(docs, cut(listed, "open"))

    def extract(batches):
        for b in (x for batch in batches for x in slices(batch, "text")):
            out = [(c["anchor"], c["row"], c["low"], c["alone"], c["huge"], t[c["low"] : c["high"] + width]) for cs, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for c in cs]
            if out:
                kinds_ = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds_)], names=["anchor", "row", "low", "alone", "huge", "bytes"])

    cutout = cut(map_arrow(texts.select("cs", "text"), extract, "anchor long, row long, low long, alone boolean, huge boolean, bytes binary"), "parts")
    spans = whole.unionByName(_sorted_spans(cutout.filter("NOT huge").drop("huge"), width, limit))
    if not cutout.filter("huge").isEmpty():
        spans = spans.unionByName(_counted_spans(cutout.filter("huge").drop("huge"), width))
    return scanned, spans


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def remove_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, limit: int = SORT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (merged): a row for each document."""
    scanned, spans = repeated_spans(docs, width, gram, limit)
    listed = spans.groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("found"))

    def merge(batches):
        for b in batches:
            made = [_merged([(x["start"], x["end"]) for x in f or ()]) for f in b.column(b.schema.get_field_index("found")).to_pylist()]
            cols = [b.column(b.schema.get_field_index(c)) for c in ("row", "doc_id", "key", "n_bytes", "sha")]
            cols += [pa.array([sum(e - s for s, e in m) for m in made], pa.int64()), pa.array([[{"start": s, "end": e} for s, e in m] for m in made], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
            yield pa.RecordBatch.from_arrays(cols, names=["row", "doc_id", "key", "n_bytes", "sha", "n_removed", "spans"])

    docs_ = scanned.select("row", "doc_id", "key", "n_bytes", "sha").join(listed, "row", "left")
    judged = cut(map_arrow(docs_, merge, "row long, doc_id long, key binary, n_bytes long, sha string, n_removed long, spans array<struct<start:long,end:long>>"), "judged")
    some = (F.col("n_removed") > 0) & (F.col("n_removed") < F.col("n_bytes"))

    def digest(batches):
        for b in (x for batch in batches for x in slices(batch, "text")):
            out = []
            for found, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                h, k = hashlib.sha256(), 0
                for x in found:
                    h.update(t[k : x["start"]])
                    k = x["end"]
                h.update(t[k:])
                out.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out)], names=["row", "kept"])

    # a text that loses a part is no other document's text, so its key has one row
    partly = judged.filter(some).select("key", "row", "spans")
    kept = map_arrow(_texts_of(docs, partly).select("row", "spans", "text"), digest, "row long, kept string")
    done = judged.join(kept, "row", "left")
    sha = F.when(F.col("n_removed") == 0, F.col("sha")).when(F.col("n_removed") == F.col("n_bytes"), F.sha2(F.lit(b""), 256)).otherwise(F.col("kept"))
    return done.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), sha.alias("kept_sha256"), "spans")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents")).drop("spans")
