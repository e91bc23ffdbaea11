"""Cross-entropy difference: how much better a target model than a background model predicts a text.

Both are bigram models over all words of all texts, with exact counts of every word and every pair of
words. The background is every document, the target those named; background counts are scaled to the
target's number of words, so both are smoothed alike (matched). Words and pairs are told apart by 64-bit
hashes.

    p(w | v) = (pairs(v, w) + PRIOR * p(w)) / (count(v) + PRIOR),  p(w) = (count(w) + 1) / (words + vocabulary)
    score    = mean over a text's words of log p_background - log p_target   (lower: more like the target)

No model is held in one place. Texts are taken in units of some megabytes; what a unit says of a word
(the pairs that end in it, and how often each text has them) goes to the shard of that word, where it meets what all other units
say: the shard counts its words and pairs, looks every text's pairs up among the sorted hashes and sends
back a sum for each text. Shards number in proportion to the corpus. A word of more than a shard's share
is counted before and its pairs are spread over the shards by pair; pairs over 1/HOT_SHARE of all words
(fewer than HOT_SHARE) are counted before and scored where they are read. No pair is left out.

With `vocabulary` and `buckets` given, the model is a folded one of fixed size instead: the words most
frequent in all texts (all others are one unknown word) and pairs in hash buckets. No query asks for it.

Cases: null and empty texts have no words, losses and score 0; without target texts the target
model is uniform; a null doc_id is scored and is never a target; repeated rows count and score as
often as they occur; very long texts are taken in pieces that share a word; no rows in, no rows out;
columns other than doc_id and text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT_SHARE, cut, give_back, map_arrow, read, text_of

PRIOR = 100.0
#: Target ids that are broadcast at most (8 bytes each); beyond, rows are joined by shuffle.
BROADCAST_IDS = 2_000_000
#: Bytes of text handled at a time.
PIECE = 1 << 21
#: Bytes and documents of a unit at most (a longer text is a unit of its own), words of it handled at a time.
UNIT, DOCS, HELD = 1 << 23, 16_000, 1_300_000
#: Words of a shard on average, shards at least, and the least count of a hot word or pair.
SHARD, SHARDS, LEAST_HOT = 2_000_000, 64, 1000
#: What stands before a text's first word.
_START = np.uint64(0x5851F42D4C957F2D)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_LONG = 64


def _powers() -> np.ndarray:
    p = [1]
    for _ in range(_LONG - 1):
        p.append(p[-1] * _BASE & 0xFFFFFFFFFFFFFFFF)
    return np.array(p, np.uint64)


_POWERS = _powers()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of data (A-Z lower-cased) and where they begin. Words of over _LONG bytes are
    hashed in parts of that size, the parts' hashes folded in order."""
    b = np.frombuffer(data, np.uint8)
    dark = ~_BLANK[b]
    if not dark.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    edge = np.diff(np.r_[0, dark.view(np.int8), 0])
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    size = ends - starts
    at = np.flatnonzero(dark)
    first = np.cumsum(size) - size
    where = np.arange(len(at)) - np.repeat(first, size)
    value = (b[at].astype(np.uint64) + np.uint64(1)) * _POWERS[where % _LONG]
    value *= (where // _LONG).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019 & ~1) + np.uint64(1)
    return mixed(np.add.reduceat(value, first) + size.astype(np.uint64)), starts


def pieces(texts: list[bytes]):
    """Groups of (row, bytes, shared): about PIECE bytes of whole texts, or a part of a longer one cut
    between words; shared says that its first word was the last of the part before."""
    group, n = [], 0
    for i, t in enumerate(texts):
        t = t.lower()
        k, shared = 0, False
        while len(t) - k > PIECE:
            end = k + PIECE
            while end < len(t) and not _BLANK[t[end]]:
                end += 1
            if end == len(t):
                break
            last = len(t[k:end].rstrip())
            if last:
                yield [(i, t[k:end], shared)]
                tail = t[k : k + last].split()[-1]
                k, shared = k + last - len(tail), True
                if end - k > PIECE // 2:  # a word of that size: go on behind it
                    k, shared = end, False
            else:
                k = end
        group.append((i, t[k:], shared))
        n += len(t) - k
        if n > PIECE:
            yield group
            group, n = [], 0
    if group:
        yield group


def _joined(group) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a group: word hashes, their rows, whether each begins a text, whether each is only shared."""
    data = b" ".join(t for _, t, _ in group)
    h, starts = word_hashes(data)
    size = np.array([len(t) + 1 for _, t, _ in group])
    part = np.searchsorted(np.cumsum(size), starts, side="right")
    head = np.r_[True, part[1:] != part[:-1]] if len(part) else np.zeros(0, bool)
    shared = np.array([s for *_, s in group])[part] if len(part) else np.zeros(0, bool)
    return h, np.array([i for i, *_ in group])[part] if len(part) else part, head & ~shared, head & shared


def flagged(docs: DataFrame, target: DataFrame) -> DataFrame:
    """(text as bytes, t, doc_id): t whether the document's id is in target (doc_id)."""
    ids = target.select(F.col("doc_id").cast("long").alias("_id")).filter("_id IS NOT NULL").distinct()
    few = ids.count() <= BROADCAST_IDS
    marks = ids.withColumn("_t", F.lit(True))
    d = docs.select(F.col("doc_id").cast("long").alias("_d"), text_of().cast("binary").alias("text"))
    joined = d.join(F.broadcast(marks) if few else marks, F.col("_d") == F.col("_id"), "left")
    out = joined.select("text", F.coalesce("_t", F.lit(False)).alias("t"), F.col("_d").alias("doc_id"))
    return out if few else cut(out, "texts")  # rows keep their order when a task is run again


def word_counts(texts: DataFrame) -> DataFrame:
    """(h, n, t): occurrences of every word in all texts and in the target's."""

    def run(batches):
        held, n = [], 0

        def settled():
            h = np.concatenate([x[0] for x in held])
            u, back = np.unique(h, return_inverse=True)
            return u, np.bincount(back, np.concatenate([x[1] for x in held]), len(u)), np.bincount(back, np.concatenate([x[2] for x in held]), len(u))

        def out():
            u, a, b = settled()
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64))], names=["h", "n", "t"])

        for b in batches:
            is_target = np.array(b.column(1).to_pylist(), bool)
            for group in pieces(b.column(0).to_pylist()):
                h, row, _, skip = _joined(group)
                h, row = h[~skip], row[~skip]
                held.append((h, np.ones(len(h)), is_target[row].astype(float)))
                n += len(h)
                if n > 2_000_000:
                    held = [settled()]
                    n = len(held[0][0])
                    if n > 1_000_000:
                        yield out()
                        held, n = [], 0
        if held:
            yield out()

    return texts.mapInArrow(run, "h long, n long, t long").groupBy("h").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))


class Vocabulary:
    """Numbers of words: 1 and up by place in the sorted hashes, 0 for all other words."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(hashes)

    def numbers(self, h: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, at + 1, 0)


def pair_buckets(numbers: np.ndarray, head: np.ndarray, start: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The word before each word (`start` where a text begins), and the bucket of the pair."""
    before = np.r_[start, numbers[:-1]]
    before[head] = start
    key = before.astype(np.uint64) << np.uint64(32) | numbers.astype(np.uint64)
    return before, (mixed(key + np.uint64(1)) % np.uint64(buckets)).astype(np.int64)


def pair_counts(texts: DataFrame, vocabulary, start: int, buckets: int) -> DataFrame:
    """(bucket, n, t): pairs of words in each bucket, in all texts and in the target's."""

    def run(batches):
        held, n = [], 0
        total, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)

        def settle():
            at, t = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
            nonlocal total, target
            total += np.bincount(at, minlength=buckets)
            target += np.bincount(at[t], minlength=buckets)

        for b in batches:
            is_target = np.array(b.column(1).to_pylist(), bool)
            for group in pieces(b.column(0).to_pylist()):
                h, row, head, skip = _joined(group)
                _, at = pair_buckets(vocabulary.value.numbers(h), head, start, buckets)
                held.append((at[~skip], is_target[row[~skip]]))
                n += len(at)
                if n > 2_000_000:
                    settle()
                    held, n = [], 0
        if held:
            settle()
        at = np.flatnonzero(total)
        for k in range(0, len(at), 100_000):
            x = at[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32)), pa.array(total[x]), pa.array(target[x])], names=["bucket", "n", "t"])

    return texts.mapInArrow(run, "bucket int, n long, t long").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))


def smoothed(words: np.ndarray, pairs: np.ndarray, size: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A model of `size` words: p(w) by number, scaled counts of words, scaled counts of pairs.
    words[-1] is how many texts begin."""
    total = words[:-1].sum()
    scale = size / total if total else 0.0
    p = (words[:-1] * scale + 1) / (size * (total > 0) + len(words) - 1)
    return p.astype(np.float32), (words * scale).astype(np.float32), (pairs * scale).astype(np.float32)


def losses(model, numbers, before, bucket) -> np.ndarray:
    p, words, pairs = model
    return -np.log((pairs[bucket] + PRIOR * p[numbers]) / (words[before] + PRIOR), dtype=np.float64)


def train(docs: DataFrame, target: DataFrame, vocabulary: int, buckets: int):
    """(vocabulary, start, background, target) as broadcast values; the driver holds vocabulary and
    buckets numbers, no more."""
    spark = docs.sparkSession
    texts = flagged(docs, target)
    counts = cut(word_counts(texts), "words")
    every = counts.agg(F.sum("n"), F.sum("t")).first()
    top = counts.orderBy(F.col("n").desc(), "h").limit(vocabulary).toArrow().combine_chunks()
    h = top["h"].to_numpy().view(np.uint64)
    order = np.argsort(h)
    known = spark.sparkContext.broadcast(Vocabulary(h))
    start = len(h) + 1
    begun = texts.agg(F.count("*"), F.sum(F.col("t").cast("long"))).first()
    pairs = np.zeros((2, buckets))
    got = pair_counts(texts, known, start, buckets).toArrow()
    at = got["bucket"].to_numpy()
    pairs[0, at], pairs[1, at] = got["n"].to_numpy(), got["t"].to_numpy()
    size = float((every[1] or 0))
    models = []
    for k, c in enumerate(("n", "t")):
        mine = top[c].to_numpy()[order].astype(float)
        words = np.r_[float(every[k] or 0) - mine.sum(), mine, float(begun[k] or 0)]
        models.append(smoothed(words, pairs[k], size))
    return known, start, spark.sparkContext.broadcast(models)


def score_texts(docs: DataFrame, known, start: int, models, buckets: int) -> DataFrame:
    """doc_id, n_words, loss_target, loss_background (means), score: a row for each document."""

    def run(batches):
        for b in batches:
            n = b.num_rows
            out = np.zeros((3, n))
            for group in pieces(b.column(1).to_pylist()):
                h, row, head, skip = _joined(group)
                numbers = known.value.numbers(h)
                before, bucket = pair_buckets(numbers, head, start, buckets)
                numbers, before, bucket, row = (x[~skip] for x in (numbers, before, bucket, row))
                out[0] += np.bincount(row, minlength=n)
                for k, model in enumerate(models.value, 1):
                    out[k] += np.bincount(row, losses(model, numbers, before, bucket), n)
            words = out[0].astype(np.int64)
            background, wanted = out[1] / np.maximum(words, 1), out[2] / np.maximum(words, 1)
            cols = [b.column(0), pa.array(words), *(pa.array(np.round(x, 6) + 0.0) for x in (wanted, background, wanted - background))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", "loss_target", "loss_background", "score"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().cast("binary").alias("text"))
    return d.mapInArrow(run, "doc_id long, n_words long, loss_target double, loss_background double, score double")


class Hot:
    """Sorted hashes with their counts in all texts and in the target's."""

    def __init__(self, rows):
        rows = sorted((int(r.h) & 0xFFFFFFFFFFFFFFFF, r.n, r.t) for r in rows)
        self.hashes = np.array([r[0] for r in rows], np.uint64)
        self.counts = np.array([r[1:] for r in rows], float).reshape(-1, 2).T

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of h are here, and the places of those."""
        if not len(self.hashes):
            return np.zeros(len(h), bool), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        found = self.hashes[at] == h
        return found, at[found]


class Sizes:
    """What both models share: words, texts begun (all, target), distinct words, and the shards."""

    def __init__(self, words, begun, distinct: int, shards: int):
        size = float(words[1])
        self.scale = [size / n if n else 0.0 for n in words]
        self.size = [size * (n > 0) + distinct for n in words]
        self.start = [np.log(b * s + PRIOR) for b, s in zip(begun, self.scale)]
        self.shards = shards

    def logs(self, k: int, pairs: np.ndarray, words: np.ndarray) -> np.ndarray:
        return np.log(pairs * self.scale[k] + PRIOR * (words * self.scale[k] + 1) / self.size[k])

    def before(self, k: int, words: np.ndarray) -> np.ndarray:
        return np.log(words * self.scale[k] + PRIOR)


def pair_hashes(before: np.ndarray, h: np.ndarray) -> np.ndarray:
    return mixed(h * np.uint64(_BASE) + mixed(before))


def _before(h: np.ndarray, head: np.ndarray) -> np.ndarray:
    before = np.r_[_START, h[:-1]]
    before[head] = _START
    return before


def hot_pairs(texts: DataFrame, words: np.ndarray, limit: int) -> list:
    """(h, n, t) of the pairs that occur over `limit` times; both their words are among `words` (sorted, under HOT_SHARE)."""

    def run(batches):
        many = len(words)
        known, counts = Vocabulary(words), np.zeros((2, (many + 2) * (many + 1)), np.int64)
        for b in batches:
            is_target = np.array(b.column(1).to_pylist(), bool)
            for group in pieces(b.column(0).to_pylist()):
                h, row, head, skip = _joined(group)
                numbers = known.numbers(h)
                before = np.r_[many + 1, numbers[:-1]]
                before[head] = many + 1
                both = (numbers > 0) & (before > 0) & ~skip
                at = before[both] * (many + 1) + numbers[both]
                counts[0] += np.bincount(at, minlength=counts.shape[1])
                counts[1] += np.bincount(at[is_target[row[both]]], minlength=counts.shape[1])
        at = np.flatnonzero(counts[0])
        of = np.r_[np.uint64(0), known.hashes, _START]
        for k in range(0, len(at), 100_000):
            x = at[k : k + 100_000]
            h = pair_hashes(of[x // (many + 1)], of[x % (many + 1)])
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(counts[0, x]), pa.array(counts[1, x])], names=["h", "n", "t"])

    if not len(words):
        return []
    found = map_arrow(texts.select("text", "t"), run, "h long, n long, t long")
    return found.groupBy("h").agg(F.sum("n").alias("n"), F.sum("t").alias("t")).filter(F.col("n") > limit).collect()


def _blobs(h, before, mark, sizes: Sizes, words: Hot, pairs: Hot, base: np.ndarray):
    """(shard, bytes) of a unit's words: by word the pairs that end in it, by pair the marks (document * 4 +
    target * 2 + last of its text) and how often. Hot pairs are scored here, into base."""
    key = pair_hashes(before, h)
    order = np.argsort(key, kind="stable")
    key, mark = key[order], mark[order]
    new = np.r_[True, key[1:] != key[:-1]]
    entry = np.flatnonzero(new | np.r_[True, mark[1:] != mark[:-1]])
    often = np.diff(np.r_[entry, len(key)])
    mark = mark[entry]
    pair = np.flatnonzero(new[entry])  # in entries
    many = np.diff(np.r_[pair, len(entry)])
    key, h = key[entry[pair]], h[order[entry[pair]]]
    shard = (h % np.uint64(sizes.shards)).astype(np.int64)
    spread, place = words.find(h)
    shard[spread] = (key[spread] % np.uint64(sizes.shards)).astype(np.int64)
    hot, at = pairs.find(key)
    if hot.any():
        counts = np.zeros((2, len(h)))
        counts[:, spread] = words.counts[:, place]
        of = np.repeat(hot, many)
        m, n = mark[of], often[of]
        for k in (0, 1):
            num = np.repeat(sizes.logs(k, pairs.counts[k, at], counts[k, hot]), many[hot])
            den = np.repeat(sizes.before(k, counts[k, hot]), many[hot])
            base[k] += np.bincount(m >> 2, n * (den * (m & 1 == 0) - num), base.shape[1])
    keep = np.flatnonzero(~hot)
    keep = keep[np.argsort(shard[keep].astype(np.uint64) << np.uint64(44) | h[keep] >> np.uint64(20))]
    shard, key, h, first, many = shard[keep], key[keep], h[keep], pair[keep], many[keep]
    ends = np.cumsum(many)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - many), many)
    mark, often = mark[at].astype(np.uint16), often[at].astype(np.uint32)
    heads = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if len(shard) else []
    for i, j in zip(heads, [*heads[1:], len(shard)]):
        w = i + np.flatnonzero(np.r_[True, h[i + 1 : j] != h[i : j - 1]])
        a, b = ends[i] - many[i], ends[j - 1]
        parts = [np.array([len(w), j - i, b - a], np.uint32), h[w], np.diff(np.r_[w, j]).astype(np.uint32), key[i:j], many[i:j].astype(np.uint32), often[a:b], mark[a:b]]
        yield int(shard[i]), b"".join(x.tobytes() for x in parts)


def _parsed(data: bytes):
    """words, pairs of each, pairs, marks of each, how often, marks."""
    nw, np_, ne = np.frombuffer(data, np.uint32, 3).tolist()
    at, out = 12, []
    for kind, n in ((np.uint64, nw), (np.uint32, nw), (np.uint64, np_), (np.uint32, np_), (np.uint32, ne), (np.uint16, ne)):
        out.append(np.frombuffer(data, kind, n, at))
        at += out[-1].nbytes
    return out


def _units(batch, size: int):
    """Parts of a batch (text, ...) of about `size` bytes of text and DOCS rows at most."""
    n = np.array([len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(0)], np.int64)
    i, held = 0, 0
    for j in range(len(n)):
        if j > i and (held + n[j] > size or j - i >= DOCS):
            yield batch.slice(i, j - i)
            i, held = j, 0
        held += n[j]
    if len(n):
        yield batch.slice(i)


def sent(texts: DataFrame, sizes: Sizes, words, pairs, unit: int, most: int) -> DataFrame:
    """(shard, unit, whole, data): what units say to shards; whole: a unit's own row, its documents."""

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32

        def row(shard, whole, data):
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([number]), pa.array([whole]), pa.array([data], pa.binary())], names=["shard", "unit", "whole", "data"])

        for batch in batches:
            for b in _units(batch, unit):
                docs = b.num_rows
                is_target = np.array(b.column(1).to_pylist(), np.int64)
                n_words, base, held, n = np.zeros(docs, np.int64), np.zeros((2, docs)), [], 0

                def flushed(followed: bool):
                    h, at, before, head = (np.concatenate(x) for x in zip(*held))
                    if not len(h):
                        return
                    last = np.r_[head[1:], not followed]
                    n_words[:] += np.bincount(at, minlength=docs)
                    for k in (0, 1):
                        base[k] += np.bincount(at[head], minlength=docs) * sizes.start[k]
                    for shard, data in _blobs(h, before, at * 4 + is_target[at] * 2 + last, sizes, words.value, pairs.value, base):
                        yield row(shard, False, data)

                for group in pieces(b.column(0).to_pylist()):
                    h, at, head, skip = _joined(group)
                    if n > most:
                        yield from flushed(len(h) > 1 and bool(skip[0]) and not head[1])
                        held, n = [], 0
                    held.append((h[~skip], at[~skip], _before(h, head)[~skip], head[~skip]))
                    n += len(h)
                if held:
                    yield from flushed(False)
                ids = b.column(2)
                known = np.array(ids.is_valid().to_pylist(), bool)
                yield row(number % sizes.shards, True, ids.fill_null(0).to_numpy().astype(np.int64).tobytes() + n_words.tobytes() + base.tobytes() + known.tobytes())
                number += 1

    return map_arrow(texts, run, "shard int, unit long, whole boolean, data binary")


def _shard_sums(blobs: list[bytes], sizes: Sizes, hot: Hot) -> list[bytes]:
    """For each blob the documents in it and their summed losses, from the counts of all blobs of the shard."""
    read_ = [_parsed(x) for x in blobs]
    w, pairs_of, key, many, often, mark = (np.concatenate(x) for x in zip(*read_))
    ends = np.cumsum([len(x[5]) for x in read_])
    del read_
    w, back = np.unique(w, return_inverse=True)
    word = np.repeat(back, pairs_of)  # by row of key
    key, back = np.unique(key, return_inverse=True)
    of_key = np.zeros(len(key), np.int64)
    of_key[back] = word
    at = np.repeat(np.arange(len(word)), many)  # by mark
    often = often.astype(float)
    found, place = hot.find(w)
    sums = []
    word, pair = word[at], back[at]
    for k, weight in enumerate((often, often * (mark & 2 > 0))):
        n = np.bincount(pair, weight, len(key))
        words = np.bincount(word, weight, len(w))
        words[found] = hot.counts[k, place]
        sums.append(often * (sizes.before(k, words)[word] * (mark & 1 == 0) - sizes.logs(k, n, words[of_key])[pair]))
    out = []
    for i, j in zip([0, *ends[:-1]], ends):
        d = mark[i:j] >> 2
        there = np.flatnonzero(np.bincount(d))
        out.append(there.astype(np.uint16).tobytes() + b"".join(np.bincount(d, x[i:j])[there].astype(np.float32).tobytes() for x in sums))
    return out


def score_whole(docs: DataFrame, target: DataFrame, unit: int = UNIT, most: int = HELD) -> DataFrame:
    """doc_id, n_words, loss_target, loss_background (means), score by the exact counts of all words and pairs."""
    share = docs.sparkSession.sparkContext.broadcast
    texts = flagged(docs, target)
    counts = cut(word_counts(texts), "words")
    total = counts.agg(F.sum("n"), F.sum("t"), F.count("*")).first()
    begun = texts.agg(F.count("*"), F.sum(F.col("t").cast("long"))).first()
    n = total[0] or 0
    sizes = Sizes((n, total[1] or 0), (begun[0], begun[1] or 0), total[2], max(SHARDS, -(-n // SHARD)))
    limit = max(LEAST_HOT, n // HOT_SHARE)
    spread = Hot(counts.filter(F.col("n") > min(limit, max(LEAST_HOT, SHARD))).collect())
    words, pairs = share(spread), share(Hot(hot_pairs(texts, spread.hashes[spread.counts[0] > limit], limit)))

    def scored(table):
        whole = np.array(table["whole"].to_pylist(), bool)
        data = table["data"].to_pylist()
        at = np.flatnonzero(~whole)
        if len(at):
            for i, x in zip(at, _shard_sums([data[i] for i in at], sizes, words.value)):
                data[i] = x
        out = pa.table([table["unit"], table["whole"], pa.array(data, pa.binary())], names=["unit", "whole", "data"])
        give_back()
        return out

    def summed(table):
        data, whole = table["data"].to_pylist(), table["whole"].to_pylist()
        own = data[whole.index(True)]
        docs_ = len(own) // 33
        ids, n_words = np.frombuffer(own, np.int64, 2 * docs_).reshape(2, docs_)
        loss = np.frombuffer(own, float, 2 * docs_, 16 * docs_).reshape(2, docs_).copy()
        known = np.frombuffer(own, bool, docs_, 32 * docs_)
        for x in sorted(x for x, mine in zip(data, whole) if not mine):
            d = np.frombuffer(x, np.uint16, len(x) // 10)
            for k in (0, 1):
                loss[k, d] += np.frombuffer(x, np.float32, len(d), 2 * len(d) + 4 * len(d) * k)
        background, wanted = loss / np.maximum(n_words, 1)
        cols = [pa.array(ids, mask=~known), pa.array(n_words), *(pa.array(np.round(x, 6) + 0.0) for x in (wanted, background, wanted - background))]
        return pa.table(cols, names=["doc_id", "n_words", "loss_target", "loss_background", "score"])

    said = sent(texts, sizes, words, pairs, unit, most)
    back = said.groupBy("shard").applyInArrow(scored, "unit long, whole boolean, data binary")
    return back.groupBy("unit").applyInArrow(summed, "doc_id long, n_words long, loss_target double, loss_background double, score double")


def cross_entropy_difference(docs: DataFrame, target: DataFrame, vocabulary: int | None = None, buckets: int | None = None) -> DataFrame:
    """By the whole model; by the folded one only where its sizes are given."""
    if vocabulary is None or buckets is None:
        return score_whole(docs, target)
    return score_texts(docs, *train(docs, target, vocabulary, buckets), buckets)


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target is the documents that `labels` calls good."""
    return cross_entropy_difference(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels").filter("quality = 1").select("doc_id"))
