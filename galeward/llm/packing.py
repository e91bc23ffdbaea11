"""Mixture-controlled packing of token ids into windows by deficit round-robin over source queues.

Every source is a queue of its documents' ids in doc_id order. Round r serves every queue in turn;
queue s is owed rounds' share T_s / R of its T_s ids (R rounds, about one window of ids each), gets the
whole part of what it is owed and carries the rest, its deficit, to the next round, so by the end of
round r it has got floor(r * T_s / R + f_s) ids. f_s, the deficit it begins with, comes from a hash of the
source's name, so that small sources alike in size are not all served in the same rounds. That closed
form is the deficit counter after any round, so every task knows the counters at its place in the queues
and the deficits carry across windows and across partitions without passing through one task. The rounds, end to end, are one stream that is cut into
windows of WINDOW ids; the ids left at its end fill windows of falling powers of two, so no window
is padded. Rounds are about as long as windows, so at the end of any window no source is further ahead or
behind its proportion than its part of one round.

Every source has a queue of its own at any number of sources. Up to QUEUES of them, each task holds the table of
all T_s and places its documents alone. Beyond, no task holds it: a document's shares of its rounds need only the
T_s of its own queue, and their places are a distributed prefix sum over all shares in the order
of round and queue. Both ways give the same windows.

Cases: null or empty text is the end mark alone; a null source is a queue; documents alike in source and
doc_id lie in any one order; very long documents span windows; no rows in, no rows out; columns
other than doc_id, text and source are not read.
"""

from __future__ import annotations

import string
import zlib
from array import array
from bisect import bisect_right
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, cut, map_arrow, read, running_offsets, text_of

WINDOW = 4096
END = 2
#: Queues whose totals every task may hold (8 bytes each); more are placed by a prefix sum over the rounds' shares.
QUEUES = 1024
#: Chunks of text whose ids a worker remembers, twice: when as many are new, those not asked for since go.
REMEMBERED = 400_000
#: Bytes of text whose chunks are told apart at a time.
PIECE = 1 << 23
_MARKS = string.punctuation.encode()
_ALNUM = np.isin(np.arange(256), np.frombuffer((string.ascii_letters + string.digits).encode(), np.uint8))


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column, and the places where its rows begin and the last one ends."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int32)
    _, ends, held = column.buffers()
    return np.frombuffer(held, np.uint8) if held else np.zeros(0, np.uint8), np.frombuffer(ends, np.int32, len(column) + 1, 4 * column.offset)


def _byte_letters() -> dict[int, str]:
    """The letter by which byte-level vocabularies write each byte: printable ones stand for themselves, the others,
    in order, for 256 and up."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_LETTERS = _byte_letters()


class WordIds(dict):
    """Little-endian unsigned 32-bit ids of chunks of text between white space.

    The vocabulary's tokenizer drops white space and never merges across it, so a text's ids are its
    chunks' ids, end to end; most chunks have been seen before. A run of marks behind an ASCII letter or
    digit is a piece of its own to the tokenizer, so such a chunk is its word and its marks. It lower-cases,
    so A-Z may be lower-cased first, but for texts that may hold a special token's name."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.pieces = self.model.model
        self.before: dict[bytes, bytes] = {}

    def encoded(self, word: bytes) -> bytes:
        """A word of small letters in normal form is one piece, which the vocabulary's model splits by itself.
        Capitals of Latin-1, all in normal form, have one small letter each."""
        if word.isalpha() and word.islower():  # ASCII, each byte its own letter
            return array("I", [x.id for x in self.pieces.tokenize(word.decode())]).tobytes()
        text = word.decode()
        if text.isalpha():
            small = text.lower()
            if small == text or max(text) < "\u0100":
                if small.isascii() or is_normalized("NFC", small):
                    return array("I", [x.id for x in self.pieces.tokenize(small.encode().decode("latin-1").translate(_LETTERS))]).tobytes()
        return array("I", self.model.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= REMEMBERED:
            self.before = dict(self)
            self.clear()
        out = self.before.get(word)
        if out is None:
            bare = word.rstrip(_MARKS)
            if bare != word and bare[-1:].isalnum() and b"<|" not in word:
                out = self[bare] + self[word[len(bare) :]]
            else:
                out = self.encoded(word)
        if len(word) <= 64:
            self[word] = out
        return out

    def of(self, text: bytes) -> bytes:
        return b"".join(map(self.__getitem__, (text if b"<|" in text else text.lower()).split()))

    def of_words(self, words: list[bytes]) -> list[bytes]:
        """Of each word, as self[word]; those of ASCII letters by themselves in fewer steps."""
        out, split = list(map(self.get, words)), self.pieces.tokenize
        for i in [i for i, x in enumerate(out) if x is None]:
            word = words[i]
            if word.islower() and word.isalpha() and word not in self.before and len(self) < REMEMBERED:
                ids = array("I", [x.id for x in split(word.decode())]).tobytes()
                if len(word) <= 64:
                    self[word] = ids
                out[i] = ids
            else:
                out[i] = self[word]
        return out

    def of_chunks(self, chunks: pa.StringArray) -> pa.BinaryArray:
        """Of distinct chunks. Those that are a word and its marks are parted together, and each word is looked up once."""
        import pyarrow.compute as pc

        bare = pc.ascii_rtrim(chunks, characters=_MARKS.decode())
        held, kept = pc.binary_length(chunks).to_numpy(), pc.binary_length(bare).to_numpy()
        letters, ends = _bytes_of(bare)
        last = letters[np.maximum(ends[1:] - 1, 0)] if len(letters) else np.zeros(len(bare), np.uint8)
        marked = (kept > 0) & (kept < held) & _ALNUM[last] & ~pc.match_substring(chunks, "<|").to_numpy(zero_copy_only=False)
        words = pc.if_else(pa.array(marked), bare, chunks).dictionary_encode()
        ids = pa.array(self.of_words(words.dictionary.cast(pa.binary()).to_pylist()), pa.binary()).take(words.indices)
        at = np.flatnonzero(marked)
        if not len(at):
            return ids
        letters, ends = _bytes_of(chunks)
        size = (held - kept)[at]
        upto = np.r_[0, np.cumsum(size)].astype(np.int32)
        tails = letters[np.repeat(ends[1:][at] - upto[1:], size) + np.arange(upto[-1])]
        tails = pa.BinaryArray.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(upto), pa.py_buffer(tails)]).dictionary_encode()
        which = np.zeros(len(chunks), np.int32)
        which[at] = tails.indices.to_numpy() + 1
        behind = pa.array([b"", *self.of_words(tails.dictionary.to_pylist())], pa.binary()).take(pa.array(which))
        return pc.binary_join_element_wise(ids, behind, b"")

    def column(self, texts: pa.StringArray) -> pa.BinaryArray:
        """Of each text, with the end mark. Chunks are told apart by Arrow, so each is looked up once."""
        import pyarrow.compute as pc

        chunks = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        bounds, chunks = chunks.offsets.to_numpy() - chunks.offsets[0].as_py(), chunks.flatten().dictionary_encode()
        known = self.of_chunks(chunks.dictionary)
        end = np.array([END], "<u4").tobytes()
        # a chunk more behind each text is its end mark
        which = np.insert(chunks.indices.to_numpy(), bounds[1:], len(known))
        ids = pa.concat_arrays([known, pa.array([end], pa.binary())]).take(pa.array(which))
        places = np.frombuffer(ids.buffers()[1], np.int32, len(ids) + 1, 4 * ids.offset)[bounds + np.arange(len(bounds))]
        out = pa.BinaryArray.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(places), ids.buffers()[2]])
        odd = np.flatnonzero(pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False)).tolist()
        if odd:
            made = out.to_pylist()
            for i in odd:
                made[i] = self.of(texts[i].as_py().encode()) + end
            out = pa.array(made, pa.binary())
        return out

    def of_all(self, texts: pa.StringArray) -> list[bytes]:
        """column(texts) as a list."""
        return self.column(texts).to_pylist()


_known: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The worker's own, kept from task to task."""
    if path not in _known:
        _known[path] = WordIds(path)
    return _known[path]


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, queue, n, ids): a scratch table; ids end with END, n counts them. `path`: the
    tokenizer's file on every worker, by default that of the installed package there."""

    def run(batches):
        words = word_ids(path or vocabulary())
        for b in batches:
            texts = b.column(2).cast(pa.string())
            size = np.diff(_bytes_of(texts)[1])
            group = np.cumsum(size, dtype=np.int64) // PIECE
            heads = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(texts) else []
            for i, j in zip(heads, [*heads[1:], len(texts)]):
                ids = words.column(texts.slice(i, j - i))
                n = np.diff(_bytes_of(ids)[1]).astype(np.int64) // 4
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(n), ids], names=["doc_id", "queue", "n", "ids"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("queue"), text_of().alias("text"))
    made = map_arrow(d, run, "doc_id long, queue string, n long, ids binary")
    return cut(made.withColumn("row", F.monotonically_increasing_id()), "ids")


class Rounds:
    """Places in the stream. totals: ids of each queue, in the order in which a round serves them."""

    def __init__(self, totals: list[int], window: int, total: int | None = None, keys: list[str] | None = None):
        """total: ids of all queues, where totals are not those of all of them. keys: of the queues, from which the
        deficits come that they begin with (else 0)."""
        self.totals, self.window = totals, window
        self.total = sum(totals) if total is None else total
        self.rounds = max(1, -(-self.total // window))
        self.carried = [zlib.crc32(k.encode()) * self.rounds >> 32 for k in keys] if keys else [0] * len(totals)
        self.full = self.total // window
        self.tails, left, at = [], self.total % window, self.full * window
        while left:
            size = 1 << (left.bit_length() - 1)
            self.tails.append(at)
            at, left = at + size, left - size
        self._at = (-1, [])
        self.small = np.array(totals, np.int64) if (self.rounds + 2) * max(self.total, 1) < 1 << 62 else None

    def served(self, q: int, r: int) -> int:
        """Ids of queue q served by the end of round r - 1."""
        return (r * self.totals[q] + self.carried[q]) // self.rounds

    def round_of(self, q: int, i: int) -> int:
        """The round that serves id i of queue q: the largest r with served(r) <= i."""
        return ((i + 1) * self.rounds - 1 - self.carried[q]) // self.totals[q]

    def begin(self, q: int, r: int) -> int:
        """Place in the stream of the first id that round r serves of queue q."""
        if self._at[0] != r:
            now = [self.served(k, r) for k in range(len(self.totals))]
            place, out = sum(now), []
            for k, x in enumerate(now):
                out.append(place)
                place += self.served(k, r + 1) - x
            self._at = (r, out)
        return self._at[1][q]

    def begins(self, q: int, rounds) -> list[int]:
        """begin(q, r) for each of some rounds, in one go where 64 bits hold the products."""
        if self.small is None:
            return [self.begin(q, r) for r in rounds]
        r = np.fromiter(rounds, np.int64)[:, None]
        carried = np.array(self.carried, np.int64)
        now = (r * self.small + carried) // self.rounds
        return (now.sum(1) + (((r + 1) * self.small[:q] + carried[:q]) // self.rounds - now[:, :q]).sum(1)).tolist()

    def rounds_of(self, q: int, first: int, n: int):
        """Blocks of the rounds that serve ids first..first+n of queue q, at most n rounds in all."""
        a, b = self.round_of(q, first), self.round_of(q, first + n - 1)
        found = range(a, b + 1) if b - a < n else sorted({self.round_of(q, i) for i in range(first, first + n)})
        size = max(1, 100_000 // len(self.totals))
        for k in range(0, len(found), size):
            yield found[k : k + size]

    def window_of(self, place: int) -> tuple[int, int, int]:
        """Sequence id, its first place and the place behind it."""
        if place < self.full * self.window:
            k = place // self.window
            return k, k * self.window, (k + 1) * self.window
        k = bisect_right(self.tails, place) - 1
        return self.full + k, self.tails[k], self.tails[k + 1] if k + 1 < len(self.tails) else self.total

    def shares(self, q: int, first: int, n: int):
        """(round, start, length) of the ids first..first+n of queue q by the rounds that serve them."""
        i = first
        for r in (r for block in self.rounds_of(q, first, n) for r in block):
            stop = min(self.served(q, r + 1), first + n)
            if stop > i:
                yield r, i - first, stop - i
                i = stop

    def pieces(self, q: int, first: int, n: int):
        """(start, length, sequence, offset) of the ids first..first+n of queue q; start counts from first."""
        return self.cut(self._placed(q, first, n))

    def _placed(self, q: int, first: int, n: int):
        i = first
        for r, place in ((r, p) for block in self.rounds_of(q, first, n) for r, p in zip(block, self.begins(q, block))):
            stop = min(self.served(q, r + 1), first + n)
            if stop > i:
                yield i - first, stop - i, place + i - self.served(q, r)
                i = stop

    def cut(self, parts):
        """(start, length, sequence, offset) of parts (start, length, place in the stream) of a document, cut
        where windows end. Parts that are neighbours in a window as well are one piece."""
        held = None
        for i, n, place in parts:
            stop = i + n
            while i < stop:
                seq, low, high = self.window_of(place)
                k = min(stop - i, high - place)
                if held and held[2] == seq and held[3] + held[1] == place - low:
                    held[1] += k
                else:
                    if held:
                        yield tuple(held)
                    held = [i, k, seq, place - low]
                i, place = i + k, place + k
        if held:
            yield tuple(held)


def _queue_key(queue: Column) -> Column:
    """A key that is never null and sorts as queues do: by code point, null last."""
    return F.coalesce(F.concat(F.lit("0"), queue), F.lit("1"))


def _by_share(placed: DataFrame, by_queue: DataFrame, total: int, window: int) -> DataFrame:
    """placed (row, queue, doc_id, n, start: place in the queue) as (row, parts): the places in the stream of each
    document's shares, for any number of queues. by_queue: (queue, n, docs)."""
    of = by_queue.select(_queue_key(F.col("queue")).alias("key"), F.col("n").alias("served"), "docs")
    known = attach(placed.select("row", _queue_key(F.col("queue")).alias("key"), "start", "n"), of, "key", "docs", int(by_queue.agg(F.sum("docs")).first()[0] or 0))

    def share(batches):
        for b in batches:
            of_each = zip(*(b.column(k).to_pylist() for k in range(5)))
            made = (((row, key, r, first + at, at, n) for r, at, n in Rounds([served], window, total, [key]).shares(0, first, size)) for row, key, first, size, served in of_each)
            yield from _batches_of(made, _SHARE)

    shares = map_arrow(known.select("row", "key", "start", "n", "served"), share, _ddl(_SHARE)).withColumn("all", F.lit(0))
    laid = running_offsets(shares, "all", [F.col("round"), F.col("key"), F.col("queued")], "length", "shares")
    return laid.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("at", "length", F.col("start").alias("place")))).alias("parts"))


def pack(docs: DataFrame, window: int = WINDOW, path: str | None = None, with_ids: bool = True, queues: int = QUEUES) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the
    queue and the ids if wanted. queues: how many a task may hold the totals of."""
    d = encoded(docs, path)
    by_queue = cut(d.groupBy("queue").agg(F.sum("n").alias("n"), F.count("*").alias("docs")), "queues")
    placed = running_offsets(d.select("row", "queue", "doc_id", "n"), "queue", [F.col("doc_id").asc_nulls_last()], "n", "first")
    schema = _PIECE if with_ids else pa.schema(list(_PIECE)[:7])
    few = by_queue.count() <= queues
    if few:
        totals = {r["queue"]: int(r["n"]) for r in by_queue.collect()}
        order = sorted(totals, key=lambda s: (s is None, s or ""))
        index, sums, keys = {s: i for i, s in enumerate(order)}, [totals[s] for s in order], ["1" if s is None else f"0{s}" for s in order]
        where = placed.select("row", F.col("start").alias("at"))
    else:
        keys, sums = None, [int(by_queue.agg(F.sum("n")).first()[0] or 0)]
        where = _by_share(placed, by_queue, sums[0], window).select("row", F.col("parts").alias("at"))
    joined = where.join(d, "row").select("doc_id", "queue", "at", "n", "ids")

    def run(batches):
        rounds = Rounds(sums, window, None, keys)

        def found(doc, queue, at, n, ids):
            ids = memoryview(ids.as_buffer())
            parts = rounds.pieces(index[queue], at, n) if few else rounds.cut((x["at"], x["length"], x["place"]) for x in at)
            for start, length, seq, offset in parts:
                piece = ids[4 * start : 4 * (start + length)]
                row = (doc, start, length, zlib.crc32(piece), n, seq, offset)
                yield (*row, queue, bytes(piece)) if with_ids else row

        for b in batches:
            columns = [*(b.column(k).to_pylist() for k in range(4)), b.column(4)]
            yield from _batches_of((found(*x) for x in zip(*columns)), schema)

    return map_arrow(joined, run, _ddl(schema))


def _batches_of(pieces, schema: pa.Schema):
    """Record batches of about 20,000 of the pieces."""
    cols: list[list] = [[] for _ in schema]
    for rows in pieces:
        for row in rows:
            for c, x in zip(cols, row):
                c.append(x)
        if len(cols[0]) >= 20_000:
            yield _batch(cols, schema)
            cols = [[] for _ in schema]
    if cols[0]:
        yield _batch(cols, schema)


_PIECE = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")] + [("queue", pa.string()), ("ids", pa.binary())])
#: A document's share of a round: its place in the queue and in the document.
_SHARE = pa.schema([("row", pa.int64()), ("key", pa.string()), *((n, pa.int64()) for n in ("round", "queued", "at", "length"))])
_SQL = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {_SQL[f.type]}" for f in schema)


def _batch(cols: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


def pack_report(docs: DataFrame) -> DataFrame:
    return pack(docs, with_ids=False)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_report(read(spark, sf_dir, "documents"))
