"""Quality rules: plain counts, and perplexity under an n-gram model of the document's own language.

The model is a modified Kneser-Ney model of order 4 over the texts' real characters (a run of white space is
one blank, a digit is any digit). Spark counts the 4-grams of all texts by language, derives the continuation counts of the lower
orders, the discounts and the contexts' free mass, and no language passes through one task. N-grams that are
scored by their own entry are kept as arrays sorted by hash, log probabilities beside them, for all languages
together; every worker looks n-grams up there, longest first, with the back-off weights of the contexts above.

Size: the arrays are broadcast, so they hold MODEL n-grams at most. Each language may have a part of that by the square root of its
characters; the powers of two at which its n-grams' counts meet that part are counted. N-grams that occur less often
are no less part of the model: Spark joins derive the probabilities of the rest in tables that grow with the corpus, and
where a text has one, it is looked up there by a join and added to its block. So each n-gram of each text is scored by its own entry at any size
(`train_whole`). `train` is the bounded form for texts the model has not seen: there the rest gives its
whole count to the free mass of its contexts and is scored by back-off, and probabilities still sum to one.

Bands: a document's figure is the median of the log perplexities of its blocks of BLOCK characters, so a passage in another
language or a table does not speak for the whole. Every language has a lower and an upper band about the median of its
documents' figures, BAND robust deviations wide. The figure of a short text is noisier than that of a long one, so deviations are taken by language
and by length as well (powers of two of characters; a class of few documents counts little), and the wider one of both counts.

Cases: null text has no words and fails the base rule; a null language is a language of its own;
empty texts get the model's value of nothing (perplexity 0 in log) and fail the base rule anyhow; characters
beyond the first 65,536 code points share 6,400 places; very long texts are counted in pieces; repeated rows get the same result;
no rows in, no rows out; columns other than doc_id, text and lang are not read by the report, and
all are kept by the filter.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import attach, cut, fresh, map_arrow, read, text_of

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Robust deviations (1.4826 times the median absolute deviation) from the median, either side.
BAND = 5.0
#: Characters of a block.
BLOCK = 128
#: Documents at which a length class's own half width counts by half.
PRIOR = 30
ORDER = 4
#: N-grams of all orders and languages that a worker holds at most (12 bytes each, as much again for contexts).
MODEL = 1 << 21
#: Resolution of the histogram from which medians are taken, in nats.
STEP = 1e-4
#: Characters that are handled at a time, and n-grams that a counting task holds.
PIECE, HELD = 1 << 20, 1 << 21
_START = 1
_MARKS = b"#*$%&|<>"

# --- base rules -----------------------------------------------------------------------------------


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of UTF-8 text."""
    words = text.split()
    n = len(words)
    chars = 0
    if n:
        flat = np.frombuffer(b"".join(words), np.uint8)
        chars = int(np.count_nonzero((flat & 0xC0) != 0x80))
    symbols = len(text) - len(text.translate(None, _MARKS))
    again = 0
    lines = text.split(b"\n")
    if len(lines) > 1:
        seen = set()
        for line in lines:
            if line in seen:
                again += 1
            elif line.strip():
                seen.add(line)
    return n, chars, symbols, again, _repeated(words)


def _repeated(words: list[bytes]) -> int:
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    first: dict = {}
    hit = np.zeros(len(words) + 2, np.int8)
    for i, w in enumerate(windows):
        j = first.setdefault(w, i)
        if j != i:
            hit[i : i + 3] = 1
            hit[j : j + 3] = 1
    return int(hit.sum())


# --- symbols and n-grams --------------------------------------------------------------------------


def _symbol_table() -> np.ndarray:
    t = np.arange(1 << 16, dtype=np.uint64)
    t[[0, 9, 10, 11, 12, 13]] = 32
    t[48:58] = 48
    return t


_TABLE = _symbol_table()


def symbols(text: str) -> np.ndarray:
    """Numbers of 16 bits; the mark _START passes through."""
    a = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    far = a >> 16 != 0
    s = _TABLE[np.where(far, 0xE000 + a % 6400, a)] if far.any() else _TABLE[a]
    blank = s == 32
    again = np.flatnonzero(blank[1:] & blank[:-1])
    return np.delete(s, again + 1) if len(again) else s


def pieces(texts: list[bytes]):
    """Groups ([row, text], lead) of about PIECE characters: whole texts, or a part of a longer one with some
    characters before it (`lead` of them, not counted)."""
    group, n = [], 0
    for i, t in enumerate(texts):
        t = t.decode("utf-8", "replace").replace("\x01", " ")
        if len(t) > PIECE:
            for k in range(0, len(t), PIECE):
                yield [(i, t[max(0, k - 64) : k + PIECE])], t[max(0, k - 64) : k]
            continue
        group.append((i, t))
        n += len(t)
        if n > PIECE:
            yield group, ""
            group, n = [], 0
    if group:
        yield group, ""


def grams(group: list[tuple[int, str]], lead: str = "") -> tuple[np.ndarray, np.ndarray]:
    """The row and the 4-gram that ends there, for each character; each text is preceded by _START."""
    mark = chr(_START) * (ORDER - 1)
    s = symbols(mark + mark.join(t for _, t in group))
    start = s == _START
    row = np.array([i for i, _ in group])[np.cumsum(start)[ORDER - 1 :] // (ORDER - 1) - 1]
    g = s[:-3] << np.uint64(48) | s[1:-2] << np.uint64(32) | s[2:-1] << np.uint64(16) | s[3:]
    here = np.flatnonzero(~start[ORDER - 1 :])[len(symbols(lead)) :]
    return row[here], g[here]


def _merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
    k, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(k)
    k = k[order]
    heads = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    return k[heads], np.add.reduceat(n[order], heads)


def salt_of(lang: Column) -> Column:
    return F.xxhash64(lang)


def count_grams(docs: DataFrame) -> DataFrame:
    """(salt, gram, n) over all texts, salt standing for the language; each task adds up its own before the shuffle."""

    def run(batches):
        held: dict = {}
        size = 0

        def out():
            for salt, parts in held.items():
                k, n = _merged(parts)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), salt)), pa.array(k.view(np.int64)), pa.array(n)], names=["salt", "gram", "n"])

        for b in batches:
            salts, texts = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_pylist()
            for salt in np.unique(salts).tolist():
                for group, lead in pieces([texts[i] for i in np.flatnonzero(salts == salt)]):
                    g = grams(group, lead)[1]
                    if not len(g):
                        continue
                    held.setdefault(salt, []).append(np.unique(g, return_counts=True))
                    size += len(held[salt][-1][0])
                    if size > 2 * HELD:
                        held = {k: [_merged(v)] for k, v in held.items()}
                        size = sum(len(v[0][0]) for v in held.values())
                        if size > HELD:
                            yield from out()
                            held, size = {}, 0
        yield from out()

    rows = map_arrow(docs.select(salt_of(F.col("lang")).alias("salt"), text_of().cast("binary").alias("text")), run, "salt long, gram long, n long")
    return rows.groupBy("salt", "gram").agg(F.sum("n").alias("n"))


# --- modified Kneser-Ney --------------------------------------------------------------------------


def levels(counts: DataFrame) -> DataFrame:
    """(k, salt, gram, c, r): the n-grams of orders 4 to 1 with the count of the model (for lower orders of how many
    n-grams one longer they are the end) and how often they occur."""
    of = cut(counts.select("salt", "gram", F.col("n").alias("c"), F.col("n").alias("r")), "grams4")
    every = of.withColumn("k", F.lit(ORDER))
    for k in range(ORDER - 1, 0, -1):
        end = F.col("gram").bitwiseAND(F.lit((1 << 16 * k) - 1))
        of = cut(of.groupBy("salt", end.alias("gram")).agg(F.count("*").alias("c"), F.sum("r").alias("r")), f"grams{k}")
        every = every.unionByName(of.withColumn("k", F.lit(k)))
    return every


def discounts(every: DataFrame) -> DataFrame:
    """(k, salt, d1, d2, d3): what is taken off counts of 1, 2 and more."""
    n = every.groupBy("k", "salt").agg(*[F.count_if(F.col("c") == j).cast("double").alias(f"n{j}") for j in (1, 2, 3, 4)])
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    seen = (F.col("n1") > 0) & (F.col("n2") > 0) & (F.col("n3") > 0) & (F.col("n4") > 0)
    d = lambda j, plain: F.when(seen, F.least(F.greatest(j - (j + 1) * y * F.col(f"n{j + 1}") / F.col(f"n{j}"), F.lit(0.0)), F.lit(float(j)))).otherwise(plain)
    return n.select("k", "salt", *[d(j, plain).alias(f"d{j}") for j, plain in ((1, 0.5), (2, 0.75), (3, 0.9))])


def least_counts(every: DataFrame, size: int) -> DataFrame:
    """(salt, least): the power of two from which on n-grams of a language are kept, so that `size` are in all."""
    bins = cut(every.groupBy("salt", F.floor(F.log2("r")).cast("int").alias("b")).agg(F.count("*").alias("n"), F.sum(F.when(F.col("k") == ORDER, F.col("r"))).alias("r")), "bins")
    weight = bins.groupBy("salt").agg(F.sqrt(F.sum("r")).alias("w"))
    whole = weight.agg(F.sum("w")).first()[0] or 1.0
    upper = Window.partitionBy("salt").orderBy(F.col("b").desc())
    parts = bins.join(weight, "salt").withColumn("above", F.sum("n").over(upper)).filter(F.col("above") <= F.col("w") * F.lit(size / whole))
    return parts.groupBy("salt").agg(F.pow(F.lit(2.0), F.min("b")).alias("least"))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _keys(k: int, salt: np.ndarray, gram: np.ndarray) -> np.ndarray:
    return _mixed(gram.view(np.uint64) + _mixed(salt.view(np.uint64) * np.uint64(2 * ORDER + 1) + np.uint64(k)))


class Sorted:
    """Keys in order with a value each. Keys are hashes, so their upper bits say nearly where they lie."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values, self.first = keys[order], values[order], None

    def find(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the asked keys are here, and their values (0 for others)."""
        n = len(self.keys)
        if not n:
            return np.zeros(len(asked), bool), np.zeros(len(asked))
        if self.first is None:
            bits = max(1, n.bit_length())
            self.shift = np.uint64(64 - bits)
            self.first = np.searchsorted(self.keys, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)
        at = np.minimum(self.first[asked >> self.shift], n - 1)
        left = np.flatnonzero(self.keys[at] < asked)
        while len(left):
            at[left] += 1
            left = left[at[left] < n]
            left = left[self.keys[at[left]] < asked[left]]
        at = np.minimum(at, n - 1)
        hit = self.keys[at] == asked
        return hit, np.where(hit, self.values[at], 0.0)


class Model:
    """grams: log p of the n-grams kept; contexts: log of their back-off weight, that of the empty one times the
    probability of an unknown character."""

    def __init__(self, kept: pa.Table, contexts: pa.Table):
        g = {c: kept[c].to_numpy() for c in ("k", "salt", "gram", "num")}
        x = {c: contexts[c].to_numpy() for c in ("k", "salt", "gram", "total", "free", "kinds")}
        keys, logs, lower = [], [], None
        share = x["free"] / x["total"] / np.where(x["k"] == 1, x["kinds"] + 1, 1)
        of = np.concatenate([_keys(k, x["salt"][x["k"] == k], x["gram"][x["k"] == k]) for k in range(1, ORDER + 1)])
        rank = np.argsort(x["k"], kind="stable")
        weight, total = Sorted(of, share[rank]), Sorted(of, x["total"][rank])
        for k in range(1, ORDER + 1):
            mine = g["k"] == k
            salt, gram = g["salt"][mine], g["gram"][mine].view(np.uint64)
            above = _keys(k, salt, gram >> np.uint64(16))
            p = weight.find(above)[1]
            if k > 1:
                p = p * lower.find(_keys(k - 1, salt, gram & np.uint64((1 << 16 * (k - 1)) - 1)))[1]
            p = p + g["num"][mine] / total.find(above)[1]
            keys.append(_keys(k, salt, gram))
            lower = Sorted(keys[-1], p)
            logs.append(np.log(p))
        self.grams = Sorted(np.concatenate(keys), np.concatenate(logs).astype(np.float32))
        self.contexts = Sorted(weight.keys, np.log(np.maximum(weight.values, 1e-12)).astype(np.float32))

    def own(self, salt: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the 4-grams are kept, and log p of their last symbols (0 for others)."""
        hit, p = self.grams.find(_keys(ORDER, salt, g))
        return hit, p.astype(float)

    def log_p(self, salt: np.ndarray, g: np.ndarray) -> np.ndarray:
        """log p of the last symbol of each 4-gram: the longest n-gram kept, with the back-off weights above it."""
        out = np.zeros(len(g))
        left = np.arange(len(g))
        for k in range(ORDER, 0, -1):
            mine, s = g[left] & np.uint64((1 << 16 * k) - 1), salt[left]
            hit, p = self.grams.find(_keys(k, s, mine))
            out[left] += p
            left, mine, s = left[~hit], mine[~hit], s[~hit]
            if not len(left):
                break
            out[left] += self.contexts.find(_keys(k, s, mine >> np.uint64(16)))[1]
        return out


def _judged(docs: DataFrame, size: int) -> DataFrame:
    """(k, salt, gram, c, off, kept): all n-grams with their discount, and whether they are among the `size` that workers hold."""
    every = levels(count_grams(docs))
    rows = every.join(discounts(every), ["k", "salt"]).join(least_counts(every, size), "salt", "left")
    c = F.col("c")
    off = F.when(c == 1, F.col("d1")).when(c == 2, F.col("d2")).otherwise(F.col("d3"))
    return cut(rows.select("k", "salt", "gram", "c", off.alias("off"), F.coalesce(F.col("r") >= F.col("least"), F.lit(False)).alias("kept")), "judged")


def _contexts(judged: DataFrame) -> DataFrame:
    return judged.groupBy("k", "salt", F.shiftrightunsigned("gram", 16).alias("above")).agg(
        F.sum("c").cast("double").alias("total"), F.sum("off").alias("free"), F.count("*").cast("double").alias("kinds"), F.max("kept").alias("some")
    )


def _gathered(judged: DataFrame) -> Model:
    """The n-grams kept, and their contexts, on the driver."""
    kept = judged.filter("kept").select("k", "salt", "gram", (F.col("c") - F.col("off")).alias("num"))
    return Model(kept.toArrow(), _contexts(judged).filter("some").withColumnRenamed("above", "gram").drop("some").toArrow())


def train(docs: DataFrame, size: int = MODEL) -> Model:
    """The model of all languages for any text: counted and discounted by Spark; `size` n-grams at most, and their contexts, reach the driver."""
    return _gathered(_judged(docs, size).withColumn("off", F.when(F.col("kept"), F.col("off")).otherwise(F.col("c"))))


def train_whole(docs: DataFrame, size: int = MODEL) -> tuple[Model, DataFrame | None]:
    """The model by which the texts of docs themselves are scored, nothing backed off: `size` n-grams to hold, and the
    table of the rest (salt, gram, p), p the log probability; None if there is no rest."""
    judged = _judged(docs, size)
    # an n-gram occurs no more often than its end, so with all 4-grams kept, all shorter ones are
    whole = judged.filter(~F.col("kept")).isEmpty()
    return _gathered(judged), None if whole else _rest(judged)


def _rest(judged: DataFrame) -> DataFrame:
    """(salt, gram, p) of the 4-grams that are not kept, order by order from joins with contexts and shorter n-grams.

    No key is hot there: a context has 65,536 followers at most, and an end as many symbols before it."""
    contexts, lower = _contexts(judged), None
    for k in range(1, ORDER + 1):
        rows = judged.filter((F.col("k") == k) & (~F.col("kept") if k == ORDER else F.lit(True))).withColumn("above", F.shiftrightunsigned("gram", 16))
        rows = rows.join(contexts.filter(F.col("k") == k).drop("k", "some"), ["salt", "above"])
        p = F.col("free") / F.col("total") / (F.col("kinds") + 1 if k == 1 else F.lit(1.0))
        if lower is not None:
            rows = rows.withColumn("end", F.col("gram").bitwiseAND(F.lit((1 << 16 * (k - 1)) - 1))).join(lower, ["salt", "end"])
            p = p * F.col("shorter")
        p = p + (F.col("c") - F.col("off")) / F.col("total")
        if k < ORDER:
            lower = cut(rows.select("salt", F.col("gram").alias("end"), p.alias("shorter")), f"own{k}")
    return cut(rows.select("salt", "gram", F.ln(p).cast("float").alias("p")), "rest")


# --- scoring and bands ----------------------------------------------------------------------------

_SCORED = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_scored long, loss double, typical double"
#: Of texts with n-grams of the rest: each block's sum and size, and those n-grams with their blocks.
_OPEN = ", sums array<double>, sizes array<int>, at array<int>, asked array<long>"


def _medians(row: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
    """The median of each row's values; 0 for rows without."""
    value = value[np.lexsort((value, row))]
    n = np.bincount(row, minlength=rows)
    some = np.flatnonzero(n)
    first = (np.cumsum(n) - n)[some]
    out = np.zeros(rows)
    out[some] = (value[first + (n[some] - 1) // 2] + value[first + n[some] // 2]) / 2
    return out


def scored_column(spark: SparkSession, model: Model, text: Column, lang: Column, rest: bool = False) -> Column:
    """A struct of the base counts, of `loss`, the mean of -log p over a text's characters, and of `typical`, the
    median of that mean over the text's blocks of BLOCK characters.

    rest: n-grams that the model does not hold add nothing yet, and are named for finished()."""
    shared = spark.sparkContext.broadcast(model)

    def run(texts: pd.Series, salts: pd.Series) -> pd.DataFrame:
        texts, salts = texts.tolist(), salts.to_numpy(np.int64)
        out = pd.DataFrame([base_counts(t) for t in texts], columns=_SCORED.replace(",", "").split()[0:10:2])
        loss, n, rows, means = np.zeros(len(texts)), np.zeros(len(texts), np.int64), [], []
        sizes, asked, blocks = [], [], 0
        for group, lead in pieces(texts):
            row, g = grams(group, lead)
            if not len(g):
                continue
            hit, p = shared.value.own(salts[row], g) if rest else (None, shared.value.log_p(salts[row], g))
            p = -p
            loss += np.bincount(row, p, len(texts))
            begun = n[row[0]] if lead else 0
            n += np.bincount(row, minlength=len(texts))
            place = np.arange(len(row)) - np.searchsorted(row, row) + begun
            heads = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (place[1:] % BLOCK == 0)])
            rows.append(row[heads])
            sizes.append(np.diff(np.r_[heads, len(p)]))
            means.append(np.add.reduceat(p, heads) / sizes[-1])
            if rest:
                far = np.flatnonzero(~hit)
                asked.append((row[far], blocks + np.searchsorted(heads, far, "right") - 1, g[far].view(np.int64)))
                blocks += len(heads)
        typical = _medians(np.concatenate(rows), np.concatenate(means), len(texts)) if rows else loss
        out = out.assign(n_scored=n, loss=loss / np.maximum(n, 1), typical=typical)
        return _opened(out, rows, means, sizes, asked) if rest else out

    return F.pandas_udf(run, _SCORED + (_OPEN if rest else ""))(text.cast("binary"), salt_of(lang))


def _opened(out: pd.DataFrame, rows: list, means: list, sizes: list, asked: list) -> pd.DataFrame:
    """out with the columns of _OPEN, null for texts that ask nothing of the rest."""
    none = [None] * len(out)
    made = {c: list(none) for c in ("sums", "sizes", "at", "asked")}
    if rows:
        of, mean, size = np.concatenate(rows), np.concatenate(means), np.concatenate(sizes)
        row, block, g = (np.concatenate(x) for x in zip(*asked))
        heads = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else []
        for a, b in zip(heads, [*heads[1:], len(row)]):
            r = row[a]
            i, j = np.searchsorted(of, [r, r + 1])
            made["sums"][r], made["sizes"][r] = mean[i:j] * size[i:j], size[i:j].astype(np.int32)
            made["at"][r], made["asked"][r] = (block[a:b] - i).astype(np.int32), g[a:b]
    return out.assign(**{c: pd.Series(v, dtype=object) for c, v in made.items()})


def finished(scored: DataFrame, rest: DataFrame, row: str) -> DataFrame:
    """scored (with `row`, unique, `salt` and the columns of scored_column) with the n-grams of the rest looked up and
    added, so that loss and typical are those of all n-grams.

    An n-gram of the rest is in few texts, as frequent ones are held, so the lookup has no hot key."""
    asked = scored.filter("asked IS NOT NULL").select(row, "salt", F.explode(F.arrays_zip("at", F.col("asked").alias("gram"))).alias("x")).select(row, "salt", F.col("x.at").alias("at"), F.col("x.gram").alias("gram"))
    found = asked.join(rest, ["salt", "gram"]).groupBy(row).agg(F.sort_array(F.collect_list(F.struct("at", "p"))).alias("found"))

    @F.pandas_udf("loss double, typical double")
    def added(sums: pd.Series, sizes: pd.Series, at: pd.Series, p: pd.Series) -> pd.DataFrame:
        out = []
        for s, n, a, x in zip(sums, sizes, at, p):
            s = np.array(s, float)
            np.subtract.at(s, np.asarray(a, np.int64), np.asarray(x, float))
            out.append((s.sum() / np.sum(n), float(np.median(s / n))))
        return pd.DataFrame(out, columns=["loss", "typical"])

    more = scored.filter("asked IS NOT NULL").join(found, row).select(row, added("sums", "sizes", F.col("found.at"), F.col("found.p")).alias("new"))
    every = scored.drop("sums", "sizes", "at", "asked").join(more, row, "left")
    return cut(every.withColumns({c: F.coalesce(F.col(f"new.{c}"), F.col(c)) for c in ("loss", "typical")}).drop("new"), "whole")


def base_failed(words: Column, repeated: Column) -> Column:
    return (words < MIN_WORDS) | (100 * repeated > MAX_REPEAT_PERCENT * words)


def _passed() -> Column:
    return ~base_failed(F.col("n_words"), F.col("n_repeat_words"))


def _length_class(n: Column) -> Column:
    return F.floor(F.log2(F.greatest(n, F.lit(1)))).cast("int")


def bands(scored: DataFrame, width: float = BAND) -> DataFrame:
    """(salt, docs, middle, reach, by_length): of each language the rows, the band's middle and half width, and the
    half widths by length class, over all documents that pass the base rule. scored: with `salt`."""
    kept = scored.filter(_passed())
    median = lambda df, *by: df.groupBy(*by, "x").agg(F.count("*").alias("n")).groupBy(*by).agg(F.expr("percentile(x, 0.5, n)").alias("m"), F.sum("n").alias("passed"))
    on = lambda x: F.round(x / STEP).cast("long").alias("x")
    middles = cut(median(kept.select("salt", on(F.col("typical"))), "salt").select("salt", (F.col("m") * STEP).alias("middle"), "passed"), "mid")
    total = int(middles.agg(F.sum("passed")).first()[0] or 0)
    away = attach(kept.select("salt", "typical", "n_scored"), middles, "salt", "passed", total).select("salt", _length_class(F.col("n_scored")).alias("size"), on(F.abs(F.col("typical") - F.col("middle"))))
    half = F.col("m") * (1.4826 * width * STEP) + STEP
    trusted = F.col("passed") / (F.col("passed") + PRIOR)
    by_length = median(away, "salt", "size").groupBy("salt").agg(F.map_from_entries(F.collect_list(F.struct("size", half * trusted))).alias("by_length"))
    whole = median(away, "salt").select("salt", half.alias("reach"))
    rows = scored.groupBy("salt").agg(F.count("*").alias("docs"))
    return cut(rows.join(middles.drop("passed"), "salt").join(whole, "salt").join(by_length, "salt"), "bands")


def _verdict(s: str, band: str) -> Column:
    """kept: the base rule passed and the distance is within the language's reach. s, band: prefixes of columns."""
    reach = F.greatest(F.col(f"{band}reach"), F.try_element_at(F.col(f"{band}by_length"), _length_class(F.col(f"{s}n_scored"))))
    far = F.abs(F.col(f"{s}typical") - F.col(f"{band}middle")) > reach
    return ~base_failed(F.col(f"{s}n_words"), F.col(f"{s}n_repeat_words")) & ~F.coalesce(far, F.lit(False))


def quality_report(docs: DataFrame, size: int = MODEL) -> DataFrame:
    """A row for each document: doc_id, the counts, base_failed, kept, loss, typical. size: n-grams that workers hold,
    which has no bearing on the result."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")
    model, rest = train_whole(d, size)
    s = scored_column(docs.sparkSession, model, text_of(), F.col("lang"), rest is not None).alias("s")
    scored = cut(d.select("doc_id", F.monotonically_increasing_id().alias("row"), salt_of(F.col("lang")).alias("salt"), s).select("doc_id", "row", "salt", "s.*"), "qual")
    if rest is not None:
        scored = finished(scored, rest, "row")
    found = attach(scored, bands(scored), "salt", "docs", scored.count(), "left")
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~_passed()).alias("base_failed"), _verdict("", "").alias("kept"), F.round("loss", 6).alias("loss"), F.round("typical", 6).alias("typical"),
    )


def drop_poor(docs: DataFrame, size: int = MODEL) -> DataFrame:
    """The documents that pass the base rules and lie in their language's band, with all their columns."""
    s, salt, band, row = (fresh(docs, f"_gw_{c}") for c in ("scored", "salt", "band", "row"))
    model, rest = train_whole(docs, size)
    marks = {s: scored_column(docs.sparkSession, model, text_of(), F.col("lang"), rest is not None), salt: salt_of(F.col("lang")), row: F.monotonically_increasing_id()}
    marked = cut(docs.withColumns(marks), "qual")
    scored = marked.select(F.col(row).alias("row"), F.col(salt).alias("salt"), f"{s}.*")
    if rest is not None:
        scored = finished(scored, rest, "row")
        marked = marked.drop(s).join(scored.select(F.col("row").alias(row), F.struct(*[c for c in scored.columns if c not in ("row", "salt")]).alias(s)), row)
    limits = bands(scored)
    limits = limits.select(F.col("salt").alias(salt), F.col("docs").alias(band + "n"), F.struct("middle", "reach", "by_length").alias(band))
    found = attach(marked, limits, salt, band + "n", scored.count(), "left")
    return found.filter(_verdict(f"{s}.", f"{band}.")).select(*docs.columns)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(read(spark, sf_dir, "documents"))
