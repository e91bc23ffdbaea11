import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from galeward.llm import packing as P

VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"
pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary here")
TEXTS = ["", " \n", "Hello, world! It's 2024... don't", "Été  à\tla plage x éa", "日本語 のテキスト 𝔘nicode", "a\x1cb c\x0bd", "<|endoftext|> x<|startoftext|>y", "ΣΑΣ Ω's 'RE", "x" * 300 + " y", "́lone mark ́ again", "ĳ ﬁ İstanbul ​ zero", "end. End, é. 5!! x"'"s. don"'"t, a.b.c... A.B; q<| W.", "Ångström’s, \u0130."]


def test_ids_are_the_tokenizers():
    from tokenizers import Tokenizer

    t, w = Tokenizer.from_file(VOCABULARY), P.WordIds(VOCABULARY)
    for x in TEXTS:
        assert np.frombuffer(w.of(x.encode()), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids, x


def test_rounds_serve_every_id_once():
    rng = random.Random(2)
    for totals in ([5, 0, 17, 1], [1], [64], [rng.randrange(1, 300) for _ in range(9)]):
        for window in (8, 16):
            keys = [f"0{k}" for k in range(len(totals))]
            r, large = P.Rounds(totals, window, None, keys), P.Rounds(totals, window, None, keys)
            large.small = None  # as when 64 bits are too few
            assert [x for q, n in enumerate(totals) if n for x in r.pieces(q, 0, n)] == [x for q, n in enumerate(totals) if n for x in large.pieces(q, 0, n)]
            seen = defaultdict(dict)
            for q, n in enumerate(totals):
                k = 0
                while k < n:
                    m = min(rng.randrange(1, 40), n - k)
                    for start, length, seq, offset in r.pieces(q, k, m):
                        for j in range(length):
                            assert offset + j not in seen[seq]
                            seen[seq][offset + j] = (q, k + start + j)
                    k += m
            total = sum(totals)
            assert sorted(seen) == list(range(len(seen)))
            sizes = [len(seen[s]) for s in sorted(seen)]
            assert all(sorted(seen[s]) == list(range(n)) for s, n in zip(sorted(seen), sizes))
            assert sizes[: total // window] == [window] * (total // window) and all(n & (n - 1) == 0 for n in sizes)
            ids = [seen[s][o] for s in sorted(seen) for o in range(len(seen[s]))]
            assert len(set(ids)) == total
            got = Counter()
            for place, (q, _) in enumerate(ids, 1):  # no queue strays from its share
                got[q] += 1
                if place % window == 0:
                    assert all(abs(got[k] - place * t / total) <= 1 + len(totals) + window * t / total for k, t in enumerate(totals))


def test_round_trip(spark):
    from tokenizers import Tokenizer

    rng = random.Random(4)
    rows = [(i, t, "abc"[i % 3], 1) for i, t in enumerate(TEXTS)] + [(50, None, None, 1), (None, "no id", "a", 1), (60, "twice", "b", 1), (60, "twice", "b", 1), (70, "long " * 3000, "hot", 1)]
    rows += [(100 + i, " ".join(rng.choice(["the", "Wörter", "xyzzy", "12"]) for _ in range(rng.randrange(90))), "hot", 1) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, queue int")
    got = P.pack(docs, window=256).collect()
    t = Tokenizer.from_file(VOCABULARY)
    want = Counter((i, tuple([*t.encode(x or "", add_special_tokens=False).ids, 2])) for i, x, _, _ in rows)
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for seq in by_seq.values():
        seq.sort(key=lambda r: r.offset)
        assert [r.offset for r in seq] == [0, *np.cumsum([r.length for r in seq])[:-1].tolist()]
    full = sorted(sum(r.length for r in s) for s in by_seq.values())
    assert all(n <= 256 and n & (n - 1) == 0 for n in full)
    made = Counter()
    for doc, pieces in by_doc.items():
        if doc == 60:
            assert Counter((r.start, r.length, r.ids) for r in pieces) and sum(r.length for r in pieces) == 2 * pieces[0].doc_tokens
            made[(60, next(k[1] for k in want if k[0] == 60))] += 2
            continue
        pieces.sort(key=lambda r: r.start)
        ids = b"".join(r.ids for r in pieces)
        assert [r.start for r in pieces] == [0, *np.cumsum([r.length for r in pieces])[:-1].tolist()] and {r.doc_tokens for r in pieces} == {len(ids) // 4}
        made[(doc, tuple(np.frombuffer(ids, "<u4").tolist()))] += 1
    assert made == want
    assert P.pack(docs.filter("false")).count() == 0
    assert P.pack_report(docs).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_ids_of_mixed_up_texts():
    from tokenizers import Tokenizer

    t, w = Tokenizer.from_file(VOCABULARY), P.WordIds(VOCABULARY)
    rng = random.Random(9)
    parts = ["a", "B", "é", "É", "1", "٣", ".", ",", "!", "?", ";", ":", "'s", "'", "-", "́", "’", "ß", "中", " ", "\n", "\x0b", "\x1c", " ", "<", "|", ">", "İ", "Σ", "$", "_", "😀"]
    letters = "aeéèßñöüçïσςабжあ中ｆﬁǆⅷªʰ"
    for _ in range(3000):
        x = "".join(rng.choice(letters) for _ in range(rng.randrange(1, 12)))
        assert np.frombuffer(w.of(x.encode()), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids, repr(x)
        x = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        assert np.frombuffer(w.of(x.encode()), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids, repr(x)
        assert np.frombuffer(w.of_all(pa.array(["", x, "b", x]).slice(1))[0], "<u4").tolist() == [*t.encode(x, add_special_tokens=False).ids, 2], repr(x)


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(P, "REMEMBERED", 5)
    few, all_ = P.WordIds(VOCABULARY), {}
    for x in [f"w{i % 7}x{i % 3}." for i in range(60)]:
        assert all_.setdefault(x, few.of(x.encode())) == few.of(x.encode())
        assert len(few) <= 7


def test_many_queues_are_packed_alike_by_either_way(spark):
    rng = random.Random(4)
    rows = [(i, "word " * rng.choice([0, 1, 3, 40, 400]), None if i % 97 == 0 else f"site{i % 61 if i % 3 else 0}") for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    table = sorted(map(tuple, P.pack(docs, window=128, with_ids=False).collect()))
    assert table == sorted(map(tuple, P.pack(docs, window=128, with_ids=False, queues=3).collect()))
    assert P.pack(docs.filter("false"), queues=-1).count() == 0


def test_over_1024_sources_keep_their_proportions_in_every_window(spark):
    n = P.QUEUES + 200
    rows = [(k * n + i, "word " * (199 if i == 0 else 3), f"s{i:05}") for i in range(n) for k in range(2)]
    got = P.pack(spark.createDataFrame(rows, "doc_id long, text string, source string"), window=1024).collect()
    total, full = sum(r.length for r in got), [r for r in got if r.sequence_id < sum(x.length for x in got) // 1024]
    hot, by_seq = Counter(), Counter()
    for r in full:
        by_seq[r.sequence_id] += r.length
        hot[r.sequence_id] += r.length * (r.queue == "s00000")
    share = 400 / total
    assert all(v == 1024 for v in by_seq.values())
    so_far = np.cumsum([hot[s] for s in sorted(by_seq)])  # what is ahead or behind at a window's end is less than a round's part
    assert all(abs(x - 1024 * share * k) <= 1024 * share + 2 for k, x in enumerate(so_far.tolist(), 1))
    small = Counter(r.queue for r in full for _ in range(r.length))
    assert len(small) == n


def test_words_behind_marks_and_capitals_are_told_once_and_by_themselves():
    from tokenizers import Tokenizer

    t, w, asked = Tokenizer.from_file(VOCABULARY), P.WordIds(VOCABULARY), []

    class Whole:
        def encode(self, text, **how):
            asked.append(text)
            return t.encode(text, **how)

    w.model = Whole()
    texts = ["Éréaux, éréaux; ÉRÉAUX! word. word, Word;", "", None, "Übung?! übung !?word, 中,", "a <|endoftext|> word, <|x"]
    got = w.of_all(pa.array(texts[:4]).fill_null(""))
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [[*t.encode(x or "", add_special_tokens=False).ids, 2] for x in texts[:4]]
    assert set(asked) <= {"", ",", ";", "!", ".", "?!", "!?word", "中,"}  # the rest is split by the vocabulary's model alone
    assert not [x for x in w if x.startswith(b"word") and x != b"word"]  # no word is kept again with its marks
    got = w.of_all(pa.array(["word", *texts]).slice(1).fill_null(""))
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [[*t.encode(x or "", add_special_tokens=False).ids, 2] for x in texts]
