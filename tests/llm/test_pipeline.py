import os

import numpy as np
import pytest

import corpus_pipeline
from galeward.llm import mixing, quality, simhash

pytestmark = pytest.mark.skipif(not os.path.exists("/opt/tokenizers/word_bpe_49k.json"), reason="no vocabulary here")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(0)
    stems = ["the", "and", "ing", "tion", "er", "on", "at", "re"]
    text = lambda: " ".join("".join(rng.choice(stems, 3)) for _ in range(int(rng.integers(60, 200)))) + "."
    rows = [(i, text(), "en", f"s{i % 3}", 0) for i in range(60)]
    rows += [(100 + i, rows[i][1].replace(" ", "  ", 1), "en", "s0", 0) for i in range(10)]  # exact copies
    near = lambda t: t[:-1] + "ing."
    rows += [(150 + i, near(near(rows[20 + i][1]) if i % 2 else rows[20 + i][1]), "en", "s2", 0) for i in range(12)]  # near copies
    rows += [(200, "too short", "en", "s1", 0), (201, None, None, None, None), (202, "again and again " * 40, "en", "s2", 0)]
    path = tmp_path_factory.mktemp("pipe")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(path / "documents.parquet"))
    return str(path), rows


def test_stages_take_effect(spark, folder):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs.write.parquet(f"{path}/{name}.parquet")
        docs = spark.read.parquet(f"{path}/{name}.parquet")
        seen[name] = sorted(r.doc_id for r in docs.collect())
    kept = {r.doc_id for r in quality.quality_report(spark.read.parquet(f"{path}/documents.parquet")).filter("kept").collect()}
    assert set(seen["quality_rules"]) == kept and not kept & {200, 201, 202} and len(kept) >= 68
    texts = {i: (t or "") for i, t, *_ in rows}
    # of the copies the one with a doubled blank is the longer, so it stays
    bare = lambda i: texts[i].replace(" ", "")
    best: dict = {}
    for i in sorted(kept):
        j = best.get(bare(i), i)
        best[bare(i)] = max(i, j, key=lambda k: (len(texts[k]), -k))
    assert seen["exact_dedup"] == sorted(best.values())
    fps = {i: simhash.fingerprint(texts[i].encode()) for i in seen["exact_dedup"]}
    near = [(a, b) for a in fps for b in fps if a < b and bin(fps[a] ^ fps[b]).count("1") <= 2]
    least = {i: i for i in fps}
    for _ in fps:  # until the least id has gone round
        for a, b in near:
            least[a] = least[b] = min(least[a], least[b])
    assert near and seen["near_dedup"] == sorted({least[i] for i in fps})
    mixed = {r.doc_id: r.copies for r in mixing.mix(spark.read.parquet(f"{path}/near_dedup.parquet")).collect()}
    assert seen["mix_sources"] == sorted(i for i, n in mixed.items() for _ in range(n))
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, path).collect()
    assert {r.doc_id for r in pieces} == set(seen["mix_sources"])
    assert sum(r.length for r in pieces) == sum(r.doc_tokens for r in pieces if r.start == 0)


def test_run_equals_the_stages(spark, folder):
    path, _ = folder
    assert corpus_pipeline.run(spark, path).count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "near_dedup", "mix_sources", "pack_windows"]
