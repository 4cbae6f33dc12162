import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa

from talentloom.llm import blocks as B
from talentloom.llm import textnp
from talentloom.llm.substring_dedup import FingerprintIndex, kept_texts, op10_substring_dedup, ripe, substring_dedup
from tests.llm.conftest import prose


def brute(corpus, window):
    seen = Counter()
    words = [(i, (t or "").encode().split()) for i, t in corpus]
    for _, w in words:
        seen.update(tuple(w[k : k + window]) for k in range(len(w) - window + 1))
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_query_matches_brute_force(spark, sf, corpus):
    got = sorted((tuple(r) for r in op10_substring_dedup(spark, sf).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str)
    assert got == brute(corpus, 35)


def digests(part, gone, rows):
    total = np.concatenate([[0], np.cumsum(gone)])
    hashes = [hashlib.sha256(x).hexdigest() for x in kept_texts(part, "text", gone, rows)]
    return pa.table({"doc_id": part.column("doc_id"), "n": pa.array(np.diff(rows), pa.int64()), "gone": pa.array(total[rows[1:]] - total[rows[:-1]], pa.int64()), "h": hashes})


def answers(index):
    return sorted((tuple(r) for r in index.removals(digests, "doc_id long, n long, gone long, h string").collect()), key=str)


def entries(index, level):
    return sum(len(textnp.unpack(r["keys"], np.uint64, delta=True)) for run in index.runs(level) for r in run.collect())


def test_each_batch_answers_for_all_so_far(spark, docs, corpus):
    """After every batch, held against brute force over the batches until then; a batch tells which old blocks it changed."""
    index, older = FingerprintIndex(spark, window=12), set()
    for k in range(4):
        changed = {r["block"] >> 48 for r in index.add(docs.where(f"block % 4 = {k}").select("doc_id", "text")).collect()}
        assert answers(index) == brute([x for i, x in enumerate(corpus) if i % 4 <= k], 12)
        assert len(index.runs("anchors")) <= 2
        older |= changed - {k}
    assert older  # blocks of earlier batches that later ones changed


def test_compaction_shrinks_and_changes_nothing(spark, docs, corpus):
    index = FingerprintIndex(spark, window=12, parts=3)
    for k in range(2):
        index.add(docs.where(f"block % 2 = {k}").select("doc_id", "text"))
    before = {level: entries(index, level) for level in ("anchors", "windows")}
    rows = sum(r.count() for r in index.runs("anchors"))
    index.compact()
    assert all(0 < entries(index, level) < n for level, n in before.items())
    assert len(index.runs("anchors")) == 1 and sum(r.count() for r in index.runs("anchors")) < rows
    assert answers(index) == brute(corpus, 12)
    index.parts = 7  # ranges of another width
    index.compact()
    index.add(docs.select("doc_id", "text"))
    assert answers(index) == brute(corpus + corpus, 12)


def test_an_index_goes_on_from_its_manifest(spark, docs, corpus):
    index = FingerprintIndex(spark, window=12)
    index.add(docs.where("block % 2 = 0").select("doc_id", "text"))
    again = FingerprintIndex.open(spark, index.path)
    again.add(docs.where("block % 2 = 1").select("doc_id", "text"))
    assert answers(again) == answers(FingerprintIndex.open(spark, index.path)) == brute(corpus, 12)


def test_runs_are_sorted_and_without_repeats(spark, docs):
    index = FingerprintIndex(spark, window=12, parts=5)
    index.add(docs.select("doc_id", "text"))
    for r in index.runs("anchors")[0].collect():
        keys = textnp.unpack(r["keys"], np.uint64, delta=True)
        assert (keys[1:] > keys[:-1]).all() and set(B.range_of(keys, 5).tolist()) == {r["part"]}


def test_passage_that_repeats_inside_one_document_alone(spark):
    text = " ".join(f"a{i}" for i in range(40))
    rows = [(1, text + " mid " + text), (2, " ".join(f"b{i}" for i in range(90))), (3, "w " * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substring_dedup(df).collect()}
    assert got == {1: (81, 80), 2: (90, 0), 3: (3000, 3000)}


def test_texts_and_other_columns(docs, corpus):
    out = substring_dedup(docs.withColumnRenamed("source", "n_words"))
    assert out.columns == ["doc_id", "text", "lang", "n_chars", "block", "n_words", "n_removed"]
    rows = {r["block"]: r for r in out.collect()}
    for k, (_, text) in enumerate(corpus):
        assert rows[k]["n_removed"] > 0 or rows[k]["text"] == text


def test_empty_table(empty):
    assert substring_dedup(empty).collect() == []


def test_batches_rewrite_each_entry_a_logarithm_of_times():
    """Text of merged runs over n batches is at most log_1.5(n) times all text (over 16 equal ones: at most 4 times), and runs stay few."""
    rng = np.random.default_rng(1)
    for n, draw in ((16, lambda: 1), (1000, lambda: 1), (1000, lambda: int(rng.integers(1, 100)))):
        sizes, moved, total = [], 0, 0
        for _ in range(n):
            while ripe(sizes):
                sizes[-2:] = [sizes[-2] + sizes[-1]]
                moved += sizes[-1]
            sizes.append(draw())
            total += sizes[-1]
            assert len(sizes) <= 3 + np.log2(total)
        assert moved <= np.log(n) / np.log(1.5) * total and sum(sizes) == total
        assert n != 16 or moved <= 4 * total


def test_runs_are_merged_by_size(spark):
    index = FingerprintIndex(spark, window=12, parts=4)
    for k in range(3):
        index.add(spark.createDataFrame([(k, prose(120, k))], "doc_id long, text string"), 1 << 10)
    assert index.state["sizes"] == [2 << 10, 1 << 10] and len(index.runs("anchors")) == len(index.runs("windows")) == 2
    again = FingerprintIndex.open(spark, index.path)
    assert again.state["sizes"] == index.state["sizes"]
