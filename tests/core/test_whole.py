"""Queries over whole tables and texts against brute force."""

import re

from talentloom.operators import resolve, topk
from talentloom.plans import catalog


def test_ordered_distinct_reads_whole_texts(spark, tmp_path):
    texts = ["Alpha beta\tALPHA " + "pad " * 60 + "Omega\nbeta omega end", "", None, "  one  One "]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))

    def plain(text):
        first = {}
        for w in re.split("[ \t\n\r]+", text or ""):
            if w:
                first.setdefault(w.lower(), w)
        return " ".join(first.values())

    got = {r["doc_id"]: r["words"] for r in catalog.QUERIES["ordered_distinct_whole"](spark, str(tmp_path)).collect()}
    assert {k: v or "" for k, v in got.items()} == {k: plain(t) for k, t in enumerate(texts)}


def test_error_rates_read_whole_texts(spark, tmp_path):
    text = "x" * 200 + " the end here"  # all edits are behind character 200
    spark.createDataFrame([(0, text)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    run = lambda name: catalog.QUERIES[name](spark, str(tmp_path)).collect()
    assert run("char_error_rate_whole")[0]["cer"] == round(5 / len(text), 6)
    rows = {r["engine"]: (r["ok"], r["mean_cer"], r["mean_wer"]) for r in run("ocr_engine_summary_whole")}
    assert rows == {"a": (1, round(4 / len(text), 6), 0.75), "b": (1, round(2 / len(text), 6), 0.5)}


def test_vector_search_takes_queries_in_blocks(spark):
    v = spark.createDataFrame([(i, [float(i % 7), float(i % 5)]) for i in range(60)], "id long, v array<float>")
    got = topk.vector_topk_blocks(v, v, 3, "id", "v", "id", "v", block_rows=24)
    vec = {r["id"]: r["v"] for r in v.collect()}
    score = lambda a, b: sum(x * y for x, y in zip(vec[a], vec[b], strict=True))
    want = {(a, b, n) for a in vec for n, b in enumerate(sorted(vec, key=lambda b: (-score(a, b), b))[:3], 1)}
    assert {(r["query_id"], r["match_id"], r["rank"]) for r in got.collect()} == want


def test_weak_evidence_needs_review(spark):
    rows = [
        (1, "ann lee", "a@x.org", None), (2, "ann lee", "a@x.org", None), (3, "bob ray", None, "info@x.org"), (4, "cy day", None, "info@x.org"),
        (5, "dee", None, "me@y.org"), (6, "", None, "me@y.org"), (7, "eve", None, None), (8, "eve", None, None), (9, "ann lee", None, None), (10, "fay", None, "one@z.org"),
    ]
    people = spark.createDataFrame(rows, "id long, name string, email string, generic string")
    out = resolve.review_groups(resolve.resolve(people, [("real_email", "email")], "name", "id"), "name", "generic", [("same_normalized_name", "name")])
    got = {r["id"]: (r["dedup_status"], r["dedup_confidence"], r["evidence_type"]) for r in out.collect()}
    merged, clash = ("auto_merged", 0.98, "real_email"), ("conflict_detected_no_merge", 0.0, "generic_email_conflict")
    review = lambda kind: ("possible_duplicate_needs_review", 0.4, kind)
    email, name = review("generic_email_group"), review("same_normalized_name")
    assert got == {1: merged, 2: merged, 3: clash, 4: clash, 5: email, 6: email, 7: name, 8: name, 9: name, 10: ("unique_candidate", 1.0, "none")}


def test_distinct_words_of_long_texts_need_no_python(spark, capsys):
    """lists of words of whole batches of texts went through Python workers, whose memory grew with the batch."""
    from pyspark.sql import functions as F

    from talentloom.functions.text import distinct_folded, distinct_folded_long

    df = spark.createDataFrame([(["b", "A", " a  x ", None, "", "B", "a x", "É", "é"],), (None,), ([],), ([f"w{i % 700}" for i in range(20000)],)], "v array<string>")
    out = df.select(distinct_folded_long(F.col("v")).alias("a"), F.when(F.size("v") < 100, distinct_folded(F.col("v"))).alias("b"))
    rows = out.collect()
    assert [r["a"] for r in rows[:3]] == [r["b"] if i != 1 else None for i, r in enumerate(rows[:3])]
    assert rows[3]["a"] == [f"w{i}" for i in range(700)]
    capsys.readouterr()
    out.explain()
    assert "Python" not in capsys.readouterr().out
