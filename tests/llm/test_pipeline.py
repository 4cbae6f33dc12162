from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from talentloom.llm import simhash
from talentloom.llm.common import made, materialize
from tests.llm.conftest import prose
from tests.llm.test_simhash import brute, plain


def test_stages_against_brute_force(spark, docs, tmp_path, corpus):
    item = prose(40, 777)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    leaky = spark.createDataFrame([(200, prose(50, 201) + " " + item.upper(), "en", "s", 1, 0)], docs.schema)
    current = docs.unionByName(leaky)
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        before = current.collect()
        current = materialize(stage(spark, current, str(tmp_path)), "t")
        after = current.collect()
        counts.append((name, len(after)))
        if name == "language ID":
            assert Counter(r["doc_id"] for r in after) == Counter(r["doc_id"] for r in before if any(c.isalpha() for c in r["text"] or ""))
        if name == "SimHash near-dedup":
            root = brute([plain(r["text"]) for r in before])
            assert len(after) == len(set(root))
        if name == "substring dedup":
            assert len(after) == len(before)
        if name == "benchmark decontamination":
            assert {r["doc_id"] for r in before} - {r["doc_id"] for r in after} == {200}
        if name != "BPE encoding":
            assert current.columns == docs.columns
    assert all(r["n_tokens"] == len(r["ids"]) for r in after)


def test_run_gives_the_same(spark):
    small = "/root/testdata/sf0.001"
    out = corpus_pipeline.run(spark, small)
    assert out.count() > 0 and "ids" in out.columns


def test_near_dedup_on_one_class(spark):
    rows = spark.createDataFrame([(i, "same text here now") for i in range(5)], "doc_id long, text string")
    assert [r["doc_id"] for r in simhash.near_dedup(rows).collect()] == [0]


def test_columns_of_operators_names_come_through(spark, docs, tmp_path):
    spark.createDataFrame([(1, prose(40, 777))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    names = ["score", "accepted", "lang_pred", "held_out", "n_words", "n_removed", "item_id", "_fp", "_n", "__waiting_0", "decoded_sha256"]
    marked = docs
    for n in [*names, "ids"]:
        marked = marked.withColumn(n, F.concat(F.lit(n), F.col("block").cast("string")))
    current = marked
    for name, stage in corpus_pipeline.STAGES:
        current = materialize(stage(spark, current, str(tmp_path)), "t")
        if name != "BPE encoding":
            assert current.columns == marked.columns
    rows = current.collect()
    assert rows and all(r[n] == f"{n}{r['block']}" for r in rows for n in names if n != "decoded_sha256")
    assert all(r["ids_input"] == f"ids{r['block']}" and len(r["ids"]) == r["n_tokens"] and len(r["decoded_sha256"]) == 64 for r in rows)


def test_empty_and_null_tables(spark, docs, tmp_path):
    spark.createDataFrame([(1, prose(40, 777))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    blank = spark.createDataFrame([(None, None, None, None, None)] * 3, "doc_id long, text string, lang string, source string, n_chars long")
    for k, rows in enumerate([docs.drop("block").limit(0), blank]):
        folder = tmp_path / str(k)
        rows.write.parquet(str(folder / "documents.parquet"))
        spark.read.parquet(str(tmp_path / "benchmark.parquet")).write.parquet(str(folder / "benchmark.parquet"))
        assert corpus_pipeline.run(spark, str(folder)).collect() == []


def test_run_leaves_only_what_its_result_reads(spark):
    before = made(spark)
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert made(spark) - before == 1 and out.count() > 0
