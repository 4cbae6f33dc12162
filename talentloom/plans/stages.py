"""Stored vector index and stage driver as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from talentloom.operators import vector_index
from talentloom.plans.ranking import VEC_SQL, K
from talentloom.plans.registry import query, table
from talentloom.sources.io import fresh_path
from talentloom.sources.versioned import VersionedTable
from talentloom.streaming.stage import PROVIDER_ERROR, Stage

C = F.col


def _searched(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    path = fresh_path(spark, "vector_index")
    vector_index.build(e, path, "vec_id", "embedding")
    return vector_index.VectorIndex(spark, path).search(e.where(C("vec_id") % 20 == 0), "vec_id", "embedding", K)


@query("vec_index_topk", f"WITH {VEC_SQL} SELECT query_id, match_id, round(score, 6) AS score, rank FROM ranked WHERE rank <= {K}")
def vec_index_topk(spark, d):
    """The stored index, loaded and searched: the same rows as a scan of all vectors."""
    return _searched(spark, d)[0].select("query_id", "match_id", F.round("score", 6).alias("score"), "rank")


@query("vec_index_report")
def vec_index_report(spark, d):
    """How many pairs of queries and cells the bound left unread."""
    counts = _searched(spark, d)[1]
    share = round(1 - counts["read"] / counts["pairs"], 6) if counts["pairs"] else 0.0
    return spark.createDataFrame([(counts["queries"], counts["cells"], counts["pairs"], counts["read"], share)], "queries long, cells long, pairs long, pairs_read long, share_unread double")


SHORT, FLAKY = 25, 7


def structuring(rows):
    """A stand-in for extraction: short texts are skipped, texts without language rejected, some lengths fail at the first attempt only."""
    words = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"([^ \t\n\r\f\x0B]+)"), F.lit(1)))
    flaky = (F.char_length("text") % FLAKY == 0) & (C("attempt") == 1)
    state = F.when(words < SHORT, "skipped").when(C("lang").isNull(), "rejected").when(flaky, "failed").otherwise("success")
    kind = F.when(state == "rejected", "business_validation_error").when(state == "failed", PROVIDER_ERROR)
    return rows.select("item", "attempt", state.alias("state"), kind.alias("failure_type"), F.when(state == "failed", "429").alias("error"), words.alias("words"))


@query("stage_ledger", rf"""WITH w AS (SELECT doc_id, text, lang, len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\r\f\x0B]+')) AS words FROM documents)
SELECT doc_id AS item, CASE WHEN words < {SHORT} THEN 'skipped' WHEN lang IS NULL THEN 'rejected' ELSE 'success' END AS state, CAST(CASE WHEN words >= {SHORT} AND lang IS NOT NULL AND length(text) % {FLAKY} = 0 THEN 2 ELSE 1 END AS INT) AS attempts FROM w""")
def stage_ledger(spark, d):
    """All documents through a stage in epochs of files, the failed ones once more; the ledger's last states."""
    docs = table(spark, d, "documents").select(C("doc_id").alias("item"), "text", "lang")
    source, root = fresh_path(spark, "stage_source"), fresh_path(spark, "stage")
    docs.repartitionByRange(6, "item").write.parquet(source)
    stage = Stage(spark, root, source, "item long, text string, lang string", structuring, saturation=1 << 30, files_per_epoch=2)
    stage.run("first")
    stage.resume_failed("again")
    return stage.states().select("item", "state", "attempts")


@query("versioned_upsert", """WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS quality FROM documents)
SELECT coalesce(n.doc_id, l.doc_id) AS doc_id, CAST(coalesce(n.quality, l.quality) AS BIGINT) AS quality, CASE WHEN l.doc_id IS NOT NULL THEN 1 ELSE 2 END AS created_at, CASE WHEN n.doc_id IS NOT NULL THEN 2 ELSE 1 END AS updated_at FROM n FULL JOIN labels l ON n.doc_id = l.doc_id""")
def versioned_upsert(spark, d):
    """Labels committed as a first version, lengths of all documents as a second; the newest version is read."""
    kept = VersionedTable(spark, fresh_path(spark, "versioned"), "doc_id long, quality long, created_at int, updated_at int")
    kept.upsert(table(spark, d, "labels").select("doc_id", C("quality").cast("long").alias("quality")), "doc_id", F.lit(1))
    kept.upsert(table(spark, d, "documents").select("doc_id", F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("quality")), "doc_id", F.lit(2))
    return kept.read()


@query("benchmark_bootstrap", r"""WITH w AS (SELECT item_id, len(regexp_extract_all(text, '[^ \t\n\r\f\x0B]+')) AS n FROM benchmark)
SELECT 'truth_' || item_id || '__' || CASE WHEN item_id % 2 = 0 THEN 'Truth ' || item_id ELSE 'scan' || (item_id * 7 + 3) END AS sample_id, CASE WHEN item_id % 2 = 0 THEN 'pdf' ELSE 'image' END AS source_kind,
'proxy_ground_truth_by_' || CASE WHEN item_id % 2 = 0 THEN 'stem' ELSE 'text' END AS notes FROM w WHERE n > 0""")
def benchmark_bootstrap(spark, d):
    """Items as ground truths; as sources, read with every ninth word lost, under like names or as numbered scans: the manifest of the pairs found."""
    from talentloom.operators import benchmarking as M

    rows = table(spark, d, "benchmark").select("item_id", "text")
    i = C("item_id").cast("string")
    words = F.regexp_extract_all("text", F.lit(r"([^ \t\n\r\f\x0B]+)"), F.lit(1))
    heard = F.array_join(F.filter(F.transform(words, lambda x, k: F.when((k + 1) % 9 != 0, x)), lambda x: x.isNotNull()), " ")
    path = F.when(C("item_id") % 2 == 0, F.concat(F.lit("raw/Truth "), i, F.lit(".pdf"))).otherwise(F.concat(F.lit("raw/scan"), (C("item_id") * 7 + 3).cast("string"), F.lit(".png")))
    truths = rows.select(C("item_id").alias("truth_id"), F.concat(F.lit("gt/truth_"), i, F.lit(".txt")).alias("path"), "text")
    sources = rows.select((C("item_id") + 1_000_000).alias("source_id"), path.alias("path"), heard.alias("text"))
    pairs, _ = M.match_samples(sources, truths)
    return M.manifest(pairs, sources, truths).select("sample_id", "source_kind", "notes")
