"""A training-corpus pipeline: five stages over documents, each written and read again as the next one's input."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentloom.llm import bpe, decontaminate, langid, simhash, substring_dedup
from talentloom.llm.common import clean, made, materialize, table

CORE = ["doc_id", "text", "lang", "source", "n_chars"]


def beside(stage):
    """The stage on the columns of documents alone: others wait under names of their own, so that no column of an operator meets one of the input's.

    They come back under their names and in their places; where the last stage adds a column of such a name, the input's gets `_input` behind it.
    """

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        waiting = {c: f"__waiting_{i}" for i, c in enumerate(docs.columns) if c not in CORE}
        out = stage(spark, docs.select(*[F.col(f"`{c}`").alias(waiting.get(c, c)) for c in docs.columns]), sf_dir)
        added = {c.lower() for c in out.columns} - set(waiting.values()) - {c.lower() for c in docs.columns if c in CORE}
        names = {w: c if c.lower() not in added else f"{c}_input" for c, w in waiting.items()}
        return out.select(*[F.col(f"`{c}`").alias(names.get(c, c)) for c in out.columns])

    run.__name__, run.__doc__ = stage.__name__, stage.__doc__
    return run


@beside
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or whose language stays unsure, go."""
    model = langid.train(langid.training_rows(docs))
    return langid.predict(docs, model).where("accepted").select(*docs.columns)


@beside
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of linked SimHash fingerprints stays."""
    return simhash.near_dedup(docs)


@beside
def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words under repeated windows go; documents stay, if need be with an empty text."""
    cut = substring_dedup.substring_dedup(docs)
    chars = F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", chars).select(*docs.columns)


@beside
def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


@beside
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with the digest of the text decoded from them."""
    return bpe.bpe_encode(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_near_copies),
    ("substring dedup", cut_repeated_passages),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("BPE encoding", encode),
]

#: Language ID and SimHash classes are no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents. Once a stage is written, what it and its predecessor left in the shared folder goes."""
    docs, before = table(spark, sf_dir, "documents"), made(spark)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage_" + name.lower().replace(" ", "_"))
        clean(spark, since=before, keep=1)
    return STAGES[-1][1](spark, docs, sf_dir)
