"""A benchmark from what is there: sources and ground truths matched one to one, and a manifest of the pairs.

Names come first: sources and truths of one stem are paired in the order of their ids. The rest is paired by texts: a shingle that stands in one truth only
votes for it, so that votes are a join with one truth a shingle, whatever is common to many. A pair's score is the share of the truth's own shingles that the
source holds. Pairs that are the best for both sides are accepted, both leave, and the others choose again until nobody has anybody left: with one score for both sides
that is the stable matching. Who stays alone is told with a reason.

Defined cases: null texts have no shingles, null stems pair with nothing; texts shorter than a shingle are one shingle; ties go to the smaller source, then truth; ids are distinct on
each side; extra columns are ignored; empty tables give none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talentloom.sources.io import written

SHINGLE = 5
PAIRS = "source_id long, truth_id long, score double, method string"


def stem_key(path: Column) -> Column:
    """The file's name without folders and extension, letters and digits only, in lower case."""
    name = F.regexp_extract(path, r"([^/\\]+?)(\.[^./\\]*)?$", 1)
    return F.nullif(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", ""), F.lit(""))


def shingles(text: Column, n: int = SHINGLE) -> Column:
    """Distinct hashes of n words in a row, in lower case."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([^\s]+)"), F.lit(1))
    starts = F.sequence(F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(1)))
    return F.when(F.size(words) > 0, F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice(words, i, n), " "))))).otherwise(F.array().cast("array<long>"))


def by_stem(sources: DataFrame, truths: DataFrame) -> DataFrame:
    """Pairs of equal stems, the k-th source of a stem with its k-th truth."""
    place = lambda df, i, p: df.select(F.col(i), stem_key(F.col("path")).alias(f"{p}_stem")).where(f"{p}_stem is not null").withColumn(f"{p}_k", F.row_number().over(Window.partitionBy(f"{p}_stem").orderBy(i)))
    a, b = place(sources, "source_id", "s"), place(truths, "truth_id", "t")
    return a.join(b, (F.col("s_stem") == F.col("t_stem")) & (F.col("s_k") == F.col("t_k"))).select("source_id", "truth_id", F.lit(1.0).alias("score"), F.lit("stem").alias("method"))


def votes(sources: DataFrame, truths: DataFrame) -> DataFrame:
    """(source_id, truth_id, score) of all pairs that share a shingle of one truth only."""
    own = truths.select("truth_id", F.explode(shingles(F.col("text"))).alias("h")).groupBy("h").agg(F.min("truth_id").alias("truth_id"), F.count("*").alias("n")).where("n = 1").drop("n")
    own = written(own)
    size = own.groupBy(F.col("truth_id").alias("_t")).agg(F.count("*").alias("_n"))
    said = sources.select("source_id", F.explode(shingles(F.col("text"))).alias("_h"))
    shared = said.join(own, F.col("_h") == F.col("h")).groupBy("source_id", "truth_id").agg(F.count("*").alias("_k"))
    return shared.join(size, F.col("truth_id") == F.col("_t")).select("source_id", "truth_id", (F.col("_k") / F.col("_n")).alias("score"))


def accepted(pairs: DataFrame) -> DataFrame:
    """The stable one-to-one matching of (source_id, truth_id, score): in each round the pairs that are both sides' best."""
    left, out = written(pairs), []
    rank = lambda side: F.row_number().over(Window.partitionBy(side).orderBy(F.desc("score"), "source_id", "truth_id"))
    while not left.isEmpty():
        now = written(left.withColumn("_a", rank("source_id")).withColumn("_b", rank("truth_id")).where("_a = 1 and _b = 1").drop("_a", "_b"))
        out.append(now)
        left = written(left.join(now.select("source_id"), "source_id", "left_anti").join(now.select("truth_id"), "truth_id", "left_anti").select("source_id", "truth_id", "score"))
    if not out:
        return pairs.limit(0)
    total = out[0]
    for more in out[1:]:
        total = total.unionByName(more)
    return total


def match_samples(sources: DataFrame, truths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs, alone) of sources (source_id, path, text) and truths (truth_id, path, text); alone: (side, id, reason)."""
    named = written(by_stem(sources, truths))
    free_s = sources.join(named.select("source_id"), "source_id", "left_anti")
    free_t = truths.join(named.select("truth_id"), "truth_id", "left_anti")
    proposed = written(votes(free_s, free_t))
    pairs = named.unionByName(accepted(proposed).withColumn("method", F.lit("text")))
    alone = lambda df, i, side: df.join(pairs.select(i), i, "left_anti").join(proposed.select(i, F.lit(True).alias("_p")).distinct(), i, "left").select(F.lit(side).alias("side"), F.col(i).alias("id"), F.when(F.col("_p"), "taken by others").otherwise("nothing in common").alias("reason"))
    return pairs, alone(free_s, "source_id", "source").unionByName(alone(free_t, "truth_id", "truth"))


def manifest(pairs: DataFrame, sources: DataFrame, truths: DataFrame) -> DataFrame:
    """One row a sample: sample_id of both stems, paths, kind of source, notes."""
    s = sources.select(F.col("source_id").alias("_s"), F.col("path").alias("source_path"))
    t = truths.select(F.col("truth_id").alias("_t"), F.col("path").alias("ground_truth_path"))
    name = lambda c: F.regexp_extract(c, r"([^/\\]+?)(\.[^./\\]*)?$", 1)
    rows = pairs.join(s, F.col("source_id") == F.col("_s")).join(t, F.col("truth_id") == F.col("_t"))
    kind = F.when(F.lower("source_path").endswith(".pdf"), "pdf").otherwise("image")
    return rows.select(F.concat(name(F.col("ground_truth_path")), F.lit("__"), name(F.col("source_path"))).alias("sample_id"), "source_path", "ground_truth_path", kind.alias("source_kind"), F.concat(F.lit("proxy_ground_truth_by_"), "method").alias("notes"))
