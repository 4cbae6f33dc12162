"""Text embedding and pair re-ranking with pluggable models."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

DIM = 384


def hash_embedding(text: str | None, dim: int = DIM) -> np.ndarray:
    """Signed hashed words, unit length; the zero vector for no words."""
    out = np.zeros(dim, np.float32)
    for word in (text or "").lower().split():
        h = zlib.crc32(word.encode())
        out[h % dim] += 1 if h >> 31 else -1
    n = np.linalg.norm(out)
    return out / n if n else out


def embed(texts: Column, model=hash_embedding) -> Column:
    """Unit vectors of a text column; model: text -> vector, loaded once a worker."""

    @F.pandas_udf(ArrayType(FloatType()))
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: model(t).tolist())

    return run(texts)


def token_overlap(a: Column, b: Column) -> Column:
    """The default pair scorer: shared words over the words of a."""
    words = lambda x: F.array_distinct(F.filter(F.split(F.lower(x), r"\s+"), lambda w: w != ""))
    return F.size(F.array_intersect(words(a), words(b))) / F.greatest(F.size(words(a)), F.lit(1))


def rerank(rows: DataFrame, group: str, rank: str, scorer: Column | None, tie: str) -> DataFrame:
    """rows with cross_rank by the pair score; without a scorer, or where the score is null, the old order stays."""
    score = scorer if scorer is not None else F.lit(None).cast("double")
    w = Window.partitionBy(group).orderBy(F.desc_nulls_last("cross_score"), rank, tie)
    return rows.withColumn("cross_score", score).withColumn("cross_rank", F.row_number().over(w))
