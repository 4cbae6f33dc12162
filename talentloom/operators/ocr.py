"""Text recognition metrics: character and word error rates, engine summaries."""

import sys
import unicodedata
from typing import Iterator  # noqa: UP035  (Spark reads the annotation of a pandas UDF)

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

# small helpers travel with the tasks, so that workers need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def cer(truth: Column, said: Column) -> Column:
    """Character edits over the truth's length."""
    return F.levenshtein(truth, said) / F.greatest(F.length(truth), F.lit(1))


def _column(a: list, b: list) -> np.ndarray:
    """Edits between every prefix of a (0 to all) and the whole of b: a bit-parallel column of the edit table, a bit for each element of a."""
    n = len(a)
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << n) - 1
    up, down = full, 0  # where the column grows and falls by one
    for x in b:
        hit = where.get(x, 0)
        straight = (((hit & up) + up) ^ up) | hit | down
        plus, minus = down | ~(straight | up) & full, up & straight
        plus = (plus << 1 | 1) & full
        minus = minus << 1 & full
        up, down = minus | ~(straight | plus) & full, plus & straight
    bits = lambda v: np.unpackbits(np.frombuffer(v.to_bytes(n // 8 + 1, "little"), np.uint8), bitorder="little")[:n].astype(np.int64)
    return len(b) + np.concatenate([[0], np.cumsum(bits(up) - bits(down))])


def edit_counts(truth: list, said: list) -> tuple[int, int, int]:
    """(substitutions, losses, additions) of an alignment with the fewest edits, in memory linear in the lengths.

    The said half is cut where both halves' columns add up to the least; halves are aligned on their own.
    """
    swapped = lost = added = 0
    stack = [(list(truth), list(said))]
    while stack:
        a, b = stack.pop()
        k = 0
        while k < min(len(a), len(b)) and a[k] == b[k]:
            k += 1
        a, b = a[k:], b[k:]
        k = 0
        while k < min(len(a), len(b)) and a[-1 - k] == b[-1 - k]:
            k += 1
        a, b = a[: len(a) - k], b[: len(b) - k]
        if not a or not b:
            lost, added = lost + len(a), added + len(b)
        elif len(b) == 1:
            swapped, lost = swapped + (b[0] not in a), lost + len(a) - 1
        else:
            half = len(b) // 2
            cut = int(np.argmin(_column(a, b[:half]) + _column(a[::-1], b[half:][::-1])[::-1]))
            stack += [(a[:cut], b[:half]), (a[cut:], b[half:])]
    return swapped, lost, added


def word_edits(a: list[str], b: list[str]) -> int:
    return int(_column(a, b)[-1])


COUNTS = StructType([*(StructField(n, LongType()) for n in ("words", "substituted", "lost", "added")), StructField("rate", DoubleType())])


def words_of(text: str | None) -> list[str]:
    return unicodedata.normalize("NFC", text or "").split()


@F.pandas_udf(COUNTS)
def word_counts(truth: pd.Series, said: pd.Series) -> pd.DataFrame:
    """How said differs from truth in words, both in composed form (NFC)."""
    rows = []
    for t, s in zip(truth, said, strict=True):
        counts = edit_counts(a := words_of(t), words_of(s))
        rows.append((len(a), *counts, sum(counts) / max(len(a), 1)))
    return pd.DataFrame(rows, columns=["words", "substituted", "lost", "added", "rate"])


@F.pandas_udf(DoubleType())
def composed_cer(truth: pd.Series, said: pd.Series) -> pd.Series:
    """Character edits over the truth's length, both in composed form, at any length."""
    nfc = lambda x: unicodedata.normalize("NFC", x or "")
    return pd.Series([word_edits(a := list(nfc(t)), list(nfc(s))) / max(len(a), 1) for t, s in zip(truth, said, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def wer(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Word edits over the truth's number of words (no built-in does edits on words)."""
    for truth, said in batches:
        yield pd.Series([word_edits(a := words_of(t), words_of(s)) / max(len(a), 1) for t, s in zip(truth, said, strict=True)])


def summarize(samples: DataFrame) -> DataFrame:
    """(engine, status, cer, wer) -> one row per engine, ranked by mean CER, then mean WER."""
    ok = F.col("status") == "success"
    rows = samples.groupBy("engine").agg(F.count_if(ok).alias("ok"), F.count_if(~ok).alias("failed"), F.avg(F.when(ok, F.col("cer"))).alias("mean_cer"), F.avg(F.when(ok, F.col("wer"))).alias("mean_wer"))
    return rows.orderBy(F.asc_nulls_last("mean_cer"), F.asc_nulls_last("mean_wer"), "engine")
