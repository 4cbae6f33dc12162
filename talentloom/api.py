"""Read surface over written tables: plain functions that return DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def health(tables: dict[str, DataFrame]) -> dict[str, bool]:
    """Which tables have rows."""
    return {name: not df.limit(1).isEmpty() for name, df in tables.items()}


def list_candidates(candidates: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    return candidates.orderBy("candidate_id").offset(offset).limit(limit)


def get_candidate(candidates: DataFrame, ident) -> DataFrame:
    return candidates.where((F.col("candidate_id") == ident) | (F.col("profile_id") == ident)).orderBy("profile_id").limit(1)


def get_card(cards: DataFrame, ident) -> DataFrame:
    return cards.where(F.col("profile_id") == ident).limit(1)


def match(recommendations: DataFrame, job_id: str, top_k: int = 10) -> DataFrame:
    return recommendations.where(F.col("job_id") == job_id).orderBy(F.desc("final_score"), "profile_id").limit(top_k)


def guarded(call, fallback):
    """call's result, or fallback and the reason where a back end isn't there."""
    try:
        return call(), None
    except Exception as e:  # noqa: BLE001  (the reason is given back)
        return fallback, f"{type(e).__name__}: {e}"


def answer(message: str, recommendations: DataFrame, job_id: str, top_k: int = 3) -> str:
    """The assistant's deterministic answer to a request for the best candidates of a job."""
    rows = match(recommendations, job_id, top_k).collect()  # top_k rows
    if not rows:
        return f"No candidate for {job_id}."
    return f"Best for {job_id}: " + ", ".join(f"{r['profile_id']} ({r['final_score']:.2f})" for r in rows)
