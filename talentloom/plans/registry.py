"""Where query modules register themselves, and the binding of roles to tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


#: Result columns that SQL literals would make decimals.
DOUBLES = {
    "risk_encoding": ["encoded"],
    "entity_resolution": ["dedup_confidence"],
    "entity_resolution_whole": ["dedup_confidence"],
    "job_profiles": ["years"],
    "ground_profiles": ["score"],
    "assistant_scenario_score": ["score"],
    "identity_keys": ["confidence"],
    "job_confidence": ["confidence"],
}


def query(name: str, sql: str | None = None):
    """Register a (spark, sf_dir) -> DataFrame function, with its SQL where SQL can express it."""

    def add(f):
        QUERIES[name] = f
        if sql:
            casts = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in DOUBLES.get(name, ()))
            ORACLES[name] = f"SELECT * REPLACE ({casts}) FROM ({sql})" if casts else sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Profile attributes by document: plain arithmetic on the id, in SQL that both engines share.
PROFILE_EXPRS = [
    "doc_id AS profile_id",
    "doc_id % 397 AS candidate_id",
    "source AS job_id",
    "CAST(doc_id * 37 % 101 AS DOUBLE) / 100 AS reliability",
    "CASE doc_id % 4 WHEN 0 THEN 'complete_profile' WHEN 1 THEN 'partial_profile' WHEN 2 THEN 'minimal_profile' ELSE 'unreadable' END AS profile_kind",
    "CASE doc_id % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS risk",
    "CASE doc_id % 3 WHEN 0 THEN 'groq_secondary' WHEN 1 THEN 'ollama_local' ELSE 'other' END AS route",
    "CAST(doc_id % 5 AS INT) AS flags",
    "CAST(doc_id % 7 AS INT) AS nullified",
    "doc_id % 11 = 0 AS weak_name",
    "CAST(doc_id * 53 % 97 AS DOUBLE) / 96 AS similarity",
    "CAST(doc_id % 6 AS INT) AS required",
    "CAST(floor(CAST((doc_id % 6) * (doc_id % 5) AS DOUBLE) / 4) AS INT) AS matched",
    "CAST(doc_id * 7 % 23 AS DOUBLE) / 2 AS years",
    "CASE WHEN doc_id % 9 = 0 THEN NULL ELSE CAST(doc_id % 9 AS DOUBLE) END AS required_years",
    "doc_id % 10 <> 0 AS has_experience",
    "CASE doc_id % 8 WHEN 0 THEN 'jr' WHEN 1 THEN 'Débutant' WHEN 2 THEN 'mid' WHEN 3 THEN 'Confirmé' WHEN 4 THEN 'SR' WHEN 5 THEN 'Tech Lead' WHEN 6 THEN 'architecte' ELSE 'unknown' END AS seniority",
    "CASE length(source) % 3 WHEN 0 THEN 'senior' WHEN 1 THEN 'mid_level' ELSE 'junior' END AS job_seniority",
    "n_chars AS chars",
    "lang AS lang",
    "CASE doc_id % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' WHEN 2 THEN 'images' ELSE 'scans' END AS source_format",
]
PROFILES_SQL = "profiles AS (SELECT " + ", ".join(PROFILE_EXPRS) + " FROM documents)"


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(*PROFILE_EXPRS)
