"""Profile shapes: store document, legacy projection, provenance, business rules, changes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentloom.functions.text import stable_id

# Which source of a field is trusted first.
SOURCE_PRIORITY = {"docx": 0, "pdf": 1, "images": 2, "scans": 3}


def store_document(profiles: DataFrame) -> DataFrame:
    """Nested grounded profiles (profile.bio, profile.expertise, grounding) as one flat row."""
    return profiles.select(
        stable_id("profile", F.col("source_path"), F.col("artifact_path")).alias("profile_id"),
        "source_path",
        "artifact_path",
        *[F.col(f"profile.bio.{c}").alias(c) for c in ("full_name", "email", "phone", "location")],
        F.col("profile.expertise.hard_skills").alias("hard_skills"),
        F.col("grounding.reliability_score").alias("reliability_score"),
        F.size("grounding.fields_nullified").alias("fields_nullified_count"),
    )


def legacy_projection(profiles: DataFrame) -> DataFrame:
    """The older shape: experiences as (title, company, start, end), skills as one list."""
    return profiles.select(
        "source_path",
        F.transform("profile.experiences", lambda e: F.struct(e["job_title"].alias("title"), e["company"].alias("company"), e["start_date"].alias("start"), e["end_date"].alias("end"))).alias("experience"),
        F.array_distinct(F.concat(F.coalesce("profile.expertise.hard_skills", F.array().cast("array<string>")), F.coalesce("profile.expertise.soft_skills", F.array().cast("array<string>")))).alias("skills"),
    )


def priority(source_format: Column) -> Column:
    return reduce(lambda acc, kv: F.when(source_format == kv[0], kv[1]).otherwise(acc), SOURCE_PRIORITY.items(), F.lit(len(SOURCE_PRIORITY)))


def provenance(fields: list[str], source: Column) -> Column:
    """map(field -> source) of the fields that have a value."""
    pairs = F.array(*[F.when(F.col(f).isNotNull() & (F.trim(F.col(f).cast("string")) != ""), F.struct(F.lit(f).alias("key"), source.alias("value"))) for f in fields])
    return F.map_from_entries(F.filter(pairs, lambda p: p.isNotNull()))


def business_reject(anchors: list[Column], skills: Column, words: Column) -> Column:
    """Why a profile is refused, or null: too short, nothing to hold on to, skills without any anchor."""
    n = reduce(lambda a, b: a + b, [F.when(a.isNotNull() & (F.trim(a) != ""), 1).otherwise(0) for a in anchors])
    return F.when(words < 25, "too_short").when((n == 0) & (F.size(skills) <= 0), "no_structured_anchor").when(n == 0, "ungrounded_skills")


def changed(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row for each field of a key that differs: (key, field, old, new)."""
    b = new.select(F.col(key).alias("_k"), *[F.col(f).alias(f"_n_{f}") for f in fields])
    j = old.join(b, F.col(key) == F.col("_k"))
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("old"), F.col(f"_n_{f}").cast("string").alias("new")) for f in fields])
    return j.select(key, F.inline(F.filter(rows, lambda r: ~r["old"].eqNullSafe(r["new"]))))


def valid_items(items: Column, key: str) -> Column:
    """Items without their key field go."""
    return F.filter(items, lambda x: x[key].isNotNull() & (F.trim(x[key]) != ""))


def output_path(root: str, source_format: Column, path: Column, suffix: str) -> Column:
    return F.concat(F.lit(root + "/"), source_format, F.lit("/"), F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1), F.lit(suffix))


def masked_uri(x: Column) -> Column:
    """Credentials of a connection string hidden."""
    return F.regexp_replace(x, r"://[^/@]+@", "://***@")
