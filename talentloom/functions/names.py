"""Names and identity keys as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from talentloom.functions.text import alnum_key, collapse

# Phrases that are no names, and words of roles.
SUSPECT_PHRASES = ["resume objective", "objective", "professional summary", "data scientist", "engineering manager", "multi skilled engineering manager"]
ROLE_WORDS = ["engineer", "scientist", "manager", "consultant", "developer", "director", "intern", "analyst", "objective", "summary", "resume"]


def suspect_name(x: Column) -> Column:
    cleaned, key = collapse(x), alnum_key(x, " ")
    words = F.split(key, " ")
    role = F.arrays_overlap(words, F.array(*[F.lit(w) for w in ROLE_WORDS]))
    short = F.size(words) <= 3
    return cleaned.isNull() | (key == "") | key.isin(SUSPECT_PHRASES) | (role & (F.size(words) == 1)) | (role & short & ((F.upper(cleaned) == cleaned) | (F.initcap(cleaned) == cleaned))) | key.contains("objective") | key.contains("summary")


def display_name(x: Column, ident: Column) -> Column:
    """struct(name, quality, warning): a placeholder with the id where the name is suspect."""
    bad = suspect_name(x)
    shown = F.when(~bad, collapse(x)).when(ident.isNotNull(), F.concat(F.lit("Candidate (ID: "), ident.cast("string"), F.lit(")"))).otherwise("Candidate")
    return F.struct(shown.alias("name"), F.when(bad, "weak").otherwise("ok").alias("quality"), F.when(bad, "missing_or_rejected_full_name").alias("warning"))


def identity(email: Column, name: Column, phone: Column, location: Column, document: Column) -> Column:
    """struct(key, confidence, ambiguous): e-mail, name and phone, name and location, or the document itself."""
    by_phone = name.isNotNull() & (F.length(F.regexp_replace(phone, "[^0-9]", "")) >= 6)
    by_place = name.isNotNull() & location.isNotNull()
    key = F.when(email.isNotNull(), email).when(by_phone, F.concat_ws("|", name, phone)).when(by_place, F.concat_ws("|", name, location)).otherwise(document)
    sure = F.when(email.isNotNull(), 1.0).when(by_phone, 0.9).when(by_place, 0.7).otherwise(0.3)
    return F.struct(key.alias("key"), sure.alias("confidence"), (sure < 0.5).alias("ambiguous"))
