"""Who a document tells of and how far each of its fields is to be trusted: identity keys, best sources of fields, kinds of documents, skill labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentloom.functions.text import distinct_folded

# Formats by trust, folders of job texts, labels that are no skills, words of praise, what takes confidence away.
FORMAT_PRIORITY = {"docx": 0, "pdf": 1, "images": 2, "image": 2, "scans": 3, "scan": 3}
UNKNOWN_PRIORITY = 99
JOB_FOLDERS = ["jobs", "job", "job_descriptions", "fiches_poste", "poste"]
GENERIC_LABELS = [
    "areas of interest", "big data", "bi tools", "bi & etl tools", "cloud", "cloud (aws)", "computer vision", "data engineering", "data science", "databases", "deep learning", "deployment", "deployment tools",
    "devops/cicd", "distributed processing", "frameworks", "generative models", "ides & software", "image processing", "image/video processing", "machine learning", "ml ops", "natural language processing",
    "natural language processing (nlp)", "neural networks", "nlp", "programming languages", "software", "tools", "transfer learning", "video processing",
]
GENERIC_ENDINGS = [" tools", " software"]
PRAISE = ["dynamic", "innovative", "meticulous", "motivated", "passionate", "results-driven"]
SCANNED_LOSS, OCR_LOSS, FALLBACK_LOSS, SECONDARY_LOSS = 0.03, 0.02, 0.03, 0.05
SECONDARY_PARSER = "secondary_parser"

C = F.col


def document_type(path: Column) -> Column:
    """job_description if a folder (or the file itself) bears a name of job texts, else cv."""
    return F.when(F.arrays_overlap(F.split(F.lower(path), "/"), F.array(*[F.lit(x) for x in JOB_FOLDERS])), "job_description").otherwise("cv")


def route_penalty(scanned: Column, ocr: Column, fallback: Column, parser: Column) -> Column:
    """What a document's route takes from its confidence."""
    loss = lambda test, by: F.when(test, by).otherwise(0.0)
    return F.round(loss(scanned, SCANNED_LOSS) + loss(ocr, OCR_LOSS) + loss(fallback, FALLBACK_LOSS) + loss(parser == SECONDARY_PARSER, SECONDARY_LOSS), 4)


def settled_status(status: Column, needs_repair: Column) -> Column:
    """The status after the repair gate: texts too weak to use are partial, and other partial ones are validated."""
    return F.when(needs_repair, "partial").when(status == "partial", "validated").otherwise(status)


def document_id(source_format: Column, path: Column) -> Column:
    """The format and the file's name without its last extension."""
    return F.concat(source_format, F.lit(":"), F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1))


def part_of_key(x: Column) -> Column:
    """Letters and digits in lower case, anything between them as one hyphen; empty if there are none."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), "[^a-z0-9]+", "-"), "^-|-$", "")


def candidate_identity(email: Column, name: Column, phone: Column, location: Column, document: Column) -> Column:
    """struct(key, confidence, ambiguous): the address, name with six digits of a phone, name with place, else the document; never the name alone."""
    mail, who, place = F.lower(F.trim(F.coalesce(email, F.lit("")))), part_of_key(name), part_of_key(location)
    digits = F.regexp_replace(F.coalesce(phone, F.lit("")), "[^0-9]+", "")
    told = lambda kind, *parts: F.concat(F.lit(kind + ":"), F.concat_ws("|", *parts))
    row = lambda key, sure: F.struct(key.alias("key"), F.lit(sure).alias("confidence"), F.lit(sure < 0.5).alias("ambiguous"))
    return (
        F.when(F.coalesce(email, F.lit("")) != "", row(told("email", mail), 1.0))
        .when((who != "") & (F.length(digits) >= 6), row(told("name_phone", who, digits), 0.9))
        .when((who != "") & (place != ""), row(told("name_location", who, place), 0.7))
        .otherwise(row(told("document", document), 0.3))
    )


def format_priority(source_format: Column) -> Column:
    pairs = [F.lit(x) for pair in FORMAT_PRIORITY.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.lower(source_format)), F.lit(UNKNOWN_PRIORITY))


def best_sources(documents: DataFrame, key: str, fields: list[str], document: str, source_format: str, confidence: str) -> DataFrame:
    """(key, field, value, document, source_format, confidence, n_sources): which document each field of a candidate is taken from.

    The most trusted format wins, then the higher confidence (null: 0), then the smaller document id and value. Fields that are null or blank in all documents give no row.
    One aggregation over (key, field), reduced before it moves, so that a candidate of very many documents is no hot group.
    """
    told = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), C(f).cast("string").alias("value")) for f in fields]))
    sure = F.coalesce(C(confidence).cast("double"), F.lit(0.0))
    rows = documents.select(C(key), C(document).alias("document"), C(source_format).alias("source_format"), sure.alias("confidence"), told.alias("_f"))
    rows = rows.select(key, "document", "source_format", "confidence", "_f.field", "_f.value").where("trim(value) <> ''")
    order = F.struct(format_priority(C("source_format")).alias("p"), (-C("confidence")).alias("c"), C("document").alias("d"), C("value").alias("v"))
    best = F.min_by(F.struct("value", "document", "source_format", "confidence"), order)
    out = rows.groupBy(key, "field").agg(best.alias("_b"), F.count("*").alias("n_sources"))
    return out.select(key, "field", "_b.value", "_b.document", "_b.source_format", "_b.confidence", "n_sources")


def skill_label(x: Column) -> Column:
    """Single spaces, bars as spaces, no punctuation at the ends, slashes without spaces; empty if nothing is left."""
    bare = F.trim(F.regexp_replace(F.replace(F.coalesce(x, F.lit("")), F.lit("|"), F.lit(" ")), r"[ \t\n\r\f\x0B]+", " "))
    return F.regexp_replace(F.regexp_replace(bare, "^[ ,:;.-]+|[ ,:;.-]+$", ""), " +/ +", "/")


def capitals(x: Column) -> Column:
    """Each letter as its one capital, ß as ẞ; letters whose capital is several letters stay, so that no other label comes about."""
    return F.array_join(F.transform(F.split(F.replace(x, F.lit("ß"), F.lit("ẞ")), ""), lambda c: F.when(F.length(F.upper(c)) == 1, F.upper(c)).otherwise(c)), "")


def match_key(x: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), "[^a-z0-9@]+", "")


def clean_skills(skills: Column, text_key: Column, hard: bool) -> Column:
    """Labels that the text holds, once each: of hard skills without umbrella terms, of soft ones without praise.

    text_key: match_key of the source text, made once a row. Labels of fewer than four letters and digits aren't supported by any text.
    """
    low = lambda s: F.lower(s)
    if hard:
        refused = lambda s: low(s).isin(GENERIC_LABELS) | low(s).endswith(GENERIC_ENDINGS[0]) | low(s).endswith(GENERIC_ENDINGS[1])
    else:
        refused = lambda s: low(s).isin(PRAISE)
    held = lambda s: (F.length(match_key(s)) >= 4) & text_key.contains(match_key(s))
    labels = F.transform(F.coalesce(skills, F.array().cast("array<string>")), skill_label)
    return distinct_folded(F.filter(labels, lambda s: (s != "") & ~refused(s) & held(s)))
