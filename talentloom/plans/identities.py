"""Identity keys, best sources, kinds of documents and skill labels, read from whole document texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from talentloom.functions import quality as Q
from talentloom.operators import identity as I
from talentloom.plans.registry import query, table

C = F.col
#: Where a document lies: folders and an extension by the length of its text, so that folders and extensions disagree at times.
PATH = """concat('in/', CASE length(text) % 5 WHEN 0 THEN 'Jobs/' WHEN 1 THEN 'scans/' WHEN 2 THEN 'PDF/2024/images/' WHEN 3 THEN 'poste/docx/' ELSE 'x/' END, source, '/d', CAST(doc_id AS {s}), CASE length(text) % 7 WHEN 0 THEN '.pdf' WHEN 1 THEN '.DOCX' WHEN 2 THEN '.v2.bmp' WHEN 3 THEN '.jpeg' WHEN 4 THEN '' ELSE '.bin' END)"""
MAIL = "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}"
PHONE = "[+][0-9][0-9 ().-]{7,}[0-9]"
NAME = "[^ \t\n\r]+ [^ \t\n\r]+"
#: Contacts of the text; a place by its length.
FIELDS = {
    "email": f"nullif(regexp_extract(text, '{MAIL}', 0), '')",
    "phone": f"nullif(regexp_extract(text, '{PHONE}', 0), '')",
    "full_name": f"CASE WHEN length(text) % 3 = 0 THEN nullif(regexp_extract(text, '{NAME}', 0), '') WHEN length(text) % 3 = 1 THEN ' - ' END",
    "location": "CASE length(text) % 4 WHEN 0 THEN 'Tunis, Tunisia' WHEN 1 THEN '  ' WHEN 2 THEN 'Lyon' END",
}


def contacts(spark, d):
    """Each document with its path, format, id and the fields found in its whole text."""
    rows = table(spark, d, "documents").select("doc_id", "source", "n_chars", F.expr(PATH.format(s="STRING")).alias("path"), *[F.expr(e).alias(c) for c, e in FIELDS.items()])
    return rows.withColumn("source_format", Q.source_format(C("path"))).withColumn("document", I.document_id(C("source_format"), C("path")))


_EXT = r"regexp_extract(lower(path), '[^/]\.([a-z0-9]+)$', 1)"
_DEEPEST = "list_filter(string_split(lower(path), '/'), lambda p: p IN ('pdf', 'docx', 'images', 'scans'))[-1]"
_KEY = lambda x: f"regexp_replace(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')"
CONTACTS_SQL = f"""told AS (SELECT doc_id, source, n_chars, {PATH.format(s="VARCHAR")} AS path, {", ".join(f"{e} AS {c}" for c, e in FIELDS.items())} FROM documents),
found AS (SELECT *, coalesce({_DEEPEST}, CASE WHEN {_EXT} = 'pdf' THEN 'pdf' WHEN {_EXT} = 'docx' THEN 'docx' WHEN {_EXT} IN ('png', 'jpg', 'jpeg', 'tif', 'tiff', 'bmp') THEN 'images' ELSE 'unknown' END) AS source_format FROM told),
contacts AS (SELECT *, source_format || ':' || regexp_replace(regexp_extract(path, '[^/]*$'), '\\.[^./]*$', '') AS document, {_KEY("full_name")} AS who, {_KEY("location")} AS place, regexp_replace(coalesce(phone, ''), '[^0-9]+', '', 'g') AS digits FROM found),
keyed AS (SELECT *, CASE WHEN email IS NOT NULL THEN 'email:' || lower(email) WHEN who <> '' AND length(digits) >= 6 THEN 'name_phone:' || who || '|' || digits WHEN who <> '' AND place <> '' THEN 'name_location:' || who || '|' || place ELSE 'document:' || document END AS key FROM contacts)"""


@query("document_places", f"WITH {CONTACTS_SQL} SELECT doc_id, source_format, CASE WHEN len(list_intersect(string_split(lower(path), '/'), ['jobs', 'job', 'job_descriptions', 'fiches_poste', 'poste'])) > 0 THEN 'job_description' ELSE 'cv' END AS document_type, document FROM contacts")
def document_places(spark, d):
    """Format, kind and id of each document by the folders and the extension of its path."""
    return contacts(spark, d).select("doc_id", "source_format", I.document_type(C("path")).alias("document_type"), "document")


@query("candidate_identities", f"WITH {CONTACTS_SQL} SELECT doc_id, key, CAST(CASE split_part(key, ':', 1) WHEN 'email' THEN 1.0 WHEN 'name_phone' THEN 0.9 WHEN 'name_location' THEN 0.7 ELSE 0.3 END AS DOUBLE) AS confidence, starts_with(key, 'document:') AS ambiguous FROM keyed")
def candidate_identities(spark, d):
    """Who each document tells of, by the contacts in its text."""
    key = I.candidate_identity(*[C(c) for c in ("email", "full_name", "phone", "location", "document")])
    return contacts(spark, d).select("doc_id", key.alias("_k")).select("doc_id", "_k.key", "_k.confidence", "_k.ambiguous")


_RANK = "CASE source_format WHEN 'docx' THEN 0 WHEN 'pdf' THEN 1 WHEN 'images' THEN 2 WHEN 'scans' THEN 3 ELSE 99 END"
_LONG = " UNION ALL ".join(f"SELECT source, document, source_format, least(n_chars, 900) / 1000 AS confidence, '{f}' AS field, {f} AS value FROM contacts" for f in FIELDS)


@query("field_sources", f"WITH {CONTACTS_SQL}, long AS ({_LONG}), ranked AS (SELECT *, row_number() OVER (PARTITION BY source, field ORDER BY {_RANK}, confidence DESC, document, value) AS rn, count(*) OVER (PARTITION BY source, field) AS n_sources FROM long WHERE trim(value) <> '') SELECT source, field, value, document, source_format, confidence, n_sources FROM ranked WHERE rn = 1")
def field_sources(spark, d):
    """The best document for each contact field of a source: format first, then confidence."""
    rows = contacts(spark, d).withColumn("sure", F.least(C("n_chars"), F.lit(900)) / 1000)
    return I.best_sources(rows, "source", list(FIELDS), "document", "source_format", "sure")


#: Labels that a document claims: two of its own words, its last line, and stated ones by the length of its text.
LABELS = [
    "concat(' - ', regexp_extract(text, '[^ \t\n\r]+', 0), ' ;')", f"concat(regexp_extract(text, '{NAME}', 0), '.')", f"upper(regexp_extract(text, '{NAME}', 0))", "CASE WHEN length(text) % 2 = 0 THEN 'Big | Data' END",
    "CASE WHEN length(text) % 3 = 0 THEN concat(regexp_extract(text, '[^ \t\n\r]+', 0), ' tools') ELSE 'not  to be / found' END", "'Motivated.'", "''",
]
_LABEL = r"regexp_replace(regexp_replace(trim(regexp_replace(replace(coalesce(s, ''), '|', ' '), '[ \t\n\r\f\x0B]+', ' ', 'g')), '^[ ,:;.-]+|[ ,:;.-]+$', '', 'g'), ' +/ +', '/', 'g')"
_MATCH = lambda x: f"regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9@]+', '', 'g')"
_TRUE = f"s <> '' AND length({_MATCH('s')}) >= 4 AND contains(low, {_MATCH('s')})"
_GENERIC = ", ".join(f"'{g}'" for g in I.GENERIC_LABELS)
_PRAISE = ", ".join(f"'{g}'" for g in I.PRAISE)
_ONCE = lambda xs: f"array_to_string(list_filter({xs}, lambda s, i: list_position(list_transform({xs}, lambda w: lower(w)), lower(s)) = i), '|')"


@query("skill_labels", f"""WITH l AS (SELECT doc_id, {_MATCH("text || ' big data, motivated'")} AS low, list_transform([{", ".join(LABELS)}], lambda s: {_LABEL}) AS labels FROM documents),
k AS (SELECT doc_id, list_filter(labels, lambda s: {_TRUE} AND lower(s) NOT IN ({_GENERIC}) AND NOT ends_with(lower(s), ' tools') AND NOT ends_with(lower(s), ' software')) AS hard, list_filter(labels, lambda s: {_TRUE} AND lower(s) NOT IN ({_PRAISE})) AS soft FROM l)
SELECT doc_id, {_ONCE("hard")} AS hard, {_ONCE("soft")} AS soft FROM k""")
def skill_labels(spark, d):
    """Claimed labels that the whole text holds, as hard and as soft skills."""
    # upper() would spell ß with two letters, SQL's does not
    labels = [I.capitals(F.expr(x[6:-1])) if x.startswith("upper(") else F.expr(x) for x in LABELS]
    rows = table(spark, d, "documents").select("doc_id", I.match_key(F.concat(C("text"), F.lit(" big data, motivated"))).alias("low"), F.array(*labels).alias("labels"))
    return rows.select("doc_id", *[F.array_join(I.clean_skills(C("labels"), C("low"), hard), "|").alias(name) for name, hard in (("hard", True), ("soft", False))])
