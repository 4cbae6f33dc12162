"""Nested documents: metadata found and template strings cleared anywhere in JSON, grounding of whole profiles."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from talentloom.operators import grounding, json_tree
from talentloom.plans.registry import query, table

C = F.col

#: One nested document an event, as text that both engines put together alike: objects at several depths, empty and null values among them.
_DOCUMENT = [
    '{"event":', "event_id", ',"meta":', "props", ',"profile":{"profile_id":', "user_id", ',"module2_file_path":"grounded/', "event_type", '.json","full_name":"","tags":["', "event_type",
    '","info@example.com",["example.com",{"profile_id":"p', "event_id", '","module2_file_path":null}]]},"cards":[{"matched_profile_id":"m', "user_id", '","candidate_id":', "user_id",
    ',"inner":{"deep":[[{"profile_id":0,"matched_profile_id":', "event_id", ',"source_path":"', "event_type", '"}],[{"profile_id":"x","module2_file_path":"y","source_path":[]}]]}},null,[],{}],"note":"see example.com for ', "event_type", '"}',
]
_COLUMNS = {"event_id", "props", "user_id", "event_type"}
DOCUMENT_SQL = " || ".join(f"CAST({x} AS VARCHAR)" if x in _COLUMNS else f"'{x}'" for x in _DOCUMENT)
UNFILLED_SQL = ", ".join(f"'{x}'" for x in json_tree.UNFILLED)


def event_documents(spark, d):
    return table(spark, d, "events").select("event_id", F.concat(*[C(x).cast("string") if x in _COLUMNS else F.lit(x) for x in _DOCUMENT]).alias("document"))


def _filled_sql(*keys):
    one = [f"CASE WHEN CAST(json_extract(value, '$.{k}') AS VARCHAR) NOT IN ({UNFILLED_SQL}) THEN json_extract_string(value, '$.{k}') END" for k in keys]
    return f"coalesce({', '.join(one)})" if len(one) > 1 else one[0]


_TREE_SQL = f"docs AS (SELECT event_id, {DOCUMENT_SQL} AS document FROM events), tree AS (SELECT event_id, substr(fullkey, 3) AS path, type, value FROM docs, json_tree(document))"


@query("json_profile_metadata", f"""WITH {_TREE_SQL}, found AS (SELECT event_id, path, {_filled_sql("profile_id")} AS profile_id, {_filled_sql("module2_file_path")} AS module2_file_path, {_filled_sql("full_name")} AS full_name FROM tree WHERE type = 'OBJECT')
SELECT * FROM found WHERE profile_id IS NOT NULL AND module2_file_path IS NOT NULL""")
def json_profile_metadata(spark, d):
    """Objects that name a profile and its file, wherever they stand in the events' documents."""
    return json_tree.profile_metadata(event_documents(spark, d), "event_id", "document").select("event_id", "path", "profile_id", "module2_file_path", "full_name")


@query("json_matching_metadata", f"""WITH {_TREE_SQL}, found AS (SELECT event_id, path, {_filled_sql("profile_id", "matched_profile_id")} AS profile_id, {_filled_sql("candidate_id")} AS candidate_id, {_filled_sql("source_path")} AS source_path FROM tree WHERE type = 'OBJECT')
SELECT * FROM found WHERE profile_id IS NOT NULL AND (source_path IS NOT NULL OR candidate_id IS NOT NULL)""")
def json_matching_metadata(spark, d):
    """Objects that name a profile, under either key, and its origin."""
    return json_tree.matching_metadata(event_documents(spark, d), "event_id", "document").drop("depth")


_SIGN = re.compile(r"\bexample\.com\b")


@query("json_template_clearing", f"""WITH {_TREE_SQL}, signs AS (SELECT event_id, list_sort(list(path)) AS paths FROM tree WHERE type = 'VARCHAR' AND contains(CAST(value AS VARCHAR), 'example.com') GROUP BY event_id)
SELECT event_id, array_to_string(paths, '|') AS nullified, FALSE AS sign_left, len(paths) AS n FROM signs""")
def json_template_clearing(spark, d):
    """Strings with a template's address go from the events' documents; their paths are told."""
    out = json_tree.clear_strings(event_documents(spark, d), "event_id", "document", lambda s: bool(_SIGN.search(s)))
    return out.select("event_id", F.array_join("nullified", "|").alias("nullified"), C("document").contains("example.com").alias("sign_left"), F.size("nullified").cast("long").alias("n"))


#: Where the claims of a made-up profile come from: words of the document itself and of the next one.
_CLAIMS = {
    "bio.full_name": "array_to_string(own[1:3], ' ')",
    "bio.location": "array_to_string(other[1:3], ' ')",
    "bio.email": "NULL",
    "expertise.summary": "array_to_string(own[4:9] || other[1:5], ' ')",
    "expertise.hard_skills[0]": "own[2]",
    "expertise.hard_skills[1]": "other[4]",
    "expertise.hard_skills[2]": "''",
    "experiences[0].company": "own[6]",
    "experiences[0].job_title": "array_to_string(other[5:8], ' ')",
    "experiences[0].responsibilities[0]": "array_to_string(own[1:12], ' ')",
    "experiences[0].responsibilities[1]": "array_to_string(other[1:12], ' ')",
    "experiences[1].company": "other[9]",
    "experiences[1].job_title": "array_to_string(other[10:13], ' ')",
    "experiences[1].responsibilities[0]": "array_to_string(other[13:16], ' ')",
    "education[0].institution": "array_to_string(own[1:2], ' ')",
    "education[0].year": "NULL",
    "education[1].institution": "array_to_string(other[2:6], ' ')",
    "education[1].year": "NULL",
}
_WORDS_SQL = r"""docs AS (SELECT doc_id, text, lead(text) OVER (ORDER BY doc_id) AS next FROM documents),
words AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^ \t\n\r\f\x0B]+') AS own, regexp_extract_all(coalesce(next, text, ''), '[^ \t\n\r\f\x0B]+') AS other FROM docs)"""
_LISTS = {"expertise.hard_skills", "experiences.responsibilities"}


def _claims_sql():
    parts = " UNION ALL ".join(f"SELECT doc_id, '{path}' AS path, CAST({value} AS VARCHAR) AS v, text FROM words" for path, value in _CLAIMS.items())
    tokens = lambda least, drop: f"list_distinct(list_filter(regexp_extract_all(lower(v), '[a-z0-9][a-z0-9+.#/@-]*'), lambda t: length(t) > {least} AND t NOT IN ({drop})))"
    heavy = ", ".join(f"'{w}'" for w in grounding.STOPWORDS)
    return f"""{_WORDS_SQL}, claims AS ({parts}),
    t AS (SELECT *, regexp_replace(lower(v), '[^a-z0-9]+', '', 'g') AS cv, regexp_replace(lower(text), '[^a-z0-9]+', '', 'g') AS ct, {tokens(1, "'and', 'the', 'with', 'for', 'from'")} AS w, {tokens(3, heavy)} AS h FROM claims),
    n AS (SELECT *, len(list_filter(w, lambda x: contains(lower(text), x))) / len(w) AS share, len(list_filter(h, lambda x: contains(lower(text), x))) / greatest(len(h), 1) AS heavy FROM t),
    p AS (SELECT *, CASE WHEN v IS NULL OR trim(v) = '' THEN 'missing' WHEN cv <> '' AND contains(ct, cv) THEN 'supported' WHEN len(w) = 0 THEN 'missing' WHEN share >= 0.8 THEN 'weakly_supported' ELSE 'unsupported' END AS plain FROM n),
    s AS (SELECT doc_id, path, CASE WHEN path = 'expertise.summary' THEN CASE WHEN v IS NULL OR trim(v) = '' THEN 'missing' WHEN cv <> '' AND contains(ct, cv) THEN 'supported' WHEN len(h) = 0 THEN 'unsupported' WHEN heavy >= 0.6 THEN 'supported' WHEN heavy >= 0.4 THEN 'weakly_supported' ELSE 'unsupported' END
        WHEN contains(path, 'responsibilities') THEN CASE WHEN plain IN ('missing', 'supported') THEN plain WHEN len(h) > 0 AND heavy >= 0.4 THEN 'weakly_supported' ELSE 'unsupported' END ELSE plain END AS state FROM p),
    items AS (SELECT doc_id, regexp_extract(path, '^(experiences|education)\\[[0-9]\\]') AS item FROM s WHERE regexp_matches(path, '^(experiences|education)\\[') GROUP BY ALL HAVING count(*) FILTER (WHERE state IN ('supported', 'weakly_supported')) = 0),
    gone AS (SELECT doc_id, path FROM s WHERE state = 'unsupported' UNION SELECT doc_id, item FROM items)
    SELECT d.doc_id, coalesce((SELECT string_agg(path, '|' ORDER BY path) FROM s WHERE s.doc_id = d.doc_id AND state IN ('supported', 'weakly_supported')), '') AS supported,
    coalesce((SELECT string_agg(path, '|' ORDER BY path) FROM s WHERE s.doc_id = d.doc_id AND state = 'unsupported'), '') AS unsupported,
    coalesce((SELECT string_agg(path, '|' ORDER BY path) FROM gone g WHERE g.doc_id = d.doc_id), '') AS nullified,
    2 - (SELECT count(*) FROM items i WHERE i.doc_id = d.doc_id AND item LIKE 'exp%') AS experiences_left FROM documents d"""


#: The claims of _CLAIMS are made of that many words at the start of each text.
CLAIMED_WORDS = 16
RULES = {"expertise.summary": grounding.summary_support, "experiences[].responsibilities[]": grounding.duty_support}


def claimed_profiles(spark, d):
    """Each document with a nested profile whose values are words of its own text and of the next document's."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ids = docs.select("doc_id")
    # the next id by ranges: one row a range goes into the window over all
    ranged = ids.repartitionByRange("doc_id").sortWithinPartitions("doc_id").withColumn("_p", F.spark_partition_id())
    inside = ranged.withColumn("_next", F.lead("doc_id").over(Window.partitionBy("_p").orderBy("doc_id")))
    heads = ranged.groupBy("_p").agg(F.min("doc_id").alias("_head"))
    heads = heads.select((F.lag("_p").over(Window.orderBy("_p"))).alias("_q"), "_head")
    follow = inside.join(F.broadcast(heads), C("_p") == C("_q"), "left").select("doc_id", F.coalesce("_next", "_head").alias("_n"))
    other = docs.select(C("doc_id").alias("_o"), C("text").alias("_next"))
    rows = docs.join(follow, "doc_id").join(other, C("_n") == C("_o"), "left").withColumn("_next", F.coalesce("_next", "text"))
    # claims take no word behind the sixteenth: the rest of a text stays one piece, a blank start is an empty one
    words = lambda c: F.slice(F.filter(F.split(c, r"[ \t\n\r\f\x0B]+", CLAIMED_WORDS + 2), lambda w: w != ""), 1, CLAIMED_WORDS)
    rows = rows.withColumn("own", words("text")).withColumn("other", words("_next"))
    some = lambda name, a, b: F.array_join(F.slice(name, a, b - a + 1), " ")
    one = lambda name, i: F.get(C(name), F.lit(i - 1))
    text = F.lit(None).cast("string")
    bio = F.struct(some("own", 1, 3).alias("full_name"), some("other", 1, 3).alias("location"), text.alias("email"))
    summary = F.array_join(F.concat(F.slice("own", 4, 6), F.slice("other", 1, 5)), " ")
    expertise = F.struct(summary.alias("summary"), F.array(one("own", 2), one("other", 4), F.lit("")).alias("hard_skills"))
    first = F.struct(one("own", 6).alias("company"), some("other", 5, 8).alias("job_title"), F.array(some("own", 1, 12), some("other", 1, 12)).alias("responsibilities"))
    second = F.struct(one("other", 9).alias("company"), some("other", 10, 13).alias("job_title"), F.array(some("other", 13, 16)).alias("responsibilities"))
    school = lambda c: F.struct(c.alias("institution"), text.alias("year"))
    profile = F.struct(bio.alias("bio"), expertise.alias("expertise"), F.array(first, second).alias("experiences"), F.array(school(some("own", 1, 2)), school(some("other", 2, 6))).alias("education"))
    return rows.select("doc_id", "text", profile.alias("profile"))


@query("ground_nested_profiles", f"WITH {_claims_sql()}")
def ground_nested_profiles(spark, d):
    """Every leaf of nested profiles held against their documents, with the three lists of paths."""
    g = grounding.ground_nested(claimed_profiles(spark, d), "profile", "text", RULES)
    paths = [F.array_join(f"fields_{n}", "|").alias(n) for n in ("supported", "unsupported", "nullified")]
    return g.select("doc_id", *paths, F.size("profile.experiences").cast("long").alias("experiences_left"))
