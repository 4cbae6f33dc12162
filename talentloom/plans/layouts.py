"""Pages laid out from whole texts: sections by geometry, and the evidence of each fragment."""

from __future__ import annotations

from pyspark.sql import functions as F

from talentloom.functions.lines import trim_spaces
from talentloom.operators import layout
from talentloom.plans.registry import query, table

C = F.col
#: Every sentence is a block; by the length of its text it may be said as a heading, a date, a place or a piece of work instead.
BLOCKS = [
    "doc_id",
    "CAST(floor(pos / 40) AS INT) + 1 AS page_no",
    "CAST(pos AS INT) AS idx",
    """CASE length(s) % 23 WHEN 0 THEN 'EDUCATION' WHEN 1 THEN 'Work experience' WHEN 2 THEN 'TECHNICAL SKILLS' WHEN 3 THEN '2019 - 2021' WHEN 4 THEN 'Paris, France' WHEN 5 THEN concat('Built ', s)
 WHEN 6 THEN 'Academic projects' WHEN 7 THEN 'PROFESSIONAL SUMMARY' WHEN 8 THEN '2020 Lyon, France' WHEN 9 THEN 'Languages' ELSE s END AS text""",
    "CASE WHEN length(s) % 31 = 0 OR pos % 2 = 0 THEN 40.0 ELSE 320.0 END AS l",
    "CASE WHEN length(s) % 31 = 0 THEN 570.0 WHEN pos % 2 = 0 THEN 290.0 ELSE 570.0 END AS r",
    "CAST(760 - 35 * floor(pos % 40 / 2) AS DOUBLE) AS t",
    "CAST(740 - 35 * floor(pos % 40 / 2) AS DOUBLE) AS b",
    "600.0 AS page_width",
    "800.0 AS page_height",
]


def page_blocks(spark, d):
    """Whole texts of `documents` as blocks of pages of two columns, twenty lines each."""
    said = F.filter(F.transform(F.split(F.regexp_replace("text", r"([.!?]) +", "$1\n"), "\n"), lambda s: trim_spaces(s)), lambda s: s != "")
    return table(spark, d, "documents").select("doc_id", F.posexplode(said).alias("pos", "s")).selectExpr(*BLOCKS)


_LISTS = {k: ", ".join(f"'{x}'" for x in v) for k, v in (("titles", layout.SECTION_TITLES),)}
_NAMED = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + f" THEN '{title}'" for title, words in layout.SECTION_KEYWORDS) + " END"
SECTIONS_SQL = rf"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?]) +', '\1' || chr(10), 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM documents),
e AS (SELECT doc_id, unnest(ls) AS s, generate_subscripts(ls, 1) - 1 AS pos FROM s),
k AS (SELECT {", ".join(BLOCKS)} FROM e), c AS (SELECT *, (l + r) / 2 AS x, (t + b) / 2 AS y FROM k),
m AS (SELECT doc_id, page_no, list_sort(list(x))[CAST(floor(count(*) / 2) AS INT) + 1] AS mid FROM c GROUP BY ALL),
a AS (SELECT c.*, CASE WHEN y >= 0.9 * page_height OR r - l >= 0.85 * page_width THEN 'full' WHEN x <= mid THEN 'left' ELSE 'right' END AS side, upper(text) IN ({_LISTS["titles"]}) OR (text = upper(text) AND text <> lower(text) AND len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) BETWEEN 2 AND 6) AS heads FROM c JOIN m USING (doc_id, page_no)),
o AS (SELECT *, CASE WHEN heads THEN upper(text) ELSE {_NAMED} END AS opens FROM a),
f AS (SELECT b.doc_id, b.idx, min(CASE WHEN h.side = b.side THEN h.y * 100000 + h.idx END) AS near_same, min(h.y * 100000 + h.idx) AS near_any FROM o b JOIN o h ON h.doc_id = b.doc_id AND h.page_no = b.page_no AND h.y >= b.y AND h.opens IS NOT NULL GROUP BY ALL)
SELECT o.doc_id, o.idx, o.page_no, o.side, NOT o.heads AS content, coalesce(h.opens, 'HEADER') AS section FROM o LEFT JOIN f ON f.doc_id = o.doc_id AND f.idx = o.idx
LEFT JOIN o h ON h.doc_id = o.doc_id AND h.idx = CAST(coalesce(near_same, near_any) AS BIGINT) % 100000"""


@query("layout_sections", SECTIONS_SQL)
def layout_sections(spark, d):
    """The column and section of every block; headings are found by running extremes, where the SQL joins."""
    return layout.sectioned(layout.located(page_blocks(spark, d))).select("doc_id", "idx", "page_no", "side", "content", "section")


@query("layout_evidence")
def layout_evidence(spark, d):
    """Sections of whole texts with lines, items and counts of spans; held against a plain state machine in the tests."""
    blocks = page_blocks(spark, d)
    n = layout.parts_of(blocks)
    s = layout.logical_sections(layout.evidence(layout.fragments(blocks, parts=n), blocks, parts=n))
    return s.select("doc_id", "rank", "section", F.size("lines").alias("n_lines"), F.size("items").alias("n_items"), "n_spans", "n_fallback", F.sha2(F.to_json(F.struct("lines", "items")), 256).alias("digest"))
