"""Job texts, headers and lines made from whole table text, each held against SQL that reads the same text again."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from talentloom.functions import lines as L
from talentloom.functions.scoring import SENIORITY_ALIASES
from talentloom.operators import jobs
from talentloom.plans import layouts
from talentloom.plans.registry import query, table

C = F.col
#: What a sentence s says besides, by its length.
SAYING = """CASE length(s) % 29 WHEN 0 THEN concat(s, ' We use Python and Spark.') WHEN 1 THEN concat(s, ' Docker or CI/CD is a plus.') WHEN 2 THEN concat('You will ', s) WHEN 3 THEN concat(s, ' At least ', CAST(length(s) % 9 + 1 AS STRING), ' years.')
 WHEN 4 THEN concat(s, ' Hybrid work.') WHEN 5 THEN concat('Build ', s) WHEN 6 THEN concat(s, ' An ETL, a REST API and SQL.') WHEN 7 THEN concat(s, ' Full-time.') WHEN 8 THEN concat(s, ' Based in Lyon, France with others.') WHEN 9 THEN concat(s, ' The backend.') ELSE s END"""
#: The line above a text, by its length.
HEADING = "CASE length(text) % 5 WHEN 0 THEN 'Senior Data Engineer\n' WHEN 1 THEN 'Junior Analyst wanted\n' WHEN 2 THEN 'Lead Backend Developer\n' ELSE '' END"

_EDGE, _END = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"


def _edged(pattern: str) -> str:
    r"""A pattern with \b at its ends for an engine whose \b knows ASCII only."""
    return re.sub(r"\\b$", lambda _: _END, re.sub(r"^\\b", lambda _: _EDGE, pattern))


def _first(rules, text):
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, '(?i){_edged(p)}') THEN '{label}'" for label, p in rules) + " END"


def _has(words, text):
    return "(" + " OR ".join("contains(lower({}), '{}')".format(text, w.replace("'", "''")) for w in words) + ")"


def _skills(sentences):
    hit = lambda k: f"CASE WHEN len(list_filter({sentences}, lambda s: regexp_matches(s, '(?i)(?:^|[^0-9A-Za-z_]){re.escape(k)}(?:$|[^0-9A-Za-z_])'))) > 0 THEN '{k}' END"
    return "list_sort(list_filter([" + ", ".join(hit(k) for k in jobs.KNOWN_SKILLS) + "], lambda k: k IS NOT NULL))"


_SPACE = r"[ \t\n\r\f\x0B]+"
_SQUEEZE = "trim(regexp_replace({}, '" + _SPACE + "', ' ', 'g'))"
_SPLIT = r"list_filter(list_transform(regexp_split_to_array(regexp_replace({}, '([.!?])[ \t\n\r\f\x0B]+', '\1' || chr(10), 'g'), '\n+'), lambda x: trim(x)), lambda x: x <> '')"
_LEVEL = {label: next((level for level, names in SENIORITY_ALIASES.items() if label in names), None) for label, _ in jobs.SENIORITY_RULES}
_EXTRACT = lambda ps: "coalesce(" + ", ".join("nullif(regexp_extract(t, '" + (p if p.startswith("(?i)") and "\\b" not in p else ("(?i)" if p.startswith("(?i)") else "") + _edged(p.removeprefix("(?i)"))) + "', 1), '')" for p in ps) + ")"
_COUNTS = ", ".join(f"len(regexp_extract_all(t, '(?i){_edged(p)}'))" for _, p in jobs.DOMAIN_RULES)
_DOMAINS = ", ".join(f"'{label}'" for label, _ in jobs.DOMAIN_RULES)
JOBS_SQL = rf"""WITH d AS (SELECT doc_id, {HEADING.replace("STRING", "VARCHAR")} || array_to_string(list_transform({_SPLIT.format("text")}, lambda s: {SAYING.replace("STRING", "VARCHAR")}), chr(10)) AS t FROM documents WHERE text IS NOT NULL),
p AS (SELECT *, list_filter(list_transform({_SPLIT.format("t")}, lambda s: {_SQUEEZE.format("s")}), lambda s: s <> '') AS parts, list_filter(list_transform(string_split(t, chr(10)), lambda s: {_SQUEEZE.format("s")}), lambda s: s <> '')[1:3] AS top FROM d),
q AS (SELECT *, list_filter(top, lambda s: regexp_matches(s, '(?i){_EDGE}(engineer|developer|scientist|analyst|manager|architect|specialist|intern){_END}') AND len(string_split(s, ' ')) <= 8)[1] AS line,
 {_SQUEEZE.format("regexp_extract(t, '" + _EDGE + "([A-Z][A-Za-z/+ -]{0,40}(?:Engineer|Developer|Scientist|Analyst|Architect))" + _END + "', 1)")} AS inline_title,
 list_filter(parts, lambda s: NOT {_has(jobs.NICE_CUES, "s")}) AS must, list_filter(parts, lambda s: {_has(jobs.NICE_CUES, "s")}) AS nice,
 list_filter(parts, lambda s: lower(s) <> 'responsibilities' AND ({_has(jobs.DUTY_CUES, "s")} OR regexp_matches(s, '{jobs.DUTY_VERBS}')))[1:6] AS duties,
 TRY_CAST({_EXTRACT(jobs.YEARS_PATTERNS)} AS DOUBLE) AS years, [{_COUNTS}] AS counts,
 {_EXTRACT(jobs.LOCATION_PATTERNS)} AS found FROM p),
r AS (SELECT *, coalesce(line, nullif(inline_title, '')) AS title, {_SQUEEZE.format("regexp_replace(found, '[.]+$', '')")} AS l0, CASE WHEN list_max(counts) > 0 THEN ([{_DOMAINS}])[list_position(counts, list_max(counts))] END AS domain,
 {_first(jobs.REMOTE_RULES, "t")} AS remote, {_first(jobs.CONTRACT_RULES, "t")} AS contract, {_skills("must")} AS required, {_skills("nice")} AS wished, len(list_distinct(list_transform(duties, lambda s: lower(s)))) AS n_duties FROM q),
u AS (SELECT *, nullif({_SQUEEZE.format(f"regexp_replace({_SQUEEZE.format(rf'''regexp_replace(l0, '(?i)[ \t\n\r\f\x0B]+(?:and follows|and is|with|for|where){_END}.*|{_EDGE}(?:remote|hybrid|on[- ]site|onsite){_END}.*', '', 'g')''')}, '[, ]+$', '')")}, '') AS location,
 CASE {_first(jobs.SENIORITY_RULES, "concat_ws(chr(10), title, t)")} {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _LEVEL.items() if v)} END AS seniority FROM r),
w AS (SELECT *, (title IS NULL)::INT + (len(required) = 0)::INT + (n_duties = 0)::INT + (seniority IS NULL)::INT + (years IS NULL)::INT + (location IS NULL AND remote IS NULL)::INT + (len(string_split({_SQUEEZE.format("t")}, ' ')) < 25)::INT AS n_warnings FROM u)
SELECT doc_id, coalesce(title, 'Unknown Role') AS job_title, array_to_string(required, '|') AS required, array_to_string(wished, '|') AS nice, n_duties, years, seniority, location, remote, contract, domain, n_warnings,
 round(least(greatest(CAST(0.5 AS DOUBLE) + least(CAST(0.2 AS DOUBLE), len(required) * CAST(0.03 AS DOUBLE)) + CASE WHEN n_duties > 0 THEN CAST(0.1 AS DOUBLE) ELSE 0 END + CASE WHEN seniority IS NULL THEN 0 ELSE CAST(0.05 AS DOUBLE) END + CASE WHEN years IS NULL THEN 0 ELSE CAST(0.05 AS DOUBLE) END
 + CASE WHEN location IS NULL THEN 0 ELSE CAST(0.03 AS DOUBLE) END + CASE WHEN remote IS NULL THEN 0 ELSE CAST(0.03 AS DOUBLE) END - least(CAST(0.2 AS DOUBLE), n_warnings * CAST(0.04 AS DOUBLE)), 0), CAST(0.99 AS DOUBLE)), 4) AS confidence FROM w"""


@query("job_texts", JOBS_SQL)
def job_texts(spark, d):
    """Job descriptions made of whole texts, with cues by the length of each sentence; the SQL reads the description again by its own patterns."""
    from talentloom.functions.text import sentences

    said = F.transform(sentences(C("text")), lambda s: s)
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", "text", said.alias("ss"))
    rows = rows.selectExpr("doc_id", f"concat({HEADING}, array_join(transform(ss, s -> {SAYING}), '\n')) AS description")
    p = jobs.job_profiles(rows)
    joined = lambda c: F.array_join(F.array_sort(c), "|")
    return p.select(
        "doc_id", "job_title", joined("required_skills").alias("required"), joined("nice_to_have_skills").alias("nice"), F.size("responsibilities").alias("n_duties"), C("years_experience_required").alias("years"),
        C("seniority_level").alias("seniority"), "location", C("remote_policy").alias("remote"), C("contract_type").alias("contract"), "domain", F.size("warnings").alias("n_warnings"), "confidence",
    )


HEADERS_SQL = r"""WITH c AS (SELECT c_custkey, '+216 ' || lpad(CAST(c_custkey AS VARCHAR), 12, '7') AS phone, c_acctbal < 0 AS bare, n_nationkey AS nation, array_to_string(list_transform(string_split(lower(r_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS region,
 upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS family FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)
SELECT c_custkey, CASE WHEN NOT bare THEN 'Anna ' || family END AS full_name, 'c' || c_custkey || '@mail.org' AS email, phone, CASE WHEN NOT bare THEN region || ', ' || family WHEN nation < 10 THEN 'from ' || (['Tunisia', 'France', 'Germany', 'USA', 'United States', 'Canada', 'Ireland', 'India', 'UK', 'United Kingdom'])[nation + 1] END AS location,
 CASE WHEN c_custkey % 2 = 0 THEN 'https://linkedin.com/in/c' || c_custkey END AS linkedin, CASE WHEN c_custkey % 2 = 1 THEN 'github.com/c' || c_custkey END AS github FROM c"""


@query("customer_headers", HEADERS_SQL)
def customer_headers(spark, d):
    """Headers written from customers, their nations and regions, read back."""
    c = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), C("n_nationkey") == C("c_nationkey")).join(F.broadcast(table(spark, d, "region")), C("r_regionkey") == C("n_regionkey"))
    bare, key = C("c_acctbal") < 0, C("c_custkey").cast("string")
    country = F.coalesce(F.get(F.array(*[F.lit(x) for x in L.COUNTRIES]), C("n_nationkey").cast("int")), F.initcap("n_name"))
    text = F.concat_ws(
        "\n",
        F.when(bare, "DATA SCIENTIST 2").otherwise(F.concat(F.lit("# Anna "), F.initcap("c_mktsegment"))),
        F.concat(F.lit("c"), key, F.lit("@mail.org | +216 "), F.lpad(key, 12, "7")),
        F.when(bare, F.concat(F.lit("from "), country)).otherwise(F.concat(F.lit("- "), F.initcap("r_name"), F.lit(", "), F.initcap("c_mktsegment"))),
        F.when(C("c_custkey") % 2 == 0, F.concat(F.lit("https://linkedin.com/in/c"), key)).otherwise(F.concat(F.lit("github.com/c"), key)),
    )
    return c.select("c_custkey", L.header_info(text).alias("h")).select("c_custkey", "h.full_name", "h.email", "h.phone", "h.location", "h.linkedin", "h.github")


_ONE = rf"(?:{L.MONTHS}\.? [0-9]{{4}}|(?:0?[1-9]|1[0-2])/[0-9]{{4}}|(?:19|20)[0-9]{{2}})"
_NAMES = " OR ".join(f"regexp_matches(key, '{p}')" for _, p in L.SECTION_RULES)
SHAPES_SQL = rf"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?]) +', '\1' || chr(10), 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM documents),
e AS (SELECT doc_id, unnest(ls) AS s, generate_subscripts(ls, 1) - 1 AS pos FROM s), k AS (SELECT {", ".join(layouts.BLOCKS)} FROM e),
t AS (SELECT doc_id, idx, text AS t, trim(regexp_replace(lower(text), '^[#:\- ]+|[#:\- ]+$', '', 'g')) AS key, len(string_split_regex(text, '[ \t\n\r\f\x0B]+')) AS words FROM k)
SELECT doc_id, idx, CASE WHEN {_NAMES} THEN 'section' WHEN regexp_matches(t, '(?i){_ONE}') AND words <= 6 THEN 'date' WHEN regexp_matches(t, '{L.EMAIL}') OR regexp_matches(t, '(?i)linkedin\.com|github\.com|\+?[0-9][0-9 ()-]{{7,}}') THEN 'contact'
 WHEN regexp_matches(t, '^[A-Z][A-Za-z .-]+, *[A-Z][A-Za-z .-]+$') AND words <= 5 THEN 'location' WHEN regexp_matches(t, '(?i){_EDGE}(university|school|bachelor|master|degree|institute){_END}') THEN 'education'
 WHEN len(string_split(t, ',')) >= 4 AND words <= 20 THEN 'skill' WHEN words <= 8 AND regexp_matches(t, '^[A-Z]') AND NOT regexp_matches(t, '[.!?]$') THEN 'title' ELSE 'text' END AS shape FROM t"""


@query("line_shapes_whole", SHAPES_SQL)
def line_shapes_whole(spark, d):
    """The shape of every line of every text."""
    return layouts.page_blocks(spark, d).select("doc_id", "idx", L.line_shape(C("text")).alias("shape"))
