"""Moves of customers to the role of their nation's job: brands bought in bulk are skills, markets are titles."""

from __future__ import annotations

from pyspark.sql import functions as F

from talentloom.operators import transfer as T
from talentloom.plans.registry import query, table

C = F.col
ROLES = ["Backend Developer", "Frontend Developer", "Full Stack Developer", "Data Engineer", "Data Analyst", "Machine Learning Engineer", "DevOps Engineer", "Business Intelligence Analyst"]
BULK = 60
_brand = lambda n: f"Brand#{n % 25 + 1}"
_way = lambda to, *brands: {"role": ROLES[to % 8], "condition_skills": [_brand(b) for b in brands], "rationale": ""}
#: Role i: four core skills, three adjacent ones, ways to the next role, to the third after it, and one without conditions.
GRAPH = [(r, [_brand(3 * i + k) for k in range(4)], [_brand(3 * i + 4 + k) for k in range(3)], [_way(i + 1, 3 * i, 3 * i + 7, 3 * i + 9), _way(i + 3, 5 * i + 2), _way(i + 1, 3 * i + 5), _way(i + 2)]) for i, r in enumerate(ROLES)]
TITLES = ["backend-developer", "Front end lead", "FULL STACK dev.", "Data  Engineer", "Data Analyst", "ml.engineer", "ML engineer", "DevOps", "baker"]
TITLE = f"CASE n_nationkey % {len(TITLES)} " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(TITLES)) + " END"
DOMAIN = "CASE n_nationkey % 3 WHEN 0 THEN 'bi analyst' WHEN 1 THEN 'bread' END"
JOB_ID = "concat('job_', CASE WHEN n_nationkey % 2 = 0 THEN 'devops_' ELSE '' END, n_name)"
WANTED = ["concat('BRAND#', CAST(n_nationkey * 3 % 25 + 1 AS {}))", "concat('Brand#', CAST((n_nationkey * 7 + 2) % 25 + 1 AS {}))", "concat('Brand#', CAST((n_nationkey * 11 + 5) % 31 + 1 AS {}))"]
NICE = ["concat('brand#', CAST((n_nationkey * 5 + 1) % 25 + 1 AS {}))", "concat('Brand#', CAST((n_nationkey * 2 + 9) % 25 + 1 AS {}))"]
MARKET = "CASE c_mktsegment WHEN 'BUILDING' THEN 'Backend Developer' WHEN 'MACHINERY' THEN 'Senior ML.Engineer / ML engineer' WHEN 'HOUSEHOLD' THEN 'Data Analyst' ELSE c_mktsegment END"


def people(spark, d):
    """All customers with the brands of which they bought BULK pieces at least, their market as title and the role that fits them best."""
    o, li, p = table(spark, d, "orders").select("o_orderkey", "o_custkey"), table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity"), table(spark, d, "part").select("p_partkey", "p_brand")
    # orders are held by key and lines stream by, where a merge join would sort all lines
    bought = li.join(o.hint("shuffle_hash"), C("o_orderkey") == C("l_orderkey")).join(p, C("l_partkey") == C("p_partkey")).groupBy("o_custkey", "p_brand").agg(F.sum("l_quantity").alias("n"))
    skills = bought.where(C("n") >= BULK).groupBy("o_custkey").agg(F.array_sort(F.collect_list("p_brand")).alias("skills"))
    them = table(spark, d, "customer").select(C("c_custkey").alias("cust"), "c_nationkey", F.expr(MARKET).alias("titles"))
    them = them.join(skills, C("cust") == C("o_custkey"), "left").withColumn("skills", F.coalesce("skills", F.array().cast("array<string>")))
    them = them.withColumn("norms", T.normal_skills(C("skills")))
    return them.select("cust", "c_nationkey", "skills", "norms", T.source_role(GRAPH, C("norms"), C("titles")).alias("source_role"))


def jobs(spark, d):
    """A job of each nation, with its target role."""
    made = [F.expr(f"array({', '.join(x.format('STRING') for x in xs)})") for xs in (WANTED, NICE)]
    rows = table(spark, d, "nation").select("n_nationkey", F.expr(JOB_ID).alias("job_id"), F.expr(TITLE).alias("title"), F.expr(DOMAIN).alias("domain"), made[0].alias("required"), made[1].alias("nice"))
    return T.with_targets(rows, GRAPH, "title", "domain", "job_id", "required", "nice")


_list = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]::VARCHAR[]"
_said = lambda x: "trim(regexp_replace(replace(lower(trim(" + x + ")), '.', ''), '[^a-z0-9+#/]+', ' ', 'g'))"
_first = lambda x: "CASE " + " ".join(f"WHEN contains({x}, '{a}') THEN '{r}'" for a, r in T.ROLE_ALIASES.items()) + " END"
_alias = "CASE WHEN " + " OR ".join(f"(role = '{r}' AND contains(titles, '{a}'))" for a, r in T.ROLE_ALIASES.items()) + " THEN 1 ELSE 0 END"
_once = lambda xs: f"list_filter({xs}, lambda v, i: list_position(list_transform({xs}, lambda w: lower(w)), lower(v)) = i)"
_held = lambda xs: f"list_filter({xs}, lambda s: list_contains(norms, lower(s)))"
_lost = lambda xs: f"list_filter({xs}, lambda s: NOT list_contains(norms, lower(s)))"
_ROLES = ", ".join(f"({i}, '{r}', {_list(c)}, {_list(a)})" for i, (r, c, a, _) in enumerate(GRAPH))
_WAYS = ", ".join(f"('{r}', '{w['role']}', {_list(w['condition_skills'])})" for r, _, _, ws in GRAPH for w in ws)
TRANSFER_SQL = f"""roles AS (SELECT * FROM (VALUES {_ROLES}) t(ord, role, core, adjacent)), ways AS (SELECT * FROM (VALUES {_WAYS}) t(source, target, conditions)),
sk AS (SELECT o_custkey, p_brand FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2 HAVING sum(l_quantity) >= {BULK}),
held AS (SELECT o_custkey, list(lower(p_brand)) AS norms FROM sk GROUP BY 1), ppl AS (SELECT c_custkey AS cust, c_nationkey, {_said(MARKET)} AS titles, coalesce(norms, []) AS norms FROM customer LEFT JOIN held ON c_custkey = o_custkey),
rated AS (SELECT cust, role, ord, len(list_intersect(norms, list_transform(core, lambda s: lower(s)))) + 0.5 * len(list_intersect(norms, list_transform(adjacent, lambda s: lower(s)))) + CASE WHEN contains(titles, lower(role)) THEN 1 ELSE 0 END + {_alias} AS score FROM ppl CROSS JOIN roles),
sourced AS (SELECT cust, role AS source_role FROM rated QUALIFY row_number() OVER (PARTITION BY cust ORDER BY score DESC, ord) = 1),
named AS (SELECT n_nationkey, {JOB_ID} AS job_id, {TITLE} AS title, {DOMAIN} AS domain, [{", ".join(x.format("VARCHAR") for x in WANTED)}] AS required, [{", ".join(x.format("VARCHAR") for x in NICE)}] AS nice FROM nation),
aimed AS (SELECT *, coalesce({_first(_said("title"))}, {_first(_said("domain"))}, {_first(_said("job_id"))}, '{ROLES[0]}') AS target_role FROM named),
jobs AS (SELECT a.*, {_once("list_concat(r.core, a.required)")} AS wanted, {_once("list_concat(r.adjacent, a.nice)")} AS near FROM aimed a JOIN roles r ON r.role = a.target_role)"""
_PARTED = f"""met AS (SELECT p.cust, p.norms, w.source, w.target, w.conditions, round(len({_held("w.conditions")}) / greatest(len(w.conditions), 1), 4) AS coverage FROM ppl p CROSS JOIN ways w)"""


@query("transfer_targets", f"WITH {TRANSFER_SQL} SELECT job_id, target_role, array_to_string(wanted, '|') AS target_core, array_to_string(near, '|') AS target_adjacent FROM jobs")
def transfer_targets(spark, d):
    """The role that each job is for, by its title, its domain or its id, with the skills it asks for."""
    return jobs(spark, d).select("job_id", "target_role", F.array_join("target_core", "|").alias("target_core"), F.array_join("target_adjacent", "|").alias("target_adjacent"))


_COUNT = lambda xs: f"CAST(len({xs}) AS DOUBLE)"


@query("transfer_reports", f"""WITH {TRANSFER_SQL}, {_PARTED}, b AS (SELECT p.cust, p.norms, s.source_role, j.* FROM ppl p JOIN sourced s ON p.cust = s.cust JOIN jobs j ON j.n_nationkey = p.c_nationkey),
o AS (SELECT cust, source, target, max(coverage) AS best, count(*) AS n_ways, list_transform(flatten(list(conditions)), lambda s: lower(s)) AS conditions FROM met WHERE coverage > 0 GROUP BY 1, 2, 3),
w AS (SELECT b.*, coalesce(best, 0.0) AS best, coalesce(n_ways, 0) AS n_ways, list_concat(list_transform(near, lambda s: lower(s)), coalesce(conditions, [])) AS helps, {_held("wanted")} AS matched, {_lost("wanted")} AS missing, {_held("near")} AS matched_near, len({_held("required")}) / len(required) AS fit
 FROM b LEFT JOIN o ON b.cust = o.cust AND o.source = b.source_role AND o.target = b.target_role),
g AS (SELECT *, list_filter(missing, lambda s: list_contains(helps, lower(s))) AS comp, list_filter(missing, lambda s: NOT list_contains(helps, lower(s))) AS block FROM w),
z AS (SELECT *, least(greatest(CAST(0.55 AS DOUBLE) * ({_COUNT("matched")} / len(wanted)) + CAST(0.2 AS DOUBLE) * ({_COUNT("matched_near")} / len(near)) + CAST(0.15 AS DOUBLE) * best - CAST(0.1 AS DOUBLE) * ({_COUNT("block")} / len(wanted)), 0.0), 1.0) AS score FROM g)
SELECT cust, job_id, source_role, target_role, round(fit, 4) AS direct_fit_score, fit >= 0.7 AS fit_direct, round(score, 4) AS transferability_score, CAST(n_ways AS INT) AS n_transitions, array_to_string(matched, '|') AS matched_core, array_to_string(matched_near, '|') AS matched_adjacent,
 array_to_string(comp, '|') AS gaps_compensable, array_to_string(block, '|') AS gaps_blocking,
 CASE WHEN fit >= 0.7 THEN printf('{T.DIRECT}', target_role, printf('%.2f', fit), printf('%.2f', score)) WHEN len(block) > 0 THEN printf('{T.BLOCKED}', source_role, target_role, array_to_string(block, ', ')) ELSE printf('{T.OPEN}', source_role, target_role, printf('%.2f', score)) END AS explanation FROM z""")
def transfer_reports(spark, d):
    """Each customer against the job of the customer's nation: fit, ways, gaps and the explanation."""
    pairs = people(spark, d).join(jobs(spark, d), C("c_nationkey") == C("n_nationkey"))
    out = T.reports(pairs, GRAPH, "skills", "source_role", "required", "norms")
    lists = [F.array_join(c, "|").alias(c) for c in ("matched_core", "matched_adjacent", "gaps_compensable", "gaps_blocking")]
    return out.select("cust", "job_id", "source_role", "target_role", "direct_fit_score", "fit_direct", "transferability_score", F.size("transitions").alias("n_transitions"), *lists, "explanation")


@query("transfer_role_coverage", f"""WITH {TRANSFER_SQL}, {_PARTED}, b AS (SELECT p.cust, p.norms, s.source_role AS target_role, r.core, r.adjacent FROM ppl p JOIN sourced s ON p.cust = s.cust JOIN roles r ON r.role = s.source_role),
o AS (SELECT cust, target, count(*) AS n_ways, list_transform(flatten(list(conditions)), lambda s: lower(s)) AS conditions FROM met WHERE coverage > 0 GROUP BY 1, 2),
w AS (SELECT b.*, coalesce(n_ways, 0) AS n_ways, list_concat(list_transform(adjacent, lambda s: lower(s)), coalesce(conditions, [])) AS helps, {_held("core")} AS matched, {_lost("core")} AS missing FROM b LEFT JOIN o ON b.cust = o.cust AND o.target = b.target_role),
g AS (SELECT *, len(matched) / len(core) AS part, list_filter(missing, lambda s: list_contains(helps, lower(s))) AS comp, list_filter(missing, lambda s: NOT list_contains(helps, lower(s))) AS block FROM w)
SELECT cust, target_role, round(part, 4) AS coverage_score, CAST(n_ways AS INT) AS n_transitions, array_to_string(missing, '|') AS missing, array_to_string(comp, '|') AS gaps_compensable,
 CASE WHEN part >= 0.7 THEN printf('{T.COVERED}', target_role) WHEN n_ways > 0 AND len(comp) > 0 THEN printf('{T.COMPENSABLE}', target_role, array_to_string(comp, ', ')) WHEN len(block) > 0 THEN printf('{T.BLOCKING}', target_role, array_to_string(block, ', ')) ELSE printf('{T.NEUTRAL}', target_role) END AS explanation FROM g""")
def transfer_role_coverage(spark, d):
    """Each customer against the role that fits best: coverage, ways into it from any role, gaps and the explanation."""
    out = T.role_coverage(people(spark, d), GRAPH, "skills", "source_role", "norms")
    return out.select("cust", C("source_role").alias("target_role"), "coverage_score", F.size("transitions").alias("n_transitions"), F.array_join("missing_skills", "|").alias("missing"), F.array_join("gaps_compensable", "|").alias("gaps_compensable"), "explanation")
