"""Role and skill graph queries on brands."""

from __future__ import annotations

from pyspark.sql import functions as F

from talentloom.operators import graph as G
from talentloom.plans.entities import SKILLS_SQL, customer_skill_sets, customer_skills
from talentloom.plans.registry import query, table

C = F.col
ROLES = [("building", ["Brand#11", "Brand#12", "Brand#13"], ["Brand#21", "Brand#22"]), ("household", ["Brand#31", "Brand#32"], ["Brand#11", "Brand#33"]), ("r3", ["Brand#41", "Brand#42", "Brand#43", "Brand#44"], ["Brand#12"])]
ALIASES = {"machinery": "r3", "furniture": "household"}
#: Ways into the role "building": from which role, under which skills.
WAYS = [("household", ["Brand#12", "Brand#23"]), ("household", ["Brand#51"]), ("r3", ["Brand#13", "Brand#14", "Brand#15"])]
ROLES_SQL = """roles AS (SELECT * FROM (VALUES (0, 'building', ['Brand#11', 'Brand#12', 'Brand#13'], ['Brand#21', 'Brand#22']), (1, 'household', ['Brand#31', 'Brand#32'], ['Brand#11', 'Brand#33']), (2, 'r3', ['Brand#41', 'Brand#42', 'Brand#43', 'Brand#44'], ['Brand#12'])) t(ord, role, core, adjacent)),
people AS (SELECT cust, lower(any_value(c_mktsegment)) AS titles, list_distinct(list(skill)) AS skills FROM cs JOIN customer ON cust = c_custkey GROUP BY cust),
sourced AS (SELECT cust, titles, skills, role AS source_role, score FROM (SELECT *, row_number() OVER (PARTITION BY cust ORDER BY score DESC, ord) AS rn FROM (SELECT *, len(list_intersect(skills, core)) + 0.5 * len(list_intersect(skills, adjacent)) + CASE WHEN contains(titles, role) THEN 1 ELSE 0 END
 + CASE WHEN (role = 'r3' AND contains(titles, 'machinery')) OR (role = 'household' AND contains(titles, 'furniture')) THEN 1 ELSE 0 END AS score FROM people, roles)) WHERE rn = 1)"""

ONLY_ROLES_SQL = ROLES_SQL.split(",\npeople")[0]


def people(spark, d):
    """Customers with their skills and their market segment as title."""
    titles = table(spark, d, "customer").select(C("c_custkey").alias("cust"), F.lower("c_mktsegment").alias("titles"))
    return customer_skill_sets(spark, d).join(titles, "cust")


@query("best_source_role", f"WITH {SKILLS_SQL}, {ROLES_SQL} SELECT cust, source_role, CAST(score AS DOUBLE) AS role_score FROM sourced")
def best_source_role(spark, d):
    return G.source_role(people(spark, d), G.role_tables(spark, ROLES), "cust", "skills", "titles", ALIASES)


@query("role_transferability", f"""WITH {SKILLS_SQL}, {ROLES_SQL}, w AS (SELECT cust, skills, source_role, ['Brand#11', 'Brand#12', 'Brand#13', 'Brand#51'] AS wanted, ['Brand#21', 'Brand#22', 'Brand#13'] AS adj, ['Brand#11', 'Brand#51'] AS req FROM sourced),
v AS (SELECT *, CASE WHEN source_role = 'household' THEN round(len(list_intersect(['Brand#12', 'Brand#23'], skills)) / 2, 4) ELSE 0.0 END AS t1, CASE WHEN source_role = 'household' THEN round(len(list_intersect(['Brand#51'], skills)) / 1, 4) ELSE 0.0 END AS t2,
 CASE WHEN source_role = 'r3' THEN round(len(list_intersect(['Brand#13', 'Brand#14', 'Brand#15'], skills)) / 3, 4) ELSE 0.0 END AS t3, list_filter(wanted, lambda x: NOT list_contains(skills, x)) AS missing FROM w),
h AS (SELECT *, list_concat(adj, CASE WHEN t1 > 0 THEN ['Brand#12', 'Brand#23'] ELSE [] END, CASE WHEN t2 > 0 THEN ['Brand#51'] ELSE [] END, CASE WHEN t3 > 0 THEN ['Brand#13', 'Brand#14', 'Brand#15'] ELSE [] END) AS helps FROM v),
k AS (SELECT *, list_filter(missing, lambda x: list_contains(helps, x)) AS comp, list_filter(missing, lambda x: NOT list_contains(helps, x)) AS block FROM h)
SELECT cust, round(len(list_intersect(req, skills)) / 2, 4) AS direct_fit_score, len(list_intersect(req, skills)) / 2 >= 0.7 AS fit_direct,
 round(least(greatest(0.55 * (len(list_intersect(wanted, skills)) / 4) + 0.20 * (len(list_intersect(adj, skills)) / 3) + 0.15 * greatest(t1, t2, t3) - 0.10 * len(block) / 4, 0.0), 1.0), 4) AS transferability_score, array_to_string(comp, '|') AS gaps_compensable, array_to_string(block, '|') AS gaps_blocking FROM k""")
def role_transferability(spark, d):
    them = people(spark, d)
    roles = G.source_role(them, G.role_tables(spark, ROLES), "cust", "skills", "titles", ALIASES)
    core, adjacent = ROLES[0][1], ROLES[0][2]
    t = G.transferability(them.join(roles, "cust"), "cust", "skills", "source_role", core, [*adjacent, "Brand#13"], ["Brand#11", "Brand#51"], WAYS)
    return t.withColumn("gaps_compensable", F.array_join("gaps_compensable", "|")).withColumn("gaps_blocking", F.array_join("gaps_blocking", "|"))


@query("graph_role_coverage", f"WITH {SKILLS_SQL}, {ROLES_SQL}, e AS (SELECT role, unnest(core) AS skill FROM roles) SELECT cs.cust, e.role, count(*) AS matched FROM cs JOIN e ON cs.skill = e.skill GROUP BY 1, 2")
def graph_role_coverage(spark, d):
    e = G.role_tables(spark, ROLES).select("role", F.explode("core").alias("skill"))
    return customer_skills(spark, d).join(F.broadcast(e), "skill").groupBy("cust", "role").agg(F.count("*").alias("matched"))


@query("graph_edges_into_role", f"WITH {ONLY_ROLES_SQL} SELECT role, skill, kind FROM (SELECT role, unnest(core) AS skill, 'core' AS kind FROM roles UNION ALL SELECT role, unnest(adjacent), 'adjacent' FROM roles) WHERE role = 'building'")
def graph_edges_into_role(spark, d):
    r = G.role_tables(spark, ROLES)
    e = r.select("role", F.explode("core").alias("skill"), F.lit("core").alias("kind")).unionByName(r.select("role", F.explode("adjacent").alias("skill"), F.lit("adjacent").alias("kind")))
    return e.where("role = 'building'")


@query("graph_vertex_merge", "SELECT lower(p_brand) AS key, arg_max(p_brand, p_partkey) AS p_brand FROM part GROUP BY 1")
def graph_vertex_merge(spark, d):
    return G.vertices(table(spark, d, "part").select(F.lower("p_brand").alias("key"), "p_brand", "p_partkey"), "key", "p_brand", "p_partkey")


@query("graph_distinct_edges", f"WITH {SKILLS_SQL} SELECT skill, count(*) AS holders FROM cs GROUP BY skill")
def graph_distinct_edges(spark, d):
    return customer_skills(spark, d).groupBy("skill").agg(F.count("*").alias("holders"))
