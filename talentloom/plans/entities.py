"""Joins, entity resolution, consolidation and set queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from talentloom.functions.text import distinct_folded_long
from talentloom.operators import resolve as R
from talentloom.operators import windows as W
from talentloom.plans.registry import PROFILES_SQL, profiles, query, table

C = F.col


@query("join_inner_profiles", f"WITH {PROFILES_SQL} SELECT p.profile_id, l.quality FROM profiles p JOIN labels l ON p.profile_id = l.doc_id")
def join_inner_profiles(spark, d):
    return profiles(spark, d).join(table(spark, d, "labels"), C("profile_id") == C("doc_id")).select("profile_id", "quality")


@query("join_left_enrich", f"WITH {PROFILES_SQL} SELECT p.profile_id, l.quality, l.doc_id IS NOT NULL AS matched_label FROM profiles p LEFT JOIN labels l ON p.profile_id = l.doc_id")
def join_left_enrich(spark, d):
    j = profiles(spark, d).join(table(spark, d, "labels"), C("profile_id") == C("doc_id"), "left")
    return j.select("profile_id", "quality", C("doc_id").isNotNull().alias("matched_label"))


@query("join_left_anti_resume", f"WITH {PROFILES_SQL} SELECT profile_id FROM profiles WHERE profile_id NOT IN (SELECT doc_id FROM labels)")
def join_left_anti_resume(spark, d):
    return profiles(spark, d).join(table(spark, d, "labels"), C("profile_id") == C("doc_id"), "left_anti").select("profile_id")


@query("join_semi_key_list", f"WITH {PROFILES_SQL} SELECT profile_id, reliability FROM profiles WHERE profile_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def join_semi_key_list(spark, d):
    keys = table(spark, d, "labels").where("toxic = 1").select("doc_id")
    return profiles(spark, d).join(keys, C("profile_id") == C("doc_id"), "left_semi").select("profile_id", "reliability")


@query("join_fallback_key", f"WITH {PROFILES_SQL}, m AS (SELECT doc_id, quality FROM labels), a AS (SELECT p.profile_id, coalesce(x.quality, y.quality) AS quality, CASE WHEN x.doc_id IS NOT NULL THEN 'first' WHEN y.doc_id IS NOT NULL THEN 'second' END AS via FROM profiles p LEFT JOIN m x ON p.profile_id = x.doc_id LEFT JOIN m y ON p.profile_id + 1 = y.doc_id) SELECT * FROM a")
def join_fallback_key(spark, d):
    m = table(spark, d, "labels").select("doc_id", "quality")
    a = m.select(C("doc_id").alias("_a"), C("quality").alias("_qa"))
    b = m.select(C("doc_id").alias("_b"), C("quality").alias("_qb"))
    j = profiles(spark, d).join(a, C("profile_id") == C("_a"), "left").join(b, C("profile_id") + 1 == C("_b"), "left")
    return j.select("profile_id", F.coalesce("_qa", "_qb").alias("quality"), F.when(C("_a").isNotNull(), "first").when(C("_b").isNotNull(), "second").alias("via"))


SKILLS_SQL = "cs AS (SELECT DISTINCT o_custkey AS cust, p_brand AS skill FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey), jobs AS (SELECT * FROM (VALUES ('job_a', 'Brand#11', 0), ('job_a', 'Brand#12', 1), ('job_a', 'Brand#13', 2), ('job_b', 'Brand#21', 0), ('job_b', 'Brand#99', 1)) t(job, skill, ord))"
JOBS = [("job_a", "Brand#11", 0), ("job_a", "Brand#12", 1), ("job_a", "Brand#13", 2), ("job_b", "Brand#21", 0), ("job_b", "Brand#99", 1)]


def bought_brands(spark, d):
    """(customer, brand) of every line bought."""
    o, li, p = table(spark, d, "orders").select("o_orderkey", "o_custkey"), table(spark, d, "lineitem").select("l_orderkey", "l_partkey"), table(spark, d, "part").select("p_partkey", "p_brand")
    j = li.join(o, C("l_orderkey") == C("o_orderkey")).join(p, C("l_partkey") == C("p_partkey"))
    return j.select(C("o_custkey").alias("cust"), C("p_brand").alias("skill"))


def customer_skills(spark, d):
    return bought_brands(spark, d).distinct()


def customer_skill_sets(spark, d):
    """One row per customer: sets are built map-side first, so no distinct comes before."""
    return bought_brands(spark, d).groupBy("cust").agg(F.collect_set("skill").alias("skills"))


def jobs(spark):
    return F.broadcast(spark.createDataFrame(JOBS, "job string, skill string, ord int"))  # five stated rows


@query("skill_match_missing", f"WITH {SKILLS_SQL}, c AS (SELECT DISTINCT cust FROM cs), x AS (SELECT c.cust, j.job, j.ord, j.skill, cs.skill IS NOT NULL AS hit FROM c CROSS JOIN jobs j LEFT JOIN cs ON cs.cust = c.cust AND cs.skill = j.skill) SELECT cust, job, coalesce(string_agg(skill, '|' ORDER BY ord) FILTER (WHERE hit), '') AS matched, coalesce(string_agg(skill, '|' ORDER BY ord) FILTER (WHERE NOT hit), '') AS missing FROM x GROUP BY cust, job")
def skill_match_missing(spark, d):
    have = customer_skill_sets(spark, d)
    wanted = jobs(spark).groupBy("job").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "skill"))), lambda s: s["skill"]).alias("required"))
    j = have.join(F.broadcast(wanted))
    return j.select("cust", "job", F.array_join(F.filter("required", lambda s: F.array_contains("skills", s)), "|").alias("matched"), F.array_join(F.filter("required", lambda s: ~F.array_contains("skills", s)), "|").alias("missing"))


@query("corpus_alignment", f"WITH {SKILLS_SQL}, n AS (SELECT count(DISTINCT cust) AS n FROM cs), h AS (SELECT j.job, cs.cust, count(*) AS k FROM jobs j JOIN cs ON cs.skill = j.skill GROUP BY 1, 2), r AS (SELECT job, count(*) AS required FROM jobs GROUP BY job) SELECT r.job, count(h.cust) AS with_any, count(h.cust) FILTER (WHERE k = required) AS with_all, round(CAST(coalesce(sum(k), 0) AS DOUBLE) / any_value(required) / any_value(n), 6) AS mean_coverage FROM r LEFT JOIN h ON h.job = r.job, n GROUP BY r.job")
def corpus_alignment(spark, d):
    have = customer_skills(spark, d)
    n = have.agg(F.count_distinct("cust").alias("_n"))
    required = spark.createDataFrame(JOBS, "job string, skill string, ord int").groupBy("job").agg(F.count("*").alias("required"))
    hits = have.join(jobs(spark), "skill").groupBy("job", "cust").agg(F.count("*").alias("k"))
    g = required.join(hits, "job", "left").groupBy("job", "required").agg(F.count("cust").alias("with_any"), F.count_if(C("k") == C("required")).alias("with_all"), F.coalesce(F.sum("k"), F.lit(0)).alias("_k"))
    return g.crossJoin(F.broadcast(n)).select("job", "with_any", "with_all", F.round(C("_k") / C("required") / C("_n"), 6).alias("mean_coverage"))


@query("skill_variant_expand", "WITH v AS (SELECT * FROM (VALUES ('brand#11', 'Alpha'), ('brand#11', 'Beta'), ('brand#12', 'Gamma')) t(k, canonical)) SELECT p_partkey, coalesce(canonical, p_brand) AS skill FROM part LEFT JOIN v ON lower(p_brand) = v.k")
def skill_variant_expand(spark, d):
    v = spark.createDataFrame([("brand#11", "Alpha"), ("brand#11", "Beta"), ("brand#12", "Gamma")], "k string, canonical string")
    return table(spark, d, "part").join(F.broadcast(v), F.lower("p_brand") == C("k"), "left").select("p_partkey", F.coalesce("canonical", "p_brand").alias("skill"))


@query("unmatched_skill_audit", "SELECT p_brand AS skill, count(*) AS n FROM part WHERE lower(p_brand) NOT IN ('brand#11', 'brand#12') GROUP BY p_brand ORDER BY n DESC, skill LIMIT 10")
def unmatched_skill_audit(spark, d):
    return table(spark, d, "part").where(~F.lower("p_brand").isin("brand#11", "brand#12")).groupBy(C("p_brand").alias("skill")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "skill").limit(10)


RES_SQL = """p AS (SELECT c_custkey AS id, 'n' || CAST(c_custkey % 3 AS VARCHAR) AS name, CASE WHEN c_custkey % 4 = 0 THEN 'e' || CAST(c_custkey % 60 AS VARCHAR) END AS email, CASE WHEN c_custkey % 5 = 0 THEN 'p' || CAST(c_custkey % 150 AS VARCHAR) END AS phone FROM customer)"""


def evidence_rows(spark, d):
    k = C("c_custkey")
    return table(spark, d, "customer").select(
        k.alias("id"),
        F.concat(F.lit("n"), (k % 3).cast("string")).alias("name"),
        F.when(k % 4 == 0, F.concat(F.lit("e"), (k % 60).cast("string"))).alias("email"),
        F.when(k % 5 == 0, F.concat(F.lit("p"), (k % 150).cast("string"))).alias("phone"),
    )


@query("entity_resolution", f"""WITH {RES_SQL}, e AS (SELECT email, count(*) AS n, count(DISTINCT name) AS names FROM p WHERE email IS NOT NULL GROUP BY email HAVING count(*) > 1), a AS (SELECT p.*, CASE WHEN e.names = 1 THEN 'candidate_' || substr(sha1('A|real_email|' || p.email), 1, 12) END AS ent, e.names > 1 AS clash FROM p LEFT JOIN e ON p.email = e.email),
f AS (SELECT phone, count(*) AS n, count(DISTINCT name) AS names FROM a WHERE ent IS NULL AND phone IS NOT NULL GROUP BY phone HAVING count(*) > 1), b AS (SELECT a.*, CASE WHEN a.ent IS NULL AND f.names = 1 THEN 'candidate_' || substr(sha1('A|real_phone|' || a.phone), 1, 12) END AS ent2, (a.ent IS NULL AND f.names > 1) AS clash2 FROM a LEFT JOIN f ON a.phone = f.phone)
SELECT id, coalesce(ent, ent2, 'candidate_' || substr(sha1('single|' || CAST(id AS VARCHAR)), 1, 12)) AS entity_id, CASE WHEN ent IS NOT NULL OR ent2 IS NOT NULL THEN 'auto_merged' WHEN coalesce(clash, false) OR coalesce(clash2, false) THEN 'conflict_detected_no_merge' ELSE 'unique_candidate' END AS dedup_status, CASE WHEN ent IS NOT NULL THEN 0.98 WHEN ent2 IS NOT NULL THEN 0.95 ELSE 1.0 END AS dedup_confidence FROM b""")
def entity_resolution(spark, d):
    out = R.resolve(evidence_rows(spark, d), [("real_email", "email"), ("real_phone", "phone")], "name", "id")
    return out.select("id", "entity_id", "dedup_status", "dedup_confidence")


@query("entity_resolution_whole", f"""WITH {RES_SQL}, e AS (SELECT email, count(*) AS n, count(DISTINCT name) AS names FROM p WHERE email IS NOT NULL GROUP BY email HAVING count(*) > 1),
a AS (SELECT p.*, CASE WHEN e.names = 1 THEN 'candidate_' || substr(sha1('A|real_email|' || p.email), 1, 12) END AS ent, e.names > 1 AS clash FROM p LEFT JOIN e ON p.email = e.email),
f AS (SELECT phone, count(*) AS n, count(DISTINCT name) AS names FROM a WHERE ent IS NULL AND phone IS NOT NULL GROUP BY phone HAVING count(*) > 1),
b AS (SELECT a.*, CASE WHEN a.ent IS NULL AND f.names = 1 THEN 'candidate_' || substr(sha1('A|real_phone|' || a.phone), 1, 12) END AS ent2, (a.ent IS NULL AND f.names > 1) AS clash2 FROM a LEFT JOIN f ON a.phone = f.phone),
r AS (SELECT id, name, CASE WHEN id % 7 = 0 THEN 'g' || CAST(id % 21 AS VARCHAR) END AS generic, coalesce(ent, ent2, 'candidate_' || substr(sha1('single|' || CAST(id AS VARCHAR)), 1, 12)) AS entity_id,
    CASE WHEN ent IS NOT NULL OR ent2 IS NOT NULL THEN 'auto_merged' WHEN coalesce(clash, false) OR coalesce(clash2, false) THEN 'conflict_detected_no_merge' ELSE 'unique_candidate' END AS status,
    CASE WHEN ent IS NOT NULL THEN 'real_email' WHEN ent2 IS NOT NULL THEN 'real_phone' ELSE 'none' END AS evidence, CASE WHEN ent IS NOT NULL THEN 0.98 WHEN ent2 IS NOT NULL THEN 0.95 ELSE 1.0 END AS confidence FROM b),
g AS (SELECT generic, min(name) <> max(name) AS clash FROM r WHERE generic IS NOT NULL GROUP BY generic HAVING min(entity_id) <> max(entity_id) OR min(name) <> max(name)),
s AS (SELECT r.* EXCLUDE (status, evidence, confidence), CASE WHEN status <> 'unique_candidate' OR g.generic IS NULL THEN status WHEN clash THEN 'conflict_detected_no_merge' ELSE 'possible_duplicate_needs_review' END AS status,
    CASE WHEN status <> 'unique_candidate' OR g.generic IS NULL THEN evidence WHEN clash THEN 'generic_email_conflict' ELSE 'generic_email_group' END AS evidence, CASE WHEN status <> 'unique_candidate' OR g.generic IS NULL THEN confidence WHEN clash THEN 0.0 ELSE 0.4 END AS confidence FROM r LEFT JOIN g ON r.generic = g.generic),
n AS (SELECT name FROM s GROUP BY name HAVING min(entity_id) <> max(entity_id))
SELECT id, entity_id, CASE WHEN status = 'unique_candidate' AND n.name IS NOT NULL THEN 'possible_duplicate_needs_review' ELSE status END AS dedup_status, CASE WHEN status = 'unique_candidate' AND n.name IS NOT NULL THEN 0.4 ELSE confidence END AS dedup_confidence,
 CASE WHEN status = 'unique_candidate' AND n.name IS NOT NULL THEN 'same_normalized_name' ELSE evidence END AS evidence_type FROM s LEFT JOIN n ON s.name = n.name""")
def entity_resolution_whole(spark, d):
    """entity_resolution, then generic e-mails and same names among the rows still unique."""
    rows = evidence_rows(spark, d).withColumn("generic", F.when(C("id") % 7 == 0, F.concat(F.lit("g"), (C("id") % 21).cast("string"))))
    found = R.resolve(rows, [("real_email", "email"), ("real_phone", "phone")], "name", "id")
    out = R.review_groups(found, "name", "generic", [("same_normalized_name", "name")])
    return out.select("id", "entity_id", "dedup_status", "dedup_confidence", "evidence_type")


@query("evidence_conflicts", f"WITH {RES_SQL} SELECT email FROM p WHERE email IS NOT NULL GROUP BY email HAVING count(DISTINCT name) > 1")
def evidence_conflicts(spark, d):
    return R.conflicting_keys(evidence_rows(spark, d).where("email is not null"), "email", "name").select("email")


@query("entity_consolidate", f"WITH {PROFILES_SQL} SELECT candidate_id, count(*) AS profile_count, arg_max(profile_id, reliability * 1000000 + (CASE profile_kind WHEN 'complete_profile' THEN 2 WHEN 'partial_profile' THEN 1 ELSE 0 END) * 1000 + CAST(profile_id AS DOUBLE) / 1000000) AS best_profile_id, array_to_string(list_sort(list_distinct(list(lang))), '|') AS langs FROM profiles GROUP BY candidate_id")
def entity_consolidate(spark, d):
    rank = F.when(C("profile_kind") == "complete_profile", 2).when(C("profile_kind") == "partial_profile", 1).otherwise(0)
    out = R.consolidate(profiles(spark, d), "candidate_id", [C("reliability"), rank, C("profile_id")], "profile_id", ["lang"])
    return out.select("candidate_id", "profile_count", "best_profile_id", F.array_join("all_lang", "|").alias("langs"))


@query("dedup_exact_groups", "SELECT md5(text) AS k, count(*) AS n, min(doc_id) AS keeper FROM documents GROUP BY text HAVING count(*) > 1")
def dedup_exact_groups(spark, d):
    return table(spark, d, "documents").groupBy(F.md5("text").alias("k")).agg(F.count("*").alias("n"), F.min("doc_id").alias("keeper")).where("n > 1")


@query("merge_by_source_priority", f"WITH {PROFILES_SQL}, r AS (SELECT candidate_id, CASE WHEN profile_id % 3 = 0 THEN NULL ELSE lang END AS lang, CASE WHEN profile_id % 5 = 0 THEN NULL ELSE route END AS route, CASE source_format WHEN 'docx' THEN 0 WHEN 'pdf' THEN 1 WHEN 'images' THEN 2 ELSE 3 END AS pr, profile_id FROM profiles) SELECT candidate_id, arg_min(lang, CAST(pr AS BIGINT) * 1000000000 + profile_id) FILTER (WHERE lang IS NOT NULL) AS lang, arg_min(route, CAST(pr AS BIGINT) * 1000000000 + profile_id) FILTER (WHERE route IS NOT NULL) AS route FROM r GROUP BY candidate_id")
def merge_by_source_priority(spark, d):
    pr = F.when(C("source_format") == "docx", 0).when(C("source_format") == "pdf", 1).when(C("source_format") == "images", 2).otherwise(3)
    r = profiles(spark, d).select("candidate_id", "profile_id", pr.alias("pr"), F.when(C("profile_id") % 3 != 0, C("lang")).alias("lang"), F.when(C("profile_id") % 5 != 0, C("route")).alias("route"))
    return R.merge_fields(r, "candidate_id", ["lang", "route"], [C("pr"), C("profile_id")])


@query("item_signature_dedup", "WITH i AS (SELECT o_custkey, lower(o_orderpriority) AS signature, o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END AS st FROM orders) SELECT o_custkey, signature, arg_min(st, o_orderkey) FILTER (WHERE st IS NOT NULL) AS st, count(*) AS merged FROM i GROUP BY 1, 2")
def item_signature_dedup(spark, d):
    i = table(spark, d, "orders").select("o_custkey", "o_orderpriority", "o_orderkey", F.when(C("o_orderkey") % 3 != 0, C("o_orderstatus")).alias("st"))
    return R.dedup_items(i, "o_custkey", F.lower("o_orderpriority"), "o_orderkey", ["st"])


@query("peer_best_value", f"WITH {PROFILES_SQL} SELECT profile_id, arg_max(lang, reliability * 1000000 + CAST(profile_id AS DOUBLE) / 1000000) OVER (PARTITION BY candidate_id) AS peer_lang FROM profiles")
def peer_best_value(spark, d):
    return profiles(spark, d).select("profile_id", R.peer_value(C("lang"), F.struct("reliability", "profile_id"), C("candidate_id")).alias("peer_lang"))


@query("ordered_distinct", r"""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\r]+'), lambda x: x <> '') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM t), k AS (SELECT doc_id, arg_min(w, p) AS w, min(p) AS p FROM w GROUP BY doc_id, lower(w)), j AS (SELECT doc_id, string_agg(w, ' ' ORDER BY p) AS words FROM k GROUP BY doc_id)
SELECT t.doc_id, CASE WHEN t.ws IS NOT NULL THEN coalesce(words, '') END AS words FROM t LEFT JOIN j ON t.doc_id = j.doc_id""")
def ordered_distinct(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(distinct_folded_long(F.split("text", "[ \t\n\r]+")), " ").alias("words"))


@query("key_cascade_lookup", "WITH cards AS (SELECT doc_id AS card, CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id AS VARCHAR) END AS k1, CASE WHEN doc_id % 2 = 0 THEN 'x' || CAST(doc_id AS VARCHAR) END AS k2 FROM documents), pr AS (SELECT doc_id AS profile, CAST(doc_id AS VARCHAR) AS k1, 'x' || CAST(doc_id AS VARCHAR) AS k2 FROM labels) SELECT card, coalesce(a.profile, b.profile) AS found_profile, CASE WHEN a.profile IS NOT NULL THEN 0 WHEN b.profile IS NOT NULL THEN 1 END AS found_level FROM cards LEFT JOIN pr a ON cards.k1 = a.k1 LEFT JOIN pr b ON cards.k2 = b.k2")
def key_cascade_lookup(spark, d):
    i = C("doc_id")
    cards = table(spark, d, "documents").select(i.alias("card"), F.when(i % 3 == 0, i.cast("string")).alias("k1"), F.when(i % 2 == 0, F.concat(F.lit("x"), i.cast("string"))).alias("k2"))
    prof = table(spark, d, "labels").select(i.alias("profile"), i.cast("string").alias("k1"), F.concat(F.lit("x"), i.cast("string")).alias("k2"))
    return R.key_cascade(cards, "card", ["k1", "k2"], prof, "profile").select("card", "found_profile", "found_level")


@query("upsert_by_key", "WITH o AS (SELECT doc_id, 1 AS created_at, 1 AS updated_at, quality FROM labels), n AS (SELECT doc_id, CAST(doc_id % 2 AS INT) AS quality FROM documents) SELECT coalesce(n.doc_id, o.doc_id) AS doc_id, CASE WHEN n.doc_id IS NOT NULL THEN n.quality ELSE o.quality END AS quality, coalesce(o.created_at, 9) AS created_at, CASE WHEN n.doc_id IS NOT NULL THEN 9 ELSE o.updated_at END AS updated_at, CASE WHEN o.doc_id IS NULL THEN 'created' WHEN n.doc_id IS NULL THEN 'kept' ELSE 'updated' END AS action FROM o FULL JOIN n ON o.doc_id = n.doc_id")
def upsert_by_key(spark, d):
    old = table(spark, d, "labels").select("doc_id", "quality", F.lit(1).alias("created_at"), F.lit(1).alias("updated_at"))
    new = table(spark, d, "documents").select("doc_id", (C("doc_id") % 2).cast("int").alias("quality"))
    return R.upsert(old, new, "doc_id", F.lit(9))


INTERVALS_SQL = "iv AS (SELECT o_custkey AS cust, year(o_orderdate) * 12 + month(o_orderdate) AS s, year(o_orderdate) * 12 + month(o_orderdate) + CAST(o_orderkey % 4 AS INT) AS e FROM orders)"


def intervals(spark, d):
    start = F.year("o_orderdate") * 12 + F.month("o_orderdate")
    return table(spark, d, "orders").select(C("o_custkey").alias("cust"), start.alias("s"), (start + (C("o_orderkey") % 4).cast("int")).alias("e"))


@query("interval_union_years", f"WITH {INTERVALS_SQL}, m AS (SELECT *, max(e) OVER (PARTITION BY cust ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM iv), i AS (SELECT *, sum(CASE WHEN pe IS NULL OR s > pe + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY cust ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m), g AS (SELECT cust, island, min(s) AS s, max(e) AS e FROM i GROUP BY 1, 2) SELECT cust, round(CAST(sum(e - s + 1) AS DOUBLE) / 12, 1) AS years, count(*) AS islands FROM g GROUP BY cust")
def interval_union_years(spark, d):
    u = W.union_length(intervals(spark, d), "cust", "s", "e")
    return u.select("cust", F.round(C("total") / 12, 1).alias("years"), "islands")


@query("span_sum_capped", "SELECT o_custkey AS cust, round(least(sum(greatest(1.0, CAST(o_orderkey % 4 AS DOUBLE))), 40.0), 2) AS years FROM orders GROUP BY o_custkey")
def span_sum_capped(spark, d):
    span = F.greatest(F.lit(1.0), (C("o_orderkey") % 4).cast("double"))
    return table(spark, d, "orders").groupBy(C("o_custkey").alias("cust")).agg(F.round(F.least(F.sum(span), F.lit(40.0)), 2).alias("years"))


@query("section_carry_forward", "SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN md5(text) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS section FROM conversations")
def section_carry_forward(spark, d):
    head = F.when(C("role") == "user", F.md5("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", W.carry_forward(head, "conv_id", [C("turn")]).alias("section"))


BLOCKS_SQL = "b AS (SELECT event_id, user_id AS page, CAST(event_id * 13 % 1009 AS INT) AS y, event_type = 'signup' AS header FROM events)"


def blocks(spark, d):
    return table(spark, d, "events").select("event_id", C("user_id").alias("page"), (C("event_id") * 13 % 1009).cast("int").alias("y"), (C("event_type") == "signup").alias("header"))


@query("nearest_header", f"WITH {BLOCKS_SQL} SELECT event_id, last_value(CASE WHEN header THEN event_id END IGNORE NULLS) OVER (PARTITION BY page ORDER BY y DESC, header DESC, event_id ROWS UNBOUNDED PRECEDING) AS section FROM b")
def nearest_header(spark, d):
    """The nearest header above on the same page, as a carry-forward instead of a theta join."""
    b = blocks(spark, d)
    return b.select("event_id", W.carry_forward(F.when(C("header"), C("event_id")), "page", [F.desc("y"), F.desc("header"), C("event_id")]).alias("section"))


@query("nearest_item", f"WITH {BLOCKS_SQL}, x AS (SELECT event_id, page, y, header, max(CASE WHEN header THEN y END) OVER (PARTITION BY page ORDER BY y RANGE UNBOUNDED PRECEDING) AS below, min(CASE WHEN header THEN y END) OVER (PARTITION BY page ORDER BY y DESC RANGE UNBOUNDED PRECEDING) AS above FROM b) SELECT event_id, CASE WHEN below IS NULL THEN above WHEN above IS NULL THEN below WHEN y - below <= above - y THEN below ELSE above END AS near_y FROM x WHERE NOT header")
def nearest_item(spark, d):
    """The header nearest by distance on either side: two running extremes instead of all pairs."""
    b = blocks(spark, d)
    up = Window.partitionBy("page").orderBy("y").rangeBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("page").orderBy(F.desc("y")).rangeBetween(Window.unboundedPreceding, 0)
    y = F.when(C("header"), C("y"))
    x = b.withColumn("below", F.max(y).over(up)).withColumn("above", F.min(y).over(down)).where("not header")
    near = F.when(C("below").isNull(), C("above")).when(C("above").isNull(), C("below")).when(C("y") - C("below") <= C("above") - C("y"), C("below")).otherwise(C("above"))
    return x.select("event_id", near.alias("near_y"))


@query("nth_occurrence_pairing", "WITH a AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events), b AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'view' WHEN 'F' THEN 'click' ELSE 'error' END AS t, row_number() OVER (PARTITION BY CASE o_orderstatus WHEN 'O' THEN 'view' WHEN 'F' THEN 'click' ELSE 'error' END ORDER BY o_orderkey) AS n FROM orders) SELECT o_orderkey, event_id FROM b LEFT JOIN a ON a.event_type = b.t AND a.n = b.n")
def nth_occurrence_pairing(spark, d):
    t = F.when(C("o_orderstatus") == "O", "view").when(C("o_orderstatus") == "F", "click").otherwise("error")
    a = table(spark, d, "events").select("event_id", "event_type", F.row_number().over(Window.partitionBy("event_type").orderBy("event_id")).alias("n"))
    b = table(spark, d, "orders").select("o_orderkey", t.alias("event_type")).withColumn("n", F.row_number().over(Window.partitionBy("event_type").orderBy("o_orderkey")))
    return b.join(a, ["event_type", "n"], "left").select("o_orderkey", "event_id")


@query("column_split_median", f"WITH {BLOCKS_SQL}, m AS (SELECT page, list_sort(list(y))[CAST(floor(count(*) / 2) AS INT) + 1] AS mid FROM b GROUP BY page) SELECT event_id, CASE WHEN y < mid THEN 'left' ELSE 'right' END AS side FROM b JOIN m USING (page)")
def column_split_median(spark, d):
    b = blocks(spark, d)
    w = Window.partitionBy("page")
    at = F.row_number().over(w.orderBy("y", "event_id"))
    x = b.withColumn("_r", at).withColumn("_n", F.count(F.lit(1)).over(w))
    mid = F.max(F.when(C("_r") == F.floor(C("_n") / 2) + 1, C("y"))).over(w)
    return x.withColumn("_mid", mid).select("event_id", F.when(C("y") < C("_mid"), "left").otherwise("right").alias("side"))


@query("reading_order", f"WITH {BLOCKS_SQL} SELECT event_id, row_number() OVER (PARTITION BY page ORDER BY y DESC, event_id) AS place FROM b")
def reading_order(spark, d):
    return blocks(spark, d).select("event_id", W.rank_by("page", [F.desc("y"), C("event_id")]).alias("place"))
