"""Job structuring, text repair, grounding, re-ranking and rendition queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from talentloom.functions import quality, repair
from talentloom.functions import scoring as S
from talentloom.operators import grounding, jobs, render, rerank
from talentloom.plans.registry import PROFILES_SQL, profiles, query, table
from talentloom.plans.scores import SCORED_SQL, scored

C = F.col
JOB_TEXTS = [
    "Senior Data Engineer\nYou will build ETL with Spark and Python. Docker is a plus. 5+ years of experience. Remote. English required.",
    "Backend developer wanted\nMinimum of 3 years. FastAPI, SQL. Hybrid, full-time.",
    "We bake bread.",
]


def pick(values, n=None):
    return F.element_at(F.array(*[F.lit(x) for x in values]), (C("doc_id") % len(values) + 1).cast("int"))


@query("job_profiles", """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Senior Data Engineer' WHEN 1 THEN 'Backend developer wanted' ELSE 'Unknown Role' END AS job_title, CASE doc_id % 3 WHEN 0 THEN 'Python|Spark|ETL' WHEN 1 THEN 'FastAPI|SQL' ELSE '' END AS required, CASE doc_id % 3 WHEN 0 THEN 'Docker' ELSE '' END AS nice,
 CASE doc_id % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 3.0 END AS years, CASE doc_id % 3 WHEN 0 THEN 'senior' END AS seniority, CASE doc_id % 3 WHEN 0 THEN 'remote' WHEN 1 THEN 'hybrid' END AS remote, CASE doc_id % 3 WHEN 1 THEN 'full_time' END AS contract, CASE doc_id % 3 WHEN 0 THEN 'data_engineering' WHEN 1 THEN 'backend_engineering' END AS domain FROM documents""")
def job_profiles(spark, d):
    p = jobs.job_profiles(table(spark, d, "documents").select("doc_id", pick(JOB_TEXTS).alias("description")))
    return p.select("doc_id", "job_title", F.array_join("required_skills", "|").alias("required"), F.array_join("nice_to_have_skills", "|").alias("nice"), C("years_experience_required").alias("years"), C("seniority_level").alias("seniority"), C("remote_policy").alias("remote"), C("contract_type").alias("contract"), "domain")


@query("tech_term_repair", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'FastAPI on GitHub Actions' WHEN 1 THEN 'Built a web scraping module' ELSE 'Neo4j, PyTorch' END AS fixed FROM documents")
def tech_term_repair(spark, d):
    raw = pick(["Fast A P I on git  hub actions", "Builta webscrapingmodule", "Neo 4 j, Py Torch"])
    return table(spark, d, "documents").select("doc_id", repair.merged_words(repair.tech_terms(raw)).alias("fixed"))


@query("address_repair", r"""WITH p AS (SELECT page_id, rtrim(url, '/') AS url, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host FROM pages)
SELECT page_id, 'see ' || url || ' or write to a.b' || CAST(page_id AS VARCHAR) || '@' || host || ' or github.com/x/y today' AS fixed FROM p""")
def address_repair(spark, d):
    """Addresses of pages, with spaces put in where recognition puts them, come back."""
    url, host = F.rtrim(C("url"), F.lit("/")), F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1)
    loose = F.replace(F.replace(url, F.lit("/"), F.lit(" / ")), F.lit(":"), F.lit(" : "))
    text = F.concat(F.lit("see "), loose, F.lit(" or write to a . b"), C("page_id").cast("string"), F.lit(" @ "), F.replace(host, F.lit("."), F.lit(" . ")), F.lit(" or github . com / x / y today"))
    return table(spark, d, "pages").select("page_id", repair.repair_addresses(text).alias("fixed"))


@query("spaced_letters", r"WITH t AS (SELECT p_partkey, replace(p_name, ' ', '') AS w FROM part) SELECT p_partkey, CASE WHEN length(w) BETWEEN 3 AND 16 THEN w ELSE trim(regexp_replace(w, '(.)', '\1 ', 'g')) END AS fixed FROM t")
def spaced_letters(spark, d):
    spaced = F.trim(F.regexp_replace(F.replace("p_name", F.lit(" "), F.lit("")), "(.)", "$1 "))
    return table(spark, d, "part").select("p_partkey", repair.join_spaced(spaced).alias("fixed"))


@query("mojibake_repair", r"WITH t AS (SELECT doc_id, text, regexp_matches(text, '[\x{80}-\x{ff}]') OR NOT regexp_matches(text, '[^\x00-\x7f]') AS restored FROM documents) SELECT doc_id, restored, CASE WHEN restored THEN md5(text) END AS fixed FROM t")
def mojibake_repair(spark, d):
    """Whole texts read as Latin-1 by mistake come back, where a sign of that mistake is in them."""
    fixed = repair.mojibake(F.decode(F.encode("text", "UTF-8"), "ISO-8859-1"))
    rows = table(spark, d, "documents").select("doc_id", "text", fixed.alias("fixed")).withColumn("restored", C("fixed") == C("text"))
    return rows.select("doc_id", "restored", F.when(C("restored"), F.md5("fixed")).alias("fixed"))


@query("glued_text", "SELECT doc_id, CASE doc_id % 2 WHEN 0 THEN 'data Science 101 x, y. z' ELSE 'a/b & c' END AS fixed FROM documents")
def glued_text(spark, d):
    return table(spark, d, "documents").select("doc_id", repair.glued(pick(["dataScience101x,y.z", "a / b&c"])).alias("fixed"))


@query("line_cleaning", r"""WITH s AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda s: trim(regexp_replace(s, '[ \t\n\r\f\x0B]+', ' ', 'g'))) AS ls FROM documents),
k AS (SELECT doc_id, array_to_string(list_filter(ls, lambda s: NOT (s <> '' AND (regexp_matches(regexp_replace(s, '^[#*\- ]+|[#*\- ]+$', '', 'g'), '(?i)^(<!-- *image *-->|image|page +[0-9]+|blank|copyright|usage guidelines)$') OR length(regexp_replace(s, '^[#*\- ]+|[#*\- ]+$', '', 'g')) <= 2
 OR (length(regexp_replace(s, '^[#*\- ]+|[#*\- ]+$', '', 'g')) <= 20 AND regexp_matches(regexp_replace(s, '^[#*\- ]+|[#*\- ]+$', '', 'g'), '^[^A-Za-z]+$'))))), chr(10)) AS t FROM s)
SELECT doc_id, md5(regexp_replace(regexp_replace(t, '\n{3,}', chr(10) || chr(10), 'g'), '^\n+|\n+$', '', 'g')) AS cleaned FROM k""")
def line_cleaning(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(repair.clean_lines(C("text"))).alias("cleaned"))


@query("summary_support", r"""WITH s AS (SELECT conv_id, turn, text AS v, lag(text) OVER (PARTITION BY conv_id ORDER BY turn, text NULLS FIRST) AS src FROM conversations),
w AS (SELECT *, list_distinct(list_filter(regexp_extract_all(lower(v), '[a-z0-9][a-z0-9+.#/@-]*'), lambda t: length(t) > 3 AND t NOT IN (%s))) AS ws, regexp_replace(lower(v), '[^a-z0-9]+', '', 'g') AS cv, regexp_replace(lower(src), '[^a-z0-9]+', '', 'g') AS cs FROM s),
c AS (SELECT *, len(ws) AS n, len(list_filter(ws, lambda t: contains(lower(src), t))) / greatest(len(ws), 1) AS share FROM w)
SELECT conv_id, turn, CASE WHEN v IS NULL OR trim(v) = '' THEN 'missing' WHEN cv <> '' AND contains(cs, cv) THEN 'supported' WHEN n = 0 THEN 'unsupported' WHEN share >= 0.6 THEN 'supported' WHEN share >= 0.4 THEN 'weakly_supported' ELSE 'unsupported' END AS support FROM c""" % ", ".join(f"'{w}'" for w in grounding.STOPWORDS))
def summary_support(spark, d):
    """Each message as a claim, the message before it as its source."""
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn", "text"))
    said = table(spark, d, "conversations").select("conv_id", "turn", "text", before.alias("src"))
    return said.select("conv_id", "turn", grounding.summary_support(C("text"), C("src")).alias("support"))


@query("list_support", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'supported' WHEN 1 THEN 'weakly_supported' ELSE 'missing' END AS support FROM documents")
def list_support(spark, d):
    values = F.split(pick(["python,spark", "python,cobol", ""]), ",")
    return table(spark, d, "documents").select("doc_id", grounding.list_support(F.filter(values, lambda x: x != ""), F.lit("Python and Spark")).alias("support"))


@query("ground_profiles", "SELECT doc_id, CASE doc_id % 2 WHEN 0 THEN 'Ann' END AS name, 'Tunis' AS city, CASE doc_id % 2 WHEN 0 THEN 'low' ELSE 'medium' END AS risk, CASE doc_id % 2 WHEN 0 THEN 0.98 ELSE 0.45 END AS score FROM documents")
def ground_profiles(spark, d):
    rows = table(spark, d, "documents").select("doc_id", pick(["Ann", "Zoltan"]).alias("name"), F.lit("Tunis").alias("city"), F.lit("Ann lives in Tunis").alias("src"), F.lit(0.9).alias("conf"))
    g = grounding.ground(rows, ["name", "city"], "src", "conf")
    return g.select("doc_id", "name", "city", C("hallucination_risk").alias("risk"), C("reliability_score").alias("score"))


@query("rerank_pairs", f"WITH {SCORED_SQL}, r AS (SELECT job_id, profile_id, row_number() OVER (PARTITION BY job_id ORDER BY final_score DESC, profile_id) AS rank, CASE WHEN profile_id % 5 = 0 THEN NULL ELSE CAST(profile_id * 17 % 19 AS DOUBLE) END AS cross_score FROM final) SELECT job_id, profile_id, row_number() OVER (PARTITION BY job_id ORDER BY cross_score DESC NULLS LAST, rank, profile_id) AS cross_rank FROM r WHERE rank <= 20")
def rerank_pairs(spark, d):
    from talentloom.operators.windows import rank_by

    r = scored(spark, d).withColumn("rank", rank_by("job_id", [F.desc("final_score"), C("profile_id")])).where("rank <= 20")
    score = F.when(C("profile_id") % 5 != 0, (C("profile_id") * 17 % 19).cast("double"))
    return rerank.rerank(r, "job_id", "rank", score, "profile_id").select("job_id", "profile_id", "cross_rank")


@query("text_embedding")
def text_embedding(spark, d):
    return table(spark, d, "benchmark").select("item_id", rerank.embed(C("text")).alias("embedding"))


@query("section_renditions", "SELECT conv_id, md5(string_agg('## ' || role || chr(10) || lines, chr(10) || chr(10) ORDER BY fp)) AS md FROM (SELECT conv_id, role, min(turn) AS fp, string_agg('- ' || text, chr(10) ORDER BY turn, text) AS lines FROM conversations WHERE trim(coalesce(text, '')) <> '' GROUP BY 1, 2) GROUP BY conv_id")
def section_renditions(spark, d):
    s = render.sections(table(spark, d, "conversations"), "conv_id", "role", "turn", "text")
    return render.renditions(s, "conv_id", "role").select("conv_id", F.md5("md").alias("md"))


@query("bbox_normalise", f"WITH {PROFILES_SQL} SELECT profile_id, least(flags, nullified) AS left_x, greatest(flags, nullified) AS right_x FROM profiles")
def bbox_normalise(spark, d):
    b = render.box(C("flags"), F.lit(0), C("nullified"), F.lit(1))
    return profiles(spark, d).select("profile_id", b["left"].alias("left_x"), b["right"].alias("right_x"))


@query("casefold_intersection", r"""WITH s AS (SELECT conv_id, turn, regexp_split_to_array(lower(text), '[ \t\n\r\f\x0B]+') AS a, lag(regexp_split_to_array(lower(text), '[ \t\n\r\f\x0B]+')) OVER (PARTITION BY conv_id ORDER BY turn, text NULLS FIRST) AS b FROM conversations)
SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_filter(a, lambda x: x <> '' AND list_contains(b, x)))), '|') AS shared FROM s""")
def casefold_intersection(spark, d):
    """Words that a message shares with the one before it, whatever their case."""
    words = F.split(F.lower("text"), r"\s+")
    before = F.lag(words).over(Window.partitionBy("conv_id").orderBy("turn", "text"))
    said = table(spark, d, "conversations").select("conv_id", "turn", words.alias("a"), before.alias("b"))
    shared = F.array_sort(F.array_remove(F.array_intersect("a", F.coalesce("b", F.array().cast("array<string>"))), ""))
    return said.select("conv_id", "turn", F.array_join(shared, "|").alias("shared"))


@query("sigmoid_scores", f"WITH {PROFILES_SQL} SELECT profile_id, round(1 / (1 + exp(-(reliability * 4 - 2))), 6) AS p FROM profiles")
def sigmoid_scores(spark, d):
    return profiles(spark, d).select("profile_id", F.round(1 / (1 + F.exp(-(C("reliability") * 4 - 2))), 6).alias("p"))


@query("file_stem_join", "SELECT a.doc_id, b.quality FROM documents a JOIN labels b ON a.doc_id = b.doc_id")
def file_stem_join(spark, d):
    stem = lambda x: F.regexp_extract(x, r"([^/]+)\.json$", 1)
    a = table(spark, d, "documents").select("doc_id", F.concat(F.lit("old/run/"), C("doc_id").cast("string"), F.lit(".json")).alias("pa"))
    b = table(spark, d, "labels").select("quality", F.concat(F.lit("new/"), C("doc_id").cast("string"), F.lit(".json")).alias("pb"))
    return a.join(b, stem(C("pa")) == stem(C("pb"))).select("doc_id", "quality")


@query("nested_projection", "SELECT doc_id, lang, source, 'L' || lang AS label FROM documents")
def nested_projection(spark, d):
    nested = table(spark, d, "documents").select("doc_id", F.struct(F.struct("lang", "source").alias("bio"), F.array(F.struct(F.concat(F.lit("L"), "lang").alias("name"))).alias("items")).alias("profile"))
    return nested.select("doc_id", "profile.bio.lang", "profile.bio.source", F.get(C("profile.items"), F.lit(0))["name"].alias("label"))


@query("nullify_templates", r"SELECT page_id, CASE WHEN regexp_matches(url, '(?i)(^|[^\p{L}\p{N}_])example\.com($|[^\p{L}\p{N}_])') THEN NULL ELSE url END AS url, CASE WHEN regexp_matches(path, '(?i)(^|[^\p{L}\p{N}_])\"?null\"?($|[^\p{L}\p{N}_])') THEN NULL ELSE path END AS path, concat_ws('|', CASE WHEN regexp_matches(url, '(?i)(^|[^\p{L}\p{N}_])example\.com($|[^\p{L}\p{N}_])') THEN 'url' END, CASE WHEN regexp_matches(path, '(?i)(^|[^\p{L}\p{N}_])\"?null\"?($|[^\p{L}\p{N}_])') THEN 'path' END) AS nullified FROM (SELECT page_id, url, regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '^/fr/', '/null/') AS path FROM pages)")
def nullify_templates(spark, d):
    """Addresses, and their paths with one folder named null."""
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://[^/]*", ""), "^/fr/", "/null/")
    rows = table(spark, d, "pages").select("page_id", "url", path.alias("path"))
    kept, gone = quality.nullify_templates({"url": C("url"), "path": C("path")})
    return rows.select("page_id", *[v.alias(k) for k, v in kept.items()], F.concat_ws("|", gone).alias("nullified"))


@query("job_decisions", f"""WITH {SCORED_SQL}, g AS (SELECT job_id, count(*) AS n, count(*) FILTER (WHERE coverage > 0) AS k_any, count(*) FILTER (WHERE coverage >= 0.5) AS k_half, count(*) FILTER (WHERE coverage >= 0.8) AS k_most FROM final GROUP BY job_id),
a AS (SELECT *, round(k_any / n * 0.2 + k_half / n * 0.4 + k_most / n * 0.4, 4) AS alignment FROM g)
SELECT job_id, alignment, k_most AS pool, CASE WHEN alignment >= 0.35 AND k_most >= 3 THEN 'keep' WHEN alignment >= 0.15 THEN 'adjust' ELSE 'replace' END AS decision FROM a""")
def job_decisions(spark, d):
    share = lambda c: F.avg(c.cast("double"))
    c = C("coverage")
    score = S.alignment(share(c > 0), share(c >= 0.5), share(c >= 0.8))
    g = scored(spark, d).groupBy("job_id").agg(score.alias("alignment"), F.count_if(c >= 0.8).alias("pool"))
    return g.select("job_id", "alignment", "pool", S.job_decision(C("alignment"), C("pool")).alias("decision"))


@query("corpus_features", r"SELECT doc_id, concat_ws('|', CASE WHEN contains(lower(text), 'the') THEN 'the' END, CASE WHEN contains(lower(text), 'der') THEN 'der' END) AS keywords, length(text) < 500 AS short FROM documents")
def corpus_features(spark, d):
    words = F.filter(F.array(F.lit("the"), F.lit("der")), lambda k: F.lower("text").contains(k))
    return table(spark, d, "documents").select("doc_id", F.array_join(words, "|").alias("keywords"), (F.length("text") < 500).alias("short"))
