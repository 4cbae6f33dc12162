"""Profile shape, line, header, provenance and comparison queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from talentloom.functions import lines as L
from talentloom.operators import profiles as P
from talentloom.plans.extras import pick
from talentloom.plans.ranking import MODEL_SQL, model_ranks
from talentloom.plans.registry import PROFILES_SQL, profiles, query, table
from talentloom.plans.scores import SCORED_SQL, scored

C = F.col


def docs(spark, d):
    return table(spark, d, "documents")


@query("line_shapes", "SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'section' WHEN 1 THEN 'date' WHEN 2 THEN 'contact' WHEN 3 THEN 'location' WHEN 4 THEN 'education' WHEN 5 THEN 'skill' ELSE 'text' END AS shape FROM documents")
def line_shapes(spark, d):
    raw = pick(["## Work Experience", "03/2019 - present", "me@x.org", "Tunis, Tunisia", "University of the South", "a, b, c, d", "this is a sentence."])
    return docs(spark, d).select("doc_id", L.line_shape(raw).alias("shape"))


@query("date_phrases", "SELECT o_orderkey, strftime(o_orderdate, '%b %Y') || ' to ' || strftime(o_orderdate, '%m/%Y') AS phrase, strftime(o_orderdate, '%Y') AS single FROM orders")
def date_phrases(spark, d):
    at = lambda p: F.date_format("o_orderdate", p)
    line = F.concat("o_orderpriority", F.lit(", "), at("MMM yyyy"), F.lit(" to "), at("MM/yyyy"), F.lit(" Tunis"))
    return table(spark, d, "orders").select("o_orderkey", L.date_phrase(line).alias("phrase"), L.date_phrase(F.concat(F.lit("class of "), at("yyyy"))).alias("single"))


@query("header_info", "SELECT doc_id, CASE doc_id % 2 WHEN 0 THEN 'Ada Byron' END AS full_name, 'ada@x.org' AS email, CASE doc_id % 2 WHEN 0 THEN 'github.com/ada' END AS github FROM documents")
def header_info(spark, d):
    h = L.header_info(pick(["# Ada Byron\nada@x.org | +216 71 234 987\ngithub.com/ada", "DATA SCIENTIST\nada@x.org\n"]))
    return docs(spark, d).select("doc_id", h["full_name"].alias("full_name"), h["email"].alias("email"), h["github"].alias("github"))


@query("url_identity", r"SELECT page_id, regexp_replace(lower(trim(url)), '^(https?://)?(www\.)?|[/.,);\]]+$', '', 'g') AS identity FROM pages")
def url_identity(spark, d):
    """The same for an address, and for it with www, capitals in the scheme and a slash behind."""
    page = table(spark, d, "pages")
    other = F.concat(F.regexp_replace("url", "^https?://(?:www[.])?", "HTTPS://www."), F.lit("/"))
    return page.select("page_id", F.when(L.url_identity(C("url")) == L.url_identity(other), L.url_identity(C("url"))).alias("identity"))


@query("best_url", r"""WITH u AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS u FROM pages),
q AS (SELECT page_id, u, 1 + CASE WHEN regexp_matches(u, '(?i)linkedin\.com|github\.com') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(u, '\.[a-z]+/[^ \t\n\r\f\x0B]+') THEN 1 ELSE 0 END - CASE WHEN contains(u, ' ') THEN 1 ELSE 0 END AS q FROM u),
b AS (SELECT page_id, u FROM q QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY q DESC, length(u) DESC, u DESC) = 1)
SELECT p.page_id, b.u AS url FROM pages p LEFT JOIN b ON p.page_id = b.page_id""")
def best_url(spark, d):
    links = F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))
    return table(spark, d, "pages").select("page_id", L.best_url(links).alias("url"))


@query("summary_sanitise", r"""WITH c AS (SELECT doc_id, nullif(trim(regexp_replace(text, '[ \t\n\r\f\x0B]+', ' ', 'g')), '') AS t, lower(trim(text)) AS low FROM documents)
SELECT doc_id, array_to_string(string_split(regexp_replace(t, '([.!?]) ', '\1' || chr(1), 'g'), chr(1))[1:2], ' ') AS short,
 low <> '' AND (len(regexp_split_to_array(low, '[ \t\n\r\f\x0B]+')) < 4 OR contains(low, 'with experience in') OR contains(low, 'expertise in') OR contains(low, 'professional with') OR contains(low, 'results-driven') OR contains(low, 'highly motivated') OR contains(low, 'strong background')) AS generic FROM c""")
def summary_sanitise(spark, d):
    return docs(spark, d).select("doc_id", L.short_summary(C("text")).alias("short"), L.generic_summary(C("text")).alias("generic"))


@query("section_titles", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'experience' WHEN 1 THEN 'skills' END AS section FROM documents")
def section_titles(spark, d):
    return docs(spark, d).select("doc_id", L.section_of(pick(["### Professional Experience:", "TECHNICAL SKILLS", "Hello"])).alias("section"))


@query("provenance_map", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'lang,source' ELSE 'source' END AS fields FROM documents")
def provenance_map(spark, d):
    rows = docs(spark, d).select("doc_id", F.when(C("doc_id") % 2 == 0, C("lang")).alias("lang"), "source")
    return rows.select("doc_id", F.array_join(F.array_sort(F.map_keys(P.provenance(["lang", "source"], F.lit("pdf")))), ",").alias("fields"))


@query("source_priority_counts", f"WITH {PROFILES_SQL} SELECT CASE source_format WHEN 'docx' THEN 0 WHEN 'pdf' THEN 1 WHEN 'images' THEN 2 ELSE 3 END AS place, count(*) AS n FROM profiles GROUP BY 1")
def source_priority_counts(spark, d):
    return profiles(spark, d).groupBy(P.priority(C("source_format")).alias("place")).agg(F.count("*").alias("n"))


@query("business_rejects", f"WITH {PROFILES_SQL} SELECT profile_id, CASE WHEN chars < 25 THEN 'too_short' WHEN profile_id % 3 = 0 AND matched = 0 THEN 'no_structured_anchor' WHEN profile_id % 3 = 0 THEN 'ungrounded_skills' END AS reason FROM profiles")
def business_rejects(spark, d):
    anchor = F.when(C("profile_id") % 3 != 0, F.lit("Acme"))
    skills = F.when(C("matched") > 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    return profiles(spark, d).select("profile_id", P.business_reject([anchor, F.lit(None).cast("string")], skills, C("chars")).alias("reason"))


@query("field_changes", "SELECT doc_id, 'lang' AS field, lang AS old, 'xx' AS new FROM documents WHERE doc_id % 4 = 0")
def field_changes(spark, d):
    old = docs(spark, d).select("doc_id", "lang", "source")
    new = docs(spark, d).select("doc_id", F.when(C("doc_id") % 4 == 0, "xx").otherwise(C("lang")).alias("lang"), "source")
    return P.changed(old, new, "doc_id", ["lang", "source"])


@query("output_paths", f"WITH {PROFILES_SQL} SELECT profile_id, 'out/' || source_format || '/d' || CAST(profile_id AS VARCHAR) || '.json' AS path FROM profiles")
def output_paths(spark, d):
    path = F.concat(F.lit("in/x/d"), C("profile_id").cast("string"), F.lit(".pdf"))
    return profiles(spark, d).select("profile_id", P.output_path("out", C("source_format"), path, ".json").alias("path"))


@query("store_documents", "SELECT 'profile_' || substr(sha1('s' || CAST(doc_id AS VARCHAR) || '|a'), 1, 12) AS profile_id, lang AS full_name, 1 AS fields_nullified_count FROM documents")
def store_documents(spark, d):
    text = lambda x: F.lit(x).cast("string")
    bio = F.struct(C("lang").alias("full_name"), text(None).alias("email"), text(None).alias("phone"), C("source").alias("location"))
    rows = docs(spark, d).select(
        F.concat(F.lit("s"), C("doc_id").cast("string")).alias("source_path"), text("a").alias("artifact_path"),
        F.struct(bio.alias("bio"), F.struct(F.array(text("sql")).alias("hard_skills")).alias("expertise")).alias("profile"),
        F.struct(F.lit(0.5).alias("reliability_score"), F.array(text("x")).alias("fields_nullified")).alias("grounding"),
    )
    return P.store_document(rows).select("profile_id", "full_name", "fields_nullified_count")


@query("ml_cards_chain", f"WITH {MODEL_SQL} SELECT r.job_id, r.profile_id, r.rf_rank, r.gb_rank, l.quality FROM ranks r LEFT JOIN labels l ON r.profile_id = l.doc_id WHERE r.base_rank <= 10")
def ml_cards_chain(spark, d):
    r = model_ranks(spark, d).where("base_rank <= 10")
    return r.join(table(spark, d, "labels"), C("profile_id") == C("doc_id"), "left").select("job_id", "profile_id", "rf_rank", "gb_rank", "quality")


@query("report_top_rows", f"WITH {SCORED_SQL}, r AS (SELECT job_id, profile_id, row_number() OVER (PARTITION BY job_id ORDER BY final_score DESC, profile_id) AS rn FROM final) SELECT job_id, profile_id, CAST(rn - 1 AS INT) AS pos FROM r WHERE rn <= 3")
def report_top_rows(spark, d):
    """The first rows of nested reports: exploded with their positions."""
    from talentloom.operators.windows import rank_by

    top = scored(spark, d).withColumn("rn", rank_by("job_id", [F.desc("final_score"), C("profile_id")])).where("rn <= 5")
    reports = top.groupBy("job_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "profile_id"))), lambda s: s["profile_id"]).alias("recommendations"))
    return reports.select("job_id", F.posexplode("recommendations").alias("pos", "profile_id")).where("pos < 3").select("job_id", "profile_id", "pos")


@query("gap_explanations", f"WITH {SCORED_SQL} SELECT profile_id, CASE WHEN coverage >= 0.7 THEN 'direct fit' WHEN required - matched > 0 THEN 'missing ' || CAST(required - matched AS VARCHAR) || ' of ' || CAST(required AS VARCHAR) ELSE 'plausible' END AS explanation FROM final")
def gap_explanations(spark, d):
    gaps = C("required") - C("matched")
    said = F.when(C("coverage") >= 0.7, "direct fit").when(gaps > 0, F.format_string("missing %d of %d", gaps, C("required"))).otherwise("plausible")
    return scored(spark, d).select("profile_id", said.alias("explanation"))


@query("default_record_for_missing", "SELECT d.doc_id, coalesce(l.quality, -1) AS quality, l.doc_id IS NULL AS missing FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def default_record_for_missing(spark, d):
    lab = table(spark, d, "labels").select(C("doc_id").alias("_l"), "quality")
    return docs(spark, d).join(lab, C("doc_id") == C("_l"), "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), C("_l").isNull().alias("missing"))


@query("provider_extraction", "SELECT CAST(item_id AS VARCHAR) AS key, 'second' AS provider, 3 AS attempts FROM benchmark")
def provider_extraction(spark, d):
    """The first provider always fails, the second answers: the fallback chain end to end."""
    from talentloom.operators.provider import extract

    def broken(text):
        raise TimeoutError("timeout")

    out = extract(table(spark, d, "benchmark"), "item_id", "text", [("first", broken), ("second", lambda t: t)], attempts=2, pause=lambda s: None)
    return out.select("key", "provider", "attempts")


@query("masked_uris", "SELECT page_id, regexp_replace(url, '://([^/@]+@)?', '://***@') AS uri, regexp_replace(url, '://[^/@]+@', '://***@', 'g') AS open_uri FROM pages")
def masked_uris(spark, d):
    """Addresses with a user and a password put in, and as they are."""
    secret = F.regexp_replace("url", "^([a-z]+)://(?:[^/@]+@)?", "$1://user:pass@")
    return table(spark, d, "pages").select("page_id", P.masked_uri(secret).alias("uri"), P.masked_uri(C("url")).alias("open_uri"))