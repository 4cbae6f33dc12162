"""Document parsing, quality, handoff, text and date queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from talentloom.functions import dates as D
from talentloom.functions import quality as Q
from talentloom.functions import text as X
from talentloom.operators import windows as W
from talentloom.plans.registry import PROFILES_SQL, profiles, query, table

C = F.col
QUALITY_SQL = f"""{PROFILES_SQL}, sig AS (SELECT *, CAST(matched AS DOUBLE) / 6 AS completeness, similarity AS ordering, reliability AS segmentation, CAST(nullified AS DOUBLE) / 20 AS noise, CAST(flags AS DOUBLE) / 10 AS weird FROM profiles),
conf AS (SELECT *, round(least(greatest(0.28 * least(chars / 2500.0, 1.0) + 0.24 * completeness + 0.18 * ordering + 0.16 * segmentation + 0.14 * 0.5 - 0.18 * (CASE WHEN source_format IN ('images', 'scans') THEN noise * 0.7 ELSE noise * 0.2 END) - 0.12 * weird, 0.0), 1.0) + 1e-9, 4) AS confidence FROM sig),
state AS (SELECT *, CASE WHEN source_format IN ('images', 'scans') THEN CASE WHEN confidence >= 0.58 AND chars >= 500 AND completeness >= 0.25 THEN 'validated' WHEN confidence >= 0.38 AND chars >= 250 AND completeness >= 0.15 THEN 'partial' ELSE 'uncertain' END
 ELSE CASE WHEN confidence >= 0.72 AND chars >= 800 AND completeness >= 0.45 THEN 'validated' WHEN confidence >= 0.42 AND chars >= 300 AND completeness >= 0.18 THEN 'partial' ELSE 'uncertain' END END AS status FROM conf)"""


def assessed(spark, d):
    p = profiles(spark, d).select(
        "*", (C("matched").cast("double") / 6).alias("completeness"), C("similarity").alias("ordering"), C("reliability").alias("segmentation"),
        (C("nullified").cast("double") / 20).alias("noise"), (C("flags").cast("double") / 10).alias("weird"),
    )
    signals = [C(x) for x in ("chars", "completeness", "ordering", "segmentation")]
    p = p.withColumn("confidence", Q.confidence(*signals, F.lit(0.5), C("noise"), C("weird"), C("source_format")))
    p = p.withColumn("warnings", Q.warnings(*signals, C("noise"), C("weird"), C("source_format")))
    return p.withColumn("status", Q.status(C("confidence"), C("chars"), C("completeness"), C("warnings"), C("source_format")))


@query("doc_confidence", f"WITH {QUALITY_SQL} SELECT profile_id, confidence FROM conf")
def doc_confidence(spark, d):
    return assessed(spark, d).select("profile_id", "confidence")


@query("doc_warnings", f"""WITH {QUALITY_SQL} SELECT profile_id, concat_ws('|', CASE WHEN chars < 350 THEN 'very_low_text_recovery' WHEN chars < 900 THEN 'low_text_recovery' END, CASE WHEN completeness < 0.35 THEN 'low_section_completeness' WHEN completeness < 0.55 THEN 'partial_section_completeness' END,
 CASE WHEN ordering < 0.6 THEN 'low_section_order_coherence' END, CASE WHEN segmentation < 0.45 THEN 'unstable_segmentation' END, CASE WHEN noise > CASE WHEN source_format IN ('images', 'scans') THEN 0.28 ELSE 0.45 END THEN 'high_ocr_noise' END, CASE WHEN weird > 0.35 THEN 'abnormal_section_titles' END) AS warnings FROM sig""")
def doc_warnings(spark, d):
    return assessed(spark, d).select("profile_id", F.concat_ws("|", "warnings").alias("warnings"))


@query("doc_status_class", f"WITH {QUALITY_SQL} SELECT profile_id, status FROM state")
def doc_status_class(spark, d):
    return assessed(spark, d).select("profile_id", "status")


@query("handoff_lanes", f"""WITH {QUALITY_SQL} SELECT profile_id, CASE status WHEN 'validated' THEN 'accepted' WHEN 'partial' THEN 'repair_required' ELSE 'quarantined' END AS lane, status = 'validated' AS eligible,
 CASE WHEN status = 'partial' THEN CASE WHEN source_format IN ('images', 'scans') THEN 'ocr_partial_requires_repair' ELSE 'partial_document_requires_repair' END END AS repair_reason,
 CASE status WHEN 'validated' THEN 'consume_in_module2' WHEN 'partial' THEN 'send_to_repair_queue' ELSE 'send_to_quarantine_queue' END AS next_action FROM state""")
def handoff_lanes(spark, d):
    h = assessed(spark, d).withColumn("h", Q.handoff(C("status"), C("source_format")))
    return h.select("profile_id", "h.lane", "h.eligible", "h.repair_reason", "h.next_action")


@query("handoff_summary_pivot", f"WITH {QUALITY_SQL} SELECT source_format, count(*) FILTER (WHERE status = 'validated') AS validated, count(*) FILTER (WHERE status = 'partial') AS partial, count(*) FILTER (WHERE status = 'uncertain') AS uncertain FROM state GROUP BY source_format")
def handoff_summary_pivot(spark, d):
    return assessed(spark, d).groupBy("source_format").pivot("status", ["validated", "partial", "uncertain"]).count().na.fill(0)


@query("fallback_trigger", f"WITH {QUALITY_SQL} SELECT profile_id, status <> 'validated' AND (source_format IN ('images', 'scans') OR chars < 900 OR completeness < 0.5 OR (noise > 0.24 AND chars < 1400) OR noise > 0.45) AS retry FROM state")
def fallback_trigger(spark, d):
    a = assessed(spark, d)
    return a.select("profile_id", Q.try_fallback(C("status"), C("chars"), C("completeness"), C("noise"), C("warnings"), C("source_format"), F.lit(False)).alias("retry"))


@query("better_of_two", f"""WITH {QUALITY_SQL}, t AS (SELECT profile_id, confidence AS a, CAST(profile_id * 43 % 101 AS DOUBLE) / 100 AS b, CASE status WHEN 'validated' THEN 2 WHEN 'partial' THEN 1 ELSE 0 END AS ra, CAST(profile_id % 3 AS INT) AS rb FROM state)
SELECT profile_id, CASE WHEN rb > ra THEN 'second' WHEN rb = ra AND b > a + 0.05 THEN 'second' ELSE 'first' END AS choice FROM t""")
def better_of_two(spark, d):
    b, rb = (C("profile_id") * 43 % 101).cast("double") / 100, C("profile_id") % 3
    ra = F.when(C("status") == "validated", 2).when(C("status") == "partial", 1).otherwise(0)
    return assessed(spark, d).select("profile_id", F.when((rb > ra) | ((rb == ra) & (b > C("confidence") + 0.05)), "second").otherwise("first").alias("choice"))


@query("doc_quality_signals", r"""WITH l AS (SELECT doc_id, array_to_string(list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10)) AS body FROM documents), w AS (SELECT doc_id, body, regexp_extract_all(body, '[A-Za-z0-9]{2,}') AS words FROM l)
SELECT doc_id, CAST(length(body) AS INT) AS chars, CAST(len(words) AS INT) AS words, round(length(regexp_replace(body, '[\x00-\x7F]', '', 'g')) / greatest(length(body), 1), 4) AS weird_ratio,
 round(len(list_filter(words, lambda x: length(regexp_replace(x, '[^A-Za-z]', '', 'g')) >= 8 AND length(regexp_replace(x, '[^aeiouyAEIOUY]', '', 'g')) / length(regexp_replace(x, '[^A-Za-z]', '', 'g')) < 0.2)) / greatest(len(words), 1), 4) AS noise_ratio FROM w""")
def doc_quality_signals(spark, d):
    s = Q.markdown_signals(C("text"))
    return table(spark, d, "documents").select("doc_id", *[s[k].alias(k) for k in ("chars", "words", "weird_ratio", "noise_ratio")])


GATE_SQL = r"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM documents), b AS (SELECT doc_id, ls, array_to_string(ls, chr(10)) AS body FROM l), w AS (SELECT *, regexp_extract_all(body, '[A-Za-z0-9]{2,}') AS ws FROM b),
s AS (SELECT doc_id, doc_id % 2 = 1 AS ocr, length(body) AS chars, len(ws) AS words, CAST(regexp_matches(body, '(?i)\b(experience|work experience|professional experience|internship|employment)\b') AS INT) + CAST(regexp_matches(body, '(?i)\b(education|formation|degree|university|school|baccalaur|diploma)\b') AS INT) + CAST(regexp_matches(body, '(?i)\b(skills|technical skills|competences|programming|tools|frameworks)\b') AS INT) AS sections,
 round(length(regexp_replace(body, '[\x00-\x7F]', '', 'g')) / greatest(length(body), 1), 4) AS weird, len(list_filter(ls, lambda x: length(x) >= 18 AND (regexp_matches(x, '[A-Za-z]{14,}') OR regexp_matches(x, '(?i)[a-z]{5,}(with|and|from|to|of|in)[a-z]{5,}')))) AS glued,
 round(len(list_filter(ws, lambda x: length(translate(x, '0123456789', '')) >= 8 AND length(regexp_replace(x, '[^aeiouyAEIOUY]', '', 'g')) / length(translate(x, '0123456789', '')) < 0.2)) / greatest(len(ws), 1), 4) AS noise FROM w),
g AS (SELECT *, chars < 900 OR words < 120 OR sections < 2 AS weak, weird > 0.025 OR noise > 0.18 OR (glued >= 10 AND (words < 180 OR sections < 2)) AS noisy FROM s)
SELECT doc_id, concat_ws('|', CASE WHEN weak THEN 'markdown_too_weak' END, CASE WHEN noisy THEN 'high_ocr_noise' END, CASE WHEN ocr AND (weak OR (noisy AND (words < 180 OR sections < 2))) THEN 'needs_ocr_repair' END) AS warnings, ocr AND (weak OR (noisy AND (words < 180 OR sections < 2))) AS repair FROM g"""


@query("markdown_repair_gate", GATE_SQL)
def markdown_repair_gate(spark, d):
    s = Q.markdown_signals(C("text"))
    docs = table(spark, d, "documents").select("doc_id", *[v.alias(k) for k, v in s.items()], F.element_at(F.array(F.lit("pdf"), F.lit("scans")), (C("doc_id") % 2 + 1).cast("int")).alias("source_format"))
    w = Q.markdown_warnings(*[C(x) for x in ("chars", "words", "useful_sections", "weird_ratio", "glued_lines", "noise_ratio", "source_format")])
    return docs.select("doc_id", F.concat_ws("|", w).alias("warnings"), F.array_contains(w, "needs_ocr_repair").alias("repair"))


@query("too_short_documents", r"SELECT doc_id, length(text) >= 120 AND len(list_filter(regexp_split_to_array(text, '[ \t\n\r]+'), lambda x: x <> '')) >= 25 AS kept FROM documents")
def too_short_documents(spark, d):
    words = F.size(F.filter(F.split("text", "[ \t\n\r]+"), lambda x: x != ""))
    return table(spark, d, "documents").select("doc_id", ((F.length("text") >= 120) & (words >= 25)).alias("kept"))


@query("format_inference", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'scans' WHEN 1 THEN 'pdf' WHEN 2 THEN 'images' ELSE 'unknown' END AS source_format FROM documents")
def format_inference(spark, d):
    path = F.concat(F.element_at(F.array(F.lit("in/scans/a"), F.lit("in/x/b"), F.lit("in/y/c"), F.lit("in/z/d")), (C("doc_id") % 4 + 1).cast("int")), F.element_at(F.array(F.lit(".pdf"), F.lit(".PDF"), F.lit(".jpeg"), F.lit(".bin")), (C("doc_id") % 4 + 1).cast("int")))
    return table(spark, d, "documents").select("doc_id", Q.source_format(path).alias("source_format"))


@query("routing", r"""WITH p AS (SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS doc, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \t\n\r]+', ' ', 'g')) AS t, contains(html, 'class="ad"') AS image FROM pages),
w AS (SELECT doc, length(t) AS chars, CASE WHEN t = '' THEN 0 ELSE length(t) - length(replace(t, ' ', '')) + 1 END AS words, image FROM p),
g AS (SELECT doc, count(*) AS pages, CAST(sum(chars) AS BIGINT) AS chars, CAST(sum(words) AS BIGINT) AS words, count(*) FILTER (WHERE chars >= 40) AS text_pages, count(*) FILTER (WHERE image) AS image_pages FROM w GROUP BY doc)
SELECT doc, pages, chars, words, CASE WHEN image_pages / pages >= 0.8 AND chars / pages < 140 THEN 'scanned' WHEN NOT (chars >= 40 AND chars / pages >= 80 AND text_pages / pages >= 0.5) THEN 'scanned' WHEN words < 200 THEN 'hybrid' ELSE 'native' END AS route,
 CASE WHEN image_pages / pages >= 0.8 AND chars / pages < 140 THEN 'images with weak text' WHEN NOT (chars >= 40 AND chars / pages >= 80 AND text_pages / pages >= 0.5) THEN 'text below limits' WHEN words < 200 THEN 'too few native words' ELSE 'text above limits' END AS reason FROM g""")
def routing(spark, d):
    """Hosts as files and their pages as pages; an advertisement stands for an image."""
    plain = F.trim(F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), "[ \t\n\r]+", " "))
    p = table(spark, d, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("doc"), plain.alias("t"), C("html").contains('class="ad"').alias("image"))
    w = p.select("doc", F.char_length("t").alias("chars"), F.when(C("t") == "", 0).otherwise(F.size(F.split("t", " "))).alias("words"), "image")
    g = w.groupBy("doc").agg(F.count("*").alias("pages"), F.sum("chars").alias("chars"), F.sum("words").alias("words"), F.count_if(C("chars") >= Q.TEXT_PAGE_CHARS).alias("text_pages"), F.count_if("image").alias("image_pages"))
    r = g.withColumn("r", Q.paged_route(C("pages"), C("chars"), C("words"), C("text_pages"), C("image_pages")))
    return r.select("doc", "pages", "chars", "words", "r.route", F.element_at("r.reasons", -1).alias("reason"))


@query("order_coherence", r"""WITH l AS (SELECT page_id, list_transform(regexp_split_to_array(url, '[/?&=.]'), lambda x: length(x)) AS p FROM pages WHERE url IS NOT NULL), n AS (SELECT page_id, p, len(p) AS n, list_sum(list_transform(range(1, len(p) + 1), lambda i: len(list_filter(p[i + 1:], lambda y: y < p[i])))) AS inv FROM l)
SELECT page_id, round(CASE WHEN n = 1 THEN 1.0 ELSE 1 - inv / (n * (n - 1) / 2) END, 6) AS coherence FROM n""")
def order_coherence(spark, d):
    """Lengths of an address' parts as positions."""
    parts = F.transform(F.split("url", "[/?&=.]"), F.char_length)
    return table(spark, d, "pages").where("url IS NOT NULL").select("page_id", F.round(W.order_coherence(parts), 6).alias("coherence"))


@query("normalised_quality", f"WITH {PROFILES_SQL} SELECT profile_id, round(least(greatest(1 - 0.15 * flags - 0.10 * (6 - required) - CASE WHEN chars < 400 THEN 0.20 ELSE 0.0 END, 0.0), 1.0) + 1e-9, 4) AS score FROM profiles")
def normalised_quality(spark, d):
    words = F.when(C("chars") < 400, 10).otherwise(100)
    return profiles(spark, d).select("profile_id", Q.normalised_quality(C("flags"), 6 - C("required"), words).alias("score"))


@query("whitespace_clean", r"SELECT doc_id, nullif(trim(regexp_replace(text, '[ \t\n\r\f\x0B]+', ' ', 'g')), '') AS cleaned FROM documents")
def whitespace_clean(spark, d):
    return table(spark, d, "documents").select("doc_id", X.collapse(C("text")).alias("cleaned"))


@query("alnum_keys", "SELECT doc_id, md5(trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', '-', 'g'))) AS k FROM documents")
def alnum_keys(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(X.alnum_key(C("text"), "-")).alias("k"))


@query("skill_normalise", "SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: CASE WHEN length(w) <= 3 THEN upper(w) ELSE upper(w[1]) || w[2:] END), ' ') AS skill FROM part")
def skill_normalise(spark, d):
    raw = F.concat(F.lit(" "), F.replace(F.upper("p_name"), F.lit(" "), F.lit("  ")))
    return table(spark, d, "part").select("p_partkey", X.normal_skill(raw).alias("skill"))


@query("graph_skill_normalise", "SELECT p_partkey, trim(regexp_replace(replace(lower(trim(p_name || '.' || p_brand)), '.', ''), '[^a-z0-9+#/]+', ' ', 'g')) AS skill FROM part")
def graph_skill_normalise(spark, d):
    return table(spark, d, "part").select("p_partkey", X.graph_skill(F.concat("p_name", F.lit("."), "p_brand")).alias("skill"))


@query("accent_fold", "SELECT doc_id, md5(translate(text, 'àâäáãåçéèêëíìîïñóòôöõúùûüýÿÀÂÄÁÃÅÇÉÈÊËÍÌÎÏÑÓÒÔÖÕÚÙÛÜÝ', 'aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY')) AS k FROM documents")
def accent_fold(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(X.fold_accents(C("text"))).alias("k"))


@query("stable_ids", "SELECT doc_id, 'doc_' || substr(sha1(concat_ws('|', nullif(CAST(doc_id AS VARCHAR), ''), nullif(lang, ''), nullif(source, ''))), 1, 12) AS id FROM documents")
def stable_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", X.stable_id("doc", C("doc_id"), C("lang"), C("source")).alias("id"))


@query("content_hash", "SELECT doc_id, sha256(text) AS h FROM documents")
def content_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"))


@query("emails_found", r"SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+[.][A-Za-z0-9.-]*[A-Za-z]')) AS n, lower(regexp_extract(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+[.][A-Za-z0-9.-]*[A-Za-z]')) AS first_email FROM documents")
def emails_found(spark, d):
    found = F.regexp_extract_all("text", F.lit("([A-Za-z0-9._%+-]+@[A-Za-z0-9-]+[.][A-Za-z0-9.-]*[A-Za-z])"), F.lit(1))
    return table(spark, d, "documents").select("doc_id", F.size(found).cast("long").alias("n"), F.coalesce(F.lower(F.get(found, F.lit(0))), F.lit("")).alias("first_email"))


EMAIL_SQL = "regexp_replace(lower(trim(regexp_extract(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+[.][A-Za-z0-9.-]*[A-Za-z]'))), ' ', '')"


@query("email_class", f"""WITH e AS (SELECT doc_id, nullif({EMAIL_SQL}, '') AS e FROM documents) SELECT doc_id, CASE WHEN e IS NULL THEN 'missing' WHEN split_part(e, '@', 2) IN ('example.com', 'test.com') OR split_part(e, '@', 1) = 'info' OR starts_with(split_part(e, '@', 1), 'info.') OR starts_with(split_part(e, '@', 1), 'info-') THEN 'generic' ELSE 'real' END AS email_class FROM e""")
def email_class(spark, d):
    raw = F.nullif(F.regexp_extract("text", "([A-Za-z0-9._%+-]+@[A-Za-z0-9-]+[.][A-Za-z0-9.-]*[A-Za-z])", 1), F.lit(""))
    return table(spark, d, "documents").select("doc_id", X.email_class(X.email(raw), ["example.com", "test.com"], ["info"]).alias("email_class"))


@query("phone_class", r"""WITH p AS (SELECT doc_id, regexp_extract(text, '[+][0-9]+ [(][0-9]{3}[)] [0-9]{3}-[0-9]{4}') AS raw FROM documents), q AS (SELECT doc_id, CASE WHEN length(regexp_replace(raw, '[^0-9]+', '', 'g')) >= 7 THEN regexp_replace(raw, '[^0-9]+', '', 'g') END AS ph FROM p)
SELECT doc_id, ph AS phone, CASE WHEN ph IS NULL THEN 'missing' WHEN ph IN ('0000000000', '1234567890', '123456789') OR contains(ph, '1234567') OR contains(ph, '1111111') OR length(replace(ph, ph[1], '')) = 0 OR regexp_matches(ph, '555[0-9]{4}$') THEN 'weak_or_placeholder' ELSE 'real' END AS phone_class FROM q""")
def phone_class(spark, d):
    raw = F.regexp_extract("text", r"([+][0-9]+ [(][0-9]{3}[)] [0-9]{3}-[0-9]{4})", 1)
    return table(spark, d, "documents").select("doc_id", X.phone(raw).alias("phone"), X.phone_class(X.phone(raw)).alias("phone_class"))


@query("urls_in_pages", r"SELECT page_id, len(regexp_extract_all(html, '(?i)(?:https?://|www\.)[^ \t\n\r]+')) AS n FROM pages")
def urls_in_pages(spark, d):
    return table(spark, d, "pages").select("page_id", F.size(X.urls(C("html"))).cast("long").alias("n"))


@query("html_escape", "SELECT page_id, md5(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS k FROM pages")
def html_escape(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(X.escape_html(C("html"))).alias("k"))


@query("html_to_text", r"SELECT page_id, nullif(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \t\n\r\f\x0B]+', ' ', 'g')), '') AS plain FROM pages")
def html_to_text(spark, d):
    return table(spark, d, "pages").select("page_id", X.strip_html(C("html")).alias("plain"))


@query("sentence_split", r"SELECT doc_id, len(list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?])[ \t\n\r\f\v]+', '\1' || chr(10), 'g'), '\n+'), lambda x: trim(x)), lambda x: x <> '')) AS n FROM documents")
def sentence_split(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(X.sentences(C("text"))).cast("long").alias("n"))


@query("intent_class", "SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), '\\b(compare|versus)\\b') THEN 'compare' WHEN regexp_matches(lower(text), '\\b(the|this)\\b') THEN 'search' ELSE 'other' END AS intent FROM conversations WHERE role = 'user'")
def intent_class(spark, d):
    rules = [(r"\b(compare|versus)\b", "compare"), (r"\b(the|this)\b", "search")]
    return table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", X.keyword_label(C("text"), rules, "other").alias("intent"))


@query("domain_by_count", "SELECT doc_id, CASE WHEN len(regexp_extract_all(lower(text), 'tion')) >= len(regexp_extract_all(lower(text), 'the')) THEN 'abstract' ELSE 'plain' END AS domain FROM documents")
def domain_by_count(spark, d):
    n = lambda p: F.regexp_count(F.lower("text"), F.lit(p))
    return table(spark, d, "documents").select("doc_id", F.when(n("tion") >= n("the"), "abstract").otherwise("plain").alias("domain"))


@query("top_n_request", r"SELECT conv_id, turn, CAST(coalesce(least(greatest(CASE WHEN text IS NOT NULL THEN coalesce(TRY_CAST(nullif(regexp_extract(lower(text), '\btop\s*(\d+)\b', 1), '') AS INTEGER), turn) END, 1), 10), 3) AS INTEGER) AS top_k FROM conversations")
def top_n_request(spark, d):
    """Every message asks, at its end, for as many as its turn says."""
    message = F.concat("text", F.lit("\nGive me the Top "), C("turn").cast("string"))
    n = F.nullif(F.regexp_extract(F.lower(message), r"\btop\s*(\d+)\b", 1), F.lit("")).cast("int")
    return table(spark, d, "conversations").select("conv_id", "turn", F.when(n.isNull(), 3).otherwise(F.least(F.greatest(n, F.lit(1)), F.lit(10))).alias("top_k"))


@query("experience_phrases", "SELECT p_partkey, CAST(p_size AS DOUBLE) AS years, CAST(p_size AS DOUBLE) + 1.5 AS mean_years, CASE WHEN p_size < 2 THEN 'junior' WHEN p_size <= 5 THEN 'mid_level' ELSE 'senior' END AS level FROM part")
def experience_phrases(spark, d):
    size = lambda more: (C("p_size") + more).cast("string")
    years = D.experience_value(F.concat(size(0), F.lit(" ans")))
    mean = D.experience_value(F.concat(size(0), F.lit("-"), size(3), F.lit(" years")))
    return table(spark, d, "part").select("p_partkey", years.alias("years"), mean.alias("mean_years"), D.level_of_years(years).alias("level"))


@query("years_buckets", f"WITH {PROFILES_SQL} SELECT CASE WHEN required_years IS NULL THEN 'unknown' WHEN required_years < 1 THEN '0-1' WHEN required_years < 3 THEN '1-3' WHEN required_years < 5 THEN '3-5' WHEN required_years < 8 THEN '5-8' ELSE '8+' END AS bucket, count(*) AS n FROM profiles GROUP BY 1")
def years_buckets(spark, d):
    return profiles(spark, d).groupBy(D.years_bucket(C("required_years")).alias("bucket")).agg(F.count("*").alias("n"))


@query("month_tokens", "SELECT o_orderkey, CAST(year(o_orderdate) * 12 + month(o_orderdate) AS INTEGER) AS month, CAST(year(o_orderdate) * 12 + 12 AS INTEGER) AS last_month FROM orders")
def month_tokens(spark, d):
    month, last = (D.month_index(F.date_format("o_orderdate", p), True, 2026) for p in ("MM/yyyy", "yyyy"))
    return table(spark, d, "orders").select("o_orderkey", month.alias("month"), last.alias("last_month"))


@query("field_support", r"""WITH f AS (SELECT doc_id, text, substr(text, 1, 20) AS v FROM documents), g AS (SELECT *, regexp_replace(lower(v), '[^a-z0-9]+', '', 'g') AS cv, regexp_replace(lower(text), '[^a-z0-9]+', '', 'g') AS ct, list_distinct(list_filter(regexp_extract_all(lower(v), '[a-z0-9][a-z0-9+.#/@-]*'), lambda t: length(t) > 1 AND t NOT IN ('and', 'the', 'with', 'for', 'from'))) AS w FROM f)
SELECT doc_id, CASE WHEN v IS NULL OR trim(v) = '' THEN 'missing' WHEN cv <> '' AND contains(ct, cv) THEN 'supported' WHEN len(w) = 0 THEN 'missing' WHEN len(list_filter(w, lambda t: contains(lower(text), t))) / len(w) >= 0.8 THEN 'weakly_supported' ELSE 'unsupported' END AS support FROM g""")
def field_support(spark, d):
    return table(spark, d, "documents").select("doc_id", Q.field_support(F.substring("text", 1, 20), C("text")).alias("support"))


@query("json_paths", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_paths(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("json_salvage", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_salvage(spark, d):
    broken = F.concat(F.lit("Sure:\n```json\n"), F.regexp_replace("props", r"\}\s*$", ",}"), F.lit("\n```"))
    inner = F.regexp_extract(broken, r"(?s)(\{.*\})", 1)
    fixed = F.regexp_replace(inner, r",\s*([}\]])", "$1")
    return table(spark, d, "events").select("event_id", F.from_json(fixed, "k long").getField("k").alias("k"))


@query("canonical_json_distinct", "SELECT count(DISTINCT lang || '|' || source) AS n FROM documents")
def canonical_json_distinct(spark, d):
    return table(spark, d, "documents").agg(F.count_distinct(F.sha2(F.to_json(F.struct("lang", "source")), 256)).alias("n"))


def _sign_sql(name, pattern, x):
    r"""A sign's test for DuckDB, whose \b and \w know ASCII only and which has no lookbehind."""
    edge, end = r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])"
    if name == "null_text":
        p = edge + '"?null"?' + end
    else:
        p = "|".join(edge + one.removeprefix(r"\b").removesuffix(r"\b") + (end if one.endswith(r"\b") else "") for one in pattern.split("|"))
    return f"CASE WHEN regexp_matches({x}, '(?i){p}') THEN '{name}' END"


SIGNS_SQL = "concat_ws('|', " + ", ".join(_sign_sql(n, p, "t") for n, p in Q.TEMPLATE_SIGNS) + ")"


@query("template_flags", f"""WITH t AS (SELECT 'page' AS kind, page_id AS id, url || chr(10) || html AS t FROM pages UNION ALL SELECT 'document', doc_id, text FROM documents UNION ALL
SELECT 'benchmark', item_id, CASE item_id % 4 WHEN 0 THEN text || ' First  Last' WHEN 1 THEN '000 000-0000 ' || text WHEN 2 THEN text || ' "NULL"' ELSE text || ' nullable info@ResumeWorded.com' END FROM benchmark) SELECT kind, id, {SIGNS_SQL} AS flags FROM t""")
def template_flags(spark, d):
    """Whole pages with their addresses, documents, and benchmark items with signs put in."""
    put = F.when(C("item_id") % 4 == 0, F.concat("text", F.lit(" First  Last"))).when(C("item_id") % 4 == 1, F.concat(F.lit("000 000-0000 "), "text")).when(C("item_id") % 4 == 2, F.concat("text", F.lit(' "NULL"'))).otherwise(F.concat("text", F.lit(" nullable info@ResumeWorded.com")))
    kind = lambda rows, name, i, text: rows.select(F.lit(name).alias("kind"), C(i).alias("id"), text.alias("t"))
    texts = kind(table(spark, d, "pages"), "page", "page_id", F.concat("url", F.lit("\n"), "html")).unionByName(kind(table(spark, d, "documents"), "document", "doc_id", C("text"))).unionByName(kind(table(spark, d, "benchmark"), "benchmark", "item_id", put))
    return texts.select("kind", "id", F.array_join(Q.template_signs(C("t")), "|").alias("flags"))


@query("char_error_rate", "WITH p AS (SELECT item_id, text AS truth, replace(replace(text, 'e', 'c'), 'th', 'h') AS said FROM benchmark) SELECT item_id, round(CAST(levenshtein(truth, said) AS DOUBLE) / greatest(length(truth), 1), 6) AS cer FROM p")
def char_error_rate(spark, d):
    from talentloom.operators.ocr import cer

    said = F.replace(F.replace("text", F.lit("e"), F.lit("c")), F.lit("th"), F.lit("h"))
    return table(spark, d, "benchmark").select("item_id", F.round(cer(C("text"), said), 6).alias("cer"))


@query("word_error_rate")
def word_error_rate(spark, d):
    from talentloom.operators.ocr import wer

    said = F.replace(C("text"), F.lit("the "), F.lit(""))
    return table(spark, d, "benchmark").select("item_id", F.round(wer(C("text"), said), 6).alias("wer"))


@query("word_edit_counts", r"""WITH w AS (SELECT item_id, len(regexp_extract_all(text, '[^ \t\n\r\f\x0B]+')) AS n FROM benchmark)
SELECT item_id, n AS words, n // 7 - n // 35 AS substituted, n // 5 AS lost, CAST(0 AS BIGINT) AS added, round((n // 7 - n // 35 + n // 5) / greatest(n, 1), 9) AS rate FROM w""")
def word_edit_counts(spark, d):
    """Items read with every fifth word lost and every seventh of the others misread: what the alignment finds."""
    from talentloom.operators.ocr import word_counts

    words = F.regexp_extract_all("text", F.lit(r"([^ \t\n\r\f\x0B]+)"), F.lit(1))
    heard = F.transform(words, lambda x, i: F.when((i + 1) % 5 == 0, "").when((i + 1) % 7 == 0, "@#").otherwise(x))
    rows = table(spark, d, "benchmark").select("item_id", word_counts(C("text"), F.array_join(F.filter(heard, lambda x: x != ""), " ")).alias("c"))
    return rows.select("item_id", "c.words", "c.substituted", "c.lost", "c.added", F.round("c.rate", 9).alias("rate"))
