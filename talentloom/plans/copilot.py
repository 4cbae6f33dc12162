"""The assistant's five nodes over all messages of users."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from talentloom.operators import copilot as B
from talentloom.operators.assistant import invented_ids
from talentloom.plans.registry import query, table
from talentloom.plans.scores import SCORED_SQL, scored

C = F.col
ROLES = [role for _, role in B.ROLE_WORDS]
PHRASES = ["a data engineer", "an analyste data", "an ML engineer", "DevOps", "a front-end person", "a FullStack dev", "a back-end dev", "somebody"]
#: Messages of users end with a wish; every third one says how many.
_WISH = "' Wanted: ' || p.phrase || CASE WHEN conv_id % 3 = 0 THEN ', top ' || CAST(turn * 3 AS VARCHAR) ELSE '' END"
MESSAGES_SQL = f"""phrases AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{p}')" for i, p in enumerate(PHRASES))}) p(i, phrase)),
messages AS (SELECT conv_id, turn, trim(text || {_WISH}) AS said FROM conversations JOIN phrases p ON (conv_id + turn) % {len(PHRASES)} = p.i WHERE role = 'user')"""
_ROLE_SQL = "CASE " + " ".join(f"WHEN {' OR '.join(f'''contains(lower(said), '{w}')''' for w in words)} THEN '{role}'" for words, role in B.ROLE_WORDS) + f" ELSE '{B.DEFAULT_ROLE}' END"
POOL_SQL = f"""pool AS (SELECT profile_id, final_score, risk, profile_id % {len(ROLES)} AS r, row_number() OVER (PARTITION BY profile_id % {len(ROLES)} ORDER BY final_score DESC, profile_id) AS rank FROM final)"""


def messages(spark, d):
    phrase = F.element_at(F.array(*[F.lit(p) for p in PHRASES]), ((C("conv_id") + C("turn")) % len(PHRASES) + 1).cast("int"))
    many = F.when(C("conv_id") % 3 == 0, F.concat(F.lit(", top "), (C("turn") * 3).cast("string"))).otherwise("")
    return table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.concat("text", F.lit(" Wanted: "), phrase, many).alias("said"))


def tools(spark, d):
    """Candidates of each role by score, cards of most of them, transferability from two sources."""
    w = Window.partitionBy(C("profile_id") % len(ROLES)).orderBy(F.desc("final_score"), "profile_id")
    ranked = scored(spark, d).withColumn("rank", F.row_number().over(w)).where(C("rank") <= B.MOST)
    role = F.element_at(F.array(*[F.lit(r) for r in ROLES]), (C("profile_id") % len(ROLES) + 1).cast("int"))
    ident = F.concat(F.lit("c"), C("profile_id").cast("string")).alias("candidate_id")
    pool = ranked.select(role.alias("role"), ident, "rank", C("final_score").alias("score"), F.when(C("risk") == "high", "review_needed").alias("status"))
    cards = ranked.where("profile_id % 3 <> 0").select(ident, F.concat(F.lit("card_"), "risk").alias("card_status"))
    moves = lambda keep, share, gaps: ranked.where(keep).select(ident, F.round(C("final_score") * share, 4).alias("score"), gaps.alias("gaps"))
    plain = moves("profile_id % 5 <> 0", 2.0, F.array(F.lit("SQL"), F.concat(F.lit("g"), C("profile_id").cast("string"))))
    graph = moves("profile_id % 4 = 0", 1.0, F.array().cast("array<string>"))
    return pool, cards, plain, graph


@query("copilot_understand", f"""WITH {MESSAGES_SQL}, m AS (SELECT *, TRY_CAST(nullif(regexp_extract(lower(said), '\\btop\\s*(\\d+)\\b', 1), '') AS INTEGER) AS n FROM messages)
SELECT conv_id, turn, {_ROLE_SQL} AS target_role, CAST(coalesce(last_value(CASE WHEN n IS NOT NULL THEN least(greatest(n, 1), 10) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), 5) AS INTEGER) AS top_k FROM m""")
def copilot_understand(spark, d):
    """Node 1 on every message: the role it names and how many it asks for, which later messages keep."""
    return B.understand(messages(spark, d), "conv_id", "turn", "said").select("conv_id", "turn", "target_role", "top_k")


_NODES_SQL = f"""WITH {SCORED_SQL}, {POOL_SQL}, {MESSAGES_SQL}, m AS (SELECT *, TRY_CAST(nullif(regexp_extract(lower(said), '\\btop\\s*(\\d+)\\b', 1), '') AS INTEGER) AS n FROM messages),
u AS (SELECT conv_id, turn, said, {_ROLE_SQL} AS role, coalesce(last_value(CASE WHEN n IS NOT NULL THEN least(greatest(n, 1), 10) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), 5) AS top_k FROM m),
roles AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{r}')" for i, r in enumerate(ROLES))}) t(r, role)),
x AS (SELECT conv_id, turn, rank, profile_id, 'c' || CAST(profile_id AS VARCHAR) AS id, final_score, CASE WHEN risk = 'high' THEN 'review_needed' END AS status, CASE WHEN profile_id % 3 <> 0 THEN 'card_' || risk END AS card,
    CASE WHEN profile_id % 4 = 0 THEN round(final_score, 4) WHEN profile_id % 5 <> 0 THEN round(final_score * 2, 4) END AS move, profile_id % 4 <> 0 AND profile_id % 5 <> 0 AS gaps
    FROM u JOIN roles USING (role) JOIN pool USING (r) WHERE rank <= top_k),
lines AS (SELECT conv_id, turn, count(*) AS n, string_agg(CASE WHEN rank <= 5 THEN CAST(rank AS VARCHAR) || '. `' || id || '` - ' || concat_ws('; ', 'rang V3 ' || rank, printf('score V3 %.4f', final_score), 'statut ' || coalesce(status, card),
    printf('transferabilite %.4f', move), CASE WHEN gaps THEN 'gaps bloquants: SQL, g' || profile_id END) END, chr(10) ORDER BY rank) AS listed, string_agg(CASE WHEN rank <= 5 AND status IS NOT NULL THEN '- `' || id || '`{B.SAYS["to_check"]}' END, chr(10) ORDER BY rank) AS doubt,
    count(*) FILTER (WHERE rank <= 5 AND card IS NOT NULL) AS cards, count(*) FILTER (WHERE rank <= 5 AND card IS NULL) AS lost, count(*) FILTER (WHERE rank <= 5 AND profile_id % 4 = 0) AS from_graph FROM x GROUP BY ALL)"""


def _quoted(text):
    return text.replace("'", "''")


@query("copilot_answers", f"""{_NODES_SQL}
SELECT u.conv_id, u.turn, u.role AS target_role, CAST(n AS INTEGER) AS candidates, CAST(cards AS INTEGER) AS cards, CAST(lost AS INTEGER) AS warnings, CAST(from_graph AS INTEGER) AS from_graph, 0 AS invented,
md5('{_quoted(B.SAYS["asked"])}' || said || chr(10) || '{B.SAYS["role"]}' || u.role || '.' || chr(10) || '{B.SAYS["baseline"]}' || chr(10) || chr(10) || '{B.SAYS["top"]}' || chr(10) || listed
 || CASE WHEN doubt IS NOT NULL THEN chr(10) || chr(10) || '{B.SAYS["check"]}' || chr(10) || doubt ELSE '' END || chr(10) || chr(10) || '{_quoted("@".join(B.SAYS["notes"]))}'.replace('@', chr(10))) AS answer_md5
FROM u JOIN lines USING (conv_id, turn)""")
def copilot_answers(spark, d):
    """Every user's message through all five nodes: what each found, and the answer."""
    out = B.answer(messages(spark, d), "conv_id", "turn", "said", *tools(spark, d))
    known = F.transform("candidates", lambda c: c["candidate_id"])
    graph = F.size(F.filter("transferability", lambda m: m["selected_source"] == "neo4j"))
    listed = F.element_at(F.split(F.split("answer", B.SAYS["top"])[1], "Notes"), 1)
    return out.select("conv_id", "turn", "target_role", F.size("candidates").alias("candidates"), F.size("cards").alias("cards"), F.size("warnings").alias("warnings"), graph.alias("from_graph"), F.size(invented_ids(listed, known, "`(c[0-9]+)`")).alias("invented"), F.md5("answer").alias("answer_md5"))
