"""The assistant as five nodes over a table of messages: understand, match, cards, transferability, compose.

Each node takes the state, one row a message, and returns it with its own typed columns; warnings and sources grow from node to node.
Tools are tables (or functions that give them): a tool that fails leaves a warning on every message and the next nodes go on
without it. Candidates of a message are at most ten, so lists of a message stay small whatever the tables' size.

How many candidates a message asks for holds for the later messages of its conversation until one asks anew.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words that name a target role, in order, and the role without any.
ROLE_WORDS = [
    (["data engineer", "data engineering"], "Data Engineer"),
    (["data analyst", "analyste data"], "Data Analyst"),
    (["machine learning", "ml engineer"], "Machine Learning Engineer"),
    (["devops"], "DevOps Engineer"),
    (["frontend", "front-end"], "Frontend Developer"),
    (["full stack", "fullstack"], "Full Stack Developer"),
    (["backend", "back-end"], "Backend Developer"),
]
DEFAULT_ROLE, DEFAULT_TOP, MOST, SHOWN, MOST_GAPS = "Backend Developer", 5, 10, 5, 3
# The sentences of an answer.
SAYS = {
    "asked": "J'ai analyse la demande recruteur: ",
    "role": "Role cible estime: ",
    "baseline": "Matching V3 reste la baseline officielle de scoring.",
    "none": ["Aucun candidat n'a ete retourne par les tools disponibles.", "Je ne peux donc pas recommander de profil sans resultat source."],
    "top": "Top candidats recommandes:",
    "check": "Candidats a verifier:",
    "to_check": ": statut review_needed dans les donnees disponibles.",
    "poor": "donnees sources limitees",
    "notes": [
        "Notes methodologiques:",
        "- Les scores ML/SHAP sont des couches d'analyse experimentales si presentes.",
        "- Neo4j est utilise uniquement si disponible ; sinon le fallback YAML de transferabilite est conserve.",
        "- Aucune decision recruteur finale n'est automatisee.",
    ],
}
CANDIDATES = "array<struct<position:int,candidate_id:string,rank:int,score:double,status:string>>"
CARDS = "array<struct<position:int,candidate_id:string,card_status:string>>"
MOVES = "array<struct<position:int,candidate_id:string,selected_source:string,score:double,gaps:array<string>>>"
Tool = DataFrame | Callable[[], DataFrame]


def target_role(message: Column) -> Column:
    low = F.lower(message)
    named = [F.when(reduce(Column.__or__, [low.contains(w) for w in words]), role) for words, role in ROLE_WORDS]
    return F.coalesce(*named, F.lit(DEFAULT_ROLE))


def requested(message: Column) -> Column:
    """The number behind the word top, between 1 and MOST, or null."""
    digits = F.nullif(F.regexp_extract(F.lower(message), r"\btop\s*(\d+)\b", 1), F.lit(""))
    number = F.when(F.length(F.ltrim(digits, F.lit("0"))) > 4, MOST).otherwise(F.try_to_number(digits, F.lit("9" * 20)).cast("long"))
    return F.when(digits.isNotNull(), F.least(F.greatest(number, F.lit(1)), F.lit(MOST))).cast("int")


def understand(messages: DataFrame, conversation: str, turn: str, text: str) -> DataFrame:
    """Node 1: job_description, target_role, top_k; empty warnings; the message as the first source."""
    said = F.trim(F.coalesce(F.col(text), F.lit("")))
    so_far = Window.partitionBy(conversation).orderBy(turn).rowsBetween(Window.unboundedPreceding, 0)
    asked = F.last(requested(said), ignorenulls=True).over(so_far)
    return messages.select(
        conversation,
        turn,
        said.alias("job_description"),
        target_role(said).alias("target_role"),
        F.coalesce(asked, F.lit(DEFAULT_TOP)).alias("top_k"),
        F.array(F.lit("user_message")).alias("sources"),
        F.array().cast("array<string>").alias("warnings"),
    )


def _tool(tool: Tool | None) -> tuple[DataFrame | None, str | None]:
    """The tool's table, or why there is none."""
    try:
        found = tool() if callable(tool) else tool
        if found is not None:
            found.schema  # noqa: B018  (a table that cannot be read fails here)
            return found, None
        return None, "not available"
    except Exception as e:  # noqa: BLE001  (told in the answer's warnings)
        return None, f"{type(e).__name__}: {e}"


def _warned(state: DataFrame, more: Column) -> DataFrame:
    return state.withColumn("warnings", F.concat("warnings", more))


def _sourced(state: DataFrame, used: Column, name: str) -> DataFrame:
    return state.withColumn("sources", F.when(used & ~F.array_contains("sources", name), F.array_append("sources", F.lit(name))).otherwise(F.col("sources")))


def match(state: DataFrame, tool: Tool | None) -> DataFrame:
    """Node 2: the first top_k candidates of the role. tool: (role, candidate_id, rank, score, status), at most MOST ranks of a role count."""
    found, why = _tool(tool)
    if found is None:
        return _warned(state.withColumn("candidates", F.array().cast(CANDIDATES)), F.array(F.lit(f"match_candidates failed: {why}")))
    row = F.struct(F.col("rank").cast("int").alias("position"), F.col("candidate_id").cast("string").alias("candidate_id"), F.col("rank").cast("int").alias("rank"), F.col("score").cast("double").alias("score"), F.col("status").cast("string").alias("status"))
    lists = found.where(F.col("rank") <= MOST).groupBy(F.col("role").alias("_role")).agg(F.array_sort(F.collect_list(row)).alias("_all"))
    state = state.join(lists, F.col("target_role") == F.col("_role"), "left")
    state = state.withColumn("candidates", F.coalesce(F.slice("_all", F.lit(1), F.col("top_k")), F.array().cast(CANDIDATES))).drop("_role", "_all")
    return _sourced(state, F.lit(True), "match_candidates")


def _shown(state: DataFrame) -> Column:
    return F.slice("candidates", 1, SHOWN)


def _looked_up(state: DataFrame, keys: list[str], table: DataFrame, row: Column, name: str, kind: str) -> DataFrame:
    """state with `name`: rows of table for the candidates shown, in their order."""
    asked = state.select(*keys, F.explode(_shown(state)).alias("_c")).select(*keys, F.col("_c.position").alias("position"), F.col("_c.candidate_id").alias("candidate_id"))
    one = table.withColumnRenamed("candidate_id", "_id")
    got = asked.join(one, F.col("candidate_id") == F.col("_id")).groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias(name))
    got = got.select(*[F.col(k).alias(f"_{k}") for k in keys], name)
    on = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return state.join(got, on, "left").drop(*[f"_{k}" for k in keys]).withColumn(name, F.coalesce(name, F.array().cast(kind)))


def fetch_cards(state: DataFrame, keys: list[str], tool: Tool | None) -> DataFrame:
    """Node 3: decision cards of the candidates shown. tool: one row a candidate (candidate_id, card_status)."""
    found, why = _tool(tool)
    lost = "decision card missing for "
    if found is None:
        return _warned(state.withColumn("cards", F.array().cast(CARDS)), F.transform(_shown(state), lambda c: F.concat(F.lit(lost), c["candidate_id"], F.lit(f": {why}"))))
    row = F.struct("position", "candidate_id", F.col("card_status").cast("string").alias("card_status"))
    state = _looked_up(state, keys, found, row, "cards", CARDS)
    have = F.transform("cards", lambda c: c["candidate_id"])
    missing = F.filter(_shown(state), lambda c: ~F.array_contains(have, c["candidate_id"]))
    state = _warned(state, F.transform(missing, lambda c: F.concat(F.lit(lost), c["candidate_id"], F.lit(": not found"))))
    return _sourced(state, F.size("cards") > 0, "get_decision_card")


def analyze(state: DataFrame, keys: list[str], plain: Tool | None, graph: Tool | None) -> DataFrame:
    """Node 4: transferability of the candidates shown, from the graph where it answers, else from the plain table. Tools: (candidate_id, score, gaps)."""
    by_rules, why = _tool(plain)
    by_graph, _ = _tool(graph)
    spark = state.sparkSession
    none = spark.createDataFrame([], "candidate_id string, score double, gaps array<string>")
    kind = lambda t, p: (none if t is None else t).select(F.col("candidate_id").cast("string").alias(f"{p}_id"), F.struct(F.col("score").cast("double").alias("score"), F.col("gaps").cast("array<string>").alias("gaps")).alias(p))
    ids = state.select(F.explode(_shown(state)).alias("c")).select("c.candidate_id").distinct()
    both = ids.join(kind(by_rules, "_y"), F.col("candidate_id") == F.col("_y_id"), "left").join(kind(by_graph, "_n"), F.col("candidate_id") == F.col("_n_id"), "left").drop("_y_id", "_n_id")
    source = F.when(F.col("_n").isNotNull(), "neo4j").otherwise("yaml").alias("selected_source")
    chosen = F.coalesce("_n", "_y")
    row = F.struct("position", "candidate_id", source, chosen["score"].alias("score"), chosen["gaps"].alias("gaps"))
    state = _looked_up(state, keys, both, row, "transferability", MOVES)
    if by_rules is None:
        state = _warned(state, F.transform(_shown(state), lambda c: F.concat(F.lit("transferability YAML unavailable for "), c["candidate_id"], F.lit(f": {why}"))))
    state = _sourced(state, F.size("transferability") > 0, "get_transferability")
    return _sourced(state, F.exists("transferability", lambda m: m["selected_source"] == "neo4j"), "get_neo4j_transferability")


def _number(x: Column) -> Column:
    return F.format_string("%.4f", x)


def _reasons(c: Column) -> Column:
    """What the sources say about one candidate."""
    card = F.get(F.filter("cards", lambda k: k["candidate_id"] == c["candidate_id"]), F.lit(0))
    move = F.get(F.filter("transferability", lambda k: k["candidate_id"] == c["candidate_id"]), F.lit(0))
    status = F.coalesce(c["status"], card["card_status"])
    gaps = F.array_join(F.slice(move["gaps"], 1, MOST_GAPS), ", ")
    parts = [
        F.when(c["rank"].isNotNull(), F.concat(F.lit("rang V3 "), c["rank"].cast("string"))),
        F.when(c["score"].isNotNull(), F.concat(F.lit("score V3 "), _number(c["score"]))),
        F.when(status.isNotNull(), F.concat(F.lit("statut "), status)),
        F.when(move["score"].isNotNull(), F.concat(F.lit("transferabilite "), _number(move["score"]))),
        F.when(F.size(move["gaps"]) > 0, F.concat(F.lit("gaps bloquants: "), gaps)),
    ]
    text = F.array_join(F.array_compact(F.array(*parts)), "; ")
    return F.when(text == "", SAYS["poor"]).otherwise(text)


def compose(state: DataFrame) -> DataFrame:
    """Node 5: the answer, which names only candidates that the match returned."""
    lits = lambda xs: F.array(*[F.lit(x) for x in xs])
    quoted = lambda c: F.concat(F.lit("`"), c["candidate_id"], F.lit("`"))
    head = F.array(F.concat(F.lit(SAYS["asked"]), "job_description"), F.concat(F.lit(SAYS["role"]), "target_role", F.lit(".")), F.lit(SAYS["baseline"]), F.lit(""))
    listed = F.transform(_shown(state), lambda c, i: F.concat((i + 1).cast("string"), F.lit(". "), quoted(c), F.lit(" - "), _reasons(c)))
    doubtful = F.filter(_shown(state), lambda c: F.lower(c["status"]) == "review_needed")
    review = F.when(F.size(doubtful) > 0, F.concat(lits(["", SAYS["check"]]), F.transform(doubtful, lambda c: F.concat(F.lit("- "), quoted(c), F.lit(SAYS["to_check"]))))).otherwise(F.array().cast("array<string>"))
    some = F.concat(head, lits([SAYS["top"]]), listed, review, lits(["", *SAYS["notes"]]))
    return state.withColumn("answer", F.array_join(F.when(F.size("candidates") == 0, F.concat(head, lits(SAYS["none"]))).otherwise(some), "\n"))


def answer(messages: DataFrame, conversation: str, turn: str, text: str, candidates: Tool | None, cards: Tool | None, plain: Tool | None, graph: Tool | None) -> DataFrame:
    """All five nodes; messages are told apart by (conversation, turn)."""
    keys = [conversation, turn]
    state = match(understand(messages, conversation, turn, text), candidates)
    return compose(analyze(fetch_cards(state, keys, cards), keys, plain, graph))
