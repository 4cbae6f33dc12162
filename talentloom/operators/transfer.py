"""How far people can move to the role of a job: target role, source role, ways between roles, gaps and what is said of them.

A graph is a stated list of (role, core skills, adjacent skills, ways) as `sources.io.read_graph` gives it, a way being a dictionary of role, condition_skills and
rationale. It goes into expressions as literals, so nothing is joined or shuffled here; skills are compared by `graph_skill`. What the graph alone tells is worked out
once, before the rows: a row looks up the skills and ways of its own roles and normalises only its own texts.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentloom.functions.text import graph_skill
from talentloom.operators.graph import DIRECT_FIT, WEIGHT_ADJACENT, WEIGHT_BLOCKING, WEIGHT_CORE, WEIGHT_TRANSITION

# Words that name roles, in the order in which they are looked for, and what is said.
ROLE_ALIASES = {
    "backend": "Backend Developer", "backend developer": "Backend Developer", "backend python developer": "Backend Developer", "frontend": "Frontend Developer", "frontend developer": "Frontend Developer",
    "fullstack": "Full Stack Developer", "full stack": "Full Stack Developer", "full stack developer": "Full Stack Developer", "data engineer": "Data Engineer", "data analyst": "Data Analyst",
    "machine learning engineer": "Machine Learning Engineer", "ml engineer": "Machine Learning Engineer", "devops": "DevOps Engineer", "devops engineer": "DevOps Engineer",
    "business intelligence analyst": "Business Intelligence Analyst", "bi analyst": "Business Intelligence Analyst",
}
DIRECT = "Le candidat est un fit direct pour %s avec un direct_fit_score de %s. Le score de transférabilité est %s."
BLOCKED = "Transition depuis %s vers %s partiellement plausible, mais des gaps bloquants restent présents: %s."
OPEN = "Transition depuis %s vers %s plausible sous réserve de validation humaine. Score de transférabilité: %s."
COVERED = "Le candidat couvre fortement les exigences du role %s selon le graphe Neo4j."
COMPENSABLE = "Transition plausible vers %s: certains gaps sont compensables (%s), mais une validation humaine reste necessaire."
BLOCKING = "Des gaps bloquants restent presents pour %s: %s."
NEUTRAL = "Analyse Neo4j disponible pour %s, sans conclusion automatique de recrutement."

C = F.col
Graph = list[tuple[str, list[str], list[str], list[dict]]]
_NONE = "array<string>"


def _texts(values) -> Column:
    return F.array(*[F.lit(str(v)) for v in values]).cast(_NONE)


def _keyed(key: Column, values: dict[str, Column], otherwise: Column) -> Column:
    pairs = [x for k, v in values.items() for x in (F.lit(k), v)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), otherwise) if pairs else otherwise


def _plain(value: object) -> str:
    """graph_skill of a stated text."""
    return re.sub("[^a-z0-9+#/]+", " ", str(value).strip(" ").lower().replace(".", "")).strip(" ")


def _distinct(values: list) -> list[str]:
    """distinct_skills of stated texts."""
    out: dict[str, str] = {}
    for v in values:
        out.setdefault(_plain(v), str(v))
    return [v for k, v in out.items() if k]


def _once(value: Column, then) -> Column:
    """then(value), for which value is worked out once however often it is used."""
    return F.transform(F.array(value), lambda x: then(x))[0]


def distinct_skills(values: Column) -> Column:
    """The first spelling of each skill, in order; null and empty ones go."""
    keys = F.transform(values, graph_skill)
    pair = F.struct(values.alias("values"), keys.alias("keys"))
    first = lambda x: F.filter(x["values"], lambda v, i: (F.get(x["keys"], i) != "") & (F.array_position(x["keys"], F.get(x["keys"], i)) == i + 1))
    return F.when(values.isNotNull(), _once(pair, first)).otherwise(F.array().cast(_NONE))


def normal_skills(values: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.coalesce(values, F.array().cast(_NONE)), graph_skill), lambda k: k != ""))


def target_role(graph: Graph, *named: Column) -> Column:
    """The role of the graph that the first of the texts (title, domain, id) names by an alias; the graph's first role where none does."""
    roles = [r[0] for r in graph]
    known = [(alias, role) for alias, role in ROLE_ALIASES.items() if role in roles]
    tries = [F.when(graph_skill(x).contains(alias), role) for x in named for alias, role in known]
    return F.coalesce(*tries, F.lit(roles[0]))


def source_role(graph: Graph, norms: Column, titles: Column) -> Column:
    """The role with most overlap (core, half of adjacent), one more if the titles name it and one for an alias; the first wins ties.

    norms: normalised skills; titles: all titles as one text.
    """
    lit = lambda values: _texts(dict.fromkeys(k for k in map(_plain, values) if k))

    def score(x: Column, role: str, core: list[str], adjacent: list[str]) -> Column:
        aliases = [x["said"].contains(alias) for alias, of in ROLE_ALIASES.items() if of == role]
        alias = F.coalesce(*[F.when(a, 1) for a in aliases], F.lit(0))
        named = x["said"].contains(_plain(role)).cast("int")
        return F.size(F.array_intersect(x["norms"], lit(core))) + 0.5 * F.size(F.array_intersect(x["norms"], lit(adjacent))) + named + alias

    rated = lambda x: F.array(*[F.struct(score(x, *r[:3]).cast("double").alias("score"), F.lit(-i).alias("ord"), F.lit(r[0]).alias("role")) for i, r in enumerate(graph)])
    return _once(F.struct(norms.alias("norms"), graph_skill(titles).alias("said")), lambda x: F.array_max(rated(x))["role"])


def with_targets(jobs: DataFrame, graph: Graph, title: str, domain: str, job_id: str, required: str, nice: str) -> DataFrame:
    """jobs with target_role, target_core (the role's core skills, then the required ones), target_adjacent (the role's, then the nice ones) and target_keys.

    target_keys holds core, adjacent and required skills normalised: once for the job, not again for each person held against it.
    """
    part = lambda at: _keyed(C("target_role"), {r[0]: _texts(r[at]) for r in graph}, _texts([]))
    given = lambda c: F.coalesce(C(c), F.array().cast(_NONE))
    out = jobs.withColumn("target_role", target_role(graph, C(title), C(domain), C(job_id)))
    out = out.withColumns({"target_core": distinct_skills(F.concat(part(1), given(required))), "target_adjacent": distinct_skills(F.concat(part(2), given(nice)))})
    return out.withColumn("target_keys", _target_keys(required))


def _target_keys(required: str) -> Column:
    keys = {"core": "target_core", "adjacent": "target_adjacent", "required": required}
    return F.struct(*[F.transform(c, graph_skill).alias(name) for name, c in keys.items()])


def _told(rows: list[tuple[str, dict]]) -> Column:
    """Stated ways (source, way), with the normalised conditions."""
    told = []
    for source, w in rows:
        conditions = w.get("condition_skills") or []
        told.append(F.struct(F.lit(source).alias("from_role"), F.lit(str(w.get("role"))).alias("to_role"), _texts(conditions).alias("condition_skills"), F.lit(str(w.get("rationale") or "")).alias("rationale"), _texts(map(_plain, conditions)).alias("keys")))
    return F.array(*told).cast(_TOLD)


def _ways(key: Column, stated: dict[str, list[tuple[str, dict]]], norms: Column) -> Column:
    """The ways stated under key some condition of which is met, with what is met; keys holds the normalised conditions."""
    ways = _keyed(key, {k: _told(v) for k, v in stated.items() if v}, F.array().cast(_TOLD))
    met = lambda w: F.filter(w["condition_skills"], lambda s, i: F.array_contains(norms, F.get(w["keys"], i)))
    full = F.transform(ways, lambda w: F.struct(
        w["from_role"].alias("from_role"), w["to_role"].alias("to_role"), w["condition_skills"].alias("condition_skills"), met(w).alias("matched_condition_skills"),
        F.round(F.size(met(w)) / F.greatest(F.size(w["condition_skills"]), F.lit(1)), 4).alias("condition_coverage"), w["rationale"].alias("rationale"), w["keys"].alias("keys"),
    ))
    return F.filter(full, lambda w: w["condition_coverage"] > 0).cast(_MET)


def _shown(ways: str) -> Column:
    """Ways without keys."""
    names = ["from_role", "to_role", "condition_skills", "matched_condition_skills", "condition_coverage", "rationale"]
    return F.transform(ways, lambda w: F.struct(*[w[n].alias(n) for n in names]))


_TOLD = "array<struct<from_role:string,to_role:string,condition_skills:array<string>,rationale:string,keys:array<string>>>"
_MET = "array<struct<from_role:string,to_role:string,condition_skills:array<string>,matched_condition_skills:array<string>,condition_coverage:double,rationale:string,keys:array<string>>>"


def _all_ways(graph: Graph) -> list[tuple[str, dict]]:
    return [(r[0], w) for r in graph for w in r[3] if isinstance(w, dict)]


def _helps(adjacent: Column, ways: str) -> Column:
    """Normalised skills that can make up for a missing one; adjacent: normalised."""
    return F.concat(adjacent, F.flatten(C(f"{ways}.keys")))


def _parted(wanted: str, norms: str, helps: str) -> dict[str, Column]:
    """matched, missing, compensable and blocking skills of those wanted, in their order; _keys holds the wanted ones normalised."""
    keys = lambda i: F.get(F.col("_keys"), i)
    held = lambda i: F.array_contains(norms, keys(i))
    eased = lambda i: F.array_contains(helps, keys(i))
    return {
        "_matched": F.filter(wanted, lambda s, i: held(i)), "_missing": F.filter(wanted, lambda s, i: ~held(i)), "_compensable": F.filter(wanted, lambda s, i: ~held(i) & eased(i)),
        "_blocking": F.filter(wanted, lambda s, i: ~held(i) & ~eased(i)),
    }


def reports(pairs: DataFrame, graph: Graph, skills: str, source: str, required: str, norms: str | None = None) -> DataFrame:
    """Each (person, job) row with scores, ways, gaps and an explanation; other columns stay.

    pairs: skills (array of raw names), source (the person's own role), required (the job's array) and the columns of with_targets. Only ways from
    the person's role into the target count. A job that requires nothing is fitted by 0. norms: normal_skills of the skills, where the caller has them.
    """
    rows = pairs if "target_keys" in pairs.columns else pairs.withColumn("target_keys", _target_keys(required))
    rows = rows.withColumns({"_norms": C(norms) if norms else normal_skills(C(skills)), "_keys": C("target_keys.core")})
    to = {f"{a} > {b[0]}": [(s, w) for s, w in _all_ways(graph) if s == a and str(w.get("role")).strip().lower() == b[0].strip().lower()] for a in [r[0] for r in graph] for b in graph}
    rows = rows.withColumn("_ways", _ways(F.concat_ws(" > ", source, "target_role"), to, C("_norms")))
    rows = rows.withColumn("_helps", _helps(C("target_keys.adjacent"), "_ways"))
    rows = rows.withColumns(_parted("target_core", "_norms", "_helps"))
    held = lambda c, of: F.filter(F.coalesce(c, F.array().cast(_NONE)), lambda s, i: F.array_contains("_norms", F.get(C(f"target_keys.{of}"), i)))
    part = lambda some, all_: F.when(F.size(all_) > 0, F.size(some) / F.size(all_)).otherwise(F.lit(0.0))
    rows = rows.withColumns({"_fit": part(held(C(required), "required"), C(required)), "matched_adjacent": held(C("target_adjacent"), "adjacent")})
    best = F.coalesce(F.array_max("_ways.condition_coverage"), F.lit(0.0))
    score = WEIGHT_CORE * part(C("_matched"), C("target_core")) + WEIGHT_ADJACENT * part(C("matched_adjacent"), C("target_adjacent")) + WEIGHT_TRANSITION * best - WEIGHT_BLOCKING * part(C("_blocking"), C("target_core"))
    rows = rows.withColumn("_score", F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)))
    two = lambda c: F.format_number(c, 2)
    said = (
        F.when(C("_fit") >= DIRECT_FIT, F.format_string(DIRECT, "target_role", two("_fit"), two("_score")))
        .when(F.size("_blocking") > 0, F.format_string(BLOCKED, source, "target_role", F.array_join("_blocking", ", ")))
        .otherwise(F.format_string(OPEN, source, "target_role", two("_score")))
    )
    return rows.select(
        *[c for c in pairs.columns if c not in ("target_core", "target_adjacent", "target_keys")], F.round("_fit", 4).alias("direct_fit_score"), (C("_fit") >= DIRECT_FIT).alias("fit_direct"), F.round("_score", 4).alias("transferability_score"),
        _shown("_ways").alias("transitions"), C("_matched").alias("matched_core"), C("_missing").alias("missing_core"), "matched_adjacent", C("_compensable").alias("gaps_compensable"),
        C("_blocking").alias("gaps_blocking"), said.alias("explanation"),
    )


def role_coverage(people: DataFrame, graph: Graph, skills: str, target: str, norms: str | None = None) -> DataFrame:
    """Each person against the graph's role named in `target`: coverage of its core, gaps, ways into it from any role, and an explanation; other columns stay.

    norms: normal_skills of the skills, where the caller has them.
    """
    part = lambda at, f=str: _keyed(C(target), {r[0]: _texts(map(f, _distinct(r[at]))) for r in graph}, _texts([]))
    rows = people.withColumn("_norms", C(norms) if norms else normal_skills(C(skills))).withColumns({"_core": part(1), "_keys": part(1, _plain)})
    into = {b[0]: [(s, w) for s, w in _all_ways(graph) if str(w.get("role")) == b[0]] for b in graph}
    rows = rows.withColumn("_ways", _ways(C(target), into, C("_norms")))
    rows = rows.withColumn("_helps", _helps(part(2, _plain), "_ways"))
    rows = rows.withColumns(_parted("_core", "_norms", "_helps"))
    rows = rows.withColumn("_part", F.when(F.size("_core") > 0, F.size("_matched") / F.size("_core")).otherwise(F.lit(0.0)))
    listed = lambda c: F.array_join(c, ", ")
    said = (
        F.when(C("_part") >= DIRECT_FIT, F.format_string(COVERED, target))
        .when((F.size("_ways") > 0) & (F.size("_compensable") > 0), F.format_string(COMPENSABLE, target, listed("_compensable")))
        .when(F.size("_blocking") > 0, F.format_string(BLOCKING, target, listed("_blocking")))
        .otherwise(F.format_string(NEUTRAL, target))
    )
    return rows.select(
        *people.columns, F.round("_part", 4).alias("coverage_score"), C("_matched").alias("matched_skills"), C("_missing").alias("missing_skills"), _shown("_ways").alias("transitions"),
        C("_compensable").alias("gaps_compensable"), C("_blocking").alias("gaps_blocking"), said.alias("explanation"),
    )
