"""Roles and skills as edge tables: source roles, transferability, gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WEIGHT_CORE, WEIGHT_ADJACENT, WEIGHT_TRANSITION, WEIGHT_BLOCKING = 0.55, 0.20, 0.15, 0.10
DIRECT_FIT = 0.7


def role_tables(spark: SparkSession, roles: list[tuple]) -> DataFrame:
    """roles: (role, core skills, adjacent skills) in order -> a small DataFrame with ord."""
    rows = [(i, r, list(core), list(adjacent)) for i, (r, core, adjacent) in enumerate(roles)]
    return spark.createDataFrame(rows, "ord int, role string, core array<string>, adjacent array<string>")


def overlap(a, b):
    return F.size(F.array_intersect(a, b))


def source_role(people: DataFrame, roles: DataFrame, person: str, skills: str, titles: str | None = None, aliases: dict[str, str] | None = None) -> DataFrame:
    """Each person's role with most overlap (core + half of adjacent), one more if titles name it and one if they hold an alias of it.

    The first role wins ties, even at none. titles: a column of normalised text.
    """
    score = overlap(F.col(skills), F.col("core")) + 0.5 * overlap(F.col(skills), F.col("adjacent"))
    if titles:
        named = F.col(titles).contains(F.lower("role"))
        known = F.lit(False)
        for alias, role in (aliases or {}).items():
            known = known | ((F.col("role") == role) & F.col(titles).contains(alias))
        score = score + F.coalesce(named, F.lit(False)).cast("int") + F.coalesce(known, F.lit(False)).cast("int")
    j = people.join(F.broadcast(roles)).withColumn("_score", score)
    return j.groupBy(person).agg(F.max_by("role", F.struct("_score", -F.col("ord"))).alias("source_role"), F.max("_score").alias("role_score"))


def transferability(people: DataFrame, person: str, skills: str, source: str, core: list[str], adjacent: list[str], required: list[str], transitions: list[tuple[str, list[str]]]) -> DataFrame:
    """Scores and gaps of each person for one target role.

    source: the column of the person's own role; transitions: (role, condition skills) of the ways into the target. A way is plausible if it
    leaves the person's role and some condition is met; the best covered one counts.
    """
    lit = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    wanted = list(dict.fromkeys([*core, *required]))
    near = list(dict.fromkeys(adjacent))
    have = F.col(skills)
    part = lambda xs: overlap(lit(xs), have) / len(xs) if xs else F.lit(0.0)
    open_ = [F.when((F.col(source) == role) & (part(xs) > 0), F.struct(F.round(part(xs), 4).alias("coverage"), lit(xs).alias("skills"))) for role, xs in transitions if xs]
    ways = F.array_compact(F.array(*open_)) if open_ else F.array().cast("array<struct<coverage:double,skills:array<string>>>")
    rows = people.withColumn("_ways", ways)
    missing = F.array_except(lit(wanted), have)
    helps = F.array_union(lit(near), F.flatten(F.col("_ways.skills")))
    compensable = F.filter(missing, lambda s: F.array_contains(helps, s))
    blocking = F.array_except(missing, compensable)
    best = F.coalesce(F.array_max("_ways.coverage"), F.lit(0.0))
    score = WEIGHT_CORE * part(wanted) + WEIGHT_ADJACENT * part(near) + WEIGHT_TRANSITION * best - WEIGHT_BLOCKING * F.size(blocking) / max(len(wanted), 1)
    return rows.select(
        person,
        F.round(part(required), 4).alias("direct_fit_score"),
        (part(required) >= DIRECT_FIT).alias("fit_direct"),
        F.round(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)), 4).alias("transferability_score"),
        compensable.alias("gaps_compensable"),
        blocking.alias("gaps_blocking"),
    )


def vertices(rows: DataFrame, key: str, name: str, order: str) -> DataFrame:
    """One vertex per key; the last name written wins."""
    return rows.groupBy(key).agg(F.max_by(name, order).alias(name))
