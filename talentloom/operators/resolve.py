"""Entity resolution: greedy passes by evidence priority, consolidation, peer values, upserts."""

from __future__ import annotations

import sys
from difflib import SequenceMatcher

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talentloom.functions.text import stable_id
from talentloom.sources.io import written

# small helpers travel with the tasks, so that workers need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
#: Names less alike than this are materially different.
CONFLICT = 0.62
CONFIDENCE = {"real_email": 0.98, "real_phone": 0.95, "linkedin_url": 0.99, "github_url": 0.99}


def blocks_ratio(a: str, b: str) -> float:
    """Twice the characters in matching blocks (the longest first, then those on both sides of it) over both lengths."""
    return SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(T.DoubleType())
def _ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else blocks_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def name_similarity(a: Column, b: Column) -> Column:
    """1 where one name holds the other (or one is empty), else the ratio of their matching blocks."""
    same = (a == "") | (b == "") | a.contains(b) | b.contains(a)
    return F.when(same, 1.0).otherwise(_ratios(F.when(~same, a), F.when(~same, b)))


#: Up to this length the matcher leaves out no common characters, so the longest block is at least the common prefix.
_PLAIN = 199


def _common_prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def alike_classes(names: list[str], least: float) -> list[tuple[int, int, str, int]]:
    """Runs of sorted names that are alike by their common prefix alone: (start, end, prefix, longest).

    The matched characters of two names are at least their common prefix, so a run whose prefix makes up `least` of its longest name holds no conflict.
    """
    out, start, longest = [], 0, 0
    for i, name in enumerate(names):
        grown = max(longest, len(name)) if i > start else len(name)
        if i > start and (grown > _PLAIN or _common_prefix(names[start], name) < least * grown):
            out.append((start, i, names[start][: _common_prefix(names[start], names[i - 1])], longest))
            start, grown = i, len(name)
        longest = grown
    if names:
        out.append((start, len(names), names[start][: _common_prefix(names[start], names[-1])], longest))
    return out


def worst_pair(names: list[str], least: float) -> tuple[str, str, float] | None:
    """The first pair of sorted names (in order) that differ materially. Runs of names that are alike by their common prefixes are passed over as a whole."""
    runs = alike_classes(names, least)
    for k, (start, end, prefix, longest) in enumerate(runs):
        apart = [r for r in runs[k + 1 :] if max(longest, r[3]) > _PLAIN or 2.0 * _common_prefix(prefix, r[2]) < least * (longest + r[3])]
        if not apart:
            continue
        for a in names[start:end]:
            for low, high, _, _ in apart:
                for b in names[low:high]:
                    if a not in b and b not in a and (ratio := blocks_ratio(a, b)) < least:
                        return a, b, ratio
    return None


def name_conflicts(rows: DataFrame, key: str, name: str, least: float = CONFLICT) -> DataFrame:
    """(key, left, right, similarity): of each key whose members' names differ materially one pair that does.

    Names are compared once each, however many members share them: distinct names are written first. Each is held against the key's least name, an
    aggregation that settles most keys; of keys whose names are all near to the least one, runs of names with a long common prefix
    are passed over as a whole and only the rest is compared, up to the first conflict.
    """
    named = written(rows.where(F.col(name).isNotNull() & (F.col(name) != "")).select(key, name).distinct())
    return _conflicts_of_names(named, key, name, least)


def _conflicts_of_names(named: DataFrame, key: str, name: str, least: float) -> DataFrame:
    """name_conflicts of written, distinct (key, name) rows."""
    low = named.groupBy(key).agg(F.min(name).alias("_low"), F.count("*").alias("_n")).where("_n > 1").withColumnRenamed(key, "_key")
    pairs = named.join(low, F.col(key) == F.col("_key")).where(F.col(name) != F.col("_low")).withColumn("_s", name_similarity(F.col("_low"), F.col(name)))
    judged = written(pairs.groupBy(key).agg(F.min(F.struct("_s", name)).alias("_worst"), F.min("_low").alias("_low")))
    told = judged.where(F.col("_worst._s") < least).select(key, F.col("_low").alias("left"), F.col(f"_worst.{name}").alias("right"), F.round("_worst._s", 4).alias("similarity"))
    near = judged.where(F.col("_worst._s") >= least).select(F.col(key).alias("_near"))
    if near.isEmpty():
        return told
    rest = named.join(near, F.col(key) == F.col("_near"), "left_semi")
    kind = named.schema[key].dataType.simpleString()

    def look(group: pd.DataFrame) -> pd.DataFrame:
        found = worst_pair(sorted(group[name]), least)
        return pd.DataFrame([(group[key].iloc[0], found[0], found[1], round(found[2], 4))] if found else [], columns=[key, "left", "right", "similarity"])

    return told.unionByName(rest.groupBy(key).applyInPandas(look, f"{key} {kind}, left string, right string, similarity double"))


def conflicting_keys(rows: DataFrame, key: str, name: str, least: float = CONFLICT) -> DataFrame:
    """Keys whose members' names differ materially."""
    return name_conflicts(rows, key, name, least).select(key)


def resolve(profiles: DataFrame, evidence: list[tuple[str, str]], name: str, id_column: str) -> DataFrame:
    """profiles with entity_id, dedup_status, dedup_confidence, evidence_type.

    evidence: (type, key column) by priority. A pass groups the rows not yet assigned by its key; groups of
    two or more without a name conflict merge. Greedy by priority, not a transitive closure; one
    aggregation by key and pass. Each pass is written, so that plans do not grow with the number of evidence types.
    """
    out = profiles.withColumn("entity_id", F.lit(None).cast("string")).withColumn("dedup_status", F.lit(None).cast("string")).withColumn("dedup_confidence", F.lit(None).cast("double")).withColumn("evidence_type", F.lit(None).cast("string"))
    for kind, key in evidence:
        out = written(out)
        free = out.where(F.col("entity_id").isNull() & F.col(key).isNotNull())
        named = written(free.groupBy(key, name).agg(F.count(F.lit(1)).alias("_n")))
        groups = named.groupBy(key).agg(F.sum("_n").alias("_n")).where("_n > 1")
        valid = named.where(F.col(name).isNotNull() & (F.col(name) != "")).select(key, name)
        bad = _conflicts_of_names(valid, key, name, CONFLICT).select(key).withColumn("_bad", F.lit(True))
        merged = groups.join(bad, key, "left").select(F.col(key).alias("_k"), F.coalesce("_bad", F.lit(False)).alias("_conflict"))
        joined = out.join(merged, (F.col(key) == F.col("_k")) & F.col("entity_id").isNull(), "left")
        hit = F.col("_k").isNotNull() & ~F.col("_conflict")
        clash = F.col("_k").isNotNull() & F.col("_conflict")
        out = joined.select(
            *[c for c in profiles.columns],
            F.when(hit, stable_id("candidate", F.lit("A"), F.lit(kind), F.col("_k"))).otherwise(F.col("entity_id")).alias("entity_id"),
            F.when(hit, "auto_merged").when(clash, F.coalesce("dedup_status", F.lit("conflict_detected_no_merge"))).otherwise(F.col("dedup_status")).alias("dedup_status"),
            F.when(hit, CONFIDENCE[kind]).otherwise(F.col("dedup_confidence")).alias("dedup_confidence"),
            F.when(hit, kind).otherwise(F.col("evidence_type")).alias("evidence_type"),
        )
    alone = F.col("entity_id").isNull()
    return out.select(
        *profiles.columns,
        F.when(alone, stable_id("candidate", F.lit("single"), F.col(id_column))).otherwise(F.col("entity_id")).alias("entity_id"),
        F.when(alone, F.coalesce("dedup_status", F.lit("unique_candidate"))).otherwise(F.col("dedup_status")).alias("dedup_status"),
        F.when(alone, 1.0).otherwise(F.col("dedup_confidence")).alias("dedup_confidence"),
        F.coalesce("evidence_type", F.lit("none")).alias("evidence_type"),
    )


def review_groups(resolved: DataFrame, name: str, generic_email: str, keys: list[tuple[str, str]]) -> DataFrame:
    """resolve's rows with the weak evidence of those still unique: nothing merges, entities stay.

    A generic e-mail under different names quarantines its rows; members of other groups of several entities
    (of one generic e-mail, then by each (type, key column)) need review. One aggregation by key and pass.
    """
    out, columns = resolved, resolved.columns
    valid = F.when(F.col(name) != "", F.col(name))
    for kind, key in [("generic_email_group", generic_email), *keys]:
        apart = (F.min("entity_id") != F.max("entity_id")).alias("_apart")
        clash = F.coalesce(F.min(valid) != F.max(valid), F.lit(False)) & F.lit(kind == "generic_email_group")
        groups = out.where((F.col(key).isNotNull()) & (F.col(key) != "")).groupBy(F.col(key).alias("_k")).agg(apart, clash.alias("_clash"))
        joined = out.join(groups.where("_apart or _clash"), F.col(key) == F.col("_k"), "left")
        hit = (F.col("dedup_status") == "unique_candidate") & F.col("_k").isNotNull()
        pick = lambda c, on_clash, on_review: F.when(hit & F.col("_clash"), on_clash).when(hit, on_review).otherwise(F.col(c)).alias(c)  # noqa: B023, E731
        new = {
            "dedup_status": pick("dedup_status", "conflict_detected_no_merge", "possible_duplicate_needs_review"),
            "dedup_confidence": pick("dedup_confidence", 0.0, 0.4),
            "evidence_type": pick("evidence_type", "generic_email_conflict", kind),
        }
        out = joined.select(*[new.get(c, F.col(c)) for c in columns])
    return out


def consolidate(profiles: DataFrame, entity: str, quality: list[Column], id_column: str, sets: list[str]) -> DataFrame:
    """One row per entity: size, best profile, sorted distinct unions."""
    best = F.max_by(id_column, F.struct(*quality))
    unions = [F.array_sort(F.collect_set(c)).alias(f"all_{c}") for c in sets]
    return profiles.groupBy(entity).agg(F.count(F.lit(1)).alias("profile_count"), best.alias("best_profile_id"), *unions)


def merge_fields(rows: DataFrame, entity: str, fields: list[str], priority: list[Column]) -> DataFrame:
    """Field by field the value that isn't null with the least priority."""
    aggs = [F.min_by(f, F.when(F.col(f).isNotNull(), F.struct(*priority))).alias(f) for f in fields]
    return rows.groupBy(entity).agg(*aggs)


def dedup_items(rows: DataFrame, entity: str, signature: Column, order: str, fields: list[str]) -> DataFrame:
    """Items of an entity merged by signature: the first value that isn't null of each field."""
    keyed = rows.withColumn("signature", signature)
    return keyed.groupBy(entity, "signature").agg(*[F.min_by(f, F.when(F.col(f).isNotNull(), F.col(order))).alias(f) for f in fields], F.count(F.lit(1)).alias("merged"))


def peer_value(value: Column, quality: Column, group: Column) -> Column:
    """The best value of the group on every member."""
    return F.max_by(value, quality).over(Window.partitionBy(group))


def key_cascade(cards: DataFrame, card_id: str, keys: list[str], profiles: DataFrame, profile_id: str) -> DataFrame:
    """The first level of keys on which a card finds a profile; all levels in one long-form join."""
    long = lambda df, ident, out: df.select(F.col(ident).alias(out), F.posexplode(F.array(*[F.col(k).cast("string") for k in keys])).alias("level", "_key")).where("_key is not null")
    left, right = long(cards, card_id, "_card"), long(profiles, profile_id, "_profile").groupBy("level", "_key").agg(F.min("_profile").alias("_profile"))
    found = left.join(right, ["level", "_key"]).groupBy("_card").agg(F.min_by("_profile", "level").alias("found_profile"), F.min("level").alias("found_level"))
    return cards.join(found, F.col(card_id) == F.col("_card"), "left").drop("_card")


def upsert(old: DataFrame, new: DataFrame, key: str, now: Column) -> DataFrame:
    """old merged with new by key: created_at stays, updated_at and action tell what happened.

    Merge semantics without a lakehouse: write the result beside the old table, then swap.
    """
    fields = [c for c in new.columns if c != key]
    a = old.select(F.col(key).alias("_k"), "created_at", F.col("updated_at").alias("_was"), *[F.col(f).alias(f"_{f}") for f in fields])
    j = a.join(new, F.col("_k") == F.col(key), "full")
    return j.select(
        F.coalesce(F.col(key), F.col("_k")).alias(key),
        *[F.when(F.col(key).isNotNull(), F.col(f)).otherwise(F.col(f"_{f}")).alias(f) for f in fields],
        F.coalesce("created_at", now).alias("created_at"),
        F.when(F.col(key).isNotNull(), now).otherwise(F.col("_was")).alias("updated_at"),
        F.when(F.col("_k").isNull(), "created").when(F.col(key).isNull(), "kept").otherwise("updated").alias("action"),
    )
