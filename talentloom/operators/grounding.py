"""Grounding: support of summaries, duties and lists by the source, nullified fields, whole-profile validation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talentloom.functions import scoring as S
from talentloom.functions.quality import compact, field_support

Support = Callable[[Column, Column, Column, Column], Column]
# Words without weight, and the thresholds of support.
STOPWORDS = ["about", "after", "also", "among", "and", "are", "been", "being", "built", "from", "have", "into", "more", "over", "that", "than", "their", "them", "then", "they", "this", "using", "with", "your"]
SUMMARY_SUPPORTED, SUMMARY_WEAK, DUTY_SUPPORTED = 0.6, 0.4, 0.4


def _coverage(value: Column, low: Column) -> tuple[Column, Column]:
    words = F.array_distinct(F.filter(F.regexp_extract_all(F.lower(value), F.lit("([a-z0-9][a-z0-9+.#/@-]*)"), F.lit(1)), lambda t: (F.length(t) > 3) & ~t.isin(STOPWORDS)))
    return F.size(words), F.size(F.filter(words, lambda t: low.contains(t))) / F.greatest(F.size(words), F.lit(1))


def summary_support(value: Column, source: Column, low: Column | None = None, tight: Column | None = None) -> Column:
    n, share = _coverage(value, F.lower(source) if low is None else low)
    whole = (compact(value) != "") & (compact(source) if tight is None else tight).contains(compact(value))
    return F.when(value.isNull() | (F.trim(value) == ""), "missing").when(whole, "supported").when(n == 0, "unsupported").when(share >= SUMMARY_SUPPORTED, "supported").when(share >= SUMMARY_WEAK, "weakly_supported").otherwise("unsupported")


def duty_support(value: Column, source: Column, low: Column | None = None, tight: Column | None = None) -> Column:
    n, share = _coverage(value, F.lower(source) if low is None else low)
    plain = field_support(value, source, low, tight)
    return F.when(plain.isin("missing", "supported"), plain).when((n > 0) & (share >= DUTY_SUPPORTED), "weakly_supported").otherwise("unsupported")


def list_support(values: Column, source: Column) -> Column:
    """supported if all are, weakly_supported if some are, missing if there are none."""
    states = F.transform(values, lambda v: field_support(v, source))
    some = F.exists(states, lambda s: s.isin("supported", "weakly_supported"))
    return F.when(values.isNull() | (F.size(values) == 0), "missing").when(F.forall(states, lambda s: s == "supported"), "supported").when(some, "weakly_supported").otherwise("unsupported")


def ground(rows: DataFrame, fields: list[str], source: str, confidence: str) -> DataFrame:
    """rows with unsupported fields nullified, the lists of fields by state, reliability, kind and risk."""
    state = {f: field_support(F.col(f), F.col(source)) for f in fields}
    pick = lambda *wanted: F.array_compact(F.array(*[F.when(state[f].isin(*wanted), f) for f in fields]))
    out = rows.withColumn("fields_supported", pick("supported", "weakly_supported")).withColumn("fields_unsupported", pick("unsupported"))
    for f in fields:
        out = out.withColumn(f, F.when(~F.array_contains("fields_unsupported", f), F.col(f)))
    out = out.withColumn("fields_nullified", F.col("fields_unsupported"))
    n_ok, n_bad = F.size("fields_supported"), F.size("fields_unsupported")
    out = out.withColumn("reliability_score", S.reliability(n_ok, n_ok + n_bad, F.col(confidence), n_bad, n_bad))
    return out.withColumn("profile_kind", S.profile_kind(F.col("reliability_score"), n_ok, F.lit(None).cast("string"))).withColumn("hallucination_risk", S.unsupported_risk(n_bad))


def _leaf(value: Column, path: Column, state: Column) -> Column:
    """A judged leaf: what stays of it, its path and state."""
    return F.struct(F.when(state != "unsupported", value).alias("v"), path.alias("path"), state.alias("state"))


def _judged(value: Column, kind: T.DataType, path: Column, name: str, source: tuple[Column, Column, Column], rules: dict[str, Support]) -> Column:
    """value's tree with a judged leaf in place of each leaf. name: the path without list places, which picks the rule."""
    rule = rules.get(name, field_support)
    join = lambda key: F.when(path == "", F.lit(key)).otherwise(F.concat(path, F.lit("." + key)))
    place = lambda i: F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))
    if isinstance(kind, T.StructType):
        return F.struct(*[_judged(value[f.name], f.dataType, join(f.name), f"{name}.{f.name}".lstrip("."), source, rules).alias(f.name) for f in kind])
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x, i: _judged(x, kind.elementType, place(i), name + "[]", source, rules))
    return _leaf(value, path, rule(value.cast("string"), *source))


def _leaves(tree: Column, kind: T.DataType) -> Column:
    """All judged leaves of a judged tree as one array of (path, state)."""
    if isinstance(kind, T.StructType):
        return F.concat(F.array().cast(_LEAVES), *[_leaves(tree[f.name], f.dataType) for f in kind])
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.flatten(F.transform(tree, lambda x: _leaves(x, kind.elementType))), F.array().cast(_LEAVES))
    return F.array(F.struct(tree["path"].alias("path"), tree["state"].alias("state")))


_LEAVES = "array<struct<path:string,state:string>>"


def _holds(tree: Column, kind: T.DataType) -> Column:
    """Whether some leaf of a judged tree has a value left."""
    return F.exists(_leaves(tree, kind), lambda x: x["state"].isin("supported", "weakly_supported"))


def _kept(tree: Column, kind: T.DataType) -> Column:
    """The value of a judged tree: unsupported fields null, unsupported and missing list items and items without any supported field gone."""
    if isinstance(kind, T.StructType):
        return F.struct(*[_kept(tree[f.name], f.dataType).alias(f.name) for f in kind])
    if isinstance(kind, T.ArrayType):
        return F.transform(F.filter(tree, lambda x: _holds(x, kind.elementType)), lambda x: _kept(x, kind.elementType))
    return tree["v"]


def _dropped_items(tree: Column, kind: T.DataType, path: Column) -> Column:
    """Paths of list items that are structs and lost all their fields."""
    none = F.array().cast("array<string>")
    join = lambda key: F.when(path == "", F.lit(key)).otherwise(F.concat(path, F.lit("." + key)))
    place = lambda i: F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))
    if isinstance(kind, T.StructType):
        return F.concat(none, *[_dropped_items(tree[f.name], f.dataType, join(f.name)) for f in kind])
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        inner = F.flatten(F.transform(tree, lambda x, i: _dropped_items(x, kind.elementType, place(i))))
        own = F.filter(F.transform(tree, lambda x, i: F.when(~_holds(x, kind.elementType), place(i))), lambda p: p.isNotNull())
        return F.coalesce(F.concat(inner, own), none)
    return none


def ground_nested(rows: DataFrame, profile: str, source: str, rules: dict[str, Support] | None = None) -> DataFrame:
    """rows with every leaf of the nested column `profile` held against the text in `source`.

    The profile's type is compiled into expressions that visit each leaf once, whatever its nesting of structs and lists; rules: how to judge
    leaves other than by field_support, by their path without places (``experiences[].responsibilities[]``). Unsupported fields become null;
    list items that are not supported go, and so do list items that are structs without any supported field. fields_supported (weak
    support counts), fields_unsupported and fields_nullified (dropped items too) list sorted paths; a missing value is in none. Null lists stay null.
    """
    kind = rows.schema[profile].dataType
    # the judged tree is a column of its own, so that no leaf is judged for each use
    forms = rows.withColumn("_low", F.lower(source)).withColumn("_tight", F.regexp_replace("_low", "[^a-z0-9]+", ""))
    judged = forms.withColumn("_judged", _judged(F.col(profile), kind, F.lit(""), "", (F.col(source), F.col("_low"), F.col("_tight")), rules or {}))
    judged = judged.withColumn("_leaves", _leaves(F.col("_judged"), kind))
    paths = lambda *states: F.array_sort(F.array_distinct(F.transform(F.filter("_leaves", lambda x: x["state"].isin(*states)), lambda x: x["path"])))
    out = judged.withColumn(profile, F.when(F.col(profile).isNotNull(), _kept(F.col("_judged"), kind)))
    out = out.withColumn("fields_supported", paths("supported", "weakly_supported")).withColumn("fields_unsupported", paths("unsupported"))
    gone = F.array_sort(F.array_distinct(F.concat("fields_unsupported", _dropped_items(F.col("_judged"), kind, F.lit("")))))
    return out.withColumn("fields_nullified", gone).drop("_judged", "_leaves", "_low", "_tight")
