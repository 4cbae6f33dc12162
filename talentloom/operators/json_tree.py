"""Search and clearing of values anywhere in JSON documents of any shape.

Documents are VARIANT values. The search goes down level by level: a frontier of values is exploded until nothing is left,
each level (of `values`) or every few (of `find_objects`) written once, so neither plans nor recursion grow with depth. Paths are dotted, with places of
lists in brackets: ``cards[2].profile.name``; keys are written as they are.

Clearing rebuilds a document, which no built-in expression does at unknown depth: a small walk with its own stack, over Arrow batches.

Defined cases: null and broken documents have no values; an empty object or list is a value without children; keys of null values exist but are not
filled; a document that is a single value has the empty path; of repeated keys in one object the parser's choice counts.
"""

from __future__ import annotations

import functools
import json
import sys
from collections.abc import Callable

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentloom.sources.io import written

# small helpers travel with the tasks, so that workers need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
#: Renditions of values that count as not filled.
UNFILLED = ['""', "0", "0.0", "false", "[]", "{}", "null"]
#: Levels that find_objects goes down between two writes.
LEVELS = 4
_HITS = "array<struct<path:string,depth:int,v:variant>>"


def _dealt(rows: DataFrame, ident: str, document: str) -> DataFrame:
    """Documents are small to read and dear to take apart: dealt to all cores first, where the input's few files would keep most idle."""
    spark = rows.sparkSession
    return rows.select(ident, document).repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism))


def values(rows: DataFrame, ident: str, document: str) -> DataFrame:
    """(ident, path, depth, v) of every value of every document, v being VARIANT; document: a column of JSON text."""
    spark = rows.sparkSession
    level = written(_dealt(rows, ident, document).select(ident, F.lit("").alias("path"), F.lit(0).alias("depth"), F.try_parse_json(document).alias("v")).where("v is not null"))
    levels = []
    while not level.isEmpty():
        levels.append(level)
        below = spark.sql(
            f"""SELECT p.`{ident}`, CASE WHEN e.key IS NULL THEN concat(p.path, '[', e.pos, ']') WHEN p.path = '' THEN e.key ELSE concat(p.path, '.', e.key) END AS path, p.depth + 1 AS depth, e.value AS v
            FROM {{level}} p, LATERAL variant_explode(p.v) e""",
            level=level,
        )
        level = written(below)
    out = levels[0] if levels else level
    for more in levels[1:]:
        out = out.unionByName(more)
    return out


def _rendered(v: Column, key: str) -> Column:
    return F.to_json(F.try_variant_get(v, f"$['{key}']", "variant"))


def filled(v: Column, key: str) -> Column:
    """The value under key as JSON text, or null where it is missing, null, empty, zero or false."""
    text = _rendered(v, key)
    return F.when(~text.isin(UNFILLED), text)


def text_of(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f"$['{key}']", "string")


def _deeper(level: DataFrame, ident: str, fits: Callable[[Column], Column]) -> DataFrame:
    """The objects and lists right inside those of a level. hits holds what was found above: the first child carries it on, with v null where it is a plain value."""
    v, hits = F.col("v"), F.col("hits")
    told = level.withColumn("hits", F.when(fits(v), F.concat(hits, F.array(F.struct("path", "depth", "v")))).otherwise(hits))
    below = level.sparkSession.sql(
        f"""SELECT p.`{ident}`, CASE WHEN e.key IS NULL THEN concat(p.path, '[', e.pos, ']') WHEN p.path = '' THEN e.key ELSE concat(p.path, '.', e.key) END AS path, p.depth + 1 AS depth, e.value AS v,
        CASE WHEN coalesce(e.pos, 0) = 0 THEN p.hits ELSE array() END AS hits FROM {{level}} p, LATERAL variant_explode_outer(p.v) e""",
        level=told,
    )
    # casts that read nothing below the value
    holds = F.try_variant_get(v, "$", "struct<>").isNotNull() | F.try_variant_get(v, "$", "array<struct<>>").isNotNull()
    return below.withColumn("v", F.when(holds, v)).where(F.col("v").isNotNull() | (F.size("hits") > 0))


def find_objects(rows: DataFrame, ident: str, document: str, needs: list[list[str]], fields: dict[str, list[str]]) -> DataFrame:
    """Objects anywhere in the documents that have, for each group of `needs`, some key of it filled.

    One row an object: ident, path, depth and each of `fields` as the text of its first filled key.

    Only objects and lists are gone into, LEVELS of them at a time; only what is found and what is still to be gone into is written then.
    """
    has = lambda v, group: functools.reduce(Column.__or__, [F.coalesce(~_rendered(v, k).isin(UNFILLED), F.lit(False)) for k in group])
    fits = lambda v: functools.reduce(Column.__and__, [has(v, group) for group in needs])
    root = {"path": F.lit(""), "depth": F.lit(0), "v": F.try_parse_json(document), "hits": F.array().cast(_HITS)}
    level = _dealt(rows, ident, document).select(ident, *[c.alias(name) for name, c in root.items()])
    parts = []
    while not parts or not level.isEmpty():
        for _ in range(LEVELS):
            level = _deeper(level, ident, fits)
        done = written(level)
        parts.append(done.select(ident, F.inline("hits")))
        level = done.where("v is not null").withColumn("hits", root["hits"])
    found = functools.reduce(DataFrame.unionByName, parts)
    pick = lambda keys: F.coalesce(*[F.when(filled(F.col("v"), k).isNotNull(), text_of(F.col("v"), k)) for k in keys])
    return found.select(ident, "path", "depth", *[pick(keys).alias(name) for name, keys in fields.items()])


def profile_metadata(rows: DataFrame, ident: str, document: str) -> DataFrame:
    """Objects that name a profile and the file of its structured form."""
    names = ["profile_id", "module2_file_path", "candidate_id", "source_path", "full_name"]
    return find_objects(rows, ident, document, [["profile_id"], ["module2_file_path"]], {n: [n] for n in names})


def matching_metadata(rows: DataFrame, ident: str, document: str) -> DataFrame:
    """Objects that name a profile, in either of two ways, and where it comes from."""
    needs = [["profile_id", "matched_profile_id"], ["source_path", "candidate_id"]]
    return find_objects(rows, ident, document, needs, {"profile_id": needs[0], "candidate_id": ["candidate_id"], "source_path": ["source_path"]})


def cleared(document: object, is_sign: Callable[[str], bool]) -> tuple[object, list[str]]:
    """A copy without the strings for which is_sign holds, and their paths: fields become null, items of lists go."""
    gone: list[str] = []

    def keep(value, path):
        """(value to put, container still to be filled or None)."""
        if isinstance(value, dict):
            return {}, value
        if isinstance(value, list):
            return [], value
        if isinstance(value, str) and is_sign(value):
            gone.append(path)
            return None, None
        return value, None

    root, todo = keep(document, "")
    stack = [(root, todo, "")] if todo is not None else []
    while stack:
        into, source, path = stack.pop()
        pairs = source.items() if isinstance(source, dict) else enumerate(source)
        for key, value in pairs:
            at = f"{path}[{key}]" if isinstance(source, list) else f"{path}.{key}" if path else key
            before = len(gone)
            put, todo = keep(value, at)
            if isinstance(source, dict):
                into[key] = put
            elif len(gone) == before:
                into.append(put)
            if todo is not None:
                stack.append((put, todo, at))
    return root, sorted(gone)


def clear_strings(rows: DataFrame, ident: str, document: str, is_sign: Callable[[str], bool]) -> DataFrame:
    """(ident, document, nullified): each document of JSON text without its signs, and their sorted paths. Broken documents come back unchanged."""
    kind = rows.schema[ident].dataType

    def run(batches):
        for batch in batches:
            texts, paths = [], []
            for text in batch.column(document).to_pylist():
                try:
                    value, gone = cleared(json.loads(text), is_sign) if text is not None else (None, [])
                    texts.append(json.dumps(value, ensure_ascii=False, separators=(",", ":")) if text is not None else None)
                    paths.append(gone)
                except ValueError:
                    texts.append(text)
                    paths.append([])
            yield pa.RecordBatch.from_arrays([batch.column(ident), pa.array(texts, pa.string()), pa.array(paths, pa.list_(pa.string()))], names=[ident, document, "nullified"])

    return rows.select(ident, document).mapInArrow(run, f"`{ident}` {kind.simpleString()}, `{document}` string, nullified array<string>")
