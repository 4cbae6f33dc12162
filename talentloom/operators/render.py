"""Sections and renditions: logical sections with evidence, text, markdown, HTML, profile texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentloom.functions.text import escape_html


def box(left: Column, top: Column, right: Column, bottom: Column) -> Column:
    """A bounding box whose corners are in order."""
    return F.struct(F.least(left, right).alias("left"), F.least(top, bottom).alias("top"), F.greatest(left, right).alias("right"), F.greatest(top, bottom).alias("bottom"))


def sections(blocks: DataFrame, doc: str, section: str, pos: str, text: str) -> DataFrame:
    """One row per document and section that has text: ordered lines with their block indices as evidence."""
    rows = blocks.where(F.trim(F.coalesce(F.col(text), F.lit(""))) != "")
    line = F.struct(F.col(pos).alias("pos"), F.col(text).alias("text"))
    return rows.groupBy(doc, section).agg(F.sort_array(F.collect_list(line)).alias("lines"), F.min(pos).alias("first_pos"))


def renditions(sectioned: DataFrame, doc: str, section: str) -> DataFrame:
    """(doc, txt, md, html) of sections in the order of their first line."""
    body = F.struct(F.col("first_pos"), F.col(section).alias("title"), F.transform("lines", lambda x: x["text"]).alias("body"))
    d = sectioned.groupBy(doc).agg(F.sort_array(F.collect_list(body)).alias("s"))
    join = lambda f, sep: F.array_join(F.transform("s", f), sep)
    return d.select(
        doc,
        join(lambda s: F.concat_ws("\n", s["title"], F.array_join(s["body"], "\n")), "\n\n").alias("txt"),
        join(lambda s: F.concat(F.lit("## "), s["title"], F.lit("\n"), F.array_join(F.transform(s["body"], lambda x: F.concat(F.lit("- "), x)), "\n")), "\n\n").alias("md"),
        join(lambda s: F.concat(F.lit("<h2>"), escape_html(s["title"]), F.lit("</h2>"), F.array_join(F.transform(s["body"], lambda x: F.concat(F.lit("<p>"), escape_html(x), F.lit("</p>"))), "")), "").alias("html"),
    )


def joined_text(*parts: Column) -> Column:
    """Paragraphs of the parts that have text."""
    return F.concat_ws("\n\n", *[F.nullif(F.trim(p), F.lit("")) for p in parts])


def plain_markdown(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"(?m)^#+\s*|^[-*]\s+", ""), r"[*_`]", ""))
