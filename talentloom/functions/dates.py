"""Years, months and experience phrases as column expressions; the current year is a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PRESENT = ["present", "current", "ongoing"]


def year(x: Column) -> Column:
    return F.nullif(F.regexp_extract(x, r"((?:19|20)[0-9]{2})", 1), F.lit("")).cast("int")


def end_year(x: Column, as_of_year: int) -> Column:
    return F.when(F.lower(F.trim(x)).isin(PRESENT), as_of_year).otherwise(year(x))


def month_index(x: Column, is_end: bool, as_of_year: int) -> Column:
    """year * 12 + month of MM/YYYY, YYYY or a present word; null for anything else."""
    token = F.lower(F.trim(x))
    edge = 12 if is_end else 1
    month = F.regexp_extract(token, "^(0?[1-9]|1[0-2])[/-]([0-9]{4})$", 1)
    of = F.regexp_extract(token, "^(0?[1-9]|1[0-2])[/-]([0-9]{4})$", 2)
    return (
        F.when(token.isin(PRESENT), as_of_year * 12 + edge)
        .when(month != "", of.try_cast("int") * 12 + month.try_cast("int"))
        .when(token.rlike("^[0-9]{4}$"), token.try_cast("int") * 12 + edge)
    )


def experience_value(x: Column) -> Column:
    """Years in a phrase such as 5+, 3-5, 10 ans, 2020 - 2022; null for present words and no number."""
    text = F.lower(F.trim(x))
    a, b = F.regexp_extract(text, r"((?:19|20)[0-9]{2}) *[-/] *((?:19|20)[0-9]{2})", 1), F.regexp_extract(text, r"((?:19|20)[0-9]{2}) *[-/] *((?:19|20)[0-9]{2})", 2)
    bare = F.replace(F.replace(F.replace(F.replace(F.replace(text, F.lit("ans")), F.lit("years")), F.lit("year")), F.lit("yr")), F.lit(" "))
    low, high = F.regexp_extract(bare, r"^([0-9]+(?:\.[0-9]+)?)[-/]([0-9]+(?:\.[0-9]+)?)$", 1), F.regexp_extract(bare, r"^([0-9]+(?:\.[0-9]+)?)[-/]([0-9]+(?:\.[0-9]+)?)$", 2)
    single = F.regexp_extract(bare, r"([0-9]+(?:\.[0-9]+)?)", 1)
    return (
        F.when(text.isin([*PRESENT, ""]), None)
        .when(a != "", F.greatest(b.try_cast("int") - a.try_cast("int"), F.lit(0)).cast("double"))
        .when(low != "", F.round((low.try_cast("double") + high.try_cast("double")) / 2, 1))
        .when(single != "", single.try_cast("double"))
    )


def level_of_years(x: Column) -> Column:
    return F.when(x < 2, "junior").when(x <= 5, "mid_level").when(x > 5, "senior")


def years_bucket(x: Column) -> Column:
    return F.when(x.isNull(), "unknown").when(x < 1, "0-1").when(x < 3, "1-3").when(x < 5, "3-5").when(x < 8, "5-8").otherwise("8+")
