"""Deterministic assistant: scoring of answers against scenarios."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

CHECK_SHARE, TERM_SHARE = 0.75, 0.25


def scenario_score(answer: Column, terms: list[str], checks: list[Column]) -> Column:
    """0.75 of the passed checks' share and 0.25 of the expected terms' share."""
    passed = reduce(lambda a, b: a + b, [c.cast("double") for c in checks]) / len(checks)
    lowered = F.lower(answer)
    found = reduce(lambda a, b: a + b, [lowered.contains(t.lower()).cast("double") for t in terms]) / len(terms)
    return CHECK_SHARE * passed + TERM_SHARE * found


def invented_ids(answer: Column, known: Column, pattern: str = r"(candidate_[0-9a-f]{12})") -> Column:
    """Ids in an answer that aren't known."""
    return F.array_except(F.regexp_extract_all(answer, F.lit(pattern), F.lit(1)), known)
