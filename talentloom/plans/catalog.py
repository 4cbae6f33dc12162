"""All queries of the engine and their SQL oracles."""

from __future__ import annotations

from talentloom.plans import analysis, copilot, corpora, documents, entities, explained, extras, graphs, identities, layouts, more, nested, ranking, scores, stages, summaries, textual, transfers  # noqa: F401
from talentloom.plans.registry import ORACLES, QUERIES  # noqa: F401

#: Earlier names of queries that read whole tables and texts under their plain names too.
for _name in ("vec_topk_exact", "vec_search_width", "flagship_ranking", "vec_label_precision", "ordered_distinct", "char_error_rate"):
    QUERIES[_name + "_whole"], ORACLES[_name + "_whole"] = QUERIES[_name], ORACLES[_name]
