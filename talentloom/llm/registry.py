"""Queries of the training-data operators and the SQL oracles of those that SQL can express."""

from __future__ import annotations

from talentloom.llm.bpe import op6_bpe
from talentloom.llm.chat import OP2_SQL, op2_chat
from talentloom.llm.collision_search import op13_collision_search
from talentloom.llm.decontaminate import op8_decontaminate
from talentloom.llm.fingerprints import op1_fingerprints
from talentloom.llm.hard_negatives import OP12_SQL, op12_hard_negatives
from talentloom.llm.langid import op3_langid
from talentloom.llm.lm_scoring import op9_lm_scoring
from talentloom.llm.prefix_trie import OP11_SQL, op11_prefix_trie
from talentloom.llm.sharding import op5_sharding
from talentloom.llm.simhash import op4_simhash
from talentloom.llm.substring_dedup import OP10_SQL, op10_substring_dedup
from talentloom.llm.warc import OP7_SQL, op7_warc

QUERIES = {
    "op1_fingerprints": op1_fingerprints,
    "op2_chat": op2_chat,
    "op3_langid": op3_langid,
    "op4_simhash": op4_simhash,
    "op5_sharding": op5_sharding,
    "op6_bpe": op6_bpe,
    "op7_warc": op7_warc,
    "op8_decontaminate": op8_decontaminate,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_collision_search": op13_collision_search,
}
ORACLES: dict[str, str] = {"op2_chat": OP2_SQL, "op7_warc": OP7_SQL, "op10_substring_dedup": OP10_SQL, "op11_prefix_trie": OP11_SQL, "op12_hard_negatives": OP12_SQL}
