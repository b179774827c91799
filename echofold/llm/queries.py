"""Queries of this subpackage and their SQL, for the entry module."""

from __future__ import annotations

from . import forest, linededup, mixing, packing, search, sharding, simhash, suffix, tokens, toxicity

QUERIES = {
    "op1_best_fit_packing": packing.query,
    "op2_top_k_search": search.query,
    "op3_simhash_near_dedup": simhash.query,
    "op4_embedding_near_dedup": forest.query,
    "op5_mixing": mixing.query,
    "op6_token_counts": tokens.query,
    "op7_sharding": sharding.query,
    "op8_toxicity": toxicity.query,
    "op9_suffix_array_dedup": suffix.query,
    "op10_line_dedup": linededup.query,
}

SQL = {
    "op2_top_k_search": search.SQL,
    "op3_simhash_near_dedup": simhash.sql(),
    "op4_embedding_near_dedup": forest.SQL,
    "op5_mixing": mixing.SQL,
    "op7_sharding": sharding.sql(),
    "op9_suffix_array_dedup": suffix.SQL,
    "op10_line_dedup": linededup.SQL,
}
