"""Queries and SQL of this subpackage, for __spark_entry__."""

from __future__ import annotations

from . import decontaminate, interactions, language, linededup, lm, media, mixing, negatives, quotes, simhash, tokens, toxicity, vectors

QUERIES = {
    "op1_interleaved_media": media.op1_interleaved_media,
    "op2_quote_links": quotes.op2_quote_links,
    "op3_simhash": simhash.op3_simhash,
    "op4_lm_scores": lm.op4_lm_scores,
    "op5_language_id": language.op5_language_id,
    "op6_token_counts": tokens.op6_token_counts,
    "op7_mix_sources": mixing.op7_mix_sources,
    "op8_decontamination": decontaminate.op8_decontamination,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_line_dedup": linededup.op10_line_dedup,
    "op11_filter_interactions": interactions.op11_filter_interactions,
    "op12_near_vectors": vectors.op12_near_vectors,
    "op13_hard_negatives": negatives.op13_hard_negatives,
    "interleaved_pages": media.interleaved_pages,
}
SQL = {
    "op2_quote_links": quotes.OP2_SQL,
    "op7_mix_sources": mixing.OP7_SQL,
    "op10_line_dedup": linededup.OP10_SQL,
    "op11_filter_interactions": interactions.OP11_SQL,
    "op12_near_vectors": vectors.OP12_SQL,
    "op13_hard_negatives": negatives.OP13_SQL,
}
