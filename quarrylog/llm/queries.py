"""The queries of this subpackage and their DuckDB SQL, by the names the driver calls."""

from __future__ import annotations

from . import embedding_dedup, exact_dedup, html_extract, language_id, line_dedup, lm_scoring, mixing, ngram_join, packing, passage_dedup

QUERIES = {
    "op1_ngram_jaccard_join": ngram_join.op1_ngram_jaccard_join,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_substring_dedup": passage_dedup.op3_substring_dedup,
    "op4_mix_sources": mixing.op4_mix_sources,
    "op5_language_id": language_id.op5_language_id,
    "op6_embedding_near_dedup": embedding_dedup.op6_embedding_near_dedup,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_pack_sequences": packing.op8_pack_sequences,
    "op9_lm_scoring": lm_scoring.op9_lm_scoring,
    "op10_html_extraction": html_extract.op10_html_extraction,
}

ORACLES = {
    "op2_exact_dedup": exact_dedup.ORACLE_SQL,
    "op4_mix_sources": mixing.ORACLE_SQL,
    "op7_line_dedup": line_dedup.ORACLE_SQL,
}
