"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from lexmill.llm import clustering, decontamination, hard_negatives, licenses, line_dedup, packing, sentence_pieces, sharding, simhash, token_counts, toxicity, url_filters, vector_search

QUERIES = {
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_url_filter": url_filters.op4_url_filter,
    "op10_vector_search": vector_search.op10_vector_search,
    "op9_licenses": licenses.op9_licenses,
    "op6_sharding": sharding.op6_sharding,
    "op8_simhash": simhash.op8_simhash,
    "op1_packing": packing.op1_packing,
    "op2_token_counts": token_counts.op2_token_counts,
    "op7_decontamination": decontamination.op7_decontamination,
    "op11_clustering": clustering.op11_clustering,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_sentencepiece": sentence_pieces.op13_sentencepiece,
}

ORACLES = {
    "op5_line_dedup": line_dedup.ORACLE,
    "op10_vector_search": vector_search.ORACLE,
    "op7_decontamination": decontamination.ORACLE,
    "op11_clustering": clustering.ORACLE,
    "op12_hard_negatives": hard_negatives.ORACLE,
}
