"""The registered queries of the training-data operators, and DuckDB SQL where it can express them."""

from __future__ import annotations

from . import alignment, exact_dedup, jaccard_join, language_id, neighbours, packing, quality_rules, sentence_pieces, sharding, suffix_dedup, token_counts, url_filters

QUERIES = {
    f.__name__: f
    for f in (
        quality_rules.op1_quality_rules,
        sharding.op2_sharding,
        suffix_dedup.op3_suffix_dedup,
        url_filters.op4_url_filters,
        packing.op5_packing,
        jaccard_join.op6_jaccard_join,
        token_counts.op7_token_counts,
        exact_dedup.op8_exact_dedup,
        sentence_pieces.op9_sentence_pieces,
        language_id.op10_language_id,
        neighbours.op11_neighbours,
        alignment.op12_token_alignment,
    )
}
ORACLE_SQL = {"op1_quality_rules": quality_rules.SQL, "op2_sharding": sharding.SQL, "op8_exact_dedup": exact_dedup.SQL}
