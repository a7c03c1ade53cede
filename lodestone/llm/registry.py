"""The queries of this subpackage and, where SQL can say it, what they must return."""

from __future__ import annotations

from lodestone.llm import bpe, cap_filters, hard_negatives, jaccard, line_dedup, merkle, mixing, neighbours, paragraph_dedup, quality, substring_dedup, token_count, url_filter

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_bpe": bpe.op2_bpe,
    "op3_jaccard_join": jaccard.op3_jaccard_join,
    "op4_neighbours": neighbours.op4_neighbours,
    "op5_paragraph_dedup": paragraph_dedup.op5_paragraph_dedup,
    "op6_token_counts": token_count.op6_token_counts,
    "op7_suffix_dedup": substring_dedup.op7_suffix_dedup,
    "op8_url_filters": url_filter.op8_url_filters,
    "op9_quality_rules": quality.op9_quality_rules,
    "op10_line_dedup": line_dedup.op10_line_dedup,
    "op11_cap_filters": cap_filters.op11_cap_filters,
    "op12_merkle": merkle.op12_merkle,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
}

#: The mix is a seeded choice, the index and MinHash are approximate, the tokenizers are libraries, and
#: SQL over all 50-byte strings is too slow: tests hold these against brute force and against the libraries.
SQL = {
    "op3_jaccard_join": jaccard.OP3_SQL,
    "op8_url_filters": url_filter.OP8_SQL,
    "op9_quality_rules": quality.OP9_SQL,
    "op10_line_dedup": line_dedup.OP10_SQL,
    # Cap filters find all but one in ten thousand of the pairs that are just similar.
    "op11_cap_filters": cap_filters.OP11_SQL,
    "op12_merkle": merkle.OP12_SQL,
    "op13_hard_negatives": hard_negatives.OP13_SQL,
}
