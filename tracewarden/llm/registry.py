"""Queries of this subpackage and their SQL, for the entry module."""

from __future__ import annotations

from tracewarden.llm import bin_packing, cross_parse, interpolated_lm, jaccard_join, line_dedup, line_quality, piece_bpe, secret_scan, toxicity, vector_links

QUERIES = {
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op7_collision_counting": vector_links.op7_collision_counting,
    "op2_interpolated_lm": interpolated_lm.op2_interpolated_lm,
    "op4_jaccard_join": jaccard_join.op4_jaccard_join,
    "op1_randomness_battery": secret_scan.op1_randomness_battery,
    "op3_toxicity": toxicity.op3_toxicity,
    "op5_cross_parsing": cross_parse.op5_cross_parsing,
    "op8_best_fit_packing": bin_packing.op8_best_fit_packing,
    "op9_line_first_cleaning": line_quality.op9_line_first_cleaning,
    "op10_piece_bpe": piece_bpe.op10_piece_bpe,
}

ORACLES: dict[str, str] = {
    "op4_jaccard_join": jaccard_join.ORACLE,
    "op6_line_dedup": line_dedup.ORACLE,
    "op7_collision_counting": vector_links.ORACLE,
    "op9_line_first_cleaning": line_quality.ORACLE,
}
