"""Queries of the subpackage and their SQL."""

from __future__ import annotations

from tavola.llm import (adaptive_scan, disclosure, importance_draw, line_spread, parity_join, piece_viterbi, source_mix,
                        token_counts, token_files, turn_repair, va_search, weak_toxicity, zip_archives)

QUERIES = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_token_files": token_files.op2_token_files,
    "op3_exact_search": va_search.op3_exact_search,
    "op4_disclosure": disclosure.op4_disclosure,
    "op5_adaptive_scan": adaptive_scan.op5_adaptive_scan,
    "op6_line_spread": line_spread.op6_line_spread,
    "op7_piece_codec": piece_viterbi.op7_piece_codec,
    "op8_parity_join": parity_join.op8_parity_join,
    "op9_source_mix": source_mix.op9_source_mix,
    "op10_weak_toxicity": weak_toxicity.op10_weak_toxicity,
    "op11_zip_archives": zip_archives.op11_zip_archives,
    "op12_turn_repair": turn_repair.op12_turn_repair,
    "op13_importance_draw": importance_draw.op13_importance_draw,
}
SQL: dict[str, str] = {
    "op3_exact_search": va_search.OP3_SQL,
    "op6_line_spread": line_spread.OP6_SQL,
    "op8_parity_join": parity_join.OP8_SQL,
    "op9_source_mix": source_mix.OP9_SQL,
    "op11_zip_archives": zip_archives.OP11_SQL,
}
