"""Queries of the operators, opN_<name>, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from heronlake.llm import best_fit_packing, chat_format, hard_negatives, language_id, line_dedup, media_copies, piece_codec, quality_classifier, quality_rules, simhash_neardup, spelling_variants, token_files, url_filters

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_language_id": language_id.op2_language_id,
    "op3_simhash_neardup": simhash_neardup.op3_simhash_neardup,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_best_fit_packing": best_fit_packing.op5_best_fit_packing,
    "op6_url_filters": url_filters.op6_url_filters,
    "op7_media_copies": media_copies.op7_media_copies,
    "op8_quality_classifier": quality_classifier.op8_quality_classifier,
    "op9_piece_codec": piece_codec.op9_piece_codec,
    "op10_chat_format": chat_format.op10_chat_format,
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_spelling_variants": spelling_variants.op12_spelling_variants,
    "op13_token_files": token_files.op13_token_files,
}
ORACLES: dict[str, str] = {
    "op4_line_dedup": line_dedup.OP4_SQL,
    "op6_url_filters": url_filters.OP6_SQL,
    "op1_quality_rules": quality_rules.OP1_SQL,
}
