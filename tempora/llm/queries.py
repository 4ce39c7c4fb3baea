"""The queries of this subpackage and the SQL that gives the same rows, for the driver."""

from __future__ import annotations

from . import audit, chat, exact_dedup, html, language, mixing, near_dedup, packing, phrases, slack, substring_dedup, tokens, vectors

QUERIES = {
    "op1_chat_rotation": chat.op1_chat_rotation,
    "op2_setsketch_dedup": near_dedup.op2_setsketch_dedup,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_near_vectors": vectors.op4_near_vectors,
    "op5_main_text": html.op5_main_text,
    "op6_token_counts": tokens.op6_token_counts,
    "op7_best_fit_packing": packing.op7_best_fit_packing,
    "op10_repeated_passages": substring_dedup.op10_repeated_passages,
    "op8_temperature_mix": mixing.op8_temperature_mix,
    "op9_language_id": language.op9_language_id,
    "op11_minimum_slack": slack.op11_minimum_slack,
    "op12_phrases": phrases.op12_phrases,
    "op13_filter_audit": audit.op13_filter_audit,
}
ORACLE = {
    "op1_chat_rotation": chat.OP1_SQL,
    "op2_setsketch_dedup": near_dedup.OP2_SQL,
    "op3_exact_dedup": exact_dedup.OP3_SQL,
    "op4_near_vectors": vectors.OP4_SQL,
    "op8_temperature_mix": mixing.OP8_SQL,
    "op12_phrases": phrases.OP12_SQL,
    "op13_filter_audit": audit.OP13_SQL,
}
