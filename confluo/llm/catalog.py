"""Queries of the training-data operators, and their SQL where SQL can express them."""

from . import chat_format, decontamination, exact_dedup, filter_audit, language_id, line_dedup, near_dedup, pii, sentencepiece_codec, suffix_dedup, token_counts, toxicity, vector_codes

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_near_dedup": near_dedup.op3_near_dedup,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_language_id": language_id.op5_language_id,
    "op6_pii": pii.op6_pii,
    "op7_decontamination": decontamination.op7_decontamination,
    "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
    "op9_token_counts": token_counts.op9_token_counts,
    "op10_sentencepiece": sentencepiece_codec.op10_sentencepiece,
    "op11_vector_codes": vector_codes.op11_vector_codes,
    "op12_chat_format": chat_format.op12_chat_format,
    "op13_filter_audit": filter_audit.op13_filter_audit,
}
ORACLE_SQL = {"op1_exact_dedup": exact_dedup.OP1_SQL, "op11_vector_codes": vector_codes.OP11_SQL, "op12_chat_format": chat_format.OP12_SQL, "op13_filter_audit": filter_audit.OP13_SQL}
