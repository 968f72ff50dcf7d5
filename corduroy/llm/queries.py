"""The training-data queries by name, and their SQL twins where SQL can express them."""

from __future__ import annotations

from . import decontaminate, divergence, filters, language, mixing, near, passages, pieces, pii, quality, tokens, topk, warc

ORACLE: dict[str, str] = {
    "op6_topk": topk.ORACLE,
    "op11_mix_sources": mixing.ORACLE,
    "op12_filter_audit": filters.ORACLE,
    "op13_source_divergence": divergence.ORACLE,
}


def queries() -> dict:
    return {
        "op1_decontaminate": decontaminate.op1_decontaminate,
        "op2_pii": pii.op2_pii,
        "op3_warc": warc.op3_warc,
        "op4_substring_dedup": passages.op4_substring_dedup,
        "op5_near_duplicates": near.op5_near_duplicates,
        "op6_topk": topk.op6_topk,
        "op7_language_id": language.op7_language_id,
        "op8_quality": quality.op8_quality,
        "op9_token_binary": tokens.op9_token_binary,
        "op10_sentencepiece": pieces.op10_sentencepiece,
        "op11_mix_sources": mixing.op11_mix_sources,
        "op12_filter_audit": filters.op12_filter_audit,
        "op13_source_divergence": divergence.op13_source_divergence,
    }


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
