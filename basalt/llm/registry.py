"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from basalt.llm import chat, jaccard, langid, licenses, mixing, packing, quality, suffix_dedup, topk, toxicity


def queries() -> dict:
    return {
        "op1_chat_preferences": chat.op1_chat_preferences,
        "op2_top_k": topk.op2_top_k,
        "op3_license_digest": licenses.op3_license_digest,
        "op4_packing": packing.op4_packing,
        "op5_language_id": langid.op5_language_id,
        "op6_quality": quality.op6_quality,
        "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
        "op8_mixing": mixing.op8_mixing,
        "op9_jaccard_join": jaccard.op9_jaccard_join,
        "op10_toxicity": toxicity.op10_toxicity,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_chat_preferences": chat.ORACLE,
        "op2_top_k": topk.ORACLE,
        "op3_license_digest": licenses.oracle(),
        "op8_mixing": mixing.ORACLE,
    }
