"""The queries of this subpackage and their SQL; a missing module is an error here."""

from __future__ import annotations

from jotspark.llm import decontamination, jaccard_join, language_id, licences, line_dedup, mixing, pii, token_counts, top_k, toxicity

QUERIES = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_language_id": language_id.op2_language_id,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_top_k": top_k.op4_top_k,
    "op5_mixing": mixing.op5_mixing,
    "op6_decontamination": decontamination.op6_decontamination,
    "op7_license_scan": licences.op7_license_scan,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_pii": pii.op9_pii,
    "op10_jaccard_join": jaccard_join.op10_jaccard_join,
}
ORACLE: dict[str, str] = {"op4_top_k": top_k.ORACLE, "op5_mixing": mixing.ORACLE, "op7_license_scan": licences.ORACLE, "op8_line_dedup": line_dedup.ORACLE}
