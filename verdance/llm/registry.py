"""The queries of this folder and their SQL."""

from __future__ import annotations

import corpus_pipeline

from . import decontaminate, exact, lm, mixing, near, phrases, pii, quality, repair, rules, suffixes, tokens, webpages


def queries() -> dict:
    return {
        "pipeline": corpus_pipeline.run,
        "op1_mix_sources": mixing.op1_mix_sources,
        "op2_lm_scores": lm.op2_lm_scores,
        "op3_quality_classifier": quality.op3_quality_classifier,
        "op4_extract_html": webpages.op4_extract_html,
        "op5_decontaminate": decontaminate.op5_decontaminate,
        "op6_find_pii": pii.op6_find_pii,
        "op7_near_duplicates": near.op7_near_duplicates,
        "op8_quality_rules": rules.op8_quality_rules,
        "op9_token_counts": tokens.op9_token_counts,
        "op10_suffix_dedup": suffixes.op10_suffix_dedup,
        "op11_exact_dedup": exact.op11_exact_dedup,
        "op12_collocations": phrases.op12_collocations,
        "op13_repair_conversations": repair.op13_repair_conversations,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": mixing.ORACLE, "op11_exact_dedup": exact.ORACLE, "op12_collocations": phrases.ORACLE}
