"""The opN queries and their SQL."""

from __future__ import annotations

from quarrymill.llm import bradley_terry, decontamination, exact_dedup, gru_lm, license_scan, line_blocks, line_dedup, ngram_join, raking, rank_profiles


def queries() -> dict:
    return {
        "op1_decontamination": decontamination.op1_decontamination,
        "op2_quality_classifier": bradley_terry.op2_quality_classifier,
        "op3_html_extraction": line_blocks.op3_html_extraction,
        "op4_mix_to_targets": raking.op4_mix_to_targets,
        "op5_license_scan": license_scan.op5_license_scan,
        "op6_language_id": rank_profiles.op6_language_id,
        "op7_gru_lm": gru_lm.op7_gru_lm,
        "op8_line_dedup": line_dedup.op8_line_dedup,
        "op9_exact_dedup": exact_dedup.op9_exact_dedup,
        "op10_ngram_join": ngram_join.op10_ngram_join,
    }


def oracle_sql() -> dict:
    return {"op8_line_dedup": line_dedup.ORACLE_SQL, "op9_exact_dedup": exact_dedup.ORACLE_SQL, "op10_ngram_join": ngram_join.ORACLE_SQL}
