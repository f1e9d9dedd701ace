"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from lodeworks.llm import attention_lm, decontaminate, language_id, line_dedup, nbest, near_dup, orc_tokens, periodic_runs, quality_rules, secret_scan, suffix_dedup, token_alignment, url_filter

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_secret_scan": secret_scan.op3_secret_scan,
    "op4_simhash": near_dup.op4_simhash,
    "op5_quality_rules": quality_rules.op5_quality_rules,
    "op6_suffix_dedup": suffix_dedup.op6_suffix_dedup,
    "op7_attention_lm": attention_lm.op7_attention_lm,
    "op8_orc_tokens": orc_tokens.op8_orc_tokens,
    "op9_nbest_segmentation": nbest.op9_nbest_segmentation,
    "op10_language_id": language_id.op10_language_id,
    "op11_periodic_runs": periodic_runs.op11_periodic_runs,
    "op12_line_dedup": line_dedup.op12_line_dedup,
    "op13_token_alignment": token_alignment.op13_token_alignment,
}

ORACLES = {
    "op1_url_filter": url_filter.OP1_SQL,
    "op2_decontaminate": decontaminate.OP2_SQL,
    "op3_secret_scan": secret_scan.OP3_SQL,
    "op5_quality_rules": quality_rules.OP5_SQL,
    "op12_line_dedup": line_dedup.OP12_SQL,
}
