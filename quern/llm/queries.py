"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from quern.llm import blocks, decontam, jaccard, langid, mixing, rules, suffix, tokens, toxicity, weaklabels

QUERIES = {
    "op1_html_extraction": blocks.op1_html_extraction,
    "op2_token_counts": tokens.op2_token_counts,
    "op3_suffix_dedup": suffix.op3_suffix_dedup,
    "op4_jaccard_join": jaccard.op4_jaccard_join,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_quality_classifier": weaklabels.op6_quality_classifier,
    "op7_quality_rules": rules.op7_quality_rules,
    "op8_decontaminate": decontam.op8_decontaminate,
    "op9_mix_sources": mixing.op9_mix_sources,
    "op10_language_id": langid.op10_language_id,
}

SQL = {
    "op7_quality_rules": rules.OP7_SQL,
    "op8_decontaminate": decontam.OP8_SQL,
    "op9_mix_sources": mixing.OP9_SQL,
}
