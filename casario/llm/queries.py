"""Driver queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import additive_ann, byte_bpe, conversation_repair, decontamination, hard_negatives, jaccard_join, license_scan, line_dedup, ngram_lm, packing, quality_classifier, quality_rules, token_output

QUERIES = {
    "op1_ngram_lm": ngram_lm.op1_ngram_lm,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_token_output": token_output.op3_token_output,
    "op4_byte_bpe": byte_bpe.op4_byte_bpe,
    "op5_jaccard_join": jaccard_join.op5_jaccard_join,
    "op6_license_scan": license_scan.op6_license_scan,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_additive_ann": additive_ann.op8_additive_ann,
    "op9_best_fit_packing": packing.op9_best_fit_packing,
    "op10_quality_classifier": quality_classifier.op10_quality_classifier,
    "op11_benchmark_decontamination": decontamination.op11_benchmark_decontamination,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_conversation_repair": conversation_repair.op13_conversation_repair,
}

SQL = {
    "op2_quality_rules": quality_rules.SQL,
    "op5_jaccard_join": jaccard_join.SQL,
    "op7_line_dedup": line_dedup.SQL,
    "op11_benchmark_decontamination": decontamination.SQL,
    "op12_hard_negatives": hard_negatives.SQL,
    "op13_conversation_repair": conversation_repair.SQL,
}
