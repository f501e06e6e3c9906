"""Queries of this subpackage, and SQL for those that SQL can express."""

from . import conversations, decontaminate, html_extract, katz, line_dedup, merkle, mixing, near_dedup, packing, substring_dedup, suffix_dedup, topk, toxicity

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_substring_dedup": substring_dedup.op2_substring_dedup,
    "op3_lm_scoring": katz.op3_lm_scoring,
    "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
    "op5_benchmark_decontamination": decontaminate.op5_benchmark_decontamination,
    "op6_minhash_near_dedup": near_dedup.op6_minhash_near_dedup,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_best_fit_packing": packing.op8_best_fit_packing,
    "op9_exact_topk": topk.op9_exact_topk,
    "op10_html_extraction": html_extract.op10_html_extraction,
    "op11_mixing": mixing.op11_mixing,
    "op12_merkle_manifest": merkle.op12_merkle_manifest,
    "op13_conversation_repair": conversations.op13_conversation_repair,
}
ORACLES = {"op1_line_dedup": line_dedup.SQL, "op2_substring_dedup": substring_dedup.SQL, "op4_suffix_dedup": suffix_dedup.SQL, "op6_minhash_near_dedup": near_dedup.SQL, "op5_benchmark_decontamination": decontaminate.SQL, "op9_exact_topk": topk.SQL, "op11_mixing": mixing.SQL, "op12_merkle_manifest": merkle.SQL, "op13_conversation_repair": conversations.SQL}
