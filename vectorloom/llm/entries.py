"""The queries of this subpackage, and SQL where SQL can express them."""

from __future__ import annotations

from . import exact_dedup, learned_ann, mixing, near_dedup, packing, quality, substring_dedup, suffix_dedup, token_output, toxicity

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_mixing": mixing.op2_mixing,
    "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
    "op4_learned_ann": learned_ann.op4_learned_ann,
    "op5_near_dedup": near_dedup.op5_near_dedup,
    "op6_token_output": token_output.op6_token_output,
    "op7_quality": quality.op7_quality,
    "op8_packing": packing.op8_packing,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
}
SQL = {"op1_substring_dedup": substring_dedup.SQL, "op3_suffix_dedup": suffix_dedup.SQL, "op5_near_dedup": near_dedup.SQL, "op10_exact_dedup": exact_dedup.SQL}
