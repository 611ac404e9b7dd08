"""Queries of the corpus operators and, where SQL can express them, their oracles."""

from __future__ import annotations

from voxelflow.llm import bpe, chat, decontaminate, lm, neardup, quality, sharding, topk, toxicity, warc

QUERIES = {
    "op1_attention_mil_quality": quality.op1_attention_mil_quality,
    "op2_hypergeometric_sharding": sharding.op2_hypergeometric_sharding,
    "op3_kd_tree_top_k": topk.op3_kd_tree_top_k,
    "op4_nnpu_toxicity": toxicity.op4_nnpu_toxicity,
    "op5_sharded_warc": warc.op5_sharded_warc,
    "op6_bottom_k_near_duplicates": neardup.op6_bottom_k_near_duplicates,
    "op7_token_level_chat": chat.op7_token_level_chat,
    "op8_recursive_bpe": bpe.op8_recursive_bpe,
    "op9_masked_pseudo_likelihood": lm.op9_masked_pseudo_likelihood,
    "op10_pigeonhole_decontamination": decontaminate.op10_pigeonhole_decontamination,
}

ORACLES: dict[str, str] = {
    "op3_kd_tree_top_k": topk.ORACLE,
    "op5_sharded_warc": warc.ORACLE,
    "op6_bottom_k_near_duplicates": neardup.ORACLE,
    "op7_token_level_chat": chat.ORACLE,
}
