"""The training-data queries, and the SQL that checks those which SQL can express."""

from __future__ import annotations

from palimpsest.llm import conversations, divergence, idstore, mixing, packing, pii, quality, secrets, sharding, simhash, tokens, topk, toxicity

QUERIES = {
    "op1_bootstrapped_pii": pii.op1_bootstrapped_pii,
    "op2_guess_cost_secrets": secrets.op2_guess_cost_secrets,
    "op3_soft_mixing": mixing.op3_soft_mixing,
    "op4_anchor_simhash": simhash.op4_anchor_simhash,
    "op5_lexicon_toxicity": toxicity.op5_lexicon_toxicity,
    "op6_columnar_topk": topk.op6_columnar_topk,
    "op7_two_tier_token_counts": tokens.op7_two_tier_token_counts,
    "op8_cost_balanced_packing": packing.op8_cost_balanced_packing,
    "op9_kd_tree_shards": sharding.op9_kd_tree_shards,
    "op10_adaptive_quality": quality.op10_adaptive_quality,
    "op11_token_id_store": idstore.op11_token_id_store,
    "op12_systolic_divergence": divergence.op12_systolic_divergence,
    "op13_rank_repair": conversations.op13_rank_repair,
}
ORACLES: dict[str, str] = {"op6_columnar_topk": topk.ORACLE, "op12_systolic_divergence": divergence.ORACLE}
