"""The queries of this subpackage and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from faultline.llm import decontamination, jaccard_join, media_chunks, merkle, mixing, packing, personal_data, prefix_trie, preference_format, quality_rules, recurrent_lm, toxicity, wavelet

QUERIES = {f.__name__: f for f in (toxicity.op1_toxicity, preference_format.op2_preference_format, jaccard_join.op3_jaccard_join, packing.op4_packing, personal_data.op5_personal_data, wavelet.op6_wavelet, quality_rules.op7_quality_rules, mixing.op8_mixing, recurrent_lm.op9_recurrent_lm, media_chunks.op10_media_chunks, merkle.op11_merkle_manifest, decontamination.op12_benchmark_decontamination, prefix_trie.op13_prefix_trie)}
ORACLES = {"op2_preference_format": preference_format.OP2_SQL, "op3_jaccard_join": jaccard_join.OP3_SQL, "op7_quality_rules": quality_rules.OP7_SQL, "op11_merkle_manifest": merkle.OP11_SQL, "op12_benchmark_decontamination": decontamination.OP12_SQL, "op13_prefix_trie": prefix_trie.OP13_SQL}
