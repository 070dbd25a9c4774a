"""The registered queries of this package and their SQL twins."""

from __future__ import annotations

from emberline.llm import alignment, bpe_automaton, decontam, lexical, packing, quality, secrets, sharding, similarity, token_store, toxicity, url_index, warc

QUERIES = {
    "op1_entropy_windows": secrets.op1_entropy_windows,
    "op2_string_tiling": decontam.op2_string_tiling,
    "op3_signature_trees": similarity.op3_signature_trees,
    "op4_bit_planes": token_store.op4_bit_planes,
    "op5_digest_array": url_index.op5_digest_array,
    "op6_multi_length_packing": packing.op6_multi_length_packing,
    "op7_noisy_channel": toxicity.op7_noisy_channel,
    "op8_sampled_splitters": sharding.op8_sampled_splitters,
    "op9_transactions": warc.op9_transactions,
    "op10_robust_outliers": quality.op10_robust_outliers,
    "op11_identity_map": alignment.op11_identity_map,
    "op12_token_automaton": bpe_automaton.op12_token_automaton,
    "op13_max_sketches": lexical.op13_max_sketches,
}
ORACLES: dict[str, str] = {"op5_digest_array": url_index.ORACLE, "op13_max_sketches": lexical.ORACLE}
