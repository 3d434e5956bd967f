"""The registered queries of the corpus operators and their DuckDB SQL."""

from __future__ import annotations

from textdrift.plans.registry import spark_round

from . import (exact_dedup, language_id, merkle, mixing, ngram_trie, nn_descent, packing, rule_forest, secrets,
               simhash_golay, substring_dedup, toxicity, whitening)

QUERIES = {
    "op1_language_id": language_id.op1,
    "op2_source_mix": mixing.op2,
    "op3_pattern_packing": packing.op3,
    "op4_ngram_trie": ngram_trie.op4,
    "op5_toxicity_svm": toxicity.op5,
    "op6_digest_index": exact_dedup.op6,
    "op7_nn_descent": nn_descent.op7,
    "op8_secret_scan": secrets.op8,
    "op9_simhash_golay": simhash_golay.op9,
    "op10_substring_dedup": substring_dedup.op10,
    "op11_rule_forest": rule_forest.op11,
    "op12_octopus_manifest": merkle.op12,
    "op13_bit_sliced_whitening": whitening.op13,
}

ORACLES = {
    "op2_source_mix": spark_round(mixing.OP2_SQL),
    "op6_digest_index": exact_dedup.OP6_SQL,
    "op10_substring_dedup": substring_dedup.OP10_SQL,
    "op12_octopus_manifest": merkle.OP12_SQL,
}
