"""Queries opN_ of this subpackage and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from sparkronym.llm import bpe, divergence, embeddings, exact_dedup, jaccard, lines, lm, manifest, mixing, sharding, substrings, toxicity, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_ngram_jaccard": jaccard.op2_ngram_jaccard,
    "op3_embedding_dedup": embeddings.op3_embedding_dedup,
    "op4_substring_dedup": substrings.op4_substring_dedup,
    "op5_line_dedup": lines.op5_line_dedup,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_byte_bpe": bpe.op7_byte_bpe,
    "op8_sharding": sharding.op8_sharding,
    "op9_mixing": mixing.op9_mixing,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_lm_scoring": lm.op11_lm_scoring,
    "op12_merkle_manifest": manifest.op12_merkle_manifest,
    "op13_source_divergence": divergence.op13_source_divergence,
}

ORACLE = {
    "op1_warc": warc.ORACLE,
    "op3_embedding_dedup": embeddings.ORACLE,
    "op2_ngram_jaccard": jaccard.ORACLE,
    "op4_substring_dedup": substrings.ORACLE,
    "op10_exact_dedup": exact_dedup.ORACLE,
    "op12_merkle_manifest": manifest.ORACLE,
    "op13_source_divergence": divergence.ORACLE,
}
