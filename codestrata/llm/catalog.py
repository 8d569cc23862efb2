"""The registered queries of this subpackage and their SQL twins, by name."""

from __future__ import annotations

from codestrata.llm import (
    op1_packing,
    op2_quality_rules,
    op3_sharding,
    op4_warc,
    op5_embeddings,
    op6_classifier,
    op7_mixing,
    op8_tokens,
    op9_substrings,
    op10_minhash,
    op11_divergence,
    op12_brown,
    op13_merkle,
)

QUERIES = {
    "op1_packing": op1_packing.op1_packing,
    "op2_quality_rules": op2_quality_rules.op2_quality_rules,
    "op3_sharding": op3_sharding.op3_sharding,
    "op4_warc": op4_warc.op4_warc,
    "op5_embeddings": op5_embeddings.op5_embeddings,
    "op6_classifier": op6_classifier.op6_classifier,
    "op7_mixing": op7_mixing.op7_mixing,
    "op8_tokens": op8_tokens.op8_tokens,
    "op9_substrings": op9_substrings.op9_substrings,
    "op10_minhash": op10_minhash.op10_minhash,
    "op11_divergence": op11_divergence.op11_divergence,
    "op12_brown": op12_brown.op12_brown,
    "op13_merkle": op13_merkle.op13_merkle,
}
ORACLES = {
    "op2_quality_rules": op2_quality_rules.SQL.strip(),
    "op4_warc": op4_warc.SQL.strip(),
    "op5_embeddings": op5_embeddings.SQL.strip(),
    "op7_mixing": op7_mixing.SQL.strip(),
    "op9_substrings": op9_substrings.SQL.strip(),
    "op10_minhash": op10_minhash.SQL.strip(),
    "op11_divergence": op11_divergence.SQL.strip(),
    "op13_merkle": op13_merkle.SQL.strip(),
}
