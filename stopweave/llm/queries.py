"""The registered queries of the training-data operators, each over its whole table, and their DuckDB twins."""

from __future__ import annotations

from stopweave.llm import bpe, chat, exact, licenses, merkle, minhash, packing, quality, resampling, sharding, substring, toxicity, warc

QUERIES = {
    "op1_byte_bpe": bpe.query,
    "op2_packing": packing.query,
    "op3_license_scan": licenses.query,
    "op4_exact_dedup": exact.query,
    "op5_toxicity": toxicity.query,
    "op6_substring": substring.query,
    "op7_quality_rules": quality.query,
    "op7_quality_rules_any_host": quality.query,
    "op8_warc": warc.query,
    "op9_minhash": minhash.query,
    "op10_chat_format": chat.query,
    "op11_sharding": sharding.query,
    "op12_merkle_manifest": merkle.query,
    "op13_resampling": resampling.query,
}

ORACLES = {
    "op4_exact_dedup": exact.SQL,
    "op6_substring": substring.SQL,
    "op7_quality_rules": quality.SQL,
    "op7_quality_rules_any_host": quality.SQL,
    "op8_warc": warc.SQL,
    "op9_minhash": minhash.SQL,
    "op10_chat_format": chat.SQL,
    "op11_sharding": sharding.SQL,
    "op12_merkle_manifest": merkle.SQL,
    "op13_resampling": resampling.SQL,
}
