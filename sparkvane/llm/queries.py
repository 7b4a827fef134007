"""The queries of the corpus operators, by name, and DuckDB SQL where SQL can express one."""

from __future__ import annotations

from . import decontaminate, embedding_dedup, language_id, license_scan, line_dedup, minhash_dedup, packing, quality, token_counts, toxicity

QUERIES = {
    "op1_embedding_dedup": embedding_dedup.query,
    "op2_quality": quality.query,
    "op3_toxicity": toxicity.query,
    "op4_token_counts": token_counts.query,
    "op5_language_id": language_id.query,
    "op6_line_dedup": line_dedup.query,
    "op7_minhash_dedup": minhash_dedup.query,
    "op8_license_scan": license_scan.query,
    "op9_decontaminate": decontaminate.query,
    "op10_packing": packing.query,
}

SQL = {
    "op1_embedding_dedup": embedding_dedup.SQL,
    "op6_line_dedup": line_dedup.SQL,
    "op7_minhash_dedup": minhash_dedup.SQL,
    "op8_license_scan": license_scan.SQL,
    "op9_decontaminate": decontaminate.SQL,
}
