"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import bpe, exact_dedup, language_id, license_scan, lm_score, mixing, quality, simhash, suffix_dedup, topk


def queries() -> dict:
    found = {
        "op1_lm_score": lm_score.query,
        "op2_suffix_dedup": suffix_dedup.query,
        "op3_quality": quality.query,
        "op4_simhash_near_dedup": simhash.query,
        "op5_byte_bpe": bpe.query,
        "op6_mix_sources": mixing.query,
        "op7_language_id": language_id.query,
        "op8_exact_dedup": exact_dedup.query,
        "op9_exact_top_k": topk.query,
        "op10_license_scan": license_scan.query,
    }
    import corpus_pipeline

    return found | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op1_lm_score": lm_score.SQL, "op6_mix_sources": mixing.SQL, "op8_exact_dedup": exact_dedup.SQL, "op9_exact_top_k": topk.SQL, "op10_license_scan": license_scan.SQL}
