"""Queries of the text operators and the SQL that they are compared with."""

from __future__ import annotations

import corpus_pipeline
from tabularium.llm import bpe, clustering, exact_dedup, hpylm, jaccard_join, license_scan, merkle, mixing, quality_rules, sharding, simhash, toxicity, warc


def queries() -> dict:
    return {
        "op1_quality_rules": quality_rules.op1_quality_rules,
        "op2_license_scan": license_scan.op2_license_scan,
        "op3_lm_scores": hpylm.op3_lm_scores,
        "op4_exact_dedup": exact_dedup.op4_exact_dedup,
        "op5_sharding": sharding.op5_sharding,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_warc": warc.op7_warc,
        "op8_bpe": bpe.op8_bpe,
        "op9_jaccard_join": jaccard_join.op9_jaccard_join,
        "op10_mixing": mixing.op10_mixing,
        "op11_merkle_manifest": merkle.op11_merkle_manifest,
        "op12_centroid_clustering": clustering.op12_centroid_clustering,
        "op13_simhash": simhash.op13_simhash,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    """Models, the tokenizer, label propagation and fingerprints have none: the tests hold these against brute force."""
    return {
        "op1_quality_rules": quality_rules.SQL,
        "op2_license_scan": license_scan.SQL,
        "op4_exact_dedup": exact_dedup.SQL,
        "op7_warc": warc.SQL,
        "op9_jaccard_join": jaccard_join.SQL,
        "op10_mixing": mixing.SQL,
        "op11_merkle_manifest": merkle.SQL,
        "op12_centroid_clustering": clustering.SQL,
    }
