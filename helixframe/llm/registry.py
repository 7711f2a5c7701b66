"""Queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, decontamination, exact_dedup, jaccard_join, quality, secrets, sharding, substring_dedup, toxicity, urls

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_bpe": bpe.op2_bpe,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_substring_dedup": substring_dedup.op4_substring_dedup,
    "op5_secrets": secrets.op5_secrets,
    "op6_urls": urls.op6_urls,
    "op7_sharding": sharding.op7_sharding,
    "op8_quality": quality.op8_quality,
    "op9_decontamination": decontamination.op9_decontamination,
    "op10_jaccard_join": jaccard_join.op10_jaccard_join,
}

ORACLE_SQL = {
    "op3_exact_dedup": exact_dedup.ORACLE_SQL,
    "op6_urls": urls.ORACLE_SQL,
    "op9_decontamination": decontamination.ORACLE_SQL,
}
