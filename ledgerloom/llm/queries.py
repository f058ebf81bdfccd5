"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, fill_in_middle, merkle, minhash, mixing, ngram_join, quality_classifier, quality_rules, secrets, sharding, suffix_dedup, token_counts, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": sharding.query,
    "op2_suffix_dedup": suffix_dedup.query,
    "op3_mixing": mixing.query,
    "op4_ngram_join": ngram_join.query,
    "op5_decontamination": decontamination.query,
    "op6_toxicity": toxicity.query,
    "op7_quality_classifier": quality_classifier.query,
    "op8_secrets": secrets.query,
    "op9_token_counts": token_counts.query,
    "op10_quality_rules": quality_rules.query,
    "op11_merkle_manifest": merkle.query,
    "op12_minhash": minhash.query,
    "op13_fill_in_middle": fill_in_middle.query,
}

ORACLE_SQL: dict[str, str] = {"op4_ngram_join": ngram_join.ORACLE_SQL, "op11_merkle_manifest": merkle.ORACLE_SQL, "op12_minhash": minhash.ORACLE_SQL, "op13_fill_in_middle": fill_in_middle.ORACLE_SQL}
