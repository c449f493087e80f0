"""The operators' queries over the document tables, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioscope.llm import bpe, exact_dedup, fingerprints, importance, language_id, license_scan, lm_score, mixing, multi_index, near_dedup, prefix_trie, quality, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_lm_score": lm_score.op1,
        "op2_mixing": mixing.op2,
        "op3_ngram_jaccard": near_dedup.op3,
        "op4_toxicity": toxicity.op4,
        "op5_language_id": language_id.op5,
        "op6_exact_dedup": exact_dedup.op6,
        "op7_license_scan": license_scan.op7,
        "op8_bpe": bpe.op8,
        "op9_quality": quality.op9,
        "op10_fingerprints": fingerprints.op10,
        "op11_multi_index": multi_index.op11,
        "op12_importance": importance.op12,
        "op13_prefix_trie": prefix_trie.op13,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_exact_dedup": exact_dedup.SQL, "op11_multi_index": multi_index.SQL, "op13_prefix_trie": prefix_trie.SQL}
