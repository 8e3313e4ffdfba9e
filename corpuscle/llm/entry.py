"""Queries of the pipeline operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpuscle.llm import ann, bpe, decontaminate, fm_index, lexical, minhash, packing, quality, resampling, secrets, sharding, suffix_dedup, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_additive_ann": ann.op1_additive_ann,
        "op2_secret_scan": secrets.op2_secret_scan,
        "op3_decontaminate": decontaminate.op3_decontaminate,
        "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
        "op5_shard_lookup": sharding.op5_shard_lookup,
        "op6_warc_index": warc.op6_warc_index,
        "op7_minhash_bayes": minhash.op7_minhash_bayes,
        "op8_fm_dedup": fm_index.op8_fm_dedup,
        "op9_quality_grade": quality.op9_quality_grade,
        "op10_bpe_tree": bpe.op10_bpe_tree,
        "op11_geometric_search": lexical.op11_geometric_search,
        "op12_binary_packing": packing.op12_binary_packing,
        "op13_importance_resample": resampling.op13_importance_resample,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_secret_scan": secrets.ORACLE,
        "op4_suffix_dedup": suffix_dedup.ORACLE,
        "op5_shard_lookup": sharding.ORACLE,
        "op6_warc_index": warc.ORACLE,
        "op7_minhash_bayes": minhash.ORACLE,
        "op8_fm_dedup": fm_index.ORACLE,
        "op11_geometric_search": lexical.ORACLE,
    }
