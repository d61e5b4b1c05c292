"""Queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chunk_dedup, clustering, collocations, decontaminate, exact_dedup, jaccard, language, line_dedup, packing, suffix_dedup, topk, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": language.query,
        "op2_jaccard_join": jaccard.query,
        "op3_toxicity": toxicity.query,
        "op4_line_dedup": line_dedup.query,
        "op5_suffix_dedup": suffix_dedup.query,
        "op6_chunk_dedup": chunk_dedup.query,
        "op7_exact_dedup": exact_dedup.query,
        "op8_bpe": bpe.query,
        "op9_exact_top_k": topk.query,
        "op10_best_fit_packing": packing.query,
        "op11_decontamination": decontaminate.query,
        "op12_clustering": clustering.query,
        "op13_collocations": collocations.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op7_exact_dedup": exact_dedup.ORACLE,
        "op9_exact_top_k": topk.ORACLE,
        "op11_decontamination": decontaminate.ORACLE,
        "op12_clustering": clustering.ORACLE,
        "op13_collocations": collocations.ORACLE,
    }
