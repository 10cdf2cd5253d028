"""The queries of this package, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import jaccard_join, packing, piece_scan, quality_classifier, quality_rules, sharding, substring_dedup, token_output, topk_search, url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        token_output.op1_token_output,
        url_filter.op2_url_filter,
        substring_dedup.op3_substring_dedup,
        quality_classifier.op4_quality_classifier,
        quality_rules.op5_quality_rules,
        topk_search.op6_topk_search,
        jaccard_join.op7_jaccard_join,
        piece_scan.op8_piece_scan,
        sharding.op9_sharding,
        packing.op10_packing,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op6_topk_search": topk_search.OP6_SQL, "op9_sharding": sharding.OP9_SQL}
