"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: module and query function
_QUERIES = {
    "op1_substring_dedup": "op01_substring",
    "op2_quality_classifier": "op02_quality",
    "op3_minhash_near_dedup": "op03_minhash",
    "op4_kdtree_shards": "op04_kdtree",
    "op5_sampled_pieces": "op05_pieces",
    "op6_exact_dedup": "op06_exact",
    "op7_chat_template": "op07_chat",
    "op8_token_shards": "op08_tokens",
    "op9_warc_segments": "op09_warc",
    "op10_benchmark_containment": "op10_contamination",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(import_module(f"rankloom.llm.{module}"), name) for name, module in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"rankloom.llm.{module}"), "ORACLE", None) for name, module in _QUERIES.items()}
    return {name: sql for name, sql in found.items() if sql}
