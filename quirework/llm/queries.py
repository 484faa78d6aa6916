"""The registered queries of this subpackage: each applies one operator with production parameters to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quirework.llm import q_chat, q_dedup, q_licenses, q_lm, q_mixing, q_pieces, q_quality, q_sharding, q_topk, q_warc

MODULES = (q_chat, q_quality, q_licenses, q_sharding, q_topk, q_mixing, q_dedup, q_warc, q_lm, q_pieces)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
