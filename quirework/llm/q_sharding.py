"""Query 4: all documents in eight shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quirework.llm.shared import table
from quirework.llm.sharding import shard


def op4_feistel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"), shards=8)


QUERIES = {"op4_feistel": op4_feistel}
#: crc32 has no SQL form in the oracle's dialect; tests hold the query against a brute-force version.
ORACLE_SQL: dict[str, str] = {}
