"""Query 8: all pages as WARC records, read back through the merged capture index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quirework.llm import warc
from quirework.llm.shared import scratch, table


def op8_loser_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path, min_bytes=0)
    return warc.merged(warc.read(spark, path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op8_loser_tree": op8_loser_tree}

ORACLE_SQL = {
    "op8_loser_tree": """
WITH hashed AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS hex, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages
), parts AS (
  SELECT *, list_transform(range(8), lambda g: CAST('0x' || substr(hex, g * 5 + 1, 5) AS INTEGER)) AS v FROM hashed
)
SELECT page_id, payload_bytes, array_to_string(list_transform(v, lambda x: array_to_string(list_transform([15, 10, 5, 0],
    lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((x >> CAST(s AS INTEGER)) & 31 AS INTEGER) + 1, 1)), '')), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM parts
"""
}
