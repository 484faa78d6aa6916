"""Query 10: all documents as token ids and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quirework.llm.pieces import encode_digests
from quirework.llm.shared import table


def op10_agenda(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"))


QUERIES = {"op10_agenda": op10_agenda}
#: Merging has no SQL form; tests hold the query against the library.
ORACLE_SQL: dict[str, str] = {}
