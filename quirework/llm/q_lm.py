"""Query 9: log10 probabilities of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quirework.llm.lm import score
from quirework.llm.shared import table


def op9_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), stable=True)


QUERIES = {"op9_automaton": op9_automaton}
#: The split by crc32 has no SQL form in the oracle's dialect; tests hold the query against a brute-force version.
ORACLE_SQL: dict[str, str] = {}
