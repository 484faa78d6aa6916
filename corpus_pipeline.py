"""Documents through quality rules, near-duplicate removal, mixing to target weights and token ids.

Decisions are made by operators on narrow rows and meet the documents again by two 64-bit hashes of what the decision
depends on, the doc_id included. Rows equal in these get equal decisions, so null and repeated doc_ids need no special care:
two texts under one doc_id are two documents.

Each stage takes a table that was written before, so that two readings of it give the same rows in the same order; `run`
writes what a stage keeps to the shared folder and reads it again for the next.

Defined results: documents without text fail the quality rules; the near-duplicate stage would keep them all, and of rows
that are equal in doc_id, text, lang, source and n_chars one; extra columns go through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.llm.dedup import grouped
from quirework.llm.mixing import mix
from quirework.llm.pieces import encode_digests
from quirework.llm.quality import judge
from quirework.llm.shared import stored

NEAR_PERCENT = 80
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _free(docs: DataFrame, *names: str) -> list[str]:
    """The names with as many underscores before them as none of the documents' columns has."""
    taken = {c.lower() for c in docs.columns}
    prefix = "_"
    while any(prefix + n in taken for n in names):
        prefix += "_"
    return [prefix + n for n in names]


def _keyed(docs: DataFrame, *columns: str) -> tuple[DataFrame, list[str]]:
    """The documents with two hashes of the columns, and the names of these."""
    a, b = _free(docs, "key_a", "key_b")
    held = [F.col(c) for c in columns if c in docs.columns]
    return docs.withColumns({a: F.xxhash64(*held), b: F.xxhash64(F.lit("b"), *reversed(held))}), [a, b]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    keyed, keys = _keyed(docs, "doc_id", "text", "lang")
    kept = judge(keyed, carry=tuple(keys)).filter("kept").select(keys)
    return keyed.join(kept, keys, "left_semi").select(*docs.columns)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest doc_id, null last, ties by hash."""
    keyed, keys = _keyed(docs, *COLUMNS)
    rows = grouped(keyed, percent=NEAR_PERCENT, stable=True, carry=tuple(keys)).filter("group is not null")
    first = rows.groupBy("group").agg(F.min(F.struct(F.isnull("doc_id").alias("unnamed"), "doc_id", *keys)).alias("first"))
    with_words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    kept = keyed.filter(with_words).join(first.select(*(F.col(f"first.{k}").alias(k) for k in keys)), keys, "left_semi").dropDuplicates(keys)
    return kept.unionByName(keyed.filter(~with_words)).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    keyed, keys = _keyed(docs, "doc_id", "text", "source")
    copies, copy = _free(docs, "copies", "copy")
    taken = mix(keyed, carry=tuple(keys)).filter("copies > 0").groupBy(*keys).agg(F.max("copies").alias(copies))
    return keyed.join(taken, keys).withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of each document's token ids, and the digest of what they decode to."""
    return encode_digests(docs)


STAGES = [("quality", quality), ("near-dedup", dedup), ("mixing", mixing), ("encoding", encoding)]
#: The last stage encodes in a way that SQL doesn't express; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
