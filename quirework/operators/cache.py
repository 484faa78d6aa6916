"""The resumable cache of readings: what is missing, and appending it once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["image", "source"]


def missing_work(wanted: DataFrame, done: DataFrame) -> DataFrame:
    """Pairs (image, source) that have no reading yet."""
    return wanted.join(done.select(*KEY).distinct(), KEY, "left_anti")


def append(readings: DataFrame, path: str) -> None:
    """Adds readings to the cache, a folder for each source; Spark's commit protocol keeps a failed write out."""
    readings.write.mode("append").partitionBy("source").parquet(path)


def disjoint(rest: DataFrame, *reserved: DataFrame, key: str) -> DataFrame:
    """`rest` without the keys of any reserved set."""
    for taken in reserved:
        rest = rest.join(taken.select(key).distinct(), key, "left_anti")
    return rest


def split_by_hash(rows: DataFrame, key: str, seed: str, parts: dict[str, int]) -> DataFrame:
    """A `split` column: rows fall by a hash of key and seed into parts of the given percentages, the rest is train."""
    place = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"))), 1, 8), 16, 10).cast("long") % 100
    split, upto = F.lit("train"), sum(parts.values())
    for name, share in reversed(parts.items()):
        split = F.when(place < upto, name).otherwise(split)
        upto -= share
    return rows.withColumn("split", split)
