"""Readings that arrive as files, appended to the cache once each: an extension, the batch cache has the same semantics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quirework.operators import cache
from quirework.sources.io import READINGS


def follow(spark: SparkSession, incoming: str, store: str, checkpoint: str) -> StreamingQuery:
    """Appends new Parquet readings in `incoming` to `store`; a replayed batch adds nothing twice."""

    def add(batch: DataFrame, number: int) -> None:
        fresh = batch.dropDuplicates(cache.KEY)
        try:
            done = spark.read.schema(READINGS).parquet(store)
            fresh = cache.missing_work(fresh, done)
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
        cache.append(fresh, store)

    return spark.readStream.schema(READINGS).parquet(incoming).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
