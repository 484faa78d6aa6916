"""Threshold and configuration sweeps: small literal grids joined to scored rows, then means and an arg-min."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def grid(rows: DataFrame, name: str, values: list[float]) -> DataFrame:
    """Each row once for each value: an explode of a literal array, so no join."""
    return rows.withColumn(name, F.explode(F.array(*(F.lit(v) for v in values))))


def router(rows: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, cer, routed) of rows (conf, fast_cer, robust_cer): the robust reader takes what is below the threshold."""
    below = F.col("conf") < F.col("threshold")
    return grid(rows, "threshold", thresholds).groupBy("threshold").agg(F.avg(F.when(below, F.col("robust_cer")).otherwise(F.col("fast_cer"))).alias("cer"), F.avg(below.cast("double")).alias("routed"))


def cascade(rows: DataFrame, taus: list[float], cheap_cost: float, full_cost: float) -> DataFrame:
    """(tau, cer, cost) of rows (dataset, agreement, cheap_cer, full_cer), as means over data sets."""
    enough = F.col("agreement") >= F.col("tau")
    per_set = grid(rows, "tau", taus).groupBy("tau", "dataset").agg(F.avg(F.when(enough, F.col("cheap_cer")).otherwise(F.col("full_cer"))).alias("cer"), F.avg(F.when(enough, cheap_cost).otherwise(full_cost)).alias("cost"))
    return per_set.groupBy("tau").agg(F.avg("cer").alias("cer"), F.avg("cost").alias("cost"))


def best(rows: DataFrame, metric: str, order: str) -> DataFrame:
    """The row with the smallest metric; the smallest `order` wins ties. An aggregation, so nothing is sorted."""
    columns = [c for c in rows.columns if c not in (metric, order)]
    return rows.agg(F.min(F.struct(metric, order, *columns)).alias("b")).select("b.*")


def top(rows: DataFrame, metric: str, order: str, k: int) -> DataFrame:
    return rows.orderBy(metric, order).limit(k)


def subsets(names: list[str], sizes: range) -> list[tuple[str, ...]]:
    return [c for k in sizes for c in combinations(names, k)]


def shared_sources(readings: DataFrame, pages: DataFrame) -> DataFrame:
    """Sources that have read every page of (dataset, image)."""
    total = pages.select("dataset", "image").distinct().agg(F.count("*").alias("total"))
    seen = readings.groupBy("source").agg(F.count_distinct("dataset", "image").alias("n"))
    return seen.join(F.broadcast(total)).filter("n = total").select("source")


def strided(rows: DataFrame, order: list[str], partition: str, k: int) -> DataFrame:
    """Every (n // k)-th row of each partition, the first k of them: a sampling operator."""
    w = Window.partitionBy(partition)
    numbered = rows.withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_s", F.greatest(F.lit(1), F.floor(F.count("*").over(w) / k)))
    return numbered.filter((F.col("_i") % F.col("_s") == 0) & (F.col("_i") / F.col("_s") < k)).drop("_i", "_s")
