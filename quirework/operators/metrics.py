"""Scores of readings against references, and their reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.functions import text as T

#: The order of levels in reports.
LEVELS = ["clean", "medium", "hard", "real", "all"]


def score(pairs: DataFrame) -> DataFrame:
    """`pairs` (text, reading and optionally case_insensitive) with cer, wer and bow: projections of one row."""
    folded = F.col("case_insensitive") if "case_insensitive" in pairs.columns else F.lit(False)
    fold = lambda c: F.when(folded, F.upper(c)).otherwise(F.col(c))
    return pairs.withColumn("cer", T.cer(fold("text"), fold("reading"))).withColumn("wer", T.wer(fold("text"), fold("reading"))).withColumn("bow", T.bow_f1(fold("text"), fold("reading")))


def report(scored: DataFrame, metrics: list[str], group: str = "system", level: str = "level") -> DataFrame:
    """Means by (group, level) and over all levels, with n: one pass with two grouping sets."""
    sets = scored.groupingSets([[F.col(group), F.col(level)], [F.col(group)]], F.col(group), F.col(level))
    out = sets.agg(*(F.avg(m).alias(m) for m in metrics), F.count(F.lit(1)).alias("n"), F.grouping(level).alias("_all"))
    return out.withColumn(level, F.when(F.col("_all") == 1, "all").otherwise(F.col(level))).drop("_all")


def accuracy_table(summary: DataFrame, levels: list[str] = LEVELS) -> DataFrame:
    """One row a system, one column a level: max(0, 1 - cer)."""
    return summary.groupBy("system").pivot("level", levels).agg(F.first(F.greatest(F.lit(0.0), 1 - F.col("cer"))))


def to_markdown(summary: DataFrame, levels: list[str] = LEVELS) -> str:
    """The accuracy table as Markdown; a missing level is "-". A row for each system, so it is small."""
    rows = accuracy_table(summary, levels).orderBy("system").collect()
    show = lambda v: "-" if v is None else f"{100 * v:.2f}%"
    used = [x for x in levels if any(r[x] is not None for r in rows)]
    lines = ["| system | " + " | ".join(used) + " |", "| --- |" + " --- |" * len(used)]
    return "\n".join(lines + [f"| {r['system']} | " + " | ".join(show(r[x]) for x in used) + " |" for r in rows])


def macro(scored: DataFrame, metric: str, group: str, dataset: str = "dataset") -> DataFrame:
    """Mean over data sets of the mean in each, so a large set weighs no more than a small one."""
    return scored.groupBy(group, dataset).agg(F.avg(metric).alias(metric)).groupBy(group).agg(F.avg(metric).alias(metric))


def predictions(scored: DataFrame) -> DataFrame:
    return scored.select("image", F.col("text").alias("ref"), F.col("reading").alias("hyp"), F.round("cer", 4).alias("cer"))
