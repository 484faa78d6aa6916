"""Reading order of boxes: lines by vertical overlap, words by x, as windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirework.functions import text as T


def bounds(points: Column) -> Column:
    """struct(x0, y0, x1, y1) of array<struct<x, y>>."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def reading_order(boxes: DataFrame) -> DataFrame:
    """`boxes` (page, ordinal, x0, y0, x1, y1, …) with line_no and place in line.

    Boxes come by centre; one opens a line when its centre lies below all bottoms so far. Those of earlier lines cannot
    reach beyond the last opening, so the running maximum over the page is the current line's.
    """
    centre = (F.col("y0") + F.col("y1")) / 2
    order = Window.partitionBy("page").orderBy("_c", "ordinal")
    lowest = F.max("y1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = boxes.withColumn("_c", centre).withColumn("_new", F.when(F.col("_c") <= lowest, 0).otherwise(1))
    lines = opened.withColumn("line_no", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    place = F.row_number().over(Window.partitionBy("page", "line_no").orderBy("x0", "_c", "ordinal")) - 1
    return lines.withColumn("place", place).drop("_c", "_new")


def line_texts(ordered: DataFrame) -> DataFrame:
    """(page, line_no, line) of ordered boxes with text; blank ones are dropped."""
    words = F.array_sort(F.collect_list(F.struct("place", "text")))
    return ordered.filter(F.trim("text") != "").groupBy("page", "line_no").agg(F.array_join(F.transform(words, lambda w: w["text"]), " ").alias("line"))


def line_words(ordered: DataFrame) -> DataFrame:
    """(page, line_no, word_no, word, conf): box texts split into words that inherit the box's score."""
    exploded = ordered.select("page", "line_no", "place", "score", F.posexplode(T.words(F.col("text"))).alias("k", "word"))
    number = F.row_number().over(Window.partitionBy("page", "line_no").orderBy("place", "k")) - 1
    return exploded.select("page", "line_no", number.alias("word_no"), "word", F.col("score").alias("conf"))


def grouped_lines(words: DataFrame, row: str) -> DataFrame:
    """(page, line_no, line, x0, y0, x1, y1) of words (page, row, text, x0, …): rows by mean centre, words by x."""
    in_row = F.array_sort(F.collect_list(F.struct("x0", "ordinal", "text")))
    box = [f("%s" % c).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))]
    lines = words.groupBy("page", row).agg(F.array_join(F.transform(in_row, lambda w: w["text"]), " ").alias("line"), F.avg((F.col("y0") + F.col("y1")) / 2).alias("_c"), *box)
    number = F.row_number().over(Window.partitionBy("page").orderBy("_c", row)) - 1
    return lines.withColumn("line_no", number).drop("_c", row)
