"""Mixing sources to target weights: certain whole copies, then Pareto order sampling of the fractional ones.

Targets: sources share all words by their weights; a target stops at `cap` times its source's words and the excess is
shared again by weight. The common level of the open sources is raised until no further source is capped: one small
aggregation over the table of sources a step.

Copies: a source with target T and S words takes each document floor(T / S) times for certain. The fractional rest R is
a sample with unequal probabilities: a document of s words is included with probability min(1, c s), and c is such that
the expected words, the sum of s min(1, c s), are R. Documents with probability 1 are taken first. The others are ranked
by random odds U / (1 - U) divided by their inclusion odds; U is a hash of seed, doc_id and text. The sample is the prefix
of that order whose words come nearest to R, so its size in words is fixed to within half a document, and reruns agree.

c comes from a table of (source, size) with the number of documents: distinct sizes are bounded by the longest
text, not by the rows. The prefix is found without sorting a source in one task: documents fall in buckets by the logarithm
of their rank value, as many a source as its rows ask for (`BUCKET_ROWS`); bucket sums are aggregated on the map side,
running sums go over buckets, and only the bucket in which a source's cut lies is ordered row by row.

Defined results: a null text has size 0 and takes no words; documents of size 0 share the certain copies, at least one;
a null source is a source of its own, ordered last; rows equal in doc_id and text tie and are taken together; an
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirework.llm.shared import cut
from quirework.llm.sharding import numbered

WEIGHTS = (1, 2, 3)
CAP = 3
#: About so many rows lie in the bucket that is ordered row by row.
BUCKET_ROWS = 50_000
SEED = "mix-1"
#: Hex digits of the digest that make U; 2 ** 52 values.
_DIGITS = 13


def word_count(text: Column) -> Column:
    """Number of words [^\\x20\\x09-\\x0D]+."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"\A[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\z", "")
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+", -1))).cast("long")


def targets(sources: DataFrame, cap: int = CAP) -> DataFrame:
    """source, source_size, n, target of a table (source, source_size, n): one row for each source."""
    k = len(WEIGHTS)
    # null last, by code point: the byte order of UTF-8
    ranked = numbered(sources.withColumn("last", F.col("source").isNull()), "last", "source", number="rank")
    weighed = cut(ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") % k + 1).cast("int")).cast("double")))
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    level, before = 0.0, None
    while level != before:  # each step caps at least one more source, or is the last
        before = level
        capped = F.col("weight") * before > cap * F.col("source_size")
        full, weights = weighed.agg(F.coalesce(F.sum(F.when(capped, F.col("source_size"))), F.lit(0)), F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0.0))).first()
        level = (total - cap * full) / weights if weights else before
    target = F.least(F.lit(level) * F.col("weight"), (cap * F.col("source_size")).cast("double"))
    return weighed.select("source", "source_size", "n", F.when(F.col("source_size") == 0, 0.0).otherwise(target).alias("target"))


def inclusion(sizes: DataFrame) -> DataFrame:
    """(source, c, certain) of rows (source, size, n, rest): the probability of a document is 1 from `certain` words on, else c * size."""
    longer = Window.partitionBy("source").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    square = F.expr("CAST(n AS DECIMAL(14, 0)) * CAST(size AS DECIMAL(11, 0)) * CAST(size AS DECIMAL(11, 0))")
    squares = F.sum(square).over(Window.partitionBy("source").orderBy("size")).cast("double")
    tried = sizes.withColumn("sure", F.coalesce(F.sum(F.col("n") * F.col("size")).over(longer), F.lit(0))).withColumn("c", (F.col("rest") - F.col("sure")) / squares)
    # of the sizes that may be the largest uncertain one, the largest whose own c leaves it below 1
    fit = tried.filter((F.col("c") > 0) & (F.col("c") * F.col("size") < 1))
    return fit.groupBy("source").agg(F.max(F.struct("size", "c")).alias("x")).select("source", "x.c", F.col("x.size").alias("largest"))


def mix(docs: DataFrame, carry: tuple[str, ...] = (), seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies and the columns `carry` of each row of `docs`."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    u = (F.conv(F.substring(F.md5(F.concat_ws("\n", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text)), 1, _DIGITS), 16, 10).cast("double") + 0.5) / float(16**_DIGITS)
    rows = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"), u.alias("u"), *carry))
    sizes = cut(rows.groupBy("source", "size").agg(F.count("*").alias("n")))
    sources = targets(sizes.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("n")))
    sources = sources.withColumn("whole", F.floor(F.col("target") / F.greatest("source_size", F.lit(1))))
    sources = cut(sources.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")))
    drawn = sizes.filter("size > 0").join(sources.filter("rest > 0").select(F.col("source").alias("_s"), "rest"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    odds = inclusion(drawn).withColumnRenamed("source", "_s")
    sources = cut(sources.join(odds, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s"))

    resolution = F.greatest(F.lit(8.0), F.col("n") / BUCKET_ROWS)
    ranked = rows.join(sources.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    certain = (F.col("size") > 0) & (F.col("rest") > 0) & (F.col("largest").isNull() | (F.col("size") > F.col("largest")))
    chance = F.col("c") * F.col("size")
    q = F.when((F.col("size") > 0) & (F.col("rest") > 0) & ~certain, F.col("u") / (1 - F.col("u")) * ((1 - chance) / chance))
    ranked = ranked.withColumn("certain", certain).withColumn("q", q).withColumn("bucket", F.floor(F.ln("q") * resolution))

    sums = ranked.filter("q is not null or certain").groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.max("rest").alias("rest"))
    # the certain documents' bucket is null and comes first
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0)))
    cuts = cut(sums.filter("bucket is not null and before < rest and before + words >= rest").select("source", F.col("bucket").alias("cut"), "before"))

    placed = ranked.join(cuts.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    edge = placed.filter("bucket = cut")
    upto = F.sum("size").over(Window.partitionBy("source").orderBy("q").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    edge = edge.withColumn("tied", F.sum("size").over(Window.partitionBy("source", "q"))).withColumn("words_before", F.col("before") + upto - F.col("tied"))
    # the last document of the prefix comes in where that brings the sum nearer to the rest
    edge = edge.withColumn("chosen", F.col("words_before") + F.col("tied") / 2.0 < F.col("rest")).drop("words_before", "tied")
    others = placed.filter("not (bucket <=> cut and bucket is not null)").withColumn("chosen", F.col("certain") | F.coalesce((F.col("bucket") < F.col("cut")) | F.col("cut").isNull() & F.col("q").isNotNull(), F.lit(False)))
    copies = F.col("whole") + F.col("chosen").cast("long")
    copies = F.when(F.col("size") == 0, F.greatest(copies, F.lit(1))).otherwise(copies)
    return others.unionByName(edge).withColumn("copies", copies).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", *carry)
