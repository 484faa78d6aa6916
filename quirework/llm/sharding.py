"""Reproducible shuffle into shards: a Feistel permutation with cycle walking over global row numbers.

A row's global number is its rank by (doc_id, size, crc32). The permutation of [0, N) works on a grid of a x b >= N
places with a = ceil(sqrt(N)), b = ceil(N / a): four rounds add to one coordinate a keyed function of the other, modulo
its side, and a place at or beyond N walks on along its cycle. The place gives shard = place mod S and slot = place div
S, so counts differ by one at most, slots have no gaps, and both follow from the row number alone.

Rank without a global sort in one task: rows are range-partitioned by the key (the last key, a unique row mark, splits
rows that are equal otherwise), sorted within partitions and cut by a checkpoint, so partition and place are fixed;
each partition's offset is a running sum over the partition counts, a table with one row for each partition.

Fewer than a of the a x b places lie outside [0, N), and a walk visits each of them once at most before it returns: WALK
steps always suffice while a <= WALK, and beyond that a longer walk has a probability below N * WALK ** -WALK; it would
raise an error, never a wrong place.

Defined results: a null text has size 1 and the crc32 of no bytes, 0; null doc_ids come first; rows equal in doc_id,
size and crc32 take neighbouring numbers in any order; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirework.llm.shared import cut

#: Fixed values of the round function: (key * x + offset) mod PRIME, then its square mod PRIME.
PRIME = 2147483647
ROUNDS = ((1103515245, 12345), (1664525, 1013904223), (22695477, 54773), (134775813, 907633385))
WALK = 64
_ROW_BITS = 33


def round_sql(x: str, key: int, offset: int) -> str:
    """A keyed pseudo-random function of a small integer, as SQL that Spark and other engines evaluate alike."""
    inner = f"((({x}) % {PRIME}) * {key} + {offset}) % {PRIME}"
    return f"(({inner}) * ({inner}) % {PRIME})"


def sides(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(n, 1) - 1) + 1)
    return a, -(-max(n, 1) // a)


def _permuted(x: Column, a: int, b: int) -> Column:
    """One pass of the network over x in [0, a * b)."""

    def let(value: Column, body) -> Column:
        return F.transform(F.array(value), body)[0]

    def f(v: Column, r: int) -> Column:
        key, offset = ROUNDS[r]
        return let(((v % PRIME) * key + offset) % PRIME, lambda y: y * y % PRIME)

    def step(r: int):
        if r % 2 == 0:
            return lambda p: F.struct(((p["l"] + f(p["r"], r)) % a).alias("l"), p["r"].alias("r"))
        return lambda p: F.struct(p["l"].alias("l"), ((p["r"] + f(p["l"], r)) % b).alias("r"))

    pair = F.struct((x % a).alias("l"), F.floor(x / a).cast("long").alias("r"))
    for r in range(len(ROUNDS)):
        pair = let(pair, step(r))
    return let(pair, lambda p: p["l"] + p["r"] * a)


def feistel(number: Column, n: int) -> Column:
    """The place of a row number under the permutation of [0, n)."""
    a, b = sides(n)
    start = _permuted(number, a, b)
    if a * b == n:
        return start
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), start, lambda at, _: F.when(at < n, at).otherwise(_permuted(at, a, b)))
    return F.transform(F.array(walked), lambda at: F.when(at < n, at).otherwise(F.raise_error(F.lit("a walk did not end")).cast("long")))[0]


def numbered(rows: DataFrame, *keys: str, number: str = "number") -> DataFrame:
    """`rows` with their global rank by `keys`, from 0."""
    marked = cut(rows.withColumn("_mark", F.monotonically_increasing_id()))
    parts = rows.sparkSession.conf.get("spark.sql.shuffle.partitions")
    ranged = marked.repartitionByRange(int(parts), *keys, "_mark").sortWithinPartitions(*keys, "_mark")
    fixed = cut(ranged.drop("_mark").withColumn("_at", F.monotonically_increasing_id()))
    fixed = fixed.select("*", F.shiftrightunsigned("_at", _ROW_BITS).alias("_part"), F.col("_at").bitwiseAND((1 << _ROW_BITS) - 1).alias("_row")).drop("_at")
    counts = fixed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    # one row for each partition of the shuffle, so the broadcast is bounded
    return fixed.join(F.broadcast(offsets), "_part").withColumn(number, F.col("_offset") + F.col("_row")).drop("_part", "_row", "_offset")


def shard(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each row of `docs`; shard counts differ by one at most."""
    bytes_of = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(bytes_of) + 1).cast("long").alias("size"), F.crc32(bytes_of.cast("binary")).alias("text_crc32"))
    rows = numbered(rows, "doc_id", "size", "text_crc32")
    n = rows.count()
    place = rows.withColumn("place", feistel(F.col("number"), n))
    return place.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("place") % shards).cast("int").alias("shard"),
        F.floor(F.col("place") / shards).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("number").alias("row_number"),
    )
