"""Samples and readings made from documents by fixed corruptions, so that any engine can make the same ones.

A sample is a line of a document with words. Three sources read it: one takes "m" for "rn" in every ninth word, one takes
"d" for "cl" in every eleventh and misses every seventeenth, one takes "e" for "c" in every seventh and doubles every
thirteenth. These are synthetic and say nothing about recognizers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.functions import text as T

#: Source, period and place of its change, seen and truth, factor and offset of its confidences.
SOURCES = [("north/raw", 9, 4, "m", "rn", 37, 17, 0.45), ("south/raw", 11, 5, "d", "cl", 29, 34, 0.38), ("west/soft", 7, 3, "e", "c", 23, 51, 0.22)]
MISSED, DOUBLED = (17, 8), (13, 6)
LINE_WORDS = 8
LEVEL_OF = {"en": "clean", "de": "medium", "fr": "hard"}
WEIGHTS = [(s[0], s[7], i) for i, s in enumerate(SOURCES)]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image, dataset, level, doc_id, line_no, words) of all lines with words.

    Lines are dealt as text by image, because the kernels over them outweigh a shuffle of the text and later steps group by
    image: neither the layout of files nor one long document decides how many tasks work.
    """
    level = F.lit("real")
    for lang, name in LEVEL_OF.items():
        level = F.when(F.col("lang") == lang, name).otherwise(level)
    lines = documents(spark, sf_dir).select("doc_id", F.col("source").alias("dataset"), level.alias("level"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    dealt = lines.filter(F.col("line").rlike(f"[^{T.SPACES}]")).select(F.concat_ws(":", "doc_id", "line_no").alias("image"), "*").repartition("image")
    return dealt.select("image", "dataset", "level", "doc_id", "line_no", T.words(F.col("line")).alias("words"))


def _read(words: Column, k: int) -> Column:
    """Array of struct(word, conf, i, copy) that source k reads."""
    name, period, place, seen, truth, factor, offset, _ = SOURCES[k]

    # a confidence depends on the place modulo 50
    confs = F.array(*(F.lit((50 + (i * factor + offset) % 50) / 100) for i in range(50)))

    def made(w: Column, i: Column, copy: int = 0) -> Column:
        word = F.when(i % period == place, F.replace(w, F.lit(seen), F.lit(truth))).otherwise(w)
        return F.struct(word.alias("word"), F.get(confs, i % 50).alias("conf"), i.alias("i"), F.lit(copy).alias("copy"))

    if k == 1:
        return F.filter(F.transform(words, lambda w, i: made(w, i)), lambda w: w["i"] % MISSED[0] != MISSED[1])
    if k == 2:
        return F.flatten(F.transform(words, lambda w, i: F.when(i % DOUBLED[0] == DOUBLED[1], F.array(made(w, i), made(w, i, 1))).otherwise(F.array(made(w, i)))))
    return F.transform(words, lambda w, i: made(w, i))


def _read_text(words: Column, k: int) -> Column:
    """The words of _read, joined by blanks."""
    _, period, place, seen, truth, *_ = SOURCES[k]
    said = F.transform(words, lambda w, i: F.when(i % period == place, F.replace(w, F.lit(seen), F.lit(truth))).otherwise(w))
    if k == 1:
        said = F.filter(said, lambda w, i: i % MISSED[0] != MISSED[1])
    if k == 2:
        said = F.transform(said, lambda w, i: F.when(i % DOUBLED[0] == DOUBLED[1], F.concat_ws(" ", w, w)).otherwise(w))
    return F.array_join(said, " ")


def read_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image, dataset, level, text words, source, weight, ord, said): every sample as each source reads it, in one pass."""
    base = samples(spark, sf_dir)
    said = F.array(*(F.struct(F.lit(s[0]).alias("source"), F.lit(s[7]).alias("weight"), F.lit(k).alias("ord"), _read(F.col("words"), k).alias("said")) for k, s in enumerate(SOURCES)))
    return base.select("image", "dataset", "level", "words", F.explode(said).alias("r")).select("image", "dataset", "level", "words", "r.*")


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image, dataset, level, i, said array<struct<source, weight, ord, word, conf, copy>>): the readings of read_words at each place of a sample.

    A row a place, so what the sources say of it meets without a shuffle. Null where a source misses a word or doesn't double it.
    """
    w, i = F.col("truth"), F.col("i")

    def made(k: int, copy: int = 0) -> Column:
        name, period, place, seen, truth, factor, offset, weight = SOURCES[k]
        word = F.when(i % period == place, F.replace(w, F.lit(seen), F.lit(truth))).otherwise(w)
        conf = (50 + (i * factor + offset) % 50) / 100
        return F.struct(F.lit(name).alias("source"), F.lit(weight).alias("weight"), F.lit(k).alias("ord"), word.alias("word"), conf.alias("conf"), F.lit(copy).alias("copy"))

    said = F.array(made(0), F.when(i % MISSED[0] != MISSED[1], made(1)), made(2), F.when(i % DOUBLED[0] == DOUBLED[1], made(2, 1)))
    return samples(spark, sf_dir).select("image", "dataset", "level", F.posexplode("words").alias("i", "truth")).select("image", "dataset", "level", "i", said.alias("said"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image, dataset, level, system, text, reading)."""
    said = F.array(*(F.struct(F.lit(s[0]).alias("system"), _read_text(F.col("words"), k).alias("reading")) for k, s in enumerate(SOURCES)))
    rows = samples(spark, sf_dir).select("image", "dataset", "level", F.array_join("words", " ").alias("text"), F.explode(said).alias("r"))
    return rows.select("image", "dataset", "level", "r.system", "text", "r.reading")


def words_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image, dataset, level, source, weight, ord, pos, word, conf, i, copy)."""
    rows = read_words(spark, sf_dir).select("image", "dataset", "level", "source", "weight", "ord", F.posexplode("said").alias("pos", "w"))
    return rows.select("image", "dataset", "level", "source", "weight", "ord", "pos", "w.*")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dataset, image, source, lines): the readings cache, LINE_WORDS words a line."""
    starts = F.sequence(F.lit(1), F.greatest(F.size("said"), F.lit(1)), F.lit(LINE_WORDS))
    line = lambda k: F.transform(F.slice("said", k, F.lit(LINE_WORDS)), lambda w: F.struct(w["word"].alias("word"), w["conf"].alias("conf")))
    return read_words(spark, sf_dir).select("dataset", "image", "source", F.transform(starts, line).alias("lines"))


def _sql() -> str:
    parts = []
    for k, (name, period, place, seen, truth, factor, offset, weight) in enumerate(SOURCES):
        copies = f"unnest(CASE WHEN i % {DOUBLED[0]} = {DOUBLED[1]} THEN [0, 1] ELSE [0] END)" if k == 2 else "0"
        where = f" WHERE i % {MISSED[0]} <> {MISSED[1]}" if k == 1 else ""
        parts.append(
            f"SELECT image, dataset, level, '{name}' AS source, CAST({weight} AS DOUBLE) AS weight, {k} AS ord, i, {copies} AS copy, "
            f"CASE WHEN i % {period} = {place} THEN replace(word, '{seen}', '{truth}') ELSE word END AS word, CAST((50 + (i * {factor} + {offset}) % 50) AS DOUBLE) / 100 AS conf FROM truth{where}"
        )
    levels = " ".join(f"WHEN '{lang}' THEN '{name}'" for lang, name in LEVEL_OF.items())
    names = ", ".join(f"('{s[0]}', {k})" for k, s in enumerate(SOURCES))
    return rf"""
lines AS (
  SELECT doc_id, source AS dataset, CASE lang {levels} ELSE 'real' END AS level, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents
), samples AS (
  SELECT * FROM (SELECT doc_id || ':' || line_no AS image, doc_id, line_no, dataset, level, regexp_extract_all(line, '[^\s]+') AS words FROM lines) WHERE len(words) > 0
), truth AS (SELECT image, dataset, level, unnest(words) AS word, unnest(range(len(words))) AS i FROM samples),
said AS ({' UNION ALL '.join(parts)}),
said_texts AS (SELECT image, source, string_agg(word, ' ' ORDER BY i, copy) AS reading FROM said GROUP BY ALL),
pairs AS (
  SELECT s.image, dataset, level, n.source AS system, array_to_string(words, ' ') AS text, coalesce(reading, '') AS reading
  FROM samples s CROSS JOIN (VALUES {names}) n(source, ord) LEFT JOIN said_texts t ON t.image = s.image AND t.source = n.source
)"""


#: Common table expressions lines, samples, truth, said, said_texts and pairs with the same rows in the oracle's dialect.
SQL = _sql()
