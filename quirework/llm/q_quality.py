"""Query 2: quality rules on all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quirework.llm import quality as q
from quirework.llm.shared import table


def op2_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.judge(table(spark, sf_dir, "documents"))


QUERIES = {"op2_divergence": op2_divergence}


def _oracle() -> str:
    classes, marks = len(q.CLASSES) + 3, 21
    without = lambda pattern: f"length(t) - length(regexp_replace(t, '{pattern}', '', 'g'))"
    vocabulary = " ".join(f"WHEN '{lang}' THEN [{', '.join(repr(w) for w in words)}]" for lang, words in q.COMMON_WORDS.items())
    langs = ", ".join(repr(x) for x in q.COMMON_WORDS)
    runs = f"CASE WHEN len(v) > 0 THEN regexp_extract_all(translate(t, '{q._UPPER}', '{q._LOWER}'), '{q.NO_LETTER.replace('[', '[^', 1)}') ELSE [] END"
    words = ", ".join(["len(list_filter(u, lambda x: NOT list_contains(v, x))) AS w0"] + [f"len(list_filter(u, lambda x: x = v[{i}])) AS w{i}" for i in range(1, marks)])

    def distance(kind: str, n: int) -> str:
        p, r = (" + ".join(f"{a}{kind}{i}" for i in range(n)) for a in ("", "r"))
        share = lambda a, total, i: f"CAST({a}{kind}{i} AS DOUBLE) / CAST(({total}) AS DOUBLE)"
        terms = []
        for i in range(n):
            x, y = share("", p, i), share("r", r, i)
            for v in (x, y):
                terms.append(f"CASE WHEN {v} > 0 THEN {v} * ln({v} / (({x} + {y}) / 2)) ELSE 0 END")
        return f"CASE WHEN ({p}) > 0 AND ({r}) > 0 THEN sqrt(greatest(({' + '.join(terms)}) / 2 / ln(2), 0)) END"

    sums = ", ".join(f"CAST(sum({c}{i}) AS BIGINT) AS r{c}{i}" for c, n in (("c", classes), ("w", marks)) for i in range(n))
    kept = " AND ".join(f"NOT coalesce({rule}, false)" for rule in q.rejections(char="cd", word="wd"))
    distances = f"{distance('c', classes)} AS cd, {distance('w', marks)} AS wd"
    return rf"""
WITH base AS (
  SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    CASE lang {vocabulary} ELSE [] END AS v,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), grams AS (
  SELECT doc_id, unnest(range(1, len(w) - 1)) AS p, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g
  FROM base WHERE len(w) >= 3
), twice AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1
), covered AS (
  SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS place FROM twice) GROUP BY doc_id
), parts AS (
  SELECT doc_id, lang, len(w) AS n_words, length(t) AS n_chars, {without(q.SPACE)} AS c6, length(t) - length(regexp_replace(t, '{q.SYMBOLS}', '', 'g')) AS c5,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, {without(q.CLASSES['upper'])} AS c1, {without(q.CLASSES['wide'])} AS c2, {without(q.CLASSES['digit'])} AS c3, {without(q.CLASSES['punct'])} AS punct,
    coalesce(lang IN ({langs}), false) AS known, coalesce(covered.n, 0) AS n_repeat_words, {words}
  FROM (SELECT *, {runs} AS u FROM base) LEFT JOIN covered USING (doc_id)
), cells AS (
  SELECT *, n_chars - c6 - c1 - c2 - c3 - punct AS c0, punct - c5 AS c4,
    n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.MAX_REPEATED_PERCENT} * n_words AS base_failed FROM parts
), rough AS (
  SELECT lang, {sums} FROM cells WHERE known AND NOT base_failed GROUP BY lang
), near AS (
  SELECT cells.*, {distances} FROM cells JOIN rough USING (lang) WHERE known AND NOT base_failed
), fine AS (
  SELECT lang, {sums} FROM near WHERE cd <= {q.ROUGH_CHAR_DISTANCE} AND wd <= {q.ROUGH_WORD_DISTANCE} GROUP BY lang
), judged AS (
  SELECT cells.*, {distances} FROM cells LEFT JOIN fine USING (lang)
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_chars - c6 AS BIGINT) AS word_chars, CAST(c5 AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND {kept} AS kept,
  round(cd, 6) AS char_distance, round(wd, 6) AS word_distance
FROM judged
"""


ORACLE_SQL = {"op2_divergence": _oracle()}
