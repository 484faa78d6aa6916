"""Query 6: all documents, mixed to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quirework.llm.mixing import mix
from quirework.llm.shared import table


def op6_pareto(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


QUERIES = {"op6_pareto": op6_pareto}

#: Levels by running sums over sources, inclusion odds by running sums over sizes; the prefix by one ordered sum for each source.
ORACLE_SQL = {
    "op6_pareto": r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    (CAST(CAST('0x' || substr(md5('mix-1' || chr(10) || coalesce(CAST(doc_id AS VARCHAR), '') || chr(10) || coalesce(text, '')), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 AS u
  FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n FROM sized GROUP BY source
), weighed AS (
  SELECT *, CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight FROM sources
), filled AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total, sum(weight) OVER () AS weights,
    CAST(coalesce(sum(source_size) OVER w, 0) AS BIGINT) AS sizes_before, coalesce(sum(weight) OVER w, 0.0) AS weights_before
  FROM weighed WINDOW w AS (ORDER BY source_size / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), leveled AS (
  SELECT *, (total - 3 * sizes_before) / (weights - weights_before) AS level FROM filled
), at_level AS (
  SELECT *, (SELECT level FROM leveled WHERE level * weight <= 3 * source_size ORDER BY sizes_before, level LIMIT 1) AS lv FROM leveled
), aimed AS (
  SELECT source, source_size, n, CASE WHEN source_size = 0 THEN 0.0 ELSE least(lv * weight, CAST(3 * source_size AS DOUBLE)) END AS target FROM at_level
), split AS (
  SELECT *, CAST(floor(target / greatest(source_size, 1)) AS BIGINT) AS whole, target - CAST(floor(target / greatest(source_size, 1)) AS BIGINT) * source_size AS rest FROM aimed
), sizes AS (
  SELECT source, size, count(*) AS n FROM sized WHERE size > 0 GROUP BY ALL
), tried AS (
  SELECT z.source, z.size, (s.rest - CAST(coalesce(sum(z.n * z.size) OVER (PARTITION BY z.source ORDER BY z.size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
    / CAST(sum(CAST(z.n AS HUGEINT) * z.size * z.size) OVER (PARTITION BY z.source ORDER BY z.size) AS DOUBLE) AS c
  FROM sizes z JOIN split s ON z.source IS NOT DISTINCT FROM s.source WHERE s.rest > 0
), odds AS (
  SELECT source, max(size) AS largest, arg_max(c, size) AS c FROM tried WHERE c > 0 AND c * size < 1 GROUP BY source
), ranked AS (
  SELECT d.doc_id, d.size, s.source_size, s.target, s.whole, s.rest, d.source, CASE WHEN d.size > 0 AND s.rest > 0 THEN
    CASE WHEN o.largest IS NULL OR d.size > o.largest THEN -1.0 ELSE u / (1 - u) * ((1 - o.c * d.size) / (o.c * d.size)) END END AS q
  FROM sized d JOIN split s ON d.source IS NOT DISTINCT FROM s.source LEFT JOIN odds o ON d.source IS NOT DISTINCT FROM o.source
), summed AS (
  SELECT *, sum(size) OVER (PARTITION BY source, q) AS tied,
    sum(CASE WHEN q IS NOT NULL THEN size END) OVER (PARTITION BY source ORDER BY q ASC NULLS LAST RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM ranked
), counted AS (
  SELECT *, whole + CASE WHEN q IS NOT NULL AND (q < 0 OR upto - tied + tied / 2.0 < rest) THEN 1 ELSE 0 END AS c FROM summed
)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN size = 0 THEN greatest(c, 1) ELSE c END AS BIGINT) AS copies,
  CAST((CASE WHEN size = 0 THEN greatest(c, 1) ELSE c END) * size AS BIGINT) AS taken
FROM counted
""",
}
