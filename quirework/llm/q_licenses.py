"""Query 3: licence notices in all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quirework.llm import licenses as lic
from quirework.llm.shared import table


def op3_positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lic.scan(table(spark, sf_dir, "documents"))


QUERIES = {"op3_positional": op3_positional}


def _oracle() -> str:
    every = lic.templates()
    head = ", ".join(f"({i}, '{t.label}', {str(t.base).lower()}, {len(t.phrases)})" for i, t in enumerate(every))
    first = ", ".join(f"({i}, '{w}', {p})" for i, t in enumerate(every) for w, p in t.first.items())
    phrases = ", ".join(f"({i}, {k}, {p}, [{', '.join(repr(w) for w in part)}], {t.slack})" for i, t in enumerate(every) for k, (p, part) in enumerate(t.phrases))
    return rf"""
WITH head(t, label, base, n_phrases) AS (VALUES {head}), first(t, w, pos) AS (VALUES {first}), phrases(t, k, pos, part, slack) AS (VALUES {phrases}),
texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{lic._UPPER}', '{lic._LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), places AS (SELECT doc_id, unnest(words) AS w, unnest(range(len(words))) AS p FROM texts),
frequency AS (SELECT w, count(DISTINCT doc_id) AS df FROM places WHERE w IN (SELECT w FROM first) GROUP BY w),
ranked AS (
  SELECT t, w, pos, base, df, row_number() OVER (PARTITION BY t ORDER BY df, w) AS rarity FROM first JOIN head USING (t) LEFT JOIN frequency USING (w) WHERE base OR df IS NOT NULL
), indexed AS (SELECT * FROM ranked WHERE base OR rarity <= {lic.FEWEST} OR (rarity <= {lic.INDEXED} AND df <= {lic.COMMON_SHARE} * (SELECT count(*) FROM documents))),
sizes AS (SELECT t, count(*) AS most FROM indexed GROUP BY t),
votes AS (
  SELECT doc_id, t, p - pos AS o, count(*) AS n FROM places JOIN indexed USING (w) GROUP BY ALL HAVING count(*) >= {lic.MIN_VOTES}
), standing AS (
  SELECT doc_id, t, o, k FROM votes JOIN phrases USING (t) JOIN texts USING (doc_id)
  WHERE len(list_filter(range(-slack, slack + 1), lambda d: o + pos + d >= 0 AND words[o + pos + d + 1 : o + pos + d + len(part)] = part)) > 0
), found AS (
  SELECT doc_id, t, o, label, base FROM standing JOIN head USING (t) GROUP BY doc_id, t, o, label, base, n_phrases HAVING count(DISTINCT k) = n_phrases
), scores AS (SELECT doc_id, max(CAST(n AS DOUBLE) / sizes.most) AS score FROM votes JOIN sizes USING (t) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) FILTER (base) AS n_base, min(o) FILTER (base) AS first_word, max(o) FILTER (base) AS last_word,
    coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM found GROUP BY doc_id
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM texts LEFT JOIN named USING (doc_id) LEFT JOIN scores USING (doc_id)
"""


ORACLE_SQL = {"op3_positional": _oracle()}
