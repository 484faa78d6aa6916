"""Licence scan by a positional index of rare words, with DataFrame functions only.

A first pass counts in how many documents each word of the licence templates occurs; each template is then indexed by the
`INDEXED` of its words with the highest IDF (the first position of each). A second pass looks up the places of
these words in each document: each place votes for the offset at which the template would start, that is the place
less the word's position in the template, so equal votes are the intersection of shifted postings. An offset with two votes or
more is a candidate; it is verified if all of the template's mandatory key phrases stand there word by word, each moved by
up to `SLACK` words, because names and list numbers differ between copies. A base phrase is a template that is indexed by
all its words and is its own key phrase without slack, so every place of it is found.

score: the largest share of a template's indexed words that agree on one offset (0 below two votes).

Defined results: a null or empty text has no words, no labels and score 0; repeated rows are scanned one by one; an empty
table gives no rows. Both passes are projections of one row (the first is followed by one count by word); work and memory are
linear in the length of a text, but for sorting its votes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.llm.license_texts import PHRASES, TEMPLATES

#: Words of a template that are indexed; of those in more than COMMON_SHARE of the documents only as many as FEWEST asks for.
INDEXED, FEWEST, COMMON_SHARE = 8, 4, 0.05
MIN_VOTES = 2
SLACK = 3
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Template:
    """A licence text: the first position of each word, and (position, words) of its key phrases."""

    def __init__(self, label: str, text: str, phrases: list[str], base: bool = False):
        self.label, self.base, self.slack = label, base, 0 if base else SLACK
        words = "".join(c if c.isalnum() else " " for c in text.lower()).split()
        self.first = {w: words.index(w) for w in words}
        self.phrases = []
        for phrase in phrases:
            part = phrase.split()
            self.phrases.append((next(i for i in range(len(words)) if words[i : i + len(part)] == part), part))

    def indexed(self, frequency: dict[str, int], documents: int) -> list[str]:
        """The words to index: all of a base phrase, else those in the fewest documents, but in any at all."""
        if self.base:
            return sorted(self.first)
        ranked = sorted((w for w in self.first if frequency.get(w)), key=lambda w: (frequency[w], w))[:INDEXED]
        return [w for k, w in enumerate(ranked) if k < FEWEST or frequency[w] <= COMMON_SHARE * documents]


def templates() -> list[Template]:
    return [Template(label, phrase, [phrase], base=True) for phrase, label in PHRASES.items()] + [Template(*t) for t in TEMPLATES]


def folded(text: Column) -> Column:
    """The text with A-Z in lower case and nothing else changed."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def words_of(text: Column) -> Column:
    trimmed = F.regexp_replace(folded(F.coalesce(text.cast("string"), F.lit(""))), rf"\A{BREAK}|{BREAK}\z", "")
    return F.transform(F.array(trimmed), lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, BREAK, -1)))[0]


def frequencies(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """In how many documents each word occurs: one row for each word of the vocabulary at most comes to the driver."""
    seen = docs.select(F.explode(F.array_distinct(F.filter(words_of(F.col("text")), lambda w: w.isin(vocabulary)))).alias("w"))
    return {r["w"]: r["count"] for r in seen.groupBy("w").count().collect()}


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of each row of `docs` (doc_id, text)."""
    every = templates()
    frequency, documents = frequencies(docs, sorted({w for t in every for w in t.first})), docs.count()
    index: dict[str, list[tuple[int, int]]] = {}
    most = []
    for i, t in enumerate(every):
        chosen = t.indexed(frequency, documents)
        most.append(max(len(chosen), 1))
        for w in chosen:
            index.setdefault(w, []).append((i, t.first[w]))
    known = sorted(index)
    postings = F.array(*(F.array(*(F.struct(F.lit(i).alias("t"), F.lit(p).alias("p")) for i, p in index[w])) for w in known))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words_of(F.col("text")).alias("words"))
    n = F.size("words")
    at = F.filter(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.get("words", i).isin(known))
    rows = rows.select("doc_id", "words", n.cast("long").alias("n_words"), at.alias("at"))
    number = lambda i: F.array_position(F.array(*map(F.lit, known)), F.get("words", i)).cast("int") - 1
    shifted = F.flatten(F.transform("at", lambda i: F.transform(F.get(postings, number(i)), lambda x: F.struct(x["t"].alias("t"), (i - x["p"]).alias("o")))))
    none = F.array().cast("array<struct<t:int,o:int>>")
    rows = rows.withColumn("votes", F.when(F.size("at") >= MIN_VOTES, F.sort_array(shifted)).otherwise(none)).drop("at")
    # runs of equal votes: where each begins, then how long it is
    m = F.size("votes")
    begins = F.when(m > 0, F.filter(F.sequence(F.lit(0), m - 1), lambda i: (i == 0) | (F.get("votes", i) != F.get("votes", i - 1)))).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("begins", begins)
    runs = F.transform("begins", lambda b, j: F.struct(F.get("votes", b)["t"].alias("t"), F.get("votes", b)["o"].alias("o"), (F.coalesce(F.get("begins", j + 1), m) - b).alias("n")))
    rows = rows.withColumn("agreed", F.filter(runs, lambda r: r["n"] >= MIN_VOTES)).drop("votes", "begins")

    def stands(t: Template, o: Column) -> Column:
        """Whether all key phrases stand at the offset."""
        def phrase(position: int, part: list[str]) -> Column:
            here = lambda d: reduce(lambda x, y: x & y, (F.coalesce(F.get("words", o + d + (position + k)) == w, F.lit(False)) for k, w in enumerate(part)))
            return here(F.lit(0)) if not t.slack else F.exists(F.array(*(F.lit(d) for d in range(-t.slack, t.slack + 1))), here)

        return reduce(lambda x, y: x & y, (phrase(*p) for p in t.phrases))

    def verified(r: Column) -> Column:
        out = F.lit(False)
        for i, t in enumerate(every):
            out = F.when(r["t"] == i, stands(t, r["o"])).otherwise(out)
        return out

    rows = rows.withColumn("found", F.filter("agreed", verified)).drop("words")
    is_base = lambda r: r["t"] < len(PHRASES)
    rows = rows.withColumn("starts", F.transform(F.filter("found", is_base), lambda r: r["o"]))
    label = lambda r: F.get(F.array(*(F.lit(t.label) for t in every)), r["t"])
    named = lambda found: F.array_join(F.array_sort(F.array_distinct(F.transform(found, label))), ",")
    share = F.array_max(F.transform("agreed", lambda r: r["n"].cast("double") / F.get(F.array(*(F.lit(float(x)) for x in most)), r["t"])))
    return rows.select(
        "doc_id",
        "n_words",
        F.size("starts").cast("long").alias("n_base"),
        F.array_min("starts").cast("long").alias("first_word"),
        F.array_max("starts").cast("long").alias("last_word"),
        named(F.filter("found", is_base)).alias("base_labels"),
        named(F.col("found")).alias("labels"),
        F.coalesce(share, F.lit(0.0)).alias("score"),
    )
