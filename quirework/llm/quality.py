"""Quality rules by distribution divergence from language references, with DataFrame functions only.

One pass over the texts makes for each document its counts: base figures, a histogram of character classes and one of
the common words of its declared language (and of all other words). The references are these histograms, summed over
all documents of the language that pass the base rule and lie near the sums over all of those: a first comparison keeps
junk out of the references. Common words are looked up among the runs of letters of the text (A-Z folded), so neither case
nor punctuation hides them. A document is rejected if the Jensen-Shannon distance (base 2, from 0 to 1) of its characters
to the reference is above a limit, if that of its common words is, or if both are above limits of their own. A histogram of
few words is far from any reference by chance: limits fall with the square root of the number of words, and each rule has its own
least number of words; documents below aren't judged, nor are languages without a list of common words.

Repeated windows are found by sorting (64-bit window hash, place) within each document; two different windows of a text
of n words share a hash with probability n * n / 2 ** 65.

Defined results: a null or empty text has no words and fails the base rule (under 50 words); a null lang or one without
reference is judged by the base rule alone; repeated rows are judged one by one; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.llm.shared import cut

#: Twenty common words of each language with a reference.
COMMON_WORDS = {
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "nicht", "dem", "eine", "ein", "als"],
    "en": ["the", "of", "and", "to", "a", "in", "is", "that", "it", "for", "on", "was", "with", "as", "be", "by", "this", "are", "at", "from"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "se", "del", "las", "por", "un", "con", "no", "una", "para", "su", "es", "al", "lo"],
    "fr": ["de", "la", "le", "et", "les", "en", "des", "un", "du", "une", "est", "que", "pour", "dans", "qui", "au", "sur", "par", "pas", "il"],
}
#: Character classes as patterns; lower stands for all other characters.
CLASSES = {"upper": "[A-Z]+", "wide": r"[^\x00-\x7F]+", "digit": "[0-9]+", "punct": r"[!-/:-@\[-`{-~]+"}
SYMBOLS = "[#*$%&|<>]"
SPACE = r"[\x20\x09-\x0D]+"
WORD_CHAR = r"[^\x20\x09-\x0D]"
_MARKS = ".abcdefghijklmnopqrst"

MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
#: Guards: from so many words on the characters decide, the common words, or both together.
MIN_WORDS_CHARS = 50
MIN_WORDS_COMMON = 80
MIN_WORDS_BOTH = 50
#: A kept document's distances are at most first + second / sqrt(n_words): chance moves a histogram of n words by about 1 / sqrt(n).
CHAR_LIMIT = (0.14, 0.7)
WORD_LIMIT = (0.17, 1.4)
#: Nor are both above these at once.
BOTH_LIMITS = (0.19, 0.29)
#: Either of these keeps a document of at least MIN_WORDS words out of the references.
ROUGH_CHAR_DISTANCE = 0.25
ROUGH_WORD_DISTANCE = 0.3


#: What separates runs of letters, once A-Z are folded.
NO_LETTER = r"[\x00-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def folded(text: Column) -> Column:
    """The text with A-Z in lower case and nothing else changed."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once."""
    return F.transform(F.array(value), body)[0]


def counts(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang, the base figures, the histograms `chars` and `commons` and the columns `carry` of each row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    trimmed = F.regexp_replace("text", rf"\A{SPACE}|{SPACE}\z", "")
    runs = F.split(folded(text), NO_LETTER, -1)
    vocabulary = F.array().cast("array<string>")
    for lang, common in COMMON_WORDS.items():
        vocabulary = F.when(F.col("lang") == lang, F.array(*map(F.lit, common))).otherwise(vocabulary)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), text.alias("text"), *carry)
    rows = rows.select("doc_id", "lang", "text", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE, -1)).alias("words"), vocabulary.alias("vocabulary"), F.when(F.size(vocabulary) > 0, runs).otherwise(F.array().cast("array<string>")).alias("runs"), *carry)

    n = F.size("words")
    window = lambda i: F.struct(F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)).alias("h"), i.alias("p"))
    windows = F.when(n >= 3, F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), window))).otherwise(F.array().cast("array<struct<h:bigint,p:int>>"))
    every = sorted({w for common in COMMON_WORDS.values() for w in common})
    known = F.filter("runs", lambda w: w.isin(every))
    letters = F.array_join(F.transform(known, lambda w: F.substring(F.lit(_MARKS), F.array_position(F.col("vocabulary"), w).cast("int") + 1, F.lit(1))), "")
    lines = F.filter(F.split("text", "\n", -1), lambda line: line.rlike(WORD_CHAR))
    without = lambda pattern: F.length("text") - F.length(F.regexp_replace("text", pattern, ""))
    rows = rows.select(
        "doc_id",
        "lang",
        n.cast("long").alias("n_words"),
        F.length("text").cast("long").alias("n_chars"),
        without(SPACE).cast("long").alias("space"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        *(without(p).cast("long").alias(c) for c, p in CLASSES.items()),
        windows.alias("windows"),
        letters.alias("letters"),
        (F.size("runs") - F.size(F.filter("runs", lambda w: w == ""))).cast("long").alias("n_runs"),
        (F.size("vocabulary") > 0).alias("known"),
        *carry,
    )

    at = lambda i: F.get("windows", i)["h"]
    same = lambda w, i: F.coalesce(w["h"] == at(i - 1), F.lit(False)) | F.coalesce(w["h"] == at(i + 1), F.lit(False))
    covered = F.size(F.array_distinct(F.flatten(F.transform(F.filter("windows", same), lambda w: F.array(w["p"], w["p"] + 1, w["p"] + 2)))))
    commons = [(F.length("letters") - F.length(F.replace("letters", F.lit(c), F.lit("")))).cast("long") for c in _MARKS[1:]]
    commons.insert(0, F.col("n_runs") - reduce(lambda x, y: x + y, commons))
    lower = F.col("n_chars") - F.col("space") - F.col("upper") - F.col("wide") - F.col("digit") - F.col("punct")
    return rows.select(
        "doc_id",
        "lang",
        "known",
        "n_words",
        (F.col("n_chars") - F.col("space")).alias("word_chars"),
        "n_chars",
        "n_symbols",
        "n_dup_lines",
        covered.cast("long").alias("n_repeat_words"),
        F.array(lower, "upper", "wide", "digit", F.col("punct") - F.col("n_symbols"), "n_symbols", "space").alias("chars"),
        F.array(*commons).alias("commons"),
        *carry,
    )


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance, base 2, of two count arrays of one length; null if either is empty."""
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda s, v: s + v).cast("double")
    part = lambda v, m: F.when(v > 0, v * F.ln(v / m)).otherwise(F.lit(0.0))
    shares = F.arrays_zip(p.alias("p"), q.alias("q"))

    def summed(t: Column) -> Column:
        def add(s: Column, v: Column) -> Column:
            return let(F.struct((v["p"] / t["p"]).alias("p"), (v["q"] / t["q"]).alias("q")), lambda x: s + part(x["p"], (x["p"] + x["q"]) / 2) + part(x["q"], (x["p"] + x["q"]) / 2))

        return F.aggregate(shares, F.lit(0.0), add)

    divergence = let(F.struct(total(p).alias("p"), total(q).alias("q")), lambda t: F.when((t["p"] > 0) & (t["q"] > 0), summed(t)))
    return F.sqrt(F.greatest(divergence / 2 / F.ln(F.lit(2.0)), F.lit(0.0)))


def rejections(n: str = "n_words", char: str = "char_distance", word: str = "word_distance") -> list[str]:
    """The rules that reject a document, in SQL; each has its guard of least length."""
    limit = lambda x: f"{x[0]} + {x[1]} / sqrt({n})"
    return [
        f"({n} >= {MIN_WORDS_CHARS} and {char} > {limit(CHAR_LIMIT)})",
        f"({n} >= {MIN_WORDS_COMMON} and {word} > {limit(WORD_LIMIT)})",
        f"({n} >= {MIN_WORDS_BOTH} and {char} > {BOTH_LIMITS[0]} and {word} > {BOTH_LIMITS[1]})",
    ]


def judge(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the base figures, both distances, base_failed, kept and the columns `carry` of each row of `docs` (doc_id, text, lang)."""
    rows = cut(counts(docs, carry))
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    rows = rows.withColumn("base_failed", base_failed)
    typical = rows.filter("known and not base_failed")
    typical = _against(typical, typical).filter(f"char_distance <= {ROUGH_CHAR_DISTANCE} and word_distance <= {ROUGH_WORD_DISTANCE}")
    rules = " and ".join(f"not coalesce({rule}, false)" for rule in rejections())
    found = _against(rows, typical).withColumn("kept", F.expr(f"not base_failed and {rules}"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("char_distance", 6).alias("char_distance"), F.round("word_distance", 6).alias("word_distance"), *carry)


def _against(rows: DataFrame, typical: DataFrame) -> DataFrame:
    """`rows` with both distances to the histograms summed over `typical`, by language."""
    cells = lambda c, n: F.array(*(F.sum(F.col(c)[i]) for i in range(n)))
    references = typical.groupBy("lang").agg(cells("chars", len(CLASSES) + 3).alias("ref_chars"), cells("commons", len(_MARKS)).alias("ref_commons"))
    # one row for each language of COMMON_WORDS at most, so the broadcast is bounded
    joined = rows.join(F.broadcast(references), "lang", "left")
    return joined.withColumn("char_distance", distance(F.col("chars"), F.col("ref_chars"))).withColumn("word_distance", distance(F.col("commons"), F.col("ref_commons"))).drop("ref_chars", "ref_commons")
