"""Scalar text functions as column expressions. All but distances and what is made of them stay inside the JVM."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quirework.operators import kernels

#: The 29 characters at which text splits into words.
SPACES = r"\t-\r\x1c-\x20\x85\xa0  -     　"
#: The same class as single characters of Latin-1, a table of bits in Java, and ranges that only wider characters reach.
SPACE_RUN = r"[\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x20\x85\xa0[\u0100-\uffff&&[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]]+"
CORE = r"^([^A-Za-z0-9]*)(.*?)([^A-Za-z0-9]*)$"
#: The core alone, without trying each of its ends.
MIDDLE = r"(?s)^[^A-Za-z0-9]*+(.*[A-Za-z0-9]|)"
LETTERS = r"^[A-Za-z]+(?:'[A-Za-z]+)?$"
#: Typographic marks and their plain forms.
PLAIN_MARKS = {"‘": "'", "’": "'", "“": '"', "”": '"', "–": "-"}
#: Rewrites that join separated punctuation and clitics, in this order.
REJOIN = [
    (r" ([.,;:!?)\]])", "$1"),
    (r"([(\[]) ", "$1"),
    (r" (['’](s|t|re|ve|ll|d|m|S|T|RE|VE|LL|D|M))\b", "$1"),
    (r'" (.*?) "', '"$1"'),
]
#: Word numbers are encoded as code points: all but 0 and the surrogates.
_BELOW, _SURROGATES = 0xD7FF, 0x800


def let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE_RUN, -1), "")


def normalize(text: Column) -> Column:
    """The text's words, joined by blanks."""
    return F.trim(F.regexp_replace(text, SPACE_RUN, " "))


def plain_ascii(text: Column) -> Column:
    """Quotes and dashes in plain form; other characters outside of printable ASCII and white space go."""
    for mark, plain in PLAIN_MARKS.items():
        text = F.replace(text, F.lit(mark), F.lit(plain))
    return F.regexp_replace(F.replace(text, F.lit("—"), F.lit("--")), f"[^\x20-\x7e{SPACES}]", "")


def detokenize(text: Column) -> Column:
    for pattern, joined in REJOIN:
        text = F.regexp_replace(text, pattern, joined)
    return normalize(text)


def edges(token: Column) -> Column:
    """struct(pre, core, post): the token's middle from its first to its last letter or digit."""
    part = lambda i: F.regexp_extract(token, f"(?s){CORE}", i)
    return F.struct(part(1).alias("pre"), core(token).alias("core"), part(3).alias("post"))


def core(token: Column) -> Column:
    return F.regexp_extract(token, MIDDLE, 1)


def cores(text: Column) -> Column:
    """The lower-case cores of all words of plain_ascii(text), in order; words without letters and digits leave an empty one.

    Whole texts go through Python's own string functions: regular expressions over each character took most of the time.
    """
    return F.split(F.pandas_udf(lambda texts: texts.map(kernels.joined_cores, na_action="ignore"), "string")(text), " ", -1)


def is_letters(word: Column) -> Column:
    return word.rlike(LETTERS)


def is_upper(word: Column) -> Column:
    """At least one cased character and none in lower case."""
    return (word == F.upper(word)) & (word != F.lower(word))


def protected(word: Column) -> Column:
    """Numbers, money, dates, addresses, short capitals and hyphenated words: never to be corrected."""
    digits = F.regexp_count(word, F.lit(r"\p{Nd}"))
    letters = F.regexp_count(word, F.lit(r"\p{L}"))
    marks = F.lit(False)
    for mark in "@/$%-":
        marks = marks | F.contains(word, F.lit(mark))
    return (word == "") | ((digits > 0) & (letters < 2)) | (is_upper(word) & (F.length(word) <= 5)) | marks


def apply_case(source: Column, word: Column) -> Column:
    """`word` in the case pattern of `source`."""
    first = F.substring(source, 1, 1)
    raised = F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, F.lit(2), F.length(word)))
    return F.when(is_upper(source) & (F.length(source) > 1), F.upper(word)).when(is_upper(first), raised).otherwise(word)


def deletes(word: Column, depth: int) -> Column:
    """The word and all strings left after up to `depth` deletions."""
    shorter = lambda w: F.when(F.length(w) > 0, F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))).otherwise(F.array().cast("array<string>"))
    level, out = F.array(word), F.array(word)
    for _ in range(depth):
        level = F.array_distinct(F.flatten(F.transform(level, shorter)))
        out = F.array_union(out, level)
    return out


def n_deletes(word: Column) -> Column:
    """How many strings deletes(word, 2) holds, without making them."""
    return F.pandas_udf(lambda words: words.map(kernels.n_deletes, na_action="ignore"), "long")(word)


def _edits(a: pd.Series, b: pd.Series) -> pd.Series:
    """Distances of the pairs in which neither is null; arrays are compared by members."""
    whole = lambda x: x if isinstance(x, str) else list(x)
    out = pd.Series([None] * len(a), dtype=object)
    known = [k for k, (x, y) in enumerate(zip(a, b)) if x is not None and y is not None]
    out.iloc[known] = kernels.distances([whole(a.iloc[k]) for k in known], [whole(b.iloc[k]) for k in known]).tolist()
    return out


def _shares(edits: pd.Series, sizes: list[int | None], others: list[int | None]) -> pd.Series:
    """Edits over the size; without one 0 if the other has none either, else 1."""
    return pd.Series([(0.0 if m == 0 else 1.0) if n == 0 else None if e is None else e / n for e, n, m in zip(edits, sizes, others)], dtype=object)


def _sizes(values: pd.Series) -> list[int | None]:
    return [None if x is None else len(x) for x in values]


def _character_rates(reference: pd.Series, reading: pd.Series) -> pd.Series:
    return _shares(_edits(reference, reading), _sizes(reference), _sizes(reading))


def _word_rates(reference: pd.Series, reading: pd.Series) -> pd.Series:
    """Of normalised texts."""
    r, h = (pd.Series([None if t is None else t.split(" ") if t else [] for t in x], dtype=object) for x in (reference, reading))
    return _character_rates(r, h)


def _likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    longest = [None if x is None or y is None else max(len(x), len(y)) for x, y in zip(a, b)]
    return pd.Series([None if n is None else 1.0 if n == 0 else 1 - e / n for e, n in zip(_edits(a, b), longest)], dtype=object)


def distance(a: Column, b: Column) -> Column:
    """Levenshtein distance of any two texts; the cost grows with the square of the distance."""
    return F.pandas_udf(_edits, "int")(a, b)


def as_codes(sequence: Column, kinds: Column) -> Column:
    """A word sequence as a string with one code point for each word, by its number in `kinds`."""
    code = lambda n: F.when(n <= _BELOW, n).otherwise(n + _SURROGATES)
    number = lambda w: F.lpad(F.hex(code(F.array_position(kinds, w))), 8, "0")
    return F.decode(F.unhex(F.array_join(F.transform(sequence, number), "")), "UTF-32")


def word_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance of two word arrays."""
    return F.pandas_udf(_edits, "int")(a, b)


def shared_words(a: Column, b: Column) -> Column:
    """How many words two arrays have in common as multisets."""
    count = lambda x, y: None if x is None or y is None else kernels.shared_words(x, y)
    return F.pandas_udf(lambda x, y: pd.Series(list(map(count, x, y)), dtype=object), "int")(a, b)


def bow_f1(reference: Column, reading: Column) -> Column:
    """F1 of the word multisets; without words in the reference 1 if the reading has none either, else 0.

    Whole texts go through Python's own dictionaries: a line costs its words once, however long it is.
    """
    rate = lambda r, h: None if r is None or h is None else kernels.bow_f1(r, h)
    return F.pandas_udf(lambda r, h: pd.Series(list(map(rate, r, h)), dtype=object), "double")(reference, reading)


def cer(reference: Column, reading: Column) -> Column:
    """Character error rate of normalised texts; an empty reference costs 1 unless the reading is empty."""
    return F.pandas_udf(_character_rates, "double")(normalize(reference), normalize(reading))


def wer(reference: Column, reading: Column) -> Column:
    """Word error rate, with the same rule."""
    return F.pandas_udf(_word_rates, "double")(normalize(reference), normalize(reading))


def similarity(a: Column, b: Column) -> Column:
    """1 less the distance over the longer length; 1 for two empty texts."""
    return F.pandas_udf(_likeness, "double")(a, b)


def source_parts(source: Column) -> Column:
    """struct(engine, variant) of "engine/variant"."""
    return F.struct(F.split_part(source, F.lit("/"), F.lit(1)).alias("engine"), F.split_part(source, F.lit("/"), F.lit(2)).alias("variant"))


def engine_parts(engine: Column) -> Column:
    """struct(family, model, by_line): "tesseract-<model>" and a trailing "-line"."""
    by_line = F.endswith(engine, F.lit("-line"))
    bare = F.regexp_replace(engine, "-line$", "")
    return F.struct(F.split_part(bare, F.lit("-"), F.lit(1)).alias("family"), F.regexp_replace(bare, "^[^-]*-?", "").alias("model"), by_line.alias("by_line"))


def config_weight(error: Column, scale: Column) -> Column:
    return F.round(F.pow(1 - error, 1 + 4 * scale), 3)
