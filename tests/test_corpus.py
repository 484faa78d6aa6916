import itertools

from pyspark.sql import functions as F

from quirework.functions import text as T
from quirework.operators import kernels
from quirework.operators import lexicon as L
from quirework.sources import io

TEXTS = [("a", "“The cat, the--cat! --- 'tis (the) cat's\n\tend.  ... d'été a..b"), ("b", ""), ("c", None), ("d", "!?"), ("e", "the cat, the dog"), ("f", "tab\x00bed ‘q’ é \x01 d—e\u2003Z\x85x\xa0y\x1cz \u4e00\u3000ß")]


def corpora(spark):
    books = spark.createDataFrame(TEXTS, "book string, text string").repartition(2)
    return io.corpus_words(books), io.corpus_cores(books)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_cores_of_a_book_equal_those_of_its_words(spark):
    words, books = corpora(spark)
    assert rows(L.cores(words).filter("word <> ''").select("book", "pos", "word")) == rows(L.cores(books).filter("word <> ''"))
    assert rows(L.bigrams(words)) == rows(L.bigrams(books))
    assert rows(L.unigrams(words)) == rows(L.unigrams(books))
    plan = L.bigrams(books)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan


def test_long_runs_of_marks_are_passed_once(spark):
    text = "a" + "-" * 200_000 + "b " + "*" * 200_000
    assert spark.createDataFrame([(text,)], "t string").select(T.cores(F.col("t"))).first()[0] == [text[:200_002], ""]


def test_spaces_are_all_and_only_those_of_the_class(spark):
    every = [(chr(c),) for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000]
    rows_ = spark.createDataFrame(every, "c string").select("c", F.col("c").rlike(f"^{T.SPACE_RUN}$").alias("run"), F.col("c").rlike(f"^[{T.SPACES}]$").alias("one"))
    got = {r["c"] for r in rows_.filter("run").collect()}
    assert got == {r["c"] for r in rows_.filter("one").collect()} == {c for (c,) in every if c.isspace()}


def test_corpus_log_probability_equals_the_general_lookup(spark):
    words, books = corpora(spark)
    lex = L.build(books)
    asked = L.between(books).distinct()
    want = {tuple(r)[:3]: r["logp"] for r in L.log_probability(asked, lex).collect()}
    got = {tuple(r)[:3]: r["logp"] for r in L.corpus_log_probability(books, lex).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_counts_of_deletion_keys():
    for n in range(8):
        for w in map("".join, itertools.product("abc", repeat=n)):
            one = {w[:i] + w[i + 1 :] for i in range(n)}
            assert kernels.n_deletes(w) == len({w} | one | {x[:i] + x[i + 1 :] for x in one for i in range(len(x))}), w
