import itertools
import re

from pyspark.sql import functions as F

from quirework.functions import text as T
from quirework.operators import lexicon as L
from quirework.operators import voting as V
from quirework.plans import queries as Q
from quirework.plans import synthetic as S

SMALL = "/root/testdata/sf0.001"


def test_core_runs_from_the_first_to_the_last_letter_or_digit(spark):
    words = ["".join(w) for n in range(5) for w in itertools.product("a-é\n", repeat=n)]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", T.core(F.col("w")).alias("c")).collect()
    assert all(r["c"] == re.fullmatch(T.CORE, r["w"] or "", re.S)[2] for r in got)


def test_places_hold_the_flat_words(spark):
    said = S.places(spark, SMALL).select("image", "dataset", "level", "i", F.inline("said")).filter("source is not null")
    flat = S.words_flat(spark, SMALL).select(said.columns)
    assert said.exceptAll(flat).isEmpty() and flat.exceptAll(said).isEmpty()


def test_tallies_of_a_slot_equal_those_of_rows(spark):
    votes = [("p", [(0, "a", 0.9, 0.4), (1, "b", 0.5, 0.4), (2, "a", 0.7, 0.2)]), ("q", [(0, "x", 0.5, 0.3), (1, "y", 0.5, 0.3)]), ("r", [(1, "", 0.5, 0.5)]), ("s", [(0, "z", 1.0, 0.0)])]
    rows = spark.createDataFrame(votes, "image string, votes array<struct<ord:int,reading:string,conf:double,weight:double>>")
    flat = V.tally(rows.select("image", F.lit(0).alias("slot"), F.inline("votes")))
    here = rows.select("image", V.tallied(F.col("votes")).alias("t"))
    show = lambda df: sorted((r["image"], r["reading"], round(r["vote"], 9), round(r["engine_conf"], 9), r["ord"]) for r in df.collect())
    assert show(here.select("image", F.inline("t"))) == show(flat)
    best = {r["image"]: r["reading"] for r in V.winners(flat).collect()}
    assert {r["image"]: r["reading"] for r in here.select("image", V.winner(F.col("t")).alias("w")).select("image", "w.reading").collect()} == best


def test_votes_are_tallied_without_a_shuffle_of_words(spark):
    for name in ("slot_votes", "slot_best", "slot_candidates", "fill_empty"):
        plan = Q.QUERIES[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate" not in plan and "Window" not in plan and "Join" not in plan, name


def test_suspects_ask_the_lexicon_only_where_it_decides(spark):
    words = [(w, c, n) for w in ("known", "other", "A1", "CAPS", "LONGCAPS", "...") for c in (0.4, 0.5, 0.8, 0.85, 0.9, 0.95) for n in (0, 1, 2)]
    unigram = spark.createDataFrame([("known", -1.0), ("longcaps", -1.0)], "word string, logp double")
    for keep in (0.5, 0.8, 0.95):
        rows = spark.createDataFrame(words, "word string, conf double, n_alternatives int")
        got = sorted((r["word"], r["conf"], r["n_alternatives"]) for r in L.suspects(rows, unigram, keep).collect())
        want = [(w, c, n) for w, c, n in words if w in ("known", "other", "LONGCAPS") and not (w == "LONGCAPS" and c >= 0.5) and not (c >= (0.9 if w in ("known", "LONGCAPS") else keep) and n <= 1)]
        assert got == sorted(want), keep


def test_trust_and_boxes_carry_no_more_than_they_need(spark):
    plan = lambda name: Q.QUERIES[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    for name in ("line_text", "line_boxes", "reading_order"):
        above, below = plan(name).split("RepartitionByExpression")
        assert "explode" in above and "explode" not in below, name  # pages are dealt before their words are rows
    trust = plan("trust_pivot").split("\n")
    last = max(i for i, x in enumerate(trust) if "Window" in x)
    assert "Project" in trust[last + 1] and not re.search(r"\blines#\d+\]", trust[last + 1].split(" AS ")[-1]) and "lines#" not in trust[last]
    assert "_mean" in trust[last + 1]


def test_texts_of_readings_are_their_words(spark):
    flat = S.read_words(spark, SMALL).select("image", "dataset", "level", F.col("source").alias("system"), F.array_join("words", " ").alias("text"), F.array_join(F.transform("said", lambda w: w["word"]), " ").alias("reading"))
    pairs = S.pairs(spark, SMALL)
    assert pairs.exceptAll(flat).isEmpty() and flat.exceptAll(pairs).isEmpty()
