import math
import random
from collections import Counter

from pyspark.sql import functions as F

from quirework.operators import correct, kernels, lexicon


def model(spark):
    text = ("the quick brown fox runs over the lazy dog and the brown bear . " * 30).split()
    return lexicon.build(spark.createDataFrame([("b", i, w) for i, w in enumerate(text)], "book string, pos int, word string"))


def test_neighbors_are_all_words_within_the_distance(spark):
    lex = model(spark)
    words = [r["word"] for r in lex.unigram.collect()]
    asked = ["brovn", "teh", "dg", "foxx", "x", "quickly"]
    got = {(r["query"], r["word"]) for r in lexicon.neighbors(spark.createDataFrame([(q,) for q in asked], "query string"), lex.deletes()).collect()}

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(new[-1] + 1, row[j + 1] + 1, row[j] + (x != y)))
            row = new
        return row[-1]

    assert got == {(q, w) for q in asked if 2 <= len(q) <= 20 for w in words if 2 <= len(w) <= 20 and lev(q, w) <= (1 if len(q) <= 3 else 2)}


def test_repairs_unsure_unknown_words_only(spark):
    lex = model(spark)
    said = "the quick brovvn fox runs over the 1azy d0g".split()
    confs = [0.95, 0.95, 0.3, 0.95, 0.95, 0.95, 0.95, 0.3, 0.99]
    rows = spark.createDataFrame([("p", 0, i, w, c) for i, (w, c) in enumerate(zip(said, confs))], "image string, line_no int, pos int, word string, conf double").withColumn("alternatives", F.expr("cast(array() as array<struct<word:string,share:double>>)"))
    got = correct.correct(rows, lex, correct.Parameters(lam=4.0)).first()["words"]
    assert got == "the quick brown fox runs over the lazy d0g".split()


def test_share_of_known_words(spark):
    lex = model(spark)
    rows = spark.createDataFrame([("p", "brown", 0.9), ("p", "zzzz", 0.9), ("p", "quick", 0.5), ("q", "a", 0.9)], "image string, word string, conf double")
    assert {r["image"]: r["share"] for r in lexicon.english_share(rows, lex.unigram).collect()} == {"p": 0.5, "q": 1.0}


def brute(lines, book, p):
    """Repairs by looking at every word of the lexicon: the rules one by one, without index, joins or batches."""
    count, pair = Counter(w for w in book if w.isalpha()), Counter(zip(book, book[1:]))
    total = sum(count.values())
    logp = {w: math.log(n / total) for w, n in count.items()}
    floor = min(logp.values()) - 2
    left = Counter()
    for (a, _), n in pair.items():
        left[a] += n
    p_uni = lambda w: math.exp(logp.get(w, floor))
    p_next = lambda a, b: (pair[a, b] + 50 * p_uni(b)) / (left[a] + 50)

    def lev(a, b):
        return int(kernels.levenshtein_table(a, b)[-1, -1])

    out = []
    for line in lines:
        done = []
        for k, (word, conf, alternatives) in enumerate(line):
            core, shares = word, {}
            for w, share in alternatives:
                shares[w.lower()] = max(share, shares.get(w.lower(), 0.0))
            known, seen = core.lower() in logp, core.lower()
            if any(c.isdigit() for c in core) or (core.isupper() and len(core) <= 5) or conf >= (0.9 if known else p.keep_unknown) and len(shares) <= 1:
                done.append(word)
                continue
            before, after = done[-1].lower() if done else "", line[k + 1][0].lower() if k + 1 < len(line) else ""

            def value(c):
                log = math.log(p_next(before, c)) if before else logp.get(c, floor)  # noqa: B023
                log += math.log(p_next(c, after) / p_uni(after)) if after else 0.0  # noqa: B023
                return log - p.lam * kernels.confusion_cost(seen, c) + p.mu * shares.get(c, 0.0) - (0.0 if c in logp else p.unknown_cost)  # noqa: B023

            candidates = {seen, *shares} | {w for w in logp if 2 <= len(seen) <= 20 and 2 <= len(w) <= 20 and lev(seen, w) <= (1 if len(seen) <= 3 else 2)}
            best = min(candidates, key=lambda c: (-round(value(c), 9), c))
            keep = best == seen or (kernels.confusion_cost(seen, best) > p.max_cost and best not in shares) or (known and value(best) - value(seen) < p.margin * conf)
            done.append(word if keep else best.capitalize() if word[0].isupper() else best)
        out.append(done)
    return out


def test_repairs_equal_brute_force(spark):
    rng = random.Random(11)
    words = "the quick brown fox runs over lazy dog and bear tree three there these those house horse mouse on or of off".split()
    book = [rng.choice(words) for _ in range(1500)]
    garble = lambda w: "".join(rng.choice(["rn", "m", "x", ""]) if rng.random() < 0.15 else c for c in w) or w
    lines = []
    for _ in range(60):
        line = []
        for w in (rng.choice(words) for _ in range(rng.randint(1, 7))):
            said = garble(w)
            said = said.capitalize() if rng.random() < 0.2 else said
            others = [(garble(w), round(rng.random(), 2)) for _ in range(rng.randint(0, 2))]
            line.append((said, round(rng.choice([0.2, 0.6, 0.95]), 2), others))
        lines.append(line)
    lex = lexicon.build(spark.createDataFrame([("b", i, w) for i, w in enumerate(book)], "book string, pos int, word string"))
    rows = spark.createDataFrame([("p", n, i, w, c, a) for n, line in enumerate(lines) for i, (w, c, a) in enumerate(line)], "image string, line_no int, pos int, word string, conf double, alternatives array<struct<word:string,share:double>>")
    p = correct.Parameters(lam=4.0, keep_unknown=0.8)
    got = {r["line_no"]: r["words"] for r in correct.correct(rows, lex, p).collect()}
    assert [got[n] for n in range(len(lines))] == brute(lines, book, p)


def test_a_text_model_judges_lines_in_context(spark):
    lex = model(spark)
    asked = spark.createDataFrame([("p", 0, 0, "tbe", 0.3), ("p", 1, 0, "fax", 0.3)], "image string, line_no int, pos int, word string, conf double").withColumn("alternatives", F.expr("cast(array() as array<struct<word:string,share:double>>)"))

    def scorer():
        return lambda texts: [50.0 * (t in ("the", "the fox")) for t in texts]

    got = {r["line_no"]: r["words"] for r in correct.correct(asked, lex, scorer=scorer).collect()}
    assert got == {0: ["the"], 1: ["fox"]}


def test_stored_lexicon(spark, tmp_path):
    corpus = spark.createDataFrame([("b", i, w) for i, w in enumerate("one two three two one".split())], "book string, pos int, word string")
    path = str(tmp_path / "lexicon")
    assert lexicon.load(spark, path, "v1") is None
    first = lexicon.cached(corpus, path, "v1")
    again = lexicon.cached(spark.createDataFrame([], corpus.schema), path, "v1")
    assert sorted(map(tuple, again.bigram.collect())) == sorted(map(tuple, first.bigram.collect())) and again.floor == first.floor
    assert lexicon.load(spark, path, "v2") is None
