import random

import numpy as np

from quirework.operators import kernels, voting


def readings(spark, said):
    rows = [("p", s, w, i, [[{"word": x, "conf": c} for x in line.split()] for line in text.split("\n")] if text else []) for i, (s, w, text, c) in enumerate(said)]
    return spark.createDataFrame([(r[0], r[1], r[4]) for r in rows], f"image string, source string, lines {voting.LINES}"), spark.createDataFrame([(r[1], float(r[2]), r[3]) for r in rows], "source string, weight double, ord int")


def fused(spark, said, char_vote=False):
    rows, weights = readings(spark, said)
    got = voting.page_text(voting.fuse(rows, weights, char_vote=char_vote)).collect()
    return got[0]["reading"] if got else ""


#: Cases with exact expectations.
def test_votes(spark):
    three = lambda a, b, c, conf=0.9: [("a/x", 1, a, conf), ("b/x", 1, b, conf), ("c/x", 1, c, conf)]
    assert fused(spark, three("the quick brovvn fox", "the quick brown fox", "the qulck brown fox")) == "the quick brown fox"
    assert fused(spark, three("the brown fox", "the quick brown fox", "the quick brown fox")) == "the quick brown fox"
    assert fused(spark, [("a/x", 1, "hello ~ world", 0.2), ("b/x", 1, "hello world", 0.9), ("c/x", 1, "hello world", 0.9)]) == "hello world"
    assert fused(spark, three("one two\nthree", "one two three", "one two three")) == "one two\nthree"
    assert fused(spark, [("a/x", 1, "", 0.9), ("b/x", 1, "hello world", 0.9)]) == "hello world"
    assert fused(spark, [("a/x", 1, "", 0.9), ("b/x", 1, "", 0.9)]) == ""


def test_character_votes(spark):
    said = [("a/x", 1, "60.000", 0.6), ("b/x", 1, "60,000", 0.6), ("c/x", 1, "00.000", 0.6), ("d/x", 1, "6O.000", 0.6)]
    assert fused(spark, said, char_vote=True) == "60.000"
    assert fused(spark, [("a/x", 1, "hello", 0.9), ("b/x", 1, "hello", 0.9), ("c/x", 1, "hallo", 0.9)], char_vote=True) == "hello"


def test_agreement(spark):
    rows, _ = readings(spark, [("a/x", 1, "hello world", 0.9), ("b/x", 1, "hello world", 0.9), ("c/x", 1, "", 0.9)])
    get = lambda names: voting.agreement(rows, names).first()["agreement"]
    assert (get(["a/x", "b/x"]), get(["a/x", "c/x"]), get(["a/x"])) == (1.0, 0.0, 1.0)


def scripts(n, m):
    """All ways to pair n with m words, as steps: 0 change or keep, 1 miss, 2 insert."""
    if n and m:
        yield from ([*s, 0] for s in scripts(n - 1, m - 1))
    if n:
        yield from ([*s, 1] for s in scripts(n - 1, m))
    if m:
        yield from ([*s, 2] for s in scripts(n, m - 1))
    if not n and not m:
        yield []


def test_alignment_is_the_best_of_all():
    def cost(script, ref, hyp):
        i = j = 0
        total, pairs = 0.0, []
        for step in script:
            pairs.append((None if step == 2 else i, None if step == 1 else j))
            if step == 0:
                a, b = ref[i].lower(), hyp[j].lower()
                total += 0.0 if a == b else float(kernels.levenshtein_table(a, b)[-1, -1]) / max(len(a), len(b))
            else:
                total += 1
            i, j = i + (step != 2), j + (step != 1)
        return total, pairs

    rng = random.Random(1)
    words = ["the", "The", "of", "rn", "m", "brown", "brovvn", "x"]
    for _ in range(60):
        ref, hyp = ([rng.choice(words) for _ in range(rng.randint(0, 4))] for _ in "ab")
        # of the cheapest, the one that changes rather than misses and misses rather than inserts, seen from the end
        best = min((round(cost(s, ref, hyp)[0], 9), s[::-1], s) for s in scripts(len(ref), len(hyp)))
        assert kernels.align(ref, hyp) == cost(best[2], ref, hyp)[1]


def test_alignment_of_long_texts_does_not_depend_on_the_band():
    rng = random.Random(3)
    ref = [rng.choice(["a", "bb", "ccc", "dd", "e"]) + str(rng.randrange(50)) for _ in range(300)]
    hyp = [w for w in ref if rng.random() > 0.1]
    hyp[100:100] = ["zz"] * 25
    whole = kernels._path(*kernels._band([w.lower() for w in ref], hyp, 400), len(hyp), 400)
    assert kernels.align(ref, hyp) == whole and kernels.align([], hyp) == [(None, j) for j in range(len(hyp))]


def test_confusion_cost_is_the_least_over_all_edits():
    def least(seen, truth, begun=False):
        if not seen and not truth:
            return 0.0
        ways = []
        if seen:
            ways.append((1.4 if begun else 1.0) + least(seen[1:], truth, begun))
        if truth:
            ways.append(1.0 + least(seen, truth[1:], True))
        for p in range(1, min(3, len(seen)) + 1):
            for q in range(1, min(3, len(truth)) + 1):
                a, b = seen[:p], truth[:q]
                price = kernels.CONFUSIONS.get((a, b), 1.0 if p == q == 1 else None)
                if p == q == 1 and a.lower() == b.lower():
                    price = 0.0 if a == b else 0.6
                if price is not None:
                    ways.append(price + least(seen[p:], truth[q:], True))
        return min(ways)

    rng = random.Random(2)
    for _ in range(120):
        a, b = ("".join(rng.choice("rnmvwlIi1clD") for _ in range(rng.randint(0, 4))) for _ in "ab")
        assert abs(kernels.confusion_cost(a, b) - least(a, b)) < 1e-9


def test_ballots():
    assert kernels.ballots("abc", "abc") == [(0, 1, "a"), (1, 1, "b"), (2, 1, "c")]
    assert kernels.ballots("abc", "axc") == [(0, 1, "a"), (1, 1, "x"), (2, 1, "c")]
    assert sorted(kernels.ballots("ab", "aXYb")) == [(0, 1, "a"), (1, 0, "XY"), (1, 1, "b")]
    assert kernels.ballots("abc", "ac") == [(0, 1, "a"), (1, 1, ""), (2, 1, "c")] and kernels.ballots("a", "ab") == [(0, 1, "a"), (1, 0, "b")]


def misread(rng, words):
    out = []
    for w in words:
        x = rng.random()
        out += [] if x < 0.08 else [w] if x < 0.8 else [w.replace("m", "rn")] if x < 0.9 else [w, rng.choice(words)]
    return out


def test_alignments_of_many_pairs_ask_for_few_gaps_and_equal_the_whole_table(monkeypatch):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcmrst") for _ in range(rng.randint(1, 7))) for _ in range(200)] + ["tsar", "rats", "star", "arts"]
    refs = [[rng.choice(words) for _ in range(rng.choice([1, 5, 40, 90]))] for _ in range(60)]
    pairs = [(r, misread(rng, r)) for r in refs] + [(r, rng.sample(words, 12)) for r in refs[:10]] + [([], words[:3]), (words[:3], [])]
    asked, gap = set(), kernels.folded_gap
    monkeypatch.setattr(kernels, "folded_gap", lambda a, b: asked.add((a, b)) or gap(a, b))
    known = sorted({w for p in pairs for side in p for w in side})
    number = {w: i for i, w in enumerate(known)}
    coded = [[[number[w] for w in side] for side in p] for p in pairs]
    whole = [kernels._path(*kernels._band(r, h, 200), len(h), 200) for r, h in pairs]
    every = len(asked)
    for cells, rounds in ((kernels._BAND_CELLS, kernels._BAND_ROUNDS), (150, 1)):
        monkeypatch.setattr(kernels, "_BAND_CELLS", cells)
        monkeypatch.setattr(kernels, "_BAND_ROUNDS", rounds)
        asked.clear()
        found = kernels.alignments([np.array(r, dtype=np.int64) for r, _ in coded], [np.array(h, dtype=np.int64) for _, h in coded], known)
        assert [[(None if i < 0 else i, None if j < 0 else j) for i, j in zip(*(x.tolist() for x in f))] for f in found] == whole
        assert rounds == 1 or len(asked) < every / 10


def test_pages_are_fused_in_one_pass_as_step_by_step(spark):
    rng = random.Random(7)
    words = ["corner", "brown", "fox", "a", "mm", "Dear", "x1"]
    rows, names = [], ["a/x", "b/x", "c/x", "d/x"]
    for page in range(25):
        text = [rng.choice(words) for _ in range(rng.choice([0, 1, 6, 30]))]
        for s in names[: rng.randint(1, 4)]:
            said = [(w, rng.randrange(50, 100) / 100) for w in misread(rng, text)]
            rows.append((f"p{page}", s, [said[k : k + 5] for k in range(0, len(said), 5)] + [[]] * rng.randint(0, 1)))
    readings = spark.createDataFrame(rows, f"image string, source string, lines {voting.LINES}")
    weights = spark.createDataFrame([(s, w, i) for i, (s, w) in enumerate(zip(names, (0.45, 0.38, 0.22, 0.3)))], "source string, weight double, ord int")
    ranked = voting.with_trust(voting.selected(readings, weights, 0.52))
    votes = voting.network(ranked)
    tallied = voting.tally(votes)
    want = {(r["image"], r["line_no"]): r["words"] for r in voting.layout(voting.char_voted(votes, voting.winners(tallied)), ranked.filter("pivot_rank = 1")).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")  # pages go on in the next batch
    got = voting.fuse(readings, weights, 0.52, alternatives=True).collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    near = lambda ws: [(tuple(w["slot"]), w["word"], round(w["share"], 9), round(w["engine_conf"], 9)) for w in ws]
    assert {(r["image"], r["line_no"]): near(r["words"]) for r in got} == {k: near(v) for k, v in want.items()} and len(got) == len(want) > 25
    said = {}
    for r in voting.candidates(tallied).collect():
        said.setdefault((r["image"], tuple(r["slot"])), []).append((r["reading"], round(r["share"], 9)))
    assert all([(a["word"], round(a["share"], 9)) for a in x] == sorted(said[r["image"], tuple(w["slot"])]) for r in got for w, x in zip(r["words"], r["alternatives"]))
