"""The registered queries that have no SQL, on a small table against brute force."""

import pytest

from quirework.operators import kernels
from quirework.plans import queries as Q
from quirework.plans import synthetic as S

TEXTS = ["the corner of the barn has clear rn cl words once more today dear reader and so it goes on\nsecond line here", "Clear corn, born (again) in 1999.", "", None, "cl rn cl rn cl rn cl rn cl rn cl"]


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("small")
    rows = [(i, t, ["en", "de", "fr", "en", "es"][i], f"src{i % 2}", len(t or "")) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([(0, "the corner of the barn has corn and clear words"), (1, "dear reader")], "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path)


def read(words, k):
    """What source k reads, by the rules of plans.synthetic, as (word, place)."""
    _, period, place, seen, truth, *_ = S.SOURCES[k]
    out = []
    for i, w in enumerate(words):
        w = w.replace(seen, truth) if i % period == place else w
        out += [] if k == 1 and i % S.MISSED[0] == S.MISSED[1] else [(w, i)] * (2 if k == 2 and i % S.DOUBLED[0] == S.DOUBLED[1] else 1)
    return out


def lines():
    for d, text in enumerate(TEXTS):
        for n, line in enumerate((text or "").split("\n")):
            if line.split():
                yield f"{d}:{n}", line.split()


def test_word_error_rates(spark, small):
    levels = {0: "clean", 1: "medium", 2: "hard", 3: "clean", 4: "real"}
    want = {}
    for image, words in lines():
        for k, source in enumerate(S.SOURCES):
            rate = kernels.levenshtein_table(words, [w for w, _ in read(words, k)])[-1, -1] / len(words)
            for level in (levels[int(image[0])], "all"):
                want.setdefault((source[0], level), []).append(rate)
    got = {(r["system"], r["level"]): (r["wer"], r["n"]) for r in Q.QUERIES["wer_by_level"](spark, small).collect()}
    assert got == {k: (round(sum(v) / len(v), 6), len(v)) for k, v in want.items()}


def test_alignments(spark, small):
    got = {}
    for r in Q.QUERIES["word_alignment"](spark, small).orderBy("step").collect():
        got.setdefault((r["image"], r["source"]), []).append((r["ri"], r["hi"]))
    want = {(image, s[0]): kernels.align(words, [w for w, _ in read(words, k)]) for image, words in lines() for k, s in enumerate(S.SOURCES)}
    assert got == want


def test_edit_costs(spark, small):
    got = {(r["seen"], r["truth"]): r["cost"] for r in Q.QUERIES["confusion_costs"](spark, small).collect()}
    want = {(w, words[i]) for _, words in lines() for k in range(3) for w, i in read(words, k) if w != words[i]}
    assert set(got) == want and all(abs(c - kernels.confusion_cost(*p)) < 1e-6 for p, c in got.items())


def test_neighbours_of_unknown_words(spark, small):
    plain = lambda w: "".join(c for c in w.lower() if c.isalnum())
    lexicon = {plain(w) for t in TEXTS for w in (t or "").split() if plain(w).isalpha()}
    bigrams = {plain(w) for t in TEXTS for w in (t or "").split()} - {""}
    lexicon |= {w for w in bigrams if w.isalpha()}
    asked = {plain(w) for _, words in lines() for k in range(3) for w, _ in read(words, k)} - lexicon
    want = {(q, w) for q in asked if 2 <= len(q) <= 20 for w in lexicon if 2 <= len(w) <= 20 and kernels.levenshtein_table(q, w)[-1, -1] <= (1 if len(q) <= 3 else 2)}
    assert {(r["query"], r["word"]) for r in Q.QUERIES["neighbors"](spark, small).collect()} == want


def test_fused_and_repaired_pages(spark, small):
    fused = {r["image"]: r["reading"] for r in Q.QUERIES["fused_text"](spark, small).collect()}
    # two of three sources are right at each place but where all change, so the vote gives the text back on lines of the reader's width
    assert set(fused) == {image for image, _ in lines()}
    assert fused["0:1"] == "second line here" and fused["1:0"].split() == TEXTS[1].split()
    assert fused["0:0"].count("\n") == 2 and fused["0:0"].split("\n")[0] == " ".join(TEXTS[0].split()[:8])
    repaired = {r["image"]: r["reading"] for r in Q.QUERIES["repaired_text"](spark, small).collect()}
    assert set(repaired) == set(fused) and repaired["1:0"].split()[-1] == "1999."
