import random
import time

from pyspark.sql import functions as F

from quirework.functions import text as T
from quirework.operators import kernels


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(new[-1] + 1, row[j + 1] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def values(spark, rows, schema, expression):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expression).collect()]


def test_rates_of_known_cases(spark):
    rows = [("abcd", "abed"), ("Hello\nworld", "Hello   world"), ("", ""), ("", "x")]
    assert values(spark, rows, "a string, b string", T.cer(F.col("a"), F.col("b"))) == [0.25, 0.0, 0.0, 1.0]
    rows = [("the quick brown fox", "the quick brawn fox"), ("", ""), ("", "x")]
    assert values(spark, rows, "a string, b string", T.wer(F.col("a"), F.col("b"))) == [0.25, 0.0, 1.0]


def test_distances_equal_a_naive_table(spark):
    rng = random.Random(5)
    alphabet = "abé日 "
    rows = [("".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))), "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))) for _ in range(200)]
    rows.append(("a" * 900, "b" * 700))
    assert values(spark, rows, "a string, b string", T.distance(F.col("a"), F.col("b"))) == [lev(a, b) for a, b in rows]
    got = values(spark, rows, "a string, b string", T.word_distance(T.words(F.col("a")), T.words(F.col("b"))))
    assert got == [lev(a.split(), b.split()) for a, b in rows]


def test_many_distinct_words(spark):
    rows = [(" ".join(f"w{i}" for i in range(60_000)), " ".join(f"w{i}" for i in range(60_000) if i % 20_000))]
    assert values(spark, rows, "a string, b string", T.word_distance(F.slice(T.words(F.col("a")), 54_000, 3000), F.slice(T.words(F.col("a")), 54_001, 3000))) == [2]
    codes = F.transform(F.array(*(F.lit(x) for x in (1, 0xD7FF, 0xD800, 60_000))), lambda n: n)
    assert values(spark, [(1,)], "x int", F.length(T.as_codes(F.transform(codes, lambda n: n.cast("string")), F.transform(F.sequence(F.lit(1), F.lit(60_000)), lambda n: n.cast("string"))))) == [4]


def test_word_multisets(spark):
    rows = [("a b c", "c b a"), ("a b c d", "a b"), ("", ""), ("", "x"), ("a a b", "a b b"), ("a", "b")]
    got = values(spark, rows, "a string, b string", T.bow_f1(F.col("a"), F.col("b")))
    assert [round(x, 6) for x in got] == [1.0, round(2 / 3, 6), 1.0, 0.0, round(2 / 3, 6), 0.0]


def test_words_split_at_every_blank_of_python(spark):
    blanks = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    rows = [(f"a{b}b",) for b in blanks] + [("a​b",), (" x  y ",), ("",)]
    assert values(spark, rows, "t string", T.normalize(F.col("t"))) == ["a b"] * len(blanks) + ["a​b", "x y", ""]


def test_cores_case_and_protection(spark):
    rows = [("(Hello,",), ("...",), ("don't!",), ("a",)]
    assert [tuple(x) for x in values(spark, rows, "t string", T.edges(F.col("t")))] == [("(", "Hello", ","), ("...", "", ""), ("", "don't", "!"), ("", "a", "")]
    words = ["", "12.50", "a1", "ab1", "x@y", "USA", "LONGER", "to-day", "plain", "50%"]
    assert values(spark, [(w,) for w in words], "t string", T.protected(F.col("t"))) == [True, True, True, False, True, True, False, True, False, True]
    cases = [("HELLO", "word"), ("Hello", "word"), ("hello", "word"), ("H", "word")]
    assert values(spark, cases, "a string, b string", T.apply_case(F.col("a"), F.col("b"))) == ["WORD", "Word", "word", "Word"]


def test_deletes_and_rejoining(spark):
    def naive(w, depth):
        out = {w}
        for _ in range(depth):
            out |= {x[:i] + x[i + 1 :] for x in out for i in range(len(x))}
        return out

    for w in ("a", "abc", "aab", "word"):
        assert set(values(spark, [(w,)], "t string", T.deletes(F.col("t"), 2))[0]) == naive(w, 2)
    assert values(spark, [('He said , " yes " ( it \'s ) .',)], "t string", T.detokenize(F.col("t"))) == ['He said, "yes" (it\'s).']
    assert values(spark, [("“x” — ‘y’ ñz",)], "t string", T.plain_ascii(F.col("t"))) == ["\"x\" -- 'y' z"]
    assert [tuple(x) for x in values(spark, [("tesseract-eng_ft-line/raw",)], "t string", T.engine_parts(T.source_parts(F.col("t"))["engine"]))] == [("tesseract", "eng_ft", True)]


def test_distances_of_long_texts_take_seconds(spark):
    """Bands of the lengths' product took minutes for these."""
    rng = random.Random(7)
    near, far = ("".join(rng.choice("abcdefgh ") for _ in range(100_000)) for _ in range(2))
    changed = list(near)
    for k in range(50, 100_000, 50):
        changed[k] = "xy"  # a change and an extra character
    began = time.perf_counter()
    got = values(spark, [(near, "".join(changed)), (near, near)], "a string, b string", T.distance(F.col("a"), F.col("b")))
    assert got[1] == 0 and got[0] == 2 * len(range(50, 100_000, 50))
    # far apart: many edits go through bit sets
    assert kernels.distances([near[:3000]], [far[:2500]]) == [lev(near[:3000], far[:2500])]
    assert time.perf_counter() - began < 40


def test_pairs_of_one_table_keep_apart(spark):
    rng = random.Random(9)
    for alphabet in ("ab", "aé日😀", "".join(map(chr, range(0x4E00, 0x4E00 + 900)))):
        a = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 50))) for _ in range(300)]
        b = [x[:20] + x[22:] if rng.random() < 0.5 else "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 50))) for x in a]
        want = [lev(x, y) for x, y in zip(a, b)]
        assert kernels.distances(a, b).tolist() == want == kernels.distances([list(x) for x in a], [list(y) for y in b]).tolist()


def test_rates_of_null_texts(spark):
    rows = [(None, "x"), ("x", None), ("", None), (None, None), ("a b", "a c")]
    assert values(spark, rows, "a string, b string", T.cer(F.col("a"), F.col("b"))) == [None, None, 1.0, None, 1 / 3]
    assert values(spark, rows, "a string, b string", T.wer(F.col("a"), F.col("b"))) == [None, None, 1.0, None, 0.5]


def test_word_multisets_of_long_lines_cost_their_words_once(spark):
    words = [f"w{i}" for i in range(60_000)] * 2
    began = time.perf_counter()
    assert values(spark, [(" ".join(words), " ".join(words[::-1][:90_000]))], "a string, b string", T.bow_f1(F.col("a"), F.col("b"))) == [2 * 90_000 / 210_000]
    assert values(spark, [(["a", "b", "b"], ["b", "b", "b", "c"]), ([], ["a"])], "a array<string>, b array<string>", T.shared_words(F.col("a"), F.col("b"))) == [2, 0]
    assert time.perf_counter() - began < 30  # looking each word up in the whole line took minutes
