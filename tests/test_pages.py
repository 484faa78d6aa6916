"""Page sources and sinks, page repairs, and the pipeline of readers, with drawn bars for text and stub readers."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirework.operators import images as I
from quirework.plans import generate, pages, tuning
from quirework.sources import pages as P
from quirework.sources import readers
from quirework.sources.io import Config


def page(h=120, w=200, lines=4):
    out = np.full((h, w), 230, np.uint8)
    for k in range(lines):
        y = 15 + k * 25
        for x in range(15, w - 30, 22):
            out[y : y + 8, x : x + 14] = 20
    return out


def test_png_round_trip():
    gray = np.arange(35, dtype=np.uint8).reshape(5, 7)
    assert (P.from_png(P.png(gray)) == gray).all() and (I.decode(P.decoded(P.png(gray))) == gray).all()
    line = np.array([3, 1, 4, 1, 5, 9], dtype=np.int64)
    above = np.array([0, 0, 0, 10, 20, 30, 40, 50, 60], dtype=np.int64)
    for kind in range(5):
        made, out = np.zeros(9, dtype=np.int64), P._unfiltered(kind, line, above, 3)
        made[3:] = out
        for i in range(6):  # what each filter subtracts, by its definition
            a, b, c = made[i], above[i + 3], above[i]
            p = a + b - c
            guess = [0, a, b, (a + b) // 2, min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]][kind]
            assert (line[i] + guess) % 256 == out[i]


def test_images_are_read_by_spark(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(P.png(page()))
    (tmp_path / "bad.png").write_bytes(b"nothing")
    got = P.read_images(spark, str(tmp_path)).collect()
    assert [r["image"] for r in got] == ["a.png"] and (I.decode(got[0]["picture"].asDict()) == page()).all()


def test_receipts_are_joined_by_stem(spark, tmp_path):
    for d in ("img", "box"):
        (tmp_path / d).mkdir()
    for k in range(4):
        (tmp_path / "img" / f"x{k}.jpg").write_bytes(b"jpg")
        if k != 2:
            (tmp_path / "box" / f"x{k}.csv").write_text("10,30,40,30,40,40,10,40,B, C\n0,30,8,30,8,40,0,40,A\n0,0,9,0,9,9,0,9,TOP\nbad line\n")
    got = {r["image"]: r for r in P.read_receipts(spark, str(tmp_path / "img"), str(tmp_path / "box"), n=4, dev=2).collect()}
    assert sorted(got) == ["x0.jpg", "x1.jpg", "x3.jpg"] and got["x0.jpg"]["text"] == "TOP\nA B, C" and got["x3.jpg"]["split"] == "test" and got["x1.jpg"]["split"] == "dev"


def test_annotated_receipts(spark, tmp_path):
    quad = lambda x0, y0, x1, y1: {"x1": x0, "y1": y0, "x2": x1, "y2": y0, "x3": x1, "y3": y1, "x4": x0, "y4": y1}
    word = lambda t, row, *box: {"text": t, "row_id": row, "quad": quad(*box)}
    truth = {"meta": {"image_id": 7}, "valid_line": [{"words": [word("b", 2, 60, 40, 80, 52), word("a", 2, 10, 41, 40, 53)]}, {"words": [word("top", 5, 10, 10, 40, 22), word(" ", 5, 1, 1, 2, 2), word("tiny", 6, 1, 80, 5, 84)]}]}
    rows = [((bytearray(P.png(page())),), json.dumps(truth))]
    spark.createDataFrame(rows, "image struct<bytes:binary>, ground_truth string").write.parquet(str(tmp_path / "cord"))
    got = P.read_cord(spark, str(tmp_path / "cord"), "dev").first()
    assert got["image"] == "cord_dev_0007.png" and got["text"] == "top\na b\ntiny"
    filled = I.decode(got["picture"].asDict())
    assert filled[110, 190] == filled[100, 150] and filled.shape == (120, 200)
    cuts = {r["text"]: I.decode(r["picture"].asDict()).shape for r in P.cord_lines(spark, str(tmp_path / "cord")).collect()}
    assert cuts == {"top": (16, 34), "a b": (17, 74)}


def test_handwriting(spark, tmp_path):
    poly = lambda x0, y0, x1, y1: {"x0": x0, "y0": y0, "x1": x1, "y1": y0, "x2": x1, "y2": y1, "x3": x0, "y3": y1}
    words = [{"text": "two", "line_idx": 1, "polygon": poly(60, 60, 90, 80)}, {"text": "one", "line_idx": 1, "polygon": poly(10, 60, 50, 80)}, {"text": "top", "line_idx": 3, "polygon": poly(10, 10, 50, 30)}, {"text": "%math%", "line_idx": 3, "polygon": poly(60, 10, 90, 30)}]
    spark.createDataFrame([("p/scan 1.jpg", (bytearray(P.png(page())),), json.dumps(words))], "filename string, image struct<bytes:binary>, annotations string").write.parquet(str(tmp_path / "g"))
    whole, lines = P.read_gnhk(spark, str(tmp_path / "g"))
    assert [(r["image"], r["text"], r["level"]) for r in whole.collect()] == [("scan 1.jpg", "top\none two", "gnhk_page")]
    assert [(r["text"], I.decode(r["picture"].asDict()).shape) for r in lines.collect()] == [("one two", (32, 92))]
    names = spark.createDataFrame([(f"p{i}",) for i in range(10)], "image string")
    split = P.reserved_pages(names, 3, "s")
    assert split.filter("split = 'dev'").count() == 3
    P.write_reserved(split, str(tmp_path / "reserved"))
    assert spark.read.json(str(tmp_path / "reserved")).count() == 7
    spark.createDataFrame([((bytearray(b"%d" % i),), f"He said , \" x \" {i}") for i in range(9)], "image struct<bytes:binary>, text string").write.parquet(str(tmp_path / "iam"))
    got = P.read_iam(spark, str(tmp_path / "iam"), n_dev=2, n_test=4).collect()
    assert sorted(r["split"] for r in got) == ["dev"] * 2 + ["test"] * 4 and len({r["image"] for r in got}) == 6 and got[0]["text"].startswith('He said, "x" ')


def test_fonts_by_split(spark, tmp_path):
    for family in ("lora", "oswald", "caveat", "other"):
        (tmp_path / "fonts" / family).mkdir(parents=True)
        (tmp_path / "fonts" / family / "x.ttf").write_bytes(b"x")
    (tmp_path / "sys").mkdir()
    (tmp_path / "sys" / "s.ttf").write_bytes(b"x")
    names = lambda *a: sorted((r["family"], r["handwriting"]) for r in P.fonts(spark, str(tmp_path / "fonts"), *a).collect())
    assert names("dev") == [("lora", False)] and names("test") == [("oswald", False)]
    assert names("train", str(tmp_path / "sys")) == [("caveat", True), ("other", False), ("system", False)]
    (tmp_path / "none" / "x").mkdir(parents=True)
    (tmp_path / "none" / "x" / "a.txt").write_text("")
    with pytest.raises(RuntimeError):
        P.fonts(spark, str(tmp_path / "none"), "test")


def test_manifests_and_training_lines(spark, tmp_path):
    rows = [(f"l{i}", f"text {i}", I.encode(page(30, 60, 1))) for i in range(60)]
    lines = spark.createDataFrame(rows, f"image string, text string, picture {I.IMAGE}")
    P.write_manifest(lines.limit(2), str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m" / "manifest")).columns == ["image", "text"]
    assert (P.from_png(spark.read.parquet(str(tmp_path / "m" / "pages")).first()["png"]) == page(30, 60, 1)).all()
    made = P.training_lines(lines, least=10)
    assert {r["part"]: r["count"] for r in made.groupBy("part").count().collect()} == {"eval": 10, "train": 50}
    assert made.filter("image = 'l3'").first()["box"] == "WordStr 0 0 60 30 0 #text 3\n\t 0 0 60 30 0\n"
    P.write_training_lines(made, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t" / "lines")).filter("part = 'eval'").count() == 10
    mixed = P.mixed_lists(lines.limit(4).select("image"), lines.limit(2).select("image"))
    assert mixed.count() == 10 and [r["image"] for r in mixed.collect()] == [r["image"] for r in mixed.collect()]


def test_turning_takes_in_the_corners():
    gray = page()
    turned = I.rotate(gray, 10.0)
    assert turned.shape[0] > 120 and turned.shape[1] > 200 and (I.rotate(gray, 90) == np.rot90(gray)).all() and I.rotate(gray, 0.05) is gray
    wide = page(200, 400, 7)
    assert abs(I.skew(I.rotate(wide, 3.0)) + 3) <= 0.4
    assert I.shrunk(np.full((90, 40), 7, np.uint8), 30).shape == (30, 14)
    noisy = (page(40, 60, 1) + np.random.default_rng(0).normal(0, 20, (40, 60))).clip(0, 255).astype(np.uint8)
    assert I.noise_sigma(I.denoised(noisy, 60.0, reach=4)) < I.noise_sigma(noisy) / 2
    assert I.crop(gray, (0, 0, 5, 5), 0) is None and I.crop(gray, (0, 0, 20, 20), 5).shape == (25, 25)


def box(text, score, x0, y0, x1, y1):
    return {"text": text, "score": score, "x0": x0, "y0": y0, "x1": x1, "y1": y1}


def test_pages_are_put_right():
    upright = lambda g: [box("some words", 0.9, 0, 0, 90, 10)] if g.shape[1] >= g.shape[0] else [box("x", 0.4, 0, 0, 9, 90)]
    gray = page()
    assert I.auto_fixed(gray, upright)[1] == [] and I.auto_fixed(255 - gray, upright)[1] == ["invert"]
    dark = (gray * 0.3).astype(np.uint8)
    fixed, done, _ = I.auto_fixed(dark, upright)
    assert done == ["exposure"] and np.median(fixed) > 200
    mark = gray.copy()
    mark[:10, :10] = 0
    sideways = lambda g: [box("x", 0.4, 0, 0, 9, 90)] if g.shape[0] > g.shape[1] else [box("many readable words here", 0.9, 0, 0, 90, 10)] if g[0, 0] == 0 else []
    fixed, done, boxes = I.auto_fixed(np.rot90(mark), sideways)
    assert done == ["rotate270"] and boxes == [] and (fixed == mark).all()
    assert I.auto_fixed(np.rot90(gray), upright)[1] == []  # both turns read alike
    head = lambda g: [box("many readable words here", 0.9, 0, 0, 90, 10)] if g[0, 0] == 0 else [box("unsure", 0.6, 0, 0, 50, 10)]
    assert I.auto_fixed(np.rot90(mark, 2), head)[1] == ["rotate180"] and I.auto_fixed(mark, head)[1] == []


def stubs():
    """A reader that reads the number of black pixels of the first column and says it in its own way, and a box reader; made here, so that workers get their code."""

    class Says:
        def __init__(self, form):
            self.form = form

        def recognize_words(self, picture):
            return [[(w, 0.9) for w in self.form.format(int((I.decode(picture)[:, 0] == 0).sum())).split()]]

    def stub_boxes():
        return lambda gray: [{"text": "words", "score": 0.95, "x0": 0, "y0": 0, "x1": 50, "y1": 10}]

    return Says, stub_boxes


def test_recognition_by_route(spark):
    Says, stub_boxes = stubs()  # noqa: N806
    rng = np.random.default_rng(2)
    rows = []
    for k in range(3):
        gray = page()
        gray[:k, 0] = 0
        rows.append((f"p{k}", I.encode(gray)))
    noisy = (page() + rng.normal(0, 40, (120, 200))).clip(1, 255).astype(np.uint8)
    rows.append(("noisy", I.encode(noisy)))
    pictures = spark.createDataFrame(rows, f"image string, picture {I.IMAGE}")
    # b disagrees on pages with one dark pixel only
    factories = {"a": lambda: Says("page number {}"), "b": lambda: Says("page number {}"), "c": lambda: Says("page number {} full"), "n": lambda: Says("noise")}
    config = Config(sources={"a/raw": 1.0, "b/raw": 1.0, "c/raw": 5.0}, char_vote=False, use_lm=False, noise_threshold=8.0, noisy={"sources": {"n/raw": 1.0}}, cascade={"cheap": ["a/raw", "b/raw"]})
    got = {r["image"]: (r["route"], r["reading"]) for r in pages.recognize(pictures, config, stub_boxes, factories, "balanced").collect()}
    assert got == {"p0": ("cheap", "page number 0"), "p1": ("cheap", "page number 1"), "p2": ("cheap", "page number 2"), "noisy": ("noisy", "noise")}
    got = {r["image"]: (r["route"], r["reading"]) for r in pages.recognize(pictures, config, stub_boxes, factories, "accurate").collect()}
    assert got["p1"] == ("full", "page number 1 full") and got["noisy"] == ("noisy", "noise")
    factories["b"] = lambda: Says("other text {}")
    got = {r["image"]: (r["route"], r["reading"]) for r in pages.recognize(pictures, config, stub_boxes, factories, "fast").collect()}
    assert got["p2"] == ("full", "page number 2 full")
    samples = spark.createDataFrame([("p0", "clean", "page number 0", "d"), ("p1", "hard", "page number 1", "d")], "image string, level string, text string, dataset string")
    report = {(r["model"], r["variant"]): r for r in pages.ablate(samples, pictures, ["a"], factories).collect()}
    assert sorted(v for _, v in report) == sorted(I.VARIANTS) and report["a", "raw"]["all"] == 0.0
    times = pages.time_sources(pictures.withColumn("dataset", F.lit("d")), config, stub_boxes, factories, per_set=2).collect()
    assert sorted(r["source"] for r in times) == ["a/raw", "auto_fix", "b/raw", "c/raw", "n/raw"]
    scored = pages.evaluate_live(spark, samples, pictures, ["a/raw"], factories, limit=1).collect()
    assert [(r["image"], r["cer"], r["bow"]) for r in scored] == [("p0", 0.0, 1.0)]


def test_line_readers():
    gray = page()
    detect = lambda g: [(0, 40, 60, 52), (80, 40, 140, 52), (0, 10, 60, 22), (0, 0, 3, 3)]
    reader = readers.LineReader(detect, lambda cut: (f"w{cut.shape[1]}", 0.7))
    assert reader.recognize_words(I.encode(gray)) == [[("w62", 0.7)], [("w62", 0.7), ("w64", 0.7)]]
    assert readers.LineReader(detect, lambda cut: ("a b", 0.5), whole=True).recognize_words(I.encode(gray)) == [[("a", 0.5), ("b", 0.5)]]
    boxes = lambda g: [box("sure", 0.9, 0, 10, 60, 22), box("bad", 0.2, 0, 40, 190, 45), box("gone", 0.2, 300, 300, 310, 310)]
    pieces = lambda cuts: [(f"p{len(cuts)}", 0.8), ("no", 0.3)]
    assert readers.WideLineReader(boxes, pieces).recognize_words(I.encode(gray)) == [[("sure", 0.9)], [("p2", 0.8)]]


def test_text_models_score_distinct_texts(spark):
    def factory():
        return lambda texts: [float(len(set(texts)) == len(texts)) * len(t) for t in texts]

    rows = spark.createDataFrame([("aa",), ("aa",), ("b",)], "text string")
    assert sorted((r["text"], r["logp"]) for r in readers.log_probabilities(rows.coalesce(1), factory).collect()) == [("aa", 2.0), ("aa", 2.0), ("b", 1.0)]


def test_routes_and_searches(spark):
    scored = spark.createDataFrame([("d", f"p{i}", s, c) for i in range(4) for s, c in (("m", 0.1 if i < 2 else 0.9), ("x", 0.5))], "dataset string, image string, system string, cer double")
    sigmas = spark.createDataFrame([("p2", 5.0), ("p3", 5.0), ("p1", 1.0)], "image string, sigma double")
    got = {r["threshold"]: round(r["cer"], 6) for r in tuning.route_errors(scored, sigmas, "m", [0.5, 3.0, 9.0]).collect()}
    assert got == {0.5: 0.4, 3.0: 0.3, 9.0: 0.5}
    samples = spark.createDataFrame([("d", f"p{i}", "clean", "the quick brown fox") for i in range(2)], "dataset string, image string, level string, text string")
    said = {"a/raw": ["the quick brown fox", "zzz"], "b/raw": ["the quick brovvn fox", "the quick brown fox"]}
    readings = spark.createDataFrame([("d", f"p{i}", s, [[(w, 0.9) for w in t[i].split()]]) for s, t in said.items() for i in range(2)], "dataset string, image string, source string, lines array<array<struct<word:string,conf:double>>>")
    noise = spark.createDataFrame([("p1", 5.0)], "image string, sigma double")
    config, _ = tuning.tune_route(spark, samples, readings, noise, Config(sources={"a/raw": 1.0}, char_vote=False), thresholds=(3.0,))
    assert config.noise_threshold == 3.0 and config.noisy == {"sources": {"b/raw": 1.0}, "char_vote": False}
    same, _ = tuning.tune_route(spark, samples, readings, noise, Config(sources={"b/raw": 1.0}, char_vote=False), thresholds=(9.0,))
    assert same.noisy is None
    assert len(tuning.word_grid(Config())) == 48


def test_damage_and_datasets(spark):
    gray = page()
    assert (generate.worn(gray, "clean", 1) == gray).all()
    for level in ("medium", "hard"):
        for rich in (False, True):
            a = generate.worn(gray, level, 5, rich=rich)
            assert (a == generate.worn(gray, level, 5, rich=rich)).all() and I.noise_sigma(a) > 2
    assert generate.stressed(gray, "rot90", 1).shape == (200, 120) and generate.stressed(gray, "lowlight", 1).mean() < 100 and (generate.stressed(gray, "inverted", 1) == 255 - gray).all()
    texts = spark.createDataFrame([(f"line {i}",) for i in range(40)], "text string")
    blank = page()
    made = generate.dataset(texts, lambda: lambda lines, seed: blank, 2, "stress").collect()
    assert sorted(r["image"] for r in made) == sorted(f"{k}_000{i}.png" for k in generate.STRESS for i in range(2))
