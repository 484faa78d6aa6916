import numpy as np
from pyspark.sql import functions as F

from quirework.operators import images as I


def page(angle=0.0):
    gray = np.full((260, 360), 235, np.uint8)
    for y in range(30, 230, 20):
        gray[y : y + 6, 30:330] = 20
    return I.rotate(gray, angle)


def test_skew_is_found_and_undone():
    assert I.skew(page()) == 0.0
    for angle in (3.0, -2.0):
        assert abs(I.skew(page(angle)) + angle) <= 0.4


def test_noise_grows():
    rng = np.random.default_rng(0)
    noisy = (page().astype(float) + rng.normal(0, 20, page().shape)).clip(0, 255).astype(np.uint8)
    assert I.noise_sigma(noisy) > 3 * I.noise_sigma(page())


def test_background_and_cuts():
    shaded = (page() * np.linspace(0.5, 1, 360)).astype(np.uint8)
    even = I.normalize_background(shaded)
    assert even.shape == shaded.shape and even[5].std() < shaded[5].std()
    line = np.full((20, 300), 255, np.uint8)
    for x in (5, 60, 150, 210):
        line[6:14, x : x + 40] = 0
    pieces = I.blank_gaps(line, 120)
    assert pieces[0][0] == 0 and pieces[-1][1] == 300 and all(a[1] == b[0] for a, b in zip(pieces, pieces[1:]))


def test_measures_and_decisions(spark):
    rows = [("a", I.encode(page())), ("b", I.encode(255 - page()))]
    df = spark.createDataFrame(rows, f"image string, picture {I.IMAGE}")
    got = {r["image"]: r for r in I.measured(df).withColumn("f", I.fixes(F.col("median"), F.col("p995"))).collect()}
    assert not got["a"]["f"]["invert"] and got["b"]["f"]["invert"]
    assert sorted((r["image"], r["variant"]) for r in I.variants(df, ["raw", "binary"]).collect()) == [("a", "binary"), ("a", "raw"), ("b", "binary"), ("b", "raw")]
    routes = spark.createDataFrame([(2.0,), (3.0,), (3.1,)], "s double").select(I.noise_route(F.col("s"), 3.0)).collect()
    assert [r[0] for r in routes] == ["main", "main", "noisy"]
