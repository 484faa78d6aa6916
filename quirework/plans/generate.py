"""Generated text and worn pages: tokens, lines, receipt lines and damage drawn by hashes of row and place, the same on every run.

Lines become pages through a renderer, which is a boundary: fonts and rasterisation are not part of this project.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirework.operators import images as I

#: Upper ends of the shares of words and of each other kind of token.
MIXTURE = [("word", 0.70), ("money", 0.76), ("date", 0.82), ("name", 0.87), ("mail", 0.91), ("invoice", 0.95), ("percent", 0.98), ("phone", 1.0)]


def uniform(seed: str, *keys: Column) -> Column:
    """A number in [0, 1) from 32 bits of a hash of the seed and keys."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(seed), *(k.cast("string") for k in keys))), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / 2.0**32


def token(kind: Column, word: Column, u: Column) -> Column:
    number = lambda low, high: (low + F.floor(u * (high - low))).cast("long").cast("string")
    two = lambda low, high: F.lpad(number(low, high), 2, "0")
    return (
        F.when(kind == "money", F.concat(F.lit("$"), number(1, 2000), F.lit("."), two(0, 100)))
        .when(kind == "date", F.concat_ws("/", two(1, 29), two(1, 13), number(1990, 2027)))
        .when(kind == "name", F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substring(word, F.lit(2), F.length(word)))))
        .when(kind == "mail", F.concat(F.lower(word), F.lit("@example.com")))
        .when(kind == "invoice", F.concat(F.lit("INV-"), number(10_000, 99_999)))
        .when(kind == "percent", F.concat(number(1, 100), F.lit("%")))
        .when(kind == "phone", F.concat_ws("-", number(200, 999), number(200, 999), number(1000, 9999)))
        .otherwise(word)
    )


def mixed_line(words: DataFrame, seed: str = "1234") -> DataFrame:
    """`words` (image, pos, word) with kind and token by the mixture."""
    u = uniform(seed, F.col("image"), F.col("pos"))
    kind = F.lit(MIXTURE[-1][0])
    for name, upto in reversed(MIXTURE[:-1]):
        kind = F.when(F.col("u") < upto, name).otherwise(kind)
    drawn = words.withColumn("u", u).withColumn("kind", kind)
    return drawn.withColumn("token", token(F.col("kind"), F.col("word"), uniform(f"{seed}-value", F.col("image"), F.col("pos")))).drop("u")


#: What receipts sell, what they call their sums, and how often which kind of line comes, as upper ends.
ITEMS = "COFFEE MILK TEA RICE CHICKEN BEEF FISH NOODLE BREAD SUGAR SALT WATER JUICE APPLE ORANGE BAG PEN PAPER TAPE GLUE SOAP OIL EGG CAKE SOUP SALAD STEAK BURGER FRIES PIZZA PLATE CUP BOX SET PACK MINI LARGE".split()
LABELS = ["TOTAL", "SUBTOTAL", "CASH", "CHANGE", "ROUNDING", "DISCOUNT", "TAX", "GST", "SERVICE CHARGE", "AMOUNT DUE", "TOTAL SALES (INCLUSIVE OF GST)", "TOTAL QTY", "NET TOTAL", "BALANCE", "PAID"]
RECEIPT = [("item", 0.30), ("sum", 0.50), ("date", 0.60), ("phone", 0.68), ("number", 0.76), ("tax", 0.84), ("text", 1.0)]
ENDINGS = [".", ".", ",", ":", ";", "", "?", "!"]
LEVEL_MIX = [("clean", 0.25), ("medium", 0.60), ("hard", 1.0)]
STRESS = ["rot90", "rot180", "rot270", "inverted", "color", "lowlight"]


def draw(seed: str, what: str, *keys: Column) -> Column:
    return uniform(f"{seed}-{what}", *keys)


def whole(u: Column, low: int, high: int) -> Column:
    """An integer from low to high, both included."""
    return (low + F.floor(u * (high - low + 1))).cast("long")


def pick(u: Column, values: list[str]) -> Column:
    return F.get(F.array(*map(F.lit, values)), F.floor(u * len(values)).cast("int"))


def kind_of(u: Column, shares: list[tuple[str, float]]) -> Column:
    out = F.lit(shares[-1][0])
    for name, upto in reversed(shares[:-1]):
        out = F.when(u < upto, name).otherwise(out)
    return out


def money(seed: str, what: str, *keys: Column) -> Column:
    return F.concat(whole(draw(seed, f"{what}-a", *keys), 0, 999).cast("string"), F.lit("."), F.lpad(whole(draw(seed, f"{what}-b", *keys), 0, 99).cast("string"), 2, "0"))


def plain_line(words: Column, seed: str, *keys: Column) -> Column:
    """Words as a line: the first letter large, a mark at the end."""
    line = F.array_join(words, " ")
    return F.concat(F.upper(F.substring(line, 1, 1)), F.substring(line, F.lit(2), F.length(line)), pick(draw(seed, "end", *keys), ENDINGS))


def receipt_lines(rows: DataFrame, words: Column, seed: str = "1234") -> DataFrame:
    """`rows` (image) with kind and line: items, sums, dates, phones, numbers, tax rates, and text of `words`, mostly in upper case."""
    key = F.col("image")
    u = lambda what: draw(seed, what, key)
    text = lambda c: c.cast("string")
    two = lambda what, low, high: F.lpad(text(whole(u(what), low, high)), 2, "0")
    names = F.array_join(F.transform(F.sequence(F.lit(1).cast("long"), whole(u("n"), 1, 4)), lambda k: pick(uniform(f"{seed}-item", key, k), ITEMS)), " ")
    item = F.concat(text(whole(u("count"), 1, 9)), F.lit(" "), names, F.lit(" "), pick(u("rate"), ["", "SR ", "ZR ", "RM "]), money(seed, "price", key))
    total = F.concat(pick(u("label"), LABELS), pick(u("gap"), [" : ", ": ", " ", " RM "]), pick(u("sign"), ["", "-"]), money(seed, "sum", key))
    date = F.concat(F.lit("DATE: "), two("day", 1, 28), F.lit("/"), two("month", 1, 12), F.lit("/"), text(whole(u("year"), 2010, 2030)), F.lit(" "), two("hour", 0, 23), F.lit(":"), two("minute", 0, 59), F.lit(":"), two("second", 0, 59))
    phone = F.concat(pick(u("tel"), ["TEL", "TEL:", "FAX", "PHONE"]), F.lit(" "), text(whole(u("area"), 0, 9)), text(whole(u("code"), 1, 9)), F.lit("-"), text(whole(u("local"), 1_000_000, 9_999_999)))
    number = F.concat(pick(u("what"), ["GST ID", "GST REG NO", "INVOICE NO", "DOC NO", "RECEIPT #", "BILL NO"]), pick(u("gap"), [": ", " : ", " "]), pick(u("prefix"), ["", "CS", "OR", "INV"]), text(whole(u("id"), 10**5, 10**12)))
    tax = F.concat_ws(" ", pick(u("rate"), ["SR", "ZR", "TX"]), pick(u("percent"), ["0", "6", "10"]), money(seed, "net", key), money(seed, "tax", key))
    line = plain_line(words, seed, key)
    made = {"item": item, "sum": total, "date": date, "phone": phone, "number": number, "tax": tax, "text": F.when(u("case") < 0.6, F.upper(line)).otherwise(line)}
    out = F.lit("")
    for name, value in made.items():
        out = F.when(F.col("kind") == name, value).otherwise(out)
    return rows.withColumn("kind", kind_of(u("kind"), RECEIPT)).withColumn("line", out)


def worn(gray: np.ndarray, level: str, seed: int, most: float | None = None, rich: bool = False) -> np.ndarray:
    """The page as a scan or photo of it would be: skewed, coarse, blurred, unevenly lit, noisy. clean: as it is.

    rich: also thick or thin ink, shaking and paper texture; clean pages are worn now and then. Perspective and JPEG are left out.
    """
    rng = np.random.default_rng(seed)
    if level == "clean":
        return worn(gray, "medium", seed + 1, most) if rich and rng.random() >= 0.7 else gray
    hard = level == "hard"
    if rich:
        if rng.random() < 0.5:
            pair = np.stack([gray, np.roll(gray, 1, 0), np.roll(gray, 1, 1), np.roll(gray, (1, 1), (0, 1))])
            gray = pair.min(axis=0) if rng.random() < 0.5 else pair.max(axis=0)
        if rng.random() < (0.4 if hard else 0.15):
            k = int(rng.choice([3, 5])) if hard else 3
            gray = np.mean([np.roll(gray, s, axis=int(rng.integers(2))) for s in range(-(k // 2), k // 2 + 1)], axis=0).astype(np.uint8)
        if rng.random() < 0.5:
            texture = I.blurred(rng.normal(0, 1, gray.shape), rng.uniform(2, 6)) * (10 if hard else 5)
            gray = (gray + texture).clip(0, 255).astype(np.uint8)
    angle = rng.uniform(-3, 3) if hard else rng.uniform(-1, 1)
    gray = I.rotate(gray, float(np.clip(angle, -most, most)) if most is not None else angle)
    h, w = gray.shape
    scale = rng.uniform(0.45, 0.65) if hard else rng.uniform(0.7, 0.9)
    small = I.resized(gray, max(1, int(h * scale)), max(1, int(w * scale)))
    a = I.blurred(I.resized(small, h, w).astype(np.float64), rng.uniform(0.6, 1.3) if hard else rng.uniform(0.2, 0.6))
    if hard or rng.random() < 0.3:
        a = a * np.linspace(rng.uniform(0.6, 1.0), rng.uniform(0.9, 1.1), w)
    a = a + rng.normal(0, 14 if hard else 6, a.shape)
    if hard:
        specks = rng.random(a.shape)
        a[specks < 0.004], a[specks > 0.996] = 0, 255
    return a.clip(0, 255).astype(np.uint8)


def stressed(gray: np.ndarray, kind: str, seed: int) -> np.ndarray:
    """The page turned, inverted, in coloured ink on coloured paper (its grey values), or in low light."""
    rng = np.random.default_rng(seed)
    if kind.startswith("rot"):
        return I.rotate(gray, float(kind[3:]))
    if kind == "inverted":
        return 255 - gray
    if kind == "color":
        paper, ink = rng.uniform(0.55, 1.0, 3), rng.uniform(0.0, 0.45, 3)
        rgb = ink + (paper - ink) * (gray[..., None] / 255.0)
        return I.to_gray((rgb * 255).clip(0, 255).astype(np.uint8))
    if kind == "lowlight":
        return (gray * rng.uniform(0.18, 0.35) + rng.uniform(5, 20) + rng.normal(0, 3, gray.shape)).clip(0, 255).astype(np.uint8)
    raise ValueError(kind)


def damaged(pages: DataFrame, style: str = "v1") -> DataFrame:
    """`pages` (image, level, picture, …) with worn pictures; v1, v2 (richer) or stress, where the level is the kind of stress."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for image, level, picture in zip(pdf["image"], pdf["level"], pdf["picture"]):
                seed, gray = zlib.crc32(image.encode()), I.decode(picture)
                out.append(I.encode(stressed(worn(gray, "medium", seed, rich=True), level, seed) if style == "stress" else worn(gray, level, seed, rich=style == "v2")))
            pdf["picture"] = out
            yield pdf

    return pages.mapInPandas(run, pages.schema)


def dataset(texts: DataFrame, render: Callable[[], Callable[[list[str], int], np.ndarray]], per_level: int, style: str = "v1", seed: str = "1234") -> DataFrame:
    """(image, level, text, picture): `per_level` pages of each level, of the lines of texts (text), drawn by a renderer made in workers and worn."""
    levels = STRESS if style == "stress" else [x for x, _ in LEVEL_MIX]
    order = Window.orderBy(F.md5(F.concat_ws(":", F.lit(seed), "text")), "text")
    chosen = texts.select("text").distinct().withColumn("n", F.row_number().over(order) - 1).filter(F.col("n") < per_level * len(levels))
    named = chosen.withColumn("level", F.get(F.array(*map(F.lit, levels)), F.floor(F.col("n") / per_level).cast("int")))
    named = named.withColumn("image", F.concat("level", F.lit("_"), F.lpad((F.col("n") % per_level).cast("string"), 4, "0"), F.lit(".png")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        drawn = render()
        for pdf in batches:
            pdf["picture"] = [I.encode(drawn(t.split("\n"), zlib.crc32(i.encode()))) for i, t in zip(pdf["image"], pdf["text"])]
            yield pdf

    pages = named.select("image", "level", "text").mapInPandas(run, f"image string, level string, text string, picture {I.IMAGE}")
    return damaged(pages, style)


def training_texts(lines: DataFrame, seed: str = "7") -> DataFrame:
    """`lines` (image, line) with the level that each is to be worn at."""
    return lines.withColumn("level", kind_of(draw(seed, "level", F.col("image")), LEVEL_MIX))
