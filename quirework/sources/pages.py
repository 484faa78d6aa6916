"""Page images and annotated collections as sources, manifests and training lines as sinks.

Files are listed and read by Spark, so paths can lie in any store. PNG is decoded here; other formats inside of Parquet columns
need an image library in the workers, and files on their own go through Spark's image source.
"""

from __future__ import annotations

import io as bytes_io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirework.functions import text as T
from quirework.operators import images as I
from quirework.operators import ordering
from quirework.sources import io

#: Font families that are kept for tests and for development.
TEST_FAMILIES = ["literata", "merriweather", "sourcesans3", "ibmplexsans", "ibmplexmono", "cabin", "tinos", "robotoslab", "oswald", "spectral"]
DEV_FAMILIES = ["lora", "publicsans", "firamono", "asap"]
HANDWRITING = ["caveat", "patrickhand", "kalam", "indieflower", "architectsdaughter"]
PAGE_SIDE = 2048
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def png(gray: np.ndarray) -> bytes:
    """The image as a PNG file."""
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    h, w = gray.shape
    lines = np.concatenate([np.zeros((h, 1), np.uint8), gray], axis=1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(lines)) + part(b"IEND", b"")


def from_png(data: bytes) -> np.ndarray:
    """Grey values of a PNG with eight bits a channel, not interlaced."""
    at, body, palette = 8, b"", None
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        chunk = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            w, h, depth, colour, _, _, laced = struct.unpack(">IIBBBBB", chunk)
            if depth != 8 or laced:
                raise ValueError("only PNGs with eight bits a channel that aren't interlaced are read here")
        elif kind == b"PLTE":
            palette = np.frombuffer(chunk, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body += chunk
        at += 12 + size
    n = _CHANNELS[colour]
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + w * n)
    out = np.zeros((h + 1, w * n + n), dtype=np.int64)
    for y in range(h):
        out[y + 1, n:] = _unfiltered(raw[y, 0], raw[y, 1:].astype(np.int64), out[y], n)
    pixels = out[1:, n:].reshape(h, w, n).astype(np.uint8)
    if palette is not None:
        pixels = palette[pixels[..., 0]]
    return I.to_gray(pixels) if pixels.shape[2] >= 3 else pixels[..., 0]


def _unfiltered(kind: int, line: np.ndarray, above: np.ndarray, n: int) -> np.ndarray:
    """A line of samples from its differences; `above` starts with a pixel of zeros."""
    if kind == 0:
        return line
    if kind == 2:
        return (line + above[n:]) % 256
    if kind == 1:
        return np.cumsum(line.reshape(-1, n), axis=0).reshape(-1) % 256
    out = np.zeros(len(line) + n, dtype=np.int64)
    for i, x in enumerate(line):
        left, up, corner = out[i], above[i + n], above[i]
        if kind == 3:
            guess = (left + up) // 2
        else:
            gaps = [abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)]
            guess = (left, up, corner)[gaps.index(min(gaps))]
        out[i + n] = (x + guess) % 256
    return out[n:]


def decoded(data: bytes) -> dict:
    """The picture of an image file's bytes."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return I.encode(from_png(data))
    try:
        from PIL import Image
    except ImportError as error:
        raise ValueError("only PNG can be decoded without an image library") from error
    return I.encode(np.asarray(Image.open(bytes_io.BytesIO(data)).convert("L")))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(image, picture) of all image files under the path; what Spark's image source can't decode is left out."""
    rows = spark.read.format("image").option("dropInvalid", True).load(path).select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pictures = []
            for h, w, n, data in zip(pdf["height"], pdf["width"], pdf["nChannels"], pdf["data"]):
                pixels = np.frombuffer(data, np.uint8).reshape(h, w, n)
                pictures.append(I.encode(I.to_gray(pixels[..., 2::-1]) if n >= 3 else pixels[..., 0]))
            yield pd.DataFrame({"image": pdf["origin"].str.replace(r".*/", "", regex=True), "picture": pictures})

    return rows.mapInPandas(run, f"image string, picture {I.IMAGE}")


def with_pictures(rows: DataFrame, column: str = "image.bytes") -> DataFrame:
    """`rows` with the picture of an image file in a binary column."""
    decode = F.pandas_udf(lambda data: pd.DataFrame([decoded(x) for x in data], columns=["h", "w", "px"]), I.IMAGE)
    return rows.withColumn("picture", decode(F.col(column)))


def prefix(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows in order."""
    return rows.orderBy(*order).limit(n)


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"^.*/", ""), r"\.[^.]*$", "")


def read_receipts(spark: SparkSession, images: str, boxes: str, n: int = 150, dev: int = 50) -> DataFrame:
    """(image, path, split, level, text, case_insensitive): the first n images, with the transcript of the box file of the same stem.

    Images without box file are skipped. Only names of images are read. Transcripts are upper case whatever is printed, so
    they compare without case.
    """
    names = prefix(spark.read.format("binaryFile").option("pathGlobFilter", "*.jpg").load(images).select("path"), n, "path")
    ranked = names.withColumn("split", F.when(F.row_number().over(Window.orderBy("path")) <= dev, "dev").otherwise("test"))
    lines = spark.read.option("wholetext", True).option("pathGlobFilter", "*.csv").text(boxes).select(stem(F.col("_metadata.file_path")).alias("page"), F.posexplode(F.split("value", "\r?\n")).alias("ordinal", "value"))
    ordered = ordering.line_texts(ordering.reading_order(io.receipt_rows(lines)))
    rows = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    texts = ordered.groupBy("page").agg(F.array_join(F.transform(rows, lambda x: x["line"]), "\n").alias("text"))
    every = lines.select("page").distinct().join(texts, "page", "left")
    found = ranked.withColumn("page", stem(F.col("path"))).join(every, "page")
    return found.select(F.regexp_replace("path", "^.*/", "").alias("image"), "path", "split", F.lit("real").alias("level"), F.coalesce("text", F.lit("")).alias("text"), F.lit(True).alias("case_insensitive"))


def read_cord(spark: SparkSession, path: str, split: str = "test") -> DataFrame:
    """(image, level, text, words, picture) of annotated receipts in Parquet; rows by mean height, words by x; paper fills what isn't annotated."""
    rows = spark.read.parquet(path)
    words = io.receipt_words(rows)
    name = F.format_string(f"cord_{split}_%04d.png", F.col("page").cast("long"))
    lines = ordering.grouped_lines(words, "row_id")
    joined = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    texts = lines.groupBy("page").agg(F.array_join(F.transform(joined, lambda x: x["line"]), "\n").alias("text"))
    boxes = words.groupBy("page").agg(F.collect_list(F.struct(*(F.col(c).cast("int").alias(c) for c in ("x0", "y0", "x1", "y1")))).alias("boxes"))
    pictures = with_pictures(rows.select(F.get_json_object("ground_truth", "$.meta.image_id").alias("page"), "image")).select("page", "picture")
    found = texts.join(boxes, "page").join(pictures, "page")
    return found.select(name.alias("image"), F.lit("real").alias("level"), "text", "boxes", filled(F.col("picture"), F.col("boxes"), 3, 0.35, 2.0).alias("picture"))


def filled(picture: Column, boxes: Column, least: int, share: float, sigma: float) -> Column:
    """The picture with paper outside of boxes, which get margins of a share of their height."""
    def run(pictures: pd.DataFrame, held: pd.Series) -> pd.DataFrame:
        out = []
        for (h, w, px), bs in zip(pictures[["h", "w", "px"]].itertuples(index=False), held):
            gray = I.decode({"h": h, "w": w, "px": px})
            out.append(I.encode(I.paper_filled(gray, [(b["x0"], b["y0"], b["x1"], b["y1"]) for b in bs], lambda height: max(least, int(share * height)), sigma)))
        return pd.DataFrame(out, columns=["h", "w", "px"])

    return F.pandas_udf(run, I.IMAGE)(picture, boxes)


def gnhk_lines(words: DataFrame) -> DataFrame:
    """(page, line_no, line, clean, x0, y0, x1, y1, boxes) of words (page, line_idx, text, plain, …): plain words by x, lines by mean height.

    clean: the line holds plain words only, so it can be cut out.
    """
    centre = F.avg((F.col("y0") + F.col("y1")) / 2)
    plain = F.array_sort(F.collect_list(F.when(F.col("plain") & (F.trim("text") != ""), F.struct("x0", "ordinal", F.trim("text").alias("text")))))
    boxes = F.collect_list(F.struct(*(F.col(c).cast("int").alias(c) for c in ("x0", "y0", "x1", "y1"))))
    lines = words.groupBy("page", "line_idx").agg(plain.alias("p"), F.bool_and(F.col("plain") & (F.trim("text") != "")).alias("clean"), centre.alias("c"), *(f(c).cast("int").alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))), boxes.alias("boxes"))
    number = F.row_number().over(Window.partitionBy("page").orderBy("c", "line_idx")) - 1
    return lines.withColumn("line_no", number).withColumn("line", F.array_join(F.transform("p", lambda x: x["text"]), " ")).filter("line <> ''").drop("p", "c", "line_idx")


def read_gnhk(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Pages (image, level, text, picture) and lines (image, level, text, picture) of annotated handwriting in Parquet.

    Pages are filled with paper outside of plain words and shrunk to PAGE_SIDE; lines are cut out where all their words are plain.
    """
    rows = with_pictures(spark.read.parquet(path)).select(stem(F.col("filename")).alias("page"), "annotations", "picture")
    words = io.page_words(rows)
    lines = gnhk_lines(words)
    joined = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    texts = lines.groupBy("page").agg(F.array_join(F.transform(joined, lambda x: x["line"]), "\n").alias("text"))
    boxes = words.filter("plain and trim(text) <> ''").groupBy("page").agg(F.collect_list(F.struct(*(F.col(c).cast("int").alias(c) for c in ("x0", "y0", "x1", "y1")))).alias("boxes"))
    smaller = F.pandas_udf(lambda p: pd.DataFrame([I.encode(I.shrunk(I.decode(x._asdict()), PAGE_SIDE)) for x in p[["h", "w", "px"]].itertuples(index=False)], columns=["h", "w", "px"]), I.IMAGE)
    pages = texts.join(boxes, "page").join(rows.select("page", "picture"), "page")
    pages = pages.select(F.concat("page", F.lit(".jpg")).alias("image"), F.lit("gnhk_page").alias("level"), "text", smaller(filled(F.col("picture"), F.col("boxes"), 4, 0.15, 3.0)).alias("picture"))
    clean = lines.filter("clean").join(rows.select("page", "picture"), "page")
    return pages, cut_lines(clean, margin=8, least=16, level="gnhk_line")


def cut_lines(lines: DataFrame, margin: int, least: int, level: str, fill: bool = True) -> DataFrame:
    """(image, level, text, picture): each line cut from its page with a margin of a share of its height; too small cuts are dropped."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                gray = I.decode(r.picture)
                if fill:
                    gray = I.paper_filled(gray, [(b["x0"], b["y0"], b["x1"], b["y1"]) for b in r.boxes], lambda h: max(3, h // 10), 3.0)
                cut = I.crop(gray, (r.x0, r.y0, r.x1, r.y1), max(6 if fill else 2, (r.y1 - r.y0) // margin), least)
                if cut is not None:
                    out.append({"image": f"{r.page}_{r.line_no:02d}.png", "level": level, "text": r.line, "picture": I.encode(cut)})
            if out:
                yield pd.DataFrame(out)

    return lines.select("page", "line_no", "line", "x0", "y0", "x1", "y1", "boxes", "picture").mapInPandas(run, f"image string, level string, text string, picture {I.IMAGE}")


def cord_lines(spark: SparkSession, path: str) -> DataFrame:
    """(image, level, text, picture) of the rows of annotated receipts, cut out; rows under eight pixels are dropped."""
    rows = spark.read.parquet(path)
    lines = ordering.grouped_lines(io.receipt_words(rows), "row_id")
    pictures = with_pictures(rows.select(F.get_json_object("ground_truth", "$.meta.image_id").alias("page"), "image")).select("page", "picture")
    wide = lines.filter("y1 - y0 >= 8 and x1 - x0 >= 8 and trim(line) <> ''").select("page", "line_no", "line", *(F.col(c).cast("int").alias(c) for c in ("x0", "y0", "x1", "y1")))
    boxes = F.array(F.struct("x0", "y0", "x1", "y1"))
    return cut_lines(wide.withColumn("boxes", boxes).join(pictures, "page"), margin=6, least=8, level="cord_line", fill=False)


def read_iam(spark: SparkSession, path: str, n_dev: int = 300, n_test: int = 600, seed: str = "2026") -> DataFrame:
    """(image, split, level, text, image_bytes): seeded test lines, and development lines of the rest; words and marks joined again."""
    rows = spark.read.parquet(path)
    keyed = rows.select(T.detokenize(F.col("text")).alias("text"), F.col("image.bytes").alias("image_bytes"), F.sha2(F.col("image.bytes"), 256).alias("key"))
    order = Window.orderBy(F.md5(F.concat_ws(":", F.lit(seed), "key")), "key")
    ranked = keyed.select("key").withColumn("k", F.row_number().over(order))
    split = ranked.filter(F.col("k") <= n_test + n_dev).select("key", F.when(F.col("k") <= n_test, "test").otherwise("dev").alias("split"))
    return keyed.join(split, "key").select(F.concat(F.lit("iam_"), F.substring("key", 1, 12), F.lit(".png")).alias("image"), "split", F.lit("iam_line").alias("level"), "text", "image_bytes")


def reserved_pages(pages: DataFrame, dev: int, seed: str) -> DataFrame:
    """`pages` (image, …) with split: `dev` seeded ones for development, the others reserved for training."""
    rank = F.row_number().over(Window.orderBy(F.md5(F.concat_ws(":", F.lit(seed), "image")), "image"))
    return pages.withColumn("split", F.when(rank <= dev, "dev").otherwise("reserved"))


def fonts(spark: SparkSession, folder: str, split: str, system: str | None = None) -> DataFrame:
    """(path, family, handwriting) of the split's font files; a folder is a family; an error if there are none.

    The fonts of the `system` folder count for training only. Only names are read.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.ttf").option("recursiveFileLookup", True)
    listed = files.load(folder).select("path").withColumn("family", F.element_at(F.split("path", "/"), -2))
    if split == "train":
        found = listed.filter(~F.col("family").isin([*TEST_FAMILIES, *DEV_FAMILIES]))
        if system:
            found = found.unionByName(files.load(system).select("path", F.lit("system").alias("family")))
    else:
        found = listed.filter(F.col("family").isin({"test": TEST_FAMILIES, "dev": DEV_FAMILIES}[split]))
    found = found.withColumn("handwriting", F.col("family").isin(HANDWRITING))
    if found.isEmpty():
        raise RuntimeError(f"no fonts for {split} under {folder}")
    return found


def write_manifest(samples: DataFrame, path: str) -> None:
    """Samples as a manifest in JSON lines under `path`/manifest, their pictures as PNG files in a binary column under `path`/pages."""
    samples.drop("picture").write.mode("overwrite").json(f"{path}/manifest")
    packed = F.pandas_udf(lambda p: pd.Series([png(I.decode(x._asdict())) for x in p[["h", "w", "px"]].itertuples(index=False)]), "binary")
    samples.select("image", packed("picture").alias("png")).write.mode("overwrite").parquet(f"{path}/pages")


def write_reserved(pages: DataFrame, path: str) -> None:
    """The names of the reserved pages."""
    pages.filter("split = 'reserved'").select("image").write.mode("overwrite").json(path)


def training_lines(lines: DataFrame, eval_share: float = 0.02, least: int = 50) -> DataFrame:
    """`lines` (image, text, picture) with box (the trainer's whole-line form) and part: eval for `eval_share` of them, `least` at least."""
    h, w = F.col("picture.h"), F.col("picture.w")
    box = F.format_string("WordStr 0 0 %d %d 0 #%s\n\t 0 0 %d %d 0\n", w, h, F.col("text"), w, h)
    n_eval = max(least, int(lines.count() * eval_share))
    rank = F.row_number().over(Window.orderBy(F.md5("image"), "image"))
    chosen = lines.select("image").withColumn("part", F.when(rank <= n_eval, "eval").otherwise("train"))
    return lines.withColumn("box", box).join(chosen, "image")


def write_training_lines(lines: DataFrame, path: str) -> None:
    """Training lines as a table by part, and their texts as JSON lines."""
    packed = F.pandas_udf(lambda p: pd.Series([png(I.decode(x._asdict())) for x in p[["h", "w", "px"]].itertuples(index=False)]), "binary")
    lines.select("image", "text", "box", packed("picture").alias("png"), "part").write.mode("overwrite").partitionBy("part").parquet(f"{path}/lines")
    lines.select("image", "text").write.mode("overwrite").json(f"{path}/texts")


def mixed_lists(base: DataFrame, extra: DataFrame, times: int = 3, seed: str = "1") -> DataFrame:
    """Training lists in one: `base` once and `extra` several times, in a seeded order within partitions."""
    copies = extra.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(times))))
    every = base.withColumn("copy", F.lit(1)).unionByName(copies)
    place = F.xxhash64(F.lit(seed), "image", "copy")
    return every.withColumn("place", place).repartitionByRange("place").sortWithinPartitions("place")
