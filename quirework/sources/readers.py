"""The boundary to recognition models: readers are objects; Spark only deals pages to them.

A reader has recognize_words(picture) -> lines of (word, conf). None ships here: models need files and libraries that are
not part of this project. `register` names a factory; workers make one reader a process and keep it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.operators import images as I
from quirework.operators.voting import LINES

Line = list[tuple[str, float]]
#: Readings below this score are read again; lines wider than so many heights are cut first.
SURE, WIDEST = 0.5, 20


class Reader(Protocol):
    def recognize_words(self, picture: dict) -> list[Line]: ...


_factories: dict[str, Callable[[], Reader]] = {}
_made: dict[str, Reader] = {}


def register(engine: str, factory: Callable[[], Reader]) -> None:
    _factories[engine] = factory


def engines() -> list[str]:
    return sorted(_factories)


def _maker(engine: str, factories: dict[str, Callable[[], Reader]]) -> Callable[[], Reader]:
    make = factories.get(engine) or _factories.get(engine)
    if make is None:
        raise KeyError(f"no reader is registered for {engine}")
    return make


def single(source: str, factories: dict[str, Callable[[], Reader]]) -> Callable[[np.ndarray], list[Line]]:
    """Reads one page as a source does: its variant, then its engine."""
    engine, _, variant = source.partition("/")
    reader = _maker(engine, factories)()
    return lambda gray: reader.recognize_words(I.encode(I.VARIANTS[variant or "raw"](gray)))


def read_source(pictures: DataFrame, source: str, factory: Callable[[], Reader] | None = None) -> DataFrame:
    """(image, source, lines) of rows (image, picture) that are in the source's variant already."""
    make = factory or _maker(source.split("/")[0], {})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = _made.get(source) or _made.setdefault(source, make())
        for pdf in batches:
            lines = [[[{"word": w, "conf": float(c)} for w, c in line] for line in reader.recognize_words(p)] for p in pdf["picture"]]
            yield pd.DataFrame({"image": pdf["image"], "source": source, "lines": lines})

    return pictures.select("image", "picture").mapInPandas(run, f"image string, source string, lines {LINES}")


def read_sources(pictures: DataFrame, sources: list[str], factories: dict[str, Callable[[], Reader]] | None = None) -> DataFrame:
    """(image, source, lines) of rows (image, picture) for each source: a page's variants are made once, whichever sources share them."""
    makers = {s.split("/")[0]: _maker(s.split("/")[0], factories or {}) for s in sources}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engines_ = {name: make() for name, make in makers.items()}
        for pdf in batches:
            for image, picture in zip(pdf["image"], pdf["picture"]):
                variants: dict[str, dict] = {}
                lines = []
                for source in sources:
                    engine, _, variant = source.partition("/")
                    if variant not in variants:
                        variants[variant] = I.encode(I.VARIANTS[variant or "raw"](I.decode(picture)))
                    lines.append([[{"word": w, "conf": float(c)} for w, c in line] for line in engines_[engine].recognize_words(variants[variant])])
                yield pd.DataFrame({"image": image, "source": sources, "lines": lines})

    return pictures.select("image", "picture").mapInPandas(run, f"image string, source string, lines {LINES}")


def in_reading_order(boxes: list[dict]) -> list[Line]:
    """Lines of words of boxes (text, score, x0, y0, x1, y1): what `ordering.reading_order` does to tables, for one page in a worker."""
    lines: list[list[dict]] = []
    lowest = float("-inf")
    for b in sorted(boxes, key=lambda b: b["y0"] + b["y1"]):
        if (b["y0"] + b["y1"]) / 2 > lowest:
            lines.append([])
        lines[-1].append(b)
        lowest = max(lowest, b["y1"])
    return [[(w, b["score"]) for b in sorted(line, key=lambda b: b["x0"]) for w in b["text"].split()] for line in lines]


class LineReader:
    """A reader made of a line detector and a reader of single lines: a page gives any number of lines, a line its words and one confidence.

    detect: boxes (x0, y0, x1, y1) of a page. read_line: (text, conf) of a line's picture. whole: pages are single lines already.
    """

    def __init__(self, detect: Callable[[np.ndarray], list[tuple]], read_line: Callable[[np.ndarray], tuple[str, float]], whole: bool = False):
        self.detect, self.read_line, self.whole = detect, read_line, whole

    def recognize_words(self, picture: dict) -> list[Line]:
        gray = I.decode(picture)
        if self.whole:
            text, conf = self.read_line(gray)
            return [[(w, conf) for w in text.split()]] if text.split() else []
        found = []
        for x0, y0, x1, y1 in self.detect(gray):
            cut = I.crop(gray, (int(x0), int(y0), int(x1), int(y1)), max(2, int((y1 - y0) * 0.12)))
            if cut is not None:
                text, conf = self.read_line(cut)
                if text.strip():
                    found.append({"text": text, "score": conf, "x0": x0, "y0": y0, "x1": x1, "y1": y1})
        return in_reading_order(found)


class WideLineReader:
    """A reader of boxes that reads unsure ones again: cut at blank columns where they are wide, the sure pieces joined.

    boxes: (text, score, x0, y0, x1, y1) of a page. read_pieces: (text, score) of each line picture.
    """

    def __init__(self, boxes: Callable[[np.ndarray], list[dict]], read_pieces: Callable[[list[np.ndarray]], list[tuple[str, float]]]):
        self.boxes, self.read_pieces = boxes, read_pieces

    def again(self, gray: np.ndarray, box: dict) -> dict:
        line = gray[max(0, int(box["y0"])) : int(box["y1"]) + 1, max(0, int(box["x0"])) : int(box["x1"]) + 1]
        if not line.size:
            return box | {"text": "", "score": 0.0}
        pieces = [np.ascontiguousarray(line[:, a:b]) for a, b in I.blank_gaps(line, WIDEST * line.shape[0])]
        sure = [(t.strip(), s) for t, s in self.read_pieces(pieces) if t.strip() and s >= SURE]
        return box | {"text": " ".join(t for t, _ in sure), "score": sum(s for _, s in sure) / len(sure) if sure else 0.0}

    def recognize_words(self, picture: dict) -> list[Line]:
        gray = I.decode(picture)
        read = [b if b["score"] >= SURE else self.again(gray, b) for b in self.boxes(gray)]
        return in_reading_order([b for b in read if b["text"]])


def log_probabilities(texts: DataFrame, factory: Callable[[], Callable[[list[str]], list[float]]], column: str = "text") -> DataFrame:
    """`texts` with logp: each distinct text is scored once, in batches, by a model that workers make."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = factory()
        for pdf in batches:
            yield pd.DataFrame({"_text": pdf["_text"], "logp": score(list(pdf["_text"]))})

    scored = texts.select(F.col(column).alias("_text")).distinct().mapInPandas(run, "_text string, logp double")
    return texts.join(scored, F.col(column) == F.col("_text")).drop("_text")
