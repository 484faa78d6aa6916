"""Page image measures and repairs on grey arrays, in Arrow-batched workers; the decisions are column expressions.

An image is struct(h int, w int, px binary), row by row, one byte a pixel. Bilinear sampling and reflected borders stand in
for the cubic warps and border modes of image libraries, so pixel values are close to theirs, not equal.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IMAGE = "struct<h:int,w:int,px:binary>"
MIN_GAIN = 1.15
#: The second-difference kernel whose mean absolute response measures noise.
NOISE_KERNEL = np.array([[1, -2, 1], [-2, 4, -2], [1, -2, 1]], dtype=np.float64)


def to_gray(rgb: np.ndarray) -> np.ndarray:
    return np.rint(rgb[..., :3] @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)


def _windows(a: np.ndarray, h: int, w: int) -> np.ndarray:
    """Sliding h x w windows of the array, borders reflected without repeating the edge."""
    padded = np.pad(a, ((h // 2, (h - 1) // 2), (w // 2, (w - 1) // 2)), mode="reflect")
    return np.lib.stride_tricks.sliding_window_view(padded, (h, w))


def noise_sigma(gray: np.ndarray) -> float:
    response = (_windows(gray.astype(np.float64), 3, 3) * NOISE_KERNEL).sum(axis=(2, 3))
    return float(np.sqrt(np.pi / 2) * np.abs(response).mean() / 6)


def otsu(gray: np.ndarray) -> int:
    """The threshold with the largest variance between classes."""
    n = np.bincount(gray.reshape(-1), minlength=256).astype(np.float64)
    below, mass = n.cumsum(), (n * np.arange(256)).cumsum()
    above = below[-1] - below
    with np.errstate(divide="ignore", invalid="ignore"):
        between = below * above * (mass / below - (mass[-1] - mass) / above) ** 2
    return int(np.nanargmax(between)) if np.isfinite(between).any() else 0


def _spread(a: np.ndarray, size: int, pick: Callable) -> np.ndarray:
    """Row-wise, then column-wise extremes over a square."""
    return pick(_windows(pick(_windows(a, 1, size), axis=(2, 3)), size, 1), axis=(2, 3))


def ink_mask(gray: np.ndarray) -> np.ndarray:
    smooth = np.median(_windows(gray, 3, 3), axis=(2, 3)).astype(np.uint8)
    ink = (smooth <= otsu(smooth)).astype(np.uint8)
    return _spread(_spread(ink, 2, np.min)[::-1, ::-1], 2, np.max)[::-1, ::-1]


def rotate(gray: np.ndarray, degrees: float, grow: bool = True) -> np.ndarray:
    """Turned about the centre, positive against the clock, filled with the median; angles under 0.1 leave it as it is.

    grow: the canvas takes in all corners. Quarter turns only move pixels.
    """
    if abs(degrees) < 0.1:
        return gray
    if grow and degrees % 90 == 0:
        return np.rot90(gray, int(degrees // 90) % 4)
    h, w = gray.shape
    c, s = np.cos(np.deg2rad(degrees)), np.sin(np.deg2rad(degrees))
    tall, wide = (int(round(abs(h * c) + abs(w * s))), int(round(abs(w * c) + abs(h * s)))) if grow else (h, w)
    y, x = np.mgrid[0:tall, 0:wide]
    dx, dy = x - (wide - 1) / 2, y - (tall - 1) / 2
    return _sampled(gray, s * dx + c * dy + (h - 1) / 2, c * dx - s * dy + (w - 1) / 2)


def _sampled(gray: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Bilinear samples; the median stands for what lies outside."""
    h, w = gray.shape
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    fy, fx = y - y0, x - x0
    fill = float(np.median(gray))

    def at(yy: np.ndarray, xx: np.ndarray) -> np.ndarray:
        inside = (yy >= 0) & (yy < h) & (xx >= 0) & (xx < w)
        return np.where(inside, gray[yy.clip(0, h - 1), xx.clip(0, w - 1)], fill)

    top, bottom = at(y0, x0) * (1 - fx) + at(y0, x0 + 1) * fx, at(y0 + 1, x0) * (1 - fx) + at(y0 + 1, x0 + 1) * fx
    return np.rint(top * (1 - fy) + bottom * fy).clip(0, 255).astype(np.uint8)


def shrunk(gray: np.ndarray, side: int) -> np.ndarray:
    """The image averaged over squares so that no side is longer than `side`."""
    k = -(-max(gray.shape) // side)
    if k <= 1:
        return gray
    padded = np.pad(gray, [(0, -n % k) for n in gray.shape], mode="edge")
    return np.rint(padded.reshape(padded.shape[0] // k, k, padded.shape[1] // k, k).mean(axis=(1, 3))).astype(np.uint8)


def resized(gray: np.ndarray, h: int, w: int) -> np.ndarray:
    """The image at another size, bilinear."""
    y, x = np.mgrid[0:h, 0:w]
    top, left = (y + 0.5) * gray.shape[0] / h - 0.5, (x + 0.5) * gray.shape[1] / w - 0.5
    return _sampled(gray, top.clip(0, gray.shape[0] - 1), left.clip(0, gray.shape[1] - 1))


def blurred(a: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian blur of a float array, edges repeated."""
    reach = max(1, int(3 * sigma))
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weights /= weights.sum()
    for axis in (0, 1):
        a = np.apply_along_axis(lambda v: np.convolve(np.pad(v, reach, mode="edge"), weights, mode="valid"), axis, a)
    return a


def denoised(gray: np.ndarray, strength: float, patch: int = 7, reach: int = 10) -> np.ndarray:
    """Non-local means: each pixel is the mean of those in reach, weighted by how alike their patches are.

    One shift at a time for the whole image; patch differences are box sums of squared differences.
    """
    a = gray.astype(np.float64)
    padded = np.pad(a, reach, mode="reflect" if min(a.shape) > reach else "edge")
    total, mass = np.zeros_like(a), np.zeros_like(a)
    h, w = a.shape
    box = np.ones(patch) / patch
    for dy in range(-reach, reach + 1):
        for dx in range(-reach, reach + 1):
            moved = padded[reach + dy : reach + dy + h, reach + dx : reach + dx + w]
            gap = (a - moved) ** 2
            for axis in (0, 1):
                gap = np.apply_along_axis(lambda v: np.convolve(np.pad(v, patch // 2, mode="edge"), box, mode="valid"), axis, gap)
            weight = np.exp(-gap / (strength * strength))
            total += weight * moved
            mass += weight
    return np.rint(total / mass).astype(np.uint8)


def skew(gray: np.ndarray, limit: float = 5.0, step: float = 0.2, side: int = 800) -> float:
    """The turn within the limit that makes the ink's row sums vary most, 0 unless it gains MIN_GAIN.

    The page is averaged down to `side` pixels; pages far from square get margins, so that turned lines stay on them.
    """
    ink = ink_mask(shrunk(gray, side)) * 255
    margin = max(0, max(ink.shape) // 3 - min(ink.shape)) // 2
    ink = np.pad(ink, margin)
    sums = lambda a: float(np.var(rotate(ink, a, grow=False).sum(axis=1, dtype=np.float64)))
    angles = np.round(np.arange(-limit, limit + step / 2, step), 6)
    scores = [sums(a) for a in angles]
    flat = sums(0.0)
    k = int(np.argmax(scores))
    return float(angles[k]) if flat > 0 and scores[k] >= MIN_GAIN * flat else 0.0


def _disc(size: int) -> list[int]:
    """Half-widths of the rows of an ellipse as wide and tall as `size`."""
    r = (size - 1) / 2
    return [int(np.sqrt(max(r * r - (k - r) ** 2, 0)) + 0.5) for k in range(size)]


def _closed(gray: np.ndarray, size: int) -> np.ndarray:
    """Dark marks narrower than an ellipse of this size removed: its largest, then its smallest values."""
    def over(a: np.ndarray, pick: Callable, edge: int) -> np.ndarray:
        out, r = None, size // 2
        padded = np.pad(a, r, constant_values=edge)
        for k, half in enumerate(_disc(size)):
            rows = padded[k : k + a.shape[0], r - half : padded.shape[1] - r + half]
            row = pick(np.lib.stride_tricks.sliding_window_view(rows, 2 * half + 1, axis=1), axis=2)
            out = row if out is None else (np.maximum if pick is np.max else np.minimum)(out, row)
        return out

    return over(over(gray, np.max, 0), np.min, 255)


def normalize_background(gray: np.ndarray) -> np.ndarray:
    """Divides by the paper: the closed image, blurred."""
    size = max(15, (min(gray.shape) // 8) | 1)
    paper = blurred(_closed(gray, size).astype(np.float64), size / 4)
    return np.rint(np.minimum(255, gray * 255.0 / np.maximum(paper, 1))).astype(np.uint8)


def stretch(gray: np.ndarray) -> np.ndarray:
    """The range from the 0.5th to the 99.5th percentile spread over all grey values."""
    low, high = np.percentile(gray, [0.5, 99.5])
    return ((gray.astype(np.float64) - low) * 255 / max(1.0, high - low)).clip(0, 255).astype(np.uint8)


def adaptive_threshold(gray: np.ndarray, size: int = 31, offset: float = 15) -> np.ndarray:
    local = _windows(gray.astype(np.float64), 1, size).mean(axis=(2, 3))
    local = _windows(local, size, 1).mean(axis=(2, 3))
    return np.where(gray > local - offset, 255, 0).astype(np.uint8)


def blank_gaps(gray: np.ndarray, max_width: int) -> list[tuple[int, int]]:
    """Cuts a wide line into pieces at the middle of the last blank run in the second half of each window."""
    blank = ink_mask(gray).sum(axis=0) == 0
    pieces, start, width = [], 0, gray.shape[1]
    while width - start > max_width:
        window = blank[start + max_width // 2 : start + max_width]
        edges = np.flatnonzero(np.diff(np.concatenate([[0], window.view(np.int8), [0]])))
        cut = start + max_width
        if len(edges):
            cut = start + max_width // 2 + int(edges[-2] + edges[-1]) // 2
        pieces.append((start, cut))
        start = cut
    return [*pieces, (start, width)]


def enhanced(gray: np.ndarray, strength: float = 6.0) -> np.ndarray:
    """Denoised if noisy, set upright if skewed, then even paper."""
    sigma = noise_sigma(gray)
    if sigma > 2.0:
        gray = denoised(gray, min(30.0, strength * sigma))
    return normalize_background(rotate(gray, skew(gray)))


VARIANTS: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "raw": lambda g: g,
    "enhanced": enhanced,
    "soft": lambda g: enhanced(g, 3.0),
    "binary": lambda g: adaptive_threshold(enhanced(g)),
}


def crop(gray: np.ndarray, box: tuple[int, int, int, int], pad: int, least: int = 8) -> np.ndarray | None:
    """The box (x0, y0, x1, y1) with a margin, within the image; None if that is narrower or lower than `least`."""
    h, w = gray.shape
    x0, y0, x1, y1 = max(0, box[0] - pad), max(0, box[1] - pad), min(w, box[2] + pad), min(h, box[3] + pad)
    return gray[y0:y1, x0:x1] if x1 - x0 >= least and y1 - y0 >= least else None


def paper_filled(gray: np.ndarray, boxes: list[tuple[int, int, int, int]], pad: Callable[[int], int], sigma: float) -> np.ndarray:
    """What lies outside of the boxes painted over with paper, softly: the median of the brighter half of what lies inside."""
    keep = np.zeros(gray.shape)
    for x0, y0, x1, y1 in boxes:
        p = pad(y1 - y0)
        keep[max(0, y0 - p) : y1 + p, max(0, x0 - p) : x1 + p] = 1
    inside = gray[keep > 0]
    if not len(inside):
        return gray
    paper = np.median(inside[inside >= np.median(inside)])
    alpha = blurred(keep, sigma)
    return (gray * alpha + paper * (1 - alpha)).clip(0, 255).astype(np.uint8)


def decided_turn(boxes: list[dict], read: Callable[[int], list[dict]]) -> int:
    """The turn (0, 90, 180, 270) that makes a page read best. boxes: those of the page as it is; read: those of the page turned."""
    count = lambda bs: sum(len(b["text"]) * b["score"] for b in bs if b["score"] > 0.5)
    if not boxes:
        return 0
    tall = sum(b["y1"] - b["y0"] > 1.5 * (b["x1"] - b["x0"]) for b in boxes)
    if tall > len(boxes) / 2:  # sideways: the page as it is says nothing, so the two candidates are compared
        scores = {turn: count(read(turn)) for turn in (90, 270)}
        turn = max(scores, key=scores.get)
        return turn if scores[turn] >= 1.15 * min(scores.values()) + 5 else 0
    if sum(b["score"] for b in boxes) / len(boxes) < 0.85 and count(read(180)) > 1.3 * count(boxes) + 5:
        return 180
    return 0


def auto_fixed(gray: np.ndarray, reader: Callable[[np.ndarray], list[dict]]) -> tuple[np.ndarray, list[str], list[dict]]:
    """(repaired page, names of the repairs, boxes of the page if it needed no turn). reader: boxes (text, score, x0, y0, x1, y1) of a page."""
    done = []
    if np.median(gray) < 100 and np.percentile(gray, 99.5) - np.median(gray) > 60:
        gray = 255 - gray
        done.append("invert")
    if np.median(gray) < 120:
        gray = stretch(gray)
        done.append("exposure")
    boxes = reader(gray)
    turn = decided_turn(boxes, lambda t: reader(rotate(gray, t)))
    return (rotate(gray, turn), [*done, f"rotate{turn}"], []) if turn else (gray, done, boxes)


def decode(image: dict) -> np.ndarray:
    return np.frombuffer(image["px"], dtype=np.uint8).reshape(image["h"], image["w"])


def encode(gray: np.ndarray) -> dict:
    return {"h": gray.shape[0], "w": gray.shape[1], "px": np.ascontiguousarray(gray).tobytes()}


def measured(pages: DataFrame) -> DataFrame:
    """(image, sigma, skew, median, p995) of rows (image, picture)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            grays = [decode(x) for x in pdf["picture"]]
            yield pd.DataFrame({"image": pdf["image"], "sigma": [noise_sigma(g) for g in grays], "skew": [skew(g) for g in grays], "median": [float(np.median(g)) for g in grays], "p995": [float(np.percentile(g, 99.5)) for g in grays]})

    return pages.select("image", "picture").mapInPandas(run, "image string, sigma double, skew double, median double, p995 double")


def variants(pages: DataFrame, names: list[str]) -> DataFrame:
    """(image, variant, picture): each page in each wanted variant, decoded once."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for image, picture in zip(pdf["image"], pdf["picture"]):
                gray = decode(picture)
                yield pd.DataFrame({"image": image, "variant": names, "picture": [encode(VARIANTS[v](gray)) for v in names]})

    return pages.select("image", "picture").mapInPandas(run, f"image string, variant string, picture {IMAGE}")


def noise_route(sigma: Column, threshold: Column | float | None) -> Column:
    """"main" up to the threshold or without one, else "noisy"."""
    return F.lit("main") if threshold is None else F.when(sigma <= threshold, "main").otherwise("noisy")


def fixes(median: Column, p995: Column) -> Column:
    """struct(invert, stretch): dark pages with bright text are inverted; pages still dark are stretched."""
    invert = (median < 100) & (p995 - median > 60)
    after = F.when(invert, 255 - median).otherwise(median)
    return F.struct(invert.alias("invert"), (after < 120).alias("stretch"))


def readability(boxes: Column) -> Column:
    """Characters in confident boxes array<struct<text, score>>, weighted by score."""
    return F.aggregate(F.filter(boxes, lambda b: b["score"] > 0.5), F.lit(0.0), lambda s, b: s + F.length(b["text"]) * b["score"])


def orientation_plan(tall_share: Column, confidence: Column) -> Column:
    """Turns worth reading: quarter turns if most boxes stand upright, a half turn if the reading is unsure."""
    return F.when(tall_share > 0.5, F.array(F.lit(90), F.lit(270))).when(confidence < 0.85, F.array(F.lit(180))).otherwise(F.array().cast("array<int>"))


def accepts_turn(turn: Column, before: Column, after: Column) -> Column:
    factor = F.when(turn == 180, 1.3).otherwise(1.15)
    return after > before * factor + 5
