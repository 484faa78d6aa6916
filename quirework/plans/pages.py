"""From page images to text: repairs, routes, the cascade of readers, and fusion, as one plan over many pages."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.functions import text as T
from quirework.operators import images as I
from quirework.operators import metrics, sweeps, voting
from quirework.operators import lexicon as L
from quirework.plans.tuning import system_text
from quirework.sources import readers
from quirework.sources.io import Config
from quirework.sources.stage import stored

#: How alike the cheap readings must be to be final; accurate never ends early.
MODES = {"accurate": None, "balanced": 0.98, "fast": 0.85}
BoxReader = Callable[[], Callable]


def repaired_pages(pictures: DataFrame, boxes: BoxReader) -> DataFrame:
    """(image, picture, fixes, sigma) of rows (image, picture): pages put right, and how noisy they are. boxes: makes a box reader in a worker."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = boxes()
        for pdf in batches:
            found = [I.auto_fixed(I.decode(x), read) for x in pdf["picture"]]
            yield pd.DataFrame({"image": pdf["image"], "picture": [I.encode(g) for g, _, _ in found], "fixes": [f for _, f, _ in found], "sigma": [I.noise_sigma(g) for g, _, _ in found]})

    return pictures.select("image", "picture").mapInPandas(run, f"image string, picture {I.IMAGE}, fixes array<string>, sigma double")


def routes(sigmas: DataFrame, agreement: DataFrame, threshold: float | None, tau: float | None) -> DataFrame:
    """(image, route) of pages (image, sigma; null: 0): noisy, else cheap where the cheap readings agree, else full."""
    rows = sigmas.join(agreement, "image", "left")
    quick = F.lit(False) if tau is None else F.coalesce("agreement", F.lit(0.0)) >= tau
    main = I.noise_route(F.coalesce("sigma", F.lit(0.0)), threshold) == "main"
    return rows.select("image", F.when(~main, "noisy").when(quick, "cheap").otherwise("full").alias("route"))


def recognize(pictures: DataFrame, config: Config, boxes: BoxReader, factories: dict[str, Callable], mode: str = "balanced", lex: L.Lexicon | None = None) -> DataFrame:
    """(image, reading, route, fixes) of rows (image, picture): every page by the readers that its route asks for.

    Pages are split by predicates, so that no reader sees a page that another branch has settled; what is read is stored.
    """
    spark = pictures.sparkSession
    tau, cheap = MODES[mode], (config.cascade or {}).get("cheap", [])
    pages = stored(repaired_pages(pictures, boxes), "pages")
    first = None
    agreed = spark.createDataFrame([], "image string, agreement double")
    if tau is not None and cheap:
        main = pages.filter(I.noise_route(F.col("sigma"), config.noise_threshold if config.noisy else None) == "main")
        first = stored(readers.read_sources(main, cheap, factories), "cheap")
        agreed = voting.agreement(first, cheap)
    routed = stored(routes(pages.select("image", "sigma"), agreed, config.noise_threshold if config.noisy else None, tau if cheap else None), "routes")
    on = lambda rows, route: rows.join(routed.filter(F.col("route") == route).select("image"), "image", "left_semi")

    def read(route: str, wanted: Config, known: DataFrame | None) -> DataFrame:
        left = [s for s in wanted.sources if known is None or s not in cheap]
        said = readers.read_sources(on(pages, route), left, factories) if left else None
        held = on(known, route).filter(F.col("source").isin(list(wanted.sources))) if known is not None else None
        rows = said if held is None else held if said is None else said.unionByName(held)
        return system_text(spark, stored(rows, f"read-{route}"), wanted, lex)

    texts = read("full", config, first)
    if first is not None:
        texts = texts.unionByName(read("cheap", replace(config, sources={s: config.sources.get(s, 1.0) for s in cheap}), first))
    if config.noisy:
        texts = texts.unionByName(read("noisy", config.for_route("noisy"), None))
    return pages.select("image", "fixes").join(routed, "image").join(texts, "image", "left").select("image", F.coalesce("reading", F.lit("")).alias("reading"), "route", "fixes")


def ablation(scored: DataFrame) -> DataFrame:
    """Mean error by (model, variant, level) and over all levels of rows (source, level, cer), as one row a model and variant."""
    parts = scored.withColumn("p", T.source_parts(F.col("source"))).select(F.col("p.engine").alias("model"), F.col("p.variant").alias("variant"), "level", "cer")
    keys = [F.col("model"), F.col("variant")]
    means = parts.groupingSets([[*keys, F.col("level")], keys], *keys, F.col("level")).agg(F.avg("cer").alias("cer"), F.grouping("level").alias("_all"))
    named = means.withColumn("level", F.when(F.col("_all") == 1, "all").otherwise(F.col("level")))
    return named.groupBy("model", "variant").pivot("level", metrics.LEVELS).agg(F.first("cer"))


def ablate(samples: DataFrame, pictures: DataFrame, models: list[str], factories: dict[str, Callable]) -> DataFrame:
    """The ablation of all variants of the pages for some models."""
    sources = [f"{m}/{v}" for m in models for v in I.VARIANTS]
    said = readers.read_sources(pictures, sources, factories)
    text = F.array_join(F.transform("lines", lambda line: F.array_join(F.transform(line, lambda w: w["word"]), " ")), "\n")
    rows = said.select("image", "source", text.alias("reading")).join(samples.select("image", "level", "text"), "image")
    return ablation(rows.withColumn("cer", T.cer(F.col("text"), F.col("reading"))))


def time_sources(pictures: DataFrame, config: Config, boxes: BoxReader, factories: dict[str, Callable], per_set: int = 6) -> DataFrame:
    """(source, seconds): mean time of the repairs and of each source of both routes, on every k-th page of each dataset.

    Each step runs once before it is timed, so models are loaded; pages are timed one after the other in one worker.
    """
    spark = pictures.sparkSession
    sample = sweeps.strided(pictures, ["image"], "dataset", per_set).select("image", "picture").coalesce(1)
    sources = sorted({*config.sources, *((config.noisy or {}).get("sources", {}))})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = boxes()
        steps = {"auto_fix": lambda g: I.auto_fixed(g, read)} | {s: readers.single(s, factories) for s in sources}
        warm = False
        for pdf in batches:
            for picture in pdf["picture"]:
                gray = I.decode(picture)
                if not warm:
                    for step in steps.values():
                        step(gray)
                    warm = True
                spent = []
                for step in steps.values():
                    began = time.perf_counter()
                    step(gray)
                    spent.append(time.perf_counter() - began)
                yield pd.DataFrame({"source": list(steps), "seconds": spent})

    timed = sample.mapInPandas(run, "source string, seconds double")
    return timed.groupBy("source").agg(F.round(F.avg("seconds"), 3).alias("seconds"))


def evaluate_live(spark: SparkSession, samples: DataFrame, pictures: DataFrame, sources: list[str], factories: dict[str, Callable], limit: int | None = None) -> DataFrame:
    """samples scored for each source, read now; limit: only the first samples by image."""
    some = samples.orderBy("image").limit(limit) if limit else samples
    said = readers.read_sources(pictures.join(some.select("image"), "image", "left_semi"), sources, factories)
    text = F.array_join(F.transform("lines", lambda line: F.array_join(F.transform(line, lambda w: w["word"]), " ")), "\n")
    return metrics.score(some.join(said.select("image", F.col("source").alias("system"), text.alias("reading")), "image"))
