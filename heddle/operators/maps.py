"""Anomaly maps: a row per image with its map as an array, row by row. Pixels are exploded only at the end."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.functions.statistics import rounded_count
from heddle.functions.vectors import grid_side


@lru_cache(maxsize=64)
def upsampling(side: int, size: int) -> np.ndarray:
    """Weights (size, side) of linear interpolation between pixel centres, edges held."""
    at = np.maximum(0.0, (np.arange(size) + 0.5) * side / size - 0.5)
    low = np.minimum(np.floor(at).astype(int), side - 1)
    high = np.minimum(low + 1, side - 1)
    out = np.zeros((size, side))
    np.add.at(out, (np.arange(size), low), 1 - (at - low))
    np.add.at(out, (np.arange(size), high), at - low)
    return out


@lru_cache(maxsize=64)
def smoothing(size: int, sigma: float, truncate: float = 4.0) -> np.ndarray:
    """The matrix (size, size) of a Gaussian filter whose borders reflect, edge pixels included."""
    radius = int(truncate * sigma + 0.5)
    offsets = np.arange(-radius, radius + 1)
    kernel = np.exp(-0.5 * (offsets / sigma) ** 2)
    kernel /= kernel.sum()
    out = np.zeros((size, size))
    for offset, weight in zip(offsets, kernel, strict=True):
        at = (np.arange(size) + offset) % (2 * size)
        np.add.at(out, (np.arange(size), np.where(at < size, at, 2 * size - 1 - at)), weight)
    return out


def patch_grids(scores: DataFrame, keys: tuple[str, ...] = ("category", "image_id")) -> DataFrame:
    """(keys, grid): an image's patch scores in order of their patches."""
    rows = scores.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("patch_id", "score"))).alias("patches"))
    return rows.select(*keys, F.transform("patches", lambda p: p["score"]).alias("grid"))


def upsampled(grids: DataFrame, size: int = 224, sigma: float = 0.0) -> DataFrame:
    """`grids` with `map` in place of `grid`: interpolated to size x size, and smoothed if sigma is above 0."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            maps = []
            for grid in frame["grid"]:
                side = grid_side(len(grid))
                weights = upsampling(side, size)
                if sigma > 0:
                    weights = smoothing(size, sigma) @ weights
                maps.append((weights @ np.asarray(grid).reshape(side, side) @ weights.T).ravel())
            yield frame.drop(columns="grid").assign(map=maps)

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in grids.schema if f.name != "grid"]
    names = [f.name for f in grids.schema if f.name != "grid"]
    return grids.select(*names, "grid").mapInPandas(batches, ", ".join([*kinds, "map array<double>"]))


def smoothed(maps: DataFrame, sigma: float) -> DataFrame:
    """Square maps after a Gaussian filter; unchanged if sigma is 0."""
    if sigma <= 0:
        return maps

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for m in frame["map"]:
                side = grid_side(len(m))
                weights = smoothing(side, sigma)
                out.append((weights @ np.asarray(m).reshape(side, side) @ weights.T).ravel())
            yield frame.assign(map=out)

    return maps.mapInPandas(batches, maps.schema)


def pixels(maps: DataFrame, size: int) -> DataFrame:
    """(.., px, py, score) of maps, a row per pixel."""
    others = [c for c in maps.columns if c != "map"]
    each = maps.select(*others, F.posexplode("map").alias("at", "score"))
    return each.select(*others, (F.col("at") % size).alias("px"), F.floor(F.col("at") / size).cast("int").alias("py"), "score")


def pixel_labels(maps: DataFrame, masks: DataFrame) -> DataFrame:
    """(category, image_id, score, label) per pixel; `masks` (image_id, mask), an image without one is all 0."""
    joined = maps.join(masks.select("image_id", "mask"), "image_id", "left")
    mask = F.coalesce("mask", F.transform("map", lambda _: F.lit(0)))
    each = joined.select("category", "image_id", F.inline(F.arrays_zip(F.col("map").alias("score"), F.transform(mask, lambda m: (m > 0).cast("int")).alias("label"))))
    return each


def _of_map(maps: DataFrame, value: Column) -> DataFrame:
    return maps.withColumn("image_score", value).drop("map")


def image_maxima(maps: DataFrame) -> DataFrame:
    return _of_map(maps, F.array_max("map"))


def image_quantiles(maps: DataFrame, q: float = 0.99) -> DataFrame:
    """The linear quantile of each map, within its row."""
    n = F.size("map")
    rank = F.lit(float(q)) * (n - 1)
    low = F.floor(rank).cast("int")
    rows = maps.withColumn("map", F.sort_array("map"))
    first, second = F.element_at("map", low + 1), F.element_at("map", F.least(low + 2, n))
    return _of_map(rows, first + (second - first) * (rank - low))


def image_top_means(maps: DataFrame, fraction: float = 0.01) -> DataFrame:
    """The mean of each map's highest part, within its row."""
    if not 0 < fraction <= 1:
        raise ValueError("the fraction lies above 0 and is at most 1")
    k = F.greatest(F.lit(1), rounded_count(F.size("map"), fraction)).cast("int")
    rows = maps.withColumn("map", F.slice(F.sort_array("map", asc=False), F.lit(1), k))
    return _of_map(rows, F.aggregate("map", F.lit(0.0), lambda t, x: t + x) / F.size("map"))


def image_scores(maps: DataFrame, method: str = "topk_mean", topk_fraction: float = 0.01) -> DataFrame:
    """`maps` with `image_score` in place of the map."""
    if method == "max":
        return image_maxima(maps)
    if method == "q99":
        return image_quantiles(maps, 0.99)
    if method == "topk_mean":
        return image_top_means(maps, topk_fraction)
    raise ValueError(f"no such image score: {method}")


def top_anomalies(scored: DataFrame, thresholds: DataFrame, n: int = 20) -> DataFrame:
    """The n images of highest score in each category, with the share of pixels at or above the threshold and
    the ceiling of their colour scale; equal scores go by image."""
    rank = F.row_number().over(Window.partitionBy("category").orderBy(F.desc("image_score"), "image_id"))
    rows = scored.withColumn("rank", rank).filter(F.col("rank") <= n).join(thresholds.select("category", "pixel_threshold"), "category")
    mask = F.transform("map", lambda x: (x >= F.col("pixel_threshold")).cast("int"))
    return rows.withColumn("predicted_mask", mask).withColumn("color_ceiling", F.greatest(2.5 * F.col("pixel_threshold"), F.lit(1e-6))).drop("map")
