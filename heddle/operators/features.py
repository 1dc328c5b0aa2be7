"""Patch features: token selection, normalisation, coordinates, and pluggable extractors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.functions.vectors import grid_side, l2_normalised, patch_x, patch_y

FEATURES = "category string, image_id long, layer int, patch_id int, v array<double>"


def selected_layers(wanted: list[int], available: int) -> list[int]:
    """Sorted layers without repeats; one outside 1..available is an error."""
    if not wanted:
        raise ValueError("no layers are wanted")
    if bad := [layer for layer in wanted if not 1 <= layer <= available]:
        raise ValueError(f"no such layers: {bad}")
    return sorted(set(wanted))


def patches_of(tokens: DataFrame, layers: list[int], available: int = 12) -> DataFrame:
    """(category, image_id, layer, patch_id, v) of (.., layer, tokens), as they are: the first token, the class token, goes."""
    rows = tokens.filter(F.col("layer").isin(selected_layers(layers, available)))
    each = rows.select("category", "image_id", "layer", F.posexplode("tokens").alias("at", "v")).filter("at > 0")
    return each.select("category", "image_id", "layer", (F.col("at") - 1).alias("patch_id"), "v")


def normalised(features: DataFrame) -> DataFrame:
    return features.withColumn("v", l2_normalised(F.col("v")))


def tokens_to_patches(tokens: DataFrame, layers: list[int], available: int = 12) -> DataFrame:
    """`patches_of` the tokens, normalised."""
    return normalised(patches_of(tokens, layers, available))


def with_coordinates(rows: DataFrame, patch_count: int) -> DataFrame:
    side = grid_side(patch_count)
    return rows.withColumn("x", patch_x(F.col("patch_id"), side)).withColumn("y", patch_y(F.col("patch_id"), side))


def extract(images: DataFrame, extractor: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """Features by any function from a batch of image rows to rows of FEATURES."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield extractor(frame)

    return images.mapInPandas(batches, FEATURES)
