"""Spatial reliability of normal patches, and the spatial weights that follow from it."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.functions.statistics import linear_quantile, lower_median, values_at
from heddle.functions.storage import stored
from heddle.functions.vectors import dot


def mean_pair_distance(features: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, distance): the mean of 1 - a.b over all pairs of a group's unit vectors; 0 for a single one.

    It is 1 - (|sum|^2 - n) / (n (n - 1)), so one sum of vectors, combined before it is moved, takes the place of all pairs.
    """
    vector, v = Summarizer.metrics("sum").summary(array_to_vector("v")), F.col("v")
    group = features.groupBy(*keys).agg(vector.alias("made"), F.sum(dot(v, v)).alias("alone"), F.count(F.lit(1)).alias("n"))
    group = group.select(*keys, "n", "alone", vector_to_array("made.sum").alias("total"))
    n = F.col("n").cast("double")
    distance = 1 - (dot(F.col("total"), F.col("total")) - F.col("alone")) / (n * (n - 1))
    return group.select(*keys, "n", F.when(F.col("n") > 1, distance).otherwise(F.lit(0.0)).alias("distance"))


def same_position_distance(features: DataFrame) -> DataFrame:
    """Per category and layer, the lower median over places of the mean distance between images."""
    by_place = mean_pair_distance(features, ["category", "layer", "patch_id"])
    # As many values as the grid has places.
    return by_place.groupBy("category", "layer").agg(lower_median("distance").alias("same_position_distance"), F.min("n").alias("images"))


def _over_images(features: DataFrame) -> DataFrame:
    by_image = stored(mean_pair_distance(features, ["category", "layer", "image_id"]).drop("n"))
    return values_at(by_image, ["category", "layer"], "distance", {"cross_position_distance": (0.5, F.floor((F.col("total") - 1) / 2))})


def cross_position_distance(features: DataFrame) -> DataFrame:
    """Per category and layer, the lower median over images of the mean distance between places."""
    return _over_images(features).drop("total")


def spatial_reliability(features: DataFrame) -> DataFrame:
    """Per category and layer: both distances and their quotient. A single image has no distance at the same place, so it is an error."""
    both = same_position_distance(features).drop("images").join(_over_images(features), ["category", "layer"])
    quotient = F.col("cross_position_distance") / (F.col("same_position_distance") + 1e-8)
    few = F.concat(F.lit("one calibration image in category "), F.col("category"), F.lit("; reliability needs two"))
    return both.withColumn("reliability", F.when(F.col("total") < 2, F.raise_error(few)).otherwise(quotient)).drop("total")


def layer_tau(reliability: DataFrame, quantile: float = 0.8) -> DataFrame:
    """(layer, tau): a quantile over all categories of a run."""
    return reliability.groupBy("layer").agg(linear_quantile("reliability", quantile).alias("tau"))


def weight_of(reliability: Column, tau: Column, most: float) -> Column:
    if most < 0:
        raise ValueError("the largest weight is negative")
    both = reliability + tau
    return F.when(both > 0, F.lit(float(most)) * reliability / both).otherwise(F.lit(0.0))


def spatial_weights(reliability: DataFrame, mode: str = "adaptive", fixed: float = 0.05, most: float = 0.1, quantile: float = 0.8) -> DataFrame:
    """(category, layer, spatial_weight): none, the same for all, or by reliability."""
    if mode == "none":
        weight, rows = F.lit(0.0), reliability
    elif mode == "fixed":
        weight, rows = F.lit(float(fixed)), reliability
    elif mode == "adaptive":
        weight, rows = weight_of(F.col("reliability"), F.col("tau"), most), reliability.join(layer_tau(reliability, quantile), "layer")
    else:
        raise ValueError(f"no such spatial mode: {mode}")
    return rows.select("category", "layer", weight.alias("spatial_weight"))


def reliability_summary(reliability: DataFrame, quantile: float = 0.8) -> DataFrame:
    """Per layer: tau, and the reliabilities by category as a map."""
    rows = reliability.groupBy("layer").agg(linear_quantile("reliability", quantile).alias("tau"), F.sort_array(F.collect_list(F.struct("category", "reliability"))).alias("entries"))
    return rows.select("layer", "tau", F.map_from_entries("entries").alias("reliability_by_category"))
