"""Score calibration by robust statistics, layer fusion, thresholds from normal data, and their diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.functions.statistics import exact_median, exact_quantile
from heddle.operators.maps import image_maxima, image_top_means


def median_mad(scores: DataFrame, epsilon: float = 1e-6, keys: tuple[str, ...] = ("category", "layer")) -> DataFrame:
    """(keys, median, mad): lower median, and lower median of absolute deviations, at least `epsilon`."""
    medians = exact_median(scores, list(keys), "score")
    away = scores.join(medians, list(keys)).withColumn("away", F.abs(F.col("score") - F.col("median")))
    deviations = exact_median(away, list(keys), "away", "mad").withColumn("mad", F.greatest("mad", F.lit(epsilon)))
    return medians.join(deviations, list(keys)).select(*keys, "median", "mad")


def calibrated(scores: DataFrame, calibration: DataFrame, clamp: bool = False) -> DataFrame:
    """`scores` with score = (score - median) / mad; `calibration` has a row per category and layer."""
    value = (F.col("score") - F.col("median")) / F.col("mad")
    joined = scores.join(calibration.select("category", "layer", "median", "mad"), ["category", "layer"])
    return joined.withColumn("score", F.greatest(value, F.lit(0.0)) if clamp else value).drop("median", "mad")


def fused(scores: DataFrame) -> DataFrame:
    """(category, image_id, patch_id, score): the mean over layers."""
    return scores.groupBy("category", "image_id", "patch_id").agg(F.avg("score").alias("score"))


def pixel_threshold(maps: DataFrame, method: str = "global_quantile", pixel_quantile: float = 0.995, image_quantile: float = 0.95, topk_fraction: float = 0.01) -> DataFrame:
    """(category, pixel_threshold) from the maps (category, image_id, map) of normal images."""
    if method == "global_quantile":
        values, q = maps.select("category", F.explode("map").alias("value")), pixel_quantile
    elif method == "image_max_quantile":
        values, q = image_maxima(maps).withColumnRenamed("image_score", "value"), image_quantile
    elif method == "image_topk_quantile":
        values, q = image_top_means(maps, topk_fraction).withColumnRenamed("image_score", "value"), image_quantile
    else:
        raise ValueError(f"no such threshold method: {method}")
    return exact_quantile(values, ["category"], "value", q).withColumnRenamed("quantile", "pixel_threshold")


def image_threshold(image_scores: DataFrame, quantile: float = 0.99) -> DataFrame:
    return exact_quantile(image_scores, ["category"], "image_score", quantile).withColumnRenamed("quantile", "image_threshold")


def normal_diagnostics(maps: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Per category: the share of pixels, and of images with any pixel, at or above the pixel threshold."""
    joined = maps.join(thresholds.select("category", "pixel_threshold"), "category")
    above = F.aggregate("map", F.lit(0), lambda n, x: n + (x >= F.col("pixel_threshold")).cast("int"))
    counts = joined.select("category", above.alias("above"), F.size("map").alias("pixels"))
    return counts.groupBy("category").agg((F.sum("above") / F.sum("pixels")).alias("normal_pixel_positive_rate"), F.avg((F.col("above") > 0).cast("double")).alias("normal_image_positive_rate"))


def category_calibration(fit_maps: DataFrame, validation_maps: DataFrame, image_scores: DataFrame, splits: DataFrame, method: str = "global_quantile", image_quantile: float = 0.99, **options) -> DataFrame:
    """A record per category: thresholds from fit images, rates on held-out images, and image counts by role."""
    pixel = pixel_threshold(fit_maps, method, **options)
    role = lambda name: F.sum((F.col("role") == name).cast("long")).alias(f"{name}_images")
    counts = splits.groupBy("category").agg(role("memory"), role("threshold_fit"), role("normal_validation"))
    joined = pixel.join(image_threshold(image_scores, image_quantile), "category").join(normal_diagnostics(validation_maps, pixel), "category").join(counts, "category")
    # Medians use fit and validation images alike.
    fit_images = F.col("threshold_fit_images") + F.col("normal_validation_images")
    return joined.withColumn("normalization_fit_images", fit_images).withColumn("pixel_threshold_method", F.lit(method)).withColumn("normal_diagnostic_mode", F.lit("held_out_from_threshold_fit"))


def threshold_predictions(scores: DataFrame, thresholds: DataFrame, score: str, threshold: str) -> DataFrame:
    """`scores` with `predicted`: 1 where the score is at or above its category's threshold."""
    joined = scores.join(thresholds.select("category", threshold), "category")
    return joined.withColumn("predicted", (F.col(score) >= F.col(threshold)).cast("int")).drop(threshold)
