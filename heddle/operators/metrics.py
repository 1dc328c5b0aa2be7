"""Ranking and threshold metrics of scores against labels, per category.

Running sums see a histogram by category and score, so that equal scores are one row, and are taken within
ranges of scores, so that no task ranks a category. Counts at a threshold are plain sums of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.functions.statistics import nan_mean, running_sums
from heddle.functions.storage import stored

NAN = float("nan")


def counted(scored: DataFrame) -> DataFrame:
    """(category, score, p, n) of each row."""
    return scored.select("category", "score", F.col("label").cast("long").alias("p"), (1 - F.col("label")).cast("long").alias("n"))


def histogram(scored: DataFrame) -> DataFrame:
    """(category, score, p, n): counts of labels 1 and 0."""
    return counted(scored).groupBy("category", "score").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))


def ranking(scored: DataFrame) -> DataFrame:
    """(category, auroc, average_precision, f1_oracle, threshold_oracle): all from one set of running sums.

    AUROC and average precision are NaN where only one class is there; the best F1 is 0 without positives.
    Of equal F1, the lowest threshold counts.
    """
    return ranked(histogram(scored), counted(scored))


def ranked(counts: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """`ranking` from a histogram, and the rows that it counts where these are cheaper to read."""
    rows = counts if rows is None else rows
    sums = running_sums(counts, ["category"], "score", ["p", "n"], descending=True, rows=rows).withColumnsRenamed({"running_p": "tp", "running_n": "fp"})
    totals = stored(rows.groupBy("category").agg(F.sum("p").alias("positives"), F.sum("n").alias("negatives")))
    rows = sums.join(totals, "category")
    tp, fp, p, n = (F.col(c).cast("double") for c in ("tp", "fp", "p", "n"))
    positives, negatives = F.col("positives").cast("double"), F.col("negatives").cast("double")
    f1 = F.when(F.col("positives") > 0, 2 * tp / (tp + fp + positives)).otherwise(F.lit(0.0))
    best = F.max(F.struct(f1.alias("f1"), (-F.col("score")).alias("lowest")))
    made = rows.groupBy("category").agg(F.first("positives").alias("positives"), F.first("negatives").alias("negatives"), F.sum(p * (negatives - fp + n / 2)).alias("pairs"), F.sum(p * tp / (tp + fp)).alias("precisions"), best.alias("best"))
    both = (F.col("positives") > 0) & (F.col("negatives") > 0)
    auroc = F.when(both, F.col("pairs") / (F.col("positives").cast("double") * F.col("negatives"))).otherwise(F.lit(NAN))
    aupr = F.when(both, F.col("precisions") / F.col("positives")).otherwise(F.lit(NAN))
    return made.select("category", auroc.alias("auroc"), aupr.alias("average_precision"), F.col("best.f1").alias("f1_oracle"), (-F.col("best.lowest")).alias("threshold_oracle"))


def at_threshold(scored: DataFrame, thresholds: DataFrame, threshold: str = "threshold") -> DataFrame:
    """(category, f1_calibrated, iou_calibrated) of the predictions at or above a category's threshold.

    Without any positive, true or predicted, F1 is 0 and IoU is 1.
    """
    return fixed(counted(scored), thresholds, threshold)


def fixed(counts: DataFrame, thresholds: DataFrame, threshold: str) -> DataFrame:
    """`at_threshold` from rows or a histogram: three sums, without moving a row where the thresholds are few."""
    rows = counts.join(stored(thresholds.select("category", F.col(threshold).alias("at"))), "category")
    hit = F.col("score") >= F.col("at")
    count = lambda c, what: F.coalesce(F.sum(F.when(c, F.col(what))), F.lit(0))
    made = rows.groupBy("category").agg(count(hit, "p").alias("tp"), count(hit, "n").alias("fp"), count(~hit, "p").alias("fn"))
    union = F.col("tp") + F.col("fp") + F.col("fn")
    share = lambda top, bottom, none: F.when(bottom > 0, top / bottom).otherwise(F.lit(none))
    return made.select("category", share(2.0 * F.col("tp"), union + F.col("tp"), 0.0).alias("f1_calibrated"), share(1.0 * F.col("tp"), union, 1.0).alias("iou_calibrated"))


def binary_metrics(scored: DataFrame, thresholds: DataFrame, threshold: str, level: str, oracle: bool = True) -> DataFrame:
    """The six metrics of one level, their names led by `level`; without `oracle`, its two are NaN.

    The histogram is written once, so that the scores are made and read once.
    """
    counts = stored(histogram(scored))
    rows = ranked(counts).join(fixed(counts, thresholds, threshold), "category")
    names = {"auroc": "AUROC", "average_precision": "AUPR", "f1_calibrated": "F1_calibrated", "iou_calibrated": "IoU_calibrated", "f1_oracle": "F1_oracle", "threshold_oracle": "threshold_oracle"}
    value = lambda c: F.col(c) if oracle or "oracle" not in c else F.lit(NAN)
    return rows.select("category", *[value(c).alias(f"{level}_{name}") for c, name in names.items()])


def category_metrics(image_scored: DataFrame, pixel_scored: DataFrame, calibration: DataFrame, **options) -> DataFrame:
    """A row per category: metrics of images and of pixels, thresholds, and the number of test images."""
    images = binary_metrics(image_scored, calibration, "image_threshold", "image", **options)
    pixel = binary_metrics(pixel_scored, calibration, "pixel_threshold", "pixel", **options)
    counts = image_scored.groupBy("category").agg(F.count(F.lit(1)).alias("test_images"))
    return images.join(pixel, "category").join(calibration.select("category", "image_threshold", "pixel_threshold"), "category").join(counts, "category")


def with_mean_row(rows: DataFrame, label: str = "category") -> DataFrame:
    """`rows` and a row named mean: the means, without NaN, of all numeric columns."""
    numeric = [f.name for f in rows.schema if f.dataType.typeName() in ("double", "float", "integer", "long", "short")]
    as_double: list[Column] = [F.col(c).cast("double").alias(c) if c in numeric else F.col(c) for c in rows.columns]
    doubles = rows.select(*as_double)
    made = doubles.agg(*[nan_mean(c).alias(c) for c in numeric])
    others = {c: F.lit("mean") if c == label else F.lit(None).cast(rows.schema[c].dataType) for c in rows.columns if c not in numeric}
    return doubles.unionByName(made.select(*[others[c].alias(c) if c in others else F.col(c) for c in rows.columns]))


def latency(durations: DataFrame) -> DataFrame:
    """Per category, the seconds and the milliseconds per image of (category, seconds), a row per image."""
    total = F.sum("seconds")
    return durations.groupBy("category").agg(total.alias("inference_seconds"), (1000 * total / F.count(F.lit(1))).alias("ms_per_image"))
