"""Seeded samples of exact size within groups: splits, memory sampling, candidate caps.

Rows are ordered by an MD5 of seed and id. A histogram of the hash's leading digits decides whole
buckets; only the rows of the one bucket that the sample's end falls into are ranked together. So a group
of any size is sampled without a task that holds it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.functions.statistics import rounded_count

DIGITS = 3  # leading hexadecimal digits that name a bucket


def order_hash(seed: Column | int, *ids: str) -> Column:
    return F.md5(F.concat_ws(":", (seed if isinstance(seed, Column) else F.lit(seed)).cast("string"), *[F.col(i).cast("string") for i in ids]))


def flagged(df: DataFrame, groups: list[str], ids: list[str], seed: Column | int, wanted: Callable[[Column], Column]) -> DataFrame:
    """`df` with `taken`: whether a row is among the first `wanted(n)` of its group's n rows in seeded order."""
    rows = df.withColumn("_hash", order_hash(seed, *ids)).withColumn("_bucket", F.substring("_hash", 1, DIGITS))
    buckets = rows.groupBy(*groups, "_bucket").agg(F.count(F.lit(1)).alias("_in"))
    whole = Window.partitionBy(*groups)
    before = F.coalesce(F.sum("_in").over(whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    buckets = buckets.withColumn("_before", before).withColumn("_wanted", wanted(F.sum("_in").over(whole))).drop("_in")
    nth = F.row_number().over(Window.partitionBy(*groups, "_bucket").orderBy("_hash", *ids))
    placed = rows.join(buckets, [*groups, "_bucket"])
    return placed.withColumn("taken", F.col("_before") + nth <= F.col("_wanted")).drop("_hash", "_bucket", "_before", "_wanted")


def calibration_count(n: Column, fraction: float) -> Column:
    return F.least(F.greatest(F.lit(2), rounded_count(n, fraction)), n - 1)


def split_normal(images: DataFrame, fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """(category, image_id, role) of normal images: a seeded part of each category is for calibration."""
    if not 0 < fraction < 1:
        raise ValueError("the calibration fraction lies between 0 and 1")
    rows = flagged(images.select("category", "image_id"), ["category"], ["image_id"], seed, lambda n: calibration_count(n, fraction))
    return rows.select("category", "image_id", F.when(F.col("taken"), "calibration").otherwise("memory").alias("role"))


def split_calibration(splits: DataFrame, fraction: float = 0.5, seed: int = 1042) -> DataFrame:
    """The same with calibration images divided into threshold_fit and normal_validation; a category with one alone is an error."""
    if not 0 < fraction < 1:
        raise ValueError("the fit fraction lies between 0 and 1")
    chosen = splits.filter("role = 'calibration'").drop("role")
    few = F.concat(F.lit("one calibration image in category "), F.col("category"), F.lit("; both parts need one"))
    fit = lambda n: F.when(n < 2, F.raise_error(few)).otherwise(F.least(F.greatest(F.lit(1), rounded_count(n, fraction)), n - 1))
    rows = flagged(chosen, ["category"], ["image_id"], seed, fit)
    rows = rows.select("category", "image_id", F.when(F.col("taken"), "threshold_fit").otherwise("normal_validation").alias("role"))
    return splits.filter("role = 'memory'").unionByName(rows)


def sample_patches(features: DataFrame, ratio: float = 0.1, seed: int = 42) -> DataFrame:
    """A seeded part of each category's and layer's patches; each layer has a seed of its own."""
    if not 0 < ratio <= 1:
        raise ValueError("the ratio lies above 0 and is at most 1")
    rows = flagged(features, ["category", "layer"], ["image_id", "patch_id"], F.lit(seed) + F.col("layer"), lambda n: F.greatest(F.lit(1), rounded_count(n, ratio)))
    return rows.filter("taken").drop("taken")


def cap_candidates(features: DataFrame, most: int = 50_000, seed: int = 42) -> DataFrame:
    """At most `most` patches of each category and layer, with `k_of`, the number of patches before."""
    counted = features.groupBy("category", "layer").agg(F.count(F.lit(1)).alias("k_of"))
    rows = flagged(features, ["category", "layer"], ["image_id", "patch_id"], F.lit(seed) + F.col("layer"), lambda n: F.least(F.lit(most), n))
    return rows.filter("taken").drop("taken").join(counted, ["category", "layer"])


def split_manifest(splits: DataFrame) -> DataFrame:
    """Per category, the sorted ids of each role; calibration is both of its parts."""

    def of(*roles: str) -> Column:
        return F.sort_array(F.collect_list(F.when(F.col("role").isin(*roles), F.col("image_id"))))

    return splits.groupBy("category").agg(of("memory").alias("memory"), of("threshold_fit", "normal_validation").alias("calibration"), of("threshold_fit").alias("threshold_fit"), of("normal_validation").alias("normal_validation"))


def split_coverage(calibration: DataFrame, splits: DataFrame) -> DataFrame:
    """Per category: calibration images, those with exactly one role, and those without; a sound split has none of the last."""
    roles = splits.filter("role IN ('threshold_fit', 'normal_validation')").groupBy("category", "image_id").agg(F.count(F.lit(1)).alias("roles"))
    joined = calibration.select("category", "image_id").distinct().join(roles, ["category", "image_id"], "left")
    return joined.groupBy("category").agg(F.count(F.lit(1)).alias("images"), F.sum((F.coalesce("roles", F.lit(0)) == 1).cast("long")).alias("covered"), F.sum((F.coalesce("roles", F.lit(0)) != 1).cast("long")).alias("uncovered"))
