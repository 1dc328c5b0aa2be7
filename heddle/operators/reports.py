"""Experiment reports: stability of threshold methods, layer ablations, selection, validation and their gates.

Case metrics are rows (method, threshold_split_seed, category, metrics); layer metrics are rows (case,
case_order, category, metrics).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.functions.fingerprints import config_fingerprint, protocol_fingerprint, threshold_parameters
from heddle.functions.statistics import describe, nan_mean

METHODS = ("global_quantile", "image_max_quantile", "image_topk_quantile")
METRICS = ("pixel_F1_calibrated", "pixel_IoU_calibrated", "pixel_F1_oracle", "normal_pixel_positive_rate", "normal_image_positive_rate", "oracle_gap")
LAYER_METRICS = ("image_AUROC", "image_F1_calibrated", "image_F1_oracle", "pixel_AUROC", "pixel_F1_calibrated", "pixel_F1_oracle")
LAYER_CASES = ("block3", "block6", "block9", "block12", "fusion_3_6_9_12")
SELECTION_RULE = "least mean plus deviation of the normal image rate, then of the normal pixel rate, then the least deviations, then method order"


def enriched(cases: DataFrame) -> DataFrame:
    return cases.withColumn("oracle_gap", F.col("pixel_F1_oracle") - F.col("pixel_F1_calibrated"))


def case_label(layers: Column) -> Column:
    names = F.transform(layers, lambda x: x.cast("string"))
    return F.when(F.size(layers) == 1, F.concat(F.lit("block"), names[0])).otherwise(F.concat(F.lit("fusion_"), F.array_join(names, "_")))


def threshold_stability(cases: DataFrame) -> DataFrame:
    rows = enriched(cases)
    return rows.groupBy("method").agg(F.countDistinct("threshold_split_seed").alias("threshold_splits"), F.countDistinct("category").alias("categories"), *[a for m in METRICS for a in describe(m)])


def threshold_by_split(cases: DataFrame) -> DataFrame:
    return enriched(cases).groupBy("method", "threshold_split_seed").agg(*[F.avg(m).alias(m) for m in METRICS])


def threshold_per_category(cases: DataFrame) -> DataFrame:
    return enriched(cases).groupBy("category", "method").agg(*[a for m in METRICS for a in describe(m, ("mean", "std", "max"))])


def threshold_split_stability(cases: DataFrame) -> DataFrame:
    of = {"mean": F.avg, "std": F.stddev_pop}
    spread = lambda m: (F.max(m) - F.min(m)).alias(f"{m}_range_across_splits")
    return threshold_by_split(cases).groupBy("method").agg(*[a for m in METRICS for a in (*(f(m).alias(f"{m}_{name}_across_splits") for name, f in of.items()), spread(m))])


def shared_oracle(cases: DataFrame, tolerance: float = 1e-8) -> DataFrame:
    """Per category the mean best F1, the greatest difference between cases, and whether it is within `tolerance`."""
    rows = cases.groupBy("category").agg(F.avg("pixel_F1_oracle").alias("pixel_F1_oracle"), (F.max("pixel_F1_oracle") - F.min("pixel_F1_oracle")).alias("max_difference"))
    return rows.withColumn("shared", F.col("max_difference") <= tolerance)


def oracle_baseline(cases: DataFrame) -> DataFrame:
    return shared_oracle(cases).agg(F.avg("pixel_F1_oracle").alias("mean_pixel_F1_oracle"), F.max("max_difference").alias("max_difference"))


def method_order() -> Column:
    return F.array_position(F.array(*map(F.lit, METHODS)), F.col("method"))


def select_method(stability: DataFrame) -> DataFrame:
    """The one row of `threshold_split_stability` of least risk on held-out normal data; no anomaly label counts."""
    image, pixel = "normal_image_positive_rate", "normal_pixel_positive_rate"
    mean, std = (lambda m: F.col(f"{m}_mean_across_splits")), (lambda m: F.col(f"{m}_std_across_splits"))
    return stability.orderBy(mean(image) + std(image), mean(pixel) + std(pixel), std(image), std(pixel), method_order()).limit(1)


def selection_manifest(cases: DataFrame, configs: DataFrame | None = None) -> DataFrame:
    """One row: the selected method with its rates and risks, the split seeds, categories and oracle baseline.

    With `configs` (method, config_json), also what a later stage is held to: the selected method's threshold
    parameters, its model seed, and the fingerprints of the protocol without and with the method.
    """
    image, pixel = "normal_image_positive_rate", "normal_pixel_positive_rate"
    chosen = select_method(threshold_split_stability(cases))
    part = lambda m, short: [F.col(f"{m}_mean_across_splits").alias(f"{short}_mean"), F.col(f"{m}_std_across_splits").alias(f"{short}_std"), (F.col(f"{m}_mean_across_splits") + F.col(f"{m}_std_across_splits")).alias(f"{short}_risk")]
    seeds = cases.agg(F.sort_array(F.collect_set("threshold_split_seed")).alias("threshold_split_seeds"), F.sort_array(F.collect_set("category")).alias("development_categories"))
    row = chosen.select(F.lit(1).alias("schema_version"), F.col("method").alias("selected_method"), F.lit(SELECTION_RULE).alias("selection_rule"), *part(image, "image"), *part(pixel, "pixel"))
    # All three have one row.
    row = row.crossJoin(seeds).crossJoin(oracle_baseline(cases))
    return row if configs is None else row.join(locked_fields(configs).withColumnRenamed("method", "selected_method"), "selected_method")


#: What a validation stage must share with the manifest of the stage that selected its method.
LOCKED = ("selected_parameters", "model_seed", "base_protocol_fingerprint", "selected_protocol_fingerprint", "threshold_split_seeds")


def locked_fields(configs: DataFrame) -> DataFrame:
    """`configs` with its config_json replaced by the fields that lock a protocol."""
    made = {
        "selected_parameters": threshold_parameters(F.col("config_json")), "model_seed": F.get_json_object("config_json", "$.experiment.seed").cast("int"),
        "base_protocol_fingerprint": protocol_fingerprint(F.col("config_json")), "selected_protocol_fingerprint": protocol_fingerprint(F.col("config_json"), True),
    }
    return configs.select(*[c for c in configs.columns if c != "config_json"], *[c.alias(name) for name, c in made.items()])


def manifest_faults(manifest: DataFrame, validation: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, fields): the rows of `validation` (keys, config_json, threshold_split_seeds) that differ from the
    one row of `manifest`, and in which locked fields."""
    locked = manifest.select(*[F.col(f).alias(f"other_{f}") for f in LOCKED])
    rows = locked_fields(validation).withColumn("threshold_split_seeds", F.sort_array("threshold_split_seeds"))
    return rows.crossJoin(locked).select(*keys, _differing(LOCKED).alias("fields")).filter(F.size("fields") > 0)


def _differing(fields) -> Column:
    return F.filter(F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"other_{f}")), F.lit(f)) for f in fields]), lambda f: f.isNotNull())


#: A completion marker's fields and types, which are fixed by its format.
MARKER = "status string, expected_categories array<string>, completed_categories array<string>, expected_count int, completed_count int, seed int, threshold_split_seed int, pixel_threshold_method string, active_layers array<int>, spatial_mode string, config_fingerprint string"


def completion_faults(cases: DataFrame) -> DataFrame:
    """(case_dir, fields): the cases that aren't complete, from (case_dir, config_json, metrics_json, marker_json).

    `fields` names what the marker says otherwise than the configuration, `marker` where there is none, and
    `categories` where the metrics list other categories than the configuration or in another order.
    """
    own = F.from_json("config_json", "struct<data:struct<categories:array<string>>,experiment:struct<seed:int>,calibration:struct<threshold_split_seed:int,pixel_threshold_method:string>,model:struct<active_layers:array<int>>,retrieval:struct<spatial_mode:string>>")
    rows = cases.withColumn("own", own).withColumn("marker", F.from_json("marker_json", f"struct<{MARKER.replace(' ', ':').replace(',:', ',')}>"))
    names = F.col("own.data.categories")
    wanted = {
        "status": F.lit("complete"), "expected_categories": names, "completed_categories": names, "expected_count": F.size(names), "completed_count": F.size(names), "seed": F.col("own.experiment.seed"),
        "threshold_split_seed": F.col("own.calibration.threshold_split_seed"), "pixel_threshold_method": F.col("own.calibration.pixel_threshold_method"), "active_layers": F.col("own.model.active_layers"),
        "spatial_mode": F.col("own.retrieval.spatial_mode"), "config_fingerprint": config_fingerprint(F.col("config_json")),
    }
    rows = rows.select("case_dir", "metrics_json", "marker_json", names.alias("names"), *[F.col(f"marker.{f}").alias(f) for f in wanted], *[c.alias(f"other_{f}") for f, c in wanted.items()])
    listed = F.transform(F.from_json("metrics_json", "struct<categories:array<struct<category:string>>>")["categories"], lambda c: c["category"])
    wrong = F.when(F.col("marker_json").isNull(), F.array(F.lit("marker"))).otherwise(_differing(wanted))
    fields = F.concat(wrong, F.when(listed.eqNullSafe(F.col("names")), F.array().cast("array<string>")).otherwise(F.array(F.lit("categories"))))
    return rows.select("case_dir", fields.alias("fields")).filter(F.size("fields") > 0)


def layer_ablation_means(layers: DataFrame) -> DataFrame:
    return layers.groupBy("case", "case_order").agg(*[nan_mean(m).alias(m) for m in LAYER_METRICS])


def best_single_layer(layers: DataFrame, fusion: str = "fusion_3_6_9_12") -> DataFrame:
    """Per category the single layer of highest pixel AUROC, the first of equal ones."""
    nth = F.row_number().over(Window.partitionBy("category").orderBy(F.desc("pixel_AUROC"), "case_order"))
    rows = layers.filter(F.col("case") != fusion).withColumn("nth", nth).filter("nth = 1")
    return rows.select("category", F.col("case").alias("best_single_layer"), F.col("pixel_AUROC").alias("best_single_pixel_AUROC"))


def layer_win_counts(layers: DataFrame) -> DataFrame:
    return best_single_layer(layers).groupBy(F.col("best_single_layer").alias("case")).agg(F.count(F.lit(1)).alias("wins"))


def layer_ablation_per_category(layers: DataFrame, fusion: str = "fusion_3_6_9_12") -> DataFrame:
    wide = layers.groupBy("category").pivot("case", list(LAYER_CASES)).agg(F.first("pixel_AUROC").alias("pixel_AUROC"), F.first("pixel_F1_oracle").alias("pixel_F1_oracle"))
    rows = wide.join(best_single_layer(layers, fusion), "category").withColumn("fusion_pixel_AUROC", F.col(f"{fusion}_pixel_AUROC"))
    return rows.withColumn("fusion_minus_best_single", F.col("fusion_pixel_AUROC") - F.col("best_single_pixel_AUROC"))


def protocol_full_by_split(dev: DataFrame, validation: DataFrame, dev_categories: int = 5, validation_categories: int = 10) -> DataFrame:
    """Means by split of both stages together, weighed by their numbers of categories, from rows by split."""
    a, b = float(dev_categories), float(validation_categories)
    left = dev.select("threshold_split_seed", *[F.col(m).alias(f"dev_{m}") for m in METRICS])
    joined = left.join(validation.select("threshold_split_seed", *METRICS), "threshold_split_seed")
    return joined.select("threshold_split_seed", *[((a * F.col(f"dev_{m}") + b * F.col(m)) / (a + b)).alias(m) for m in METRICS])


def protocol_comparison(dev: DataFrame, validation: DataFrame, dev_categories: int = 5, validation_categories: int = 10) -> DataFrame:
    """Rows dev, validation and full: mean and deviation over splits of each metric, from rows by split."""

    def row(name: str, source: str, categories: int, by_split: DataFrame) -> DataFrame:
        made = by_split.agg(F.count(F.lit(1)).alias("threshold_splits"), *[x for m in METRICS for x in describe(m, ("mean", "std"))])
        return made.select(F.lit(name).alias("group"), F.lit(source).alias("source"), F.lit(categories).alias("categories"), *made.columns)

    full = protocol_full_by_split(dev, validation, dev_categories, validation_categories)
    both = row("dev", "selection_stage", dev_categories, dev).unionByName(row("validation", "locked_validation", validation_categories, validation))
    return both.unionByName(row("full", "derived_dev_plus_locked_validation", dev_categories + validation_categories, full))


def case_grid(methods: DataFrame, seeds: DataFrame) -> DataFrame:
    """All combinations of two short lists of parameters."""
    return methods.distinct().crossJoin(seeds.distinct())


def pending_cases(grid: DataFrame, completed: DataFrame, keys: list[str]) -> DataFrame:
    return grid.join(completed.select(*keys).distinct(), keys, "left_anti")


def cases_to_run(desired: DataFrame, markers: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, found): the cases of `desired` (keys, categories, config_fingerprint) without a marker that fits.

    A case is done if its marker (keys and the marker's fields) is complete, names just its categories, and has
    the fingerprint of the configuration that is wanted now. `found` tells whether there is any marker.
    """
    rows = desired.join(markers.withColumnRenamed("config_fingerprint", "marker_fingerprint").withColumn("found", F.lit(True)), keys, "left")
    n = F.size("categories")
    done = (F.col("status") == "complete") & (F.col("expected_categories") == F.col("categories")) & (F.col("completed_categories") == F.col("categories")) & (F.col("expected_count") == n) & (F.col("completed_count") == n) & (F.col("marker_fingerprint") == F.col("config_fingerprint"))
    return rows.filter(~F.coalesce(done, F.lit(False))).select(*keys, F.coalesce("found", F.lit(False)).alias("found"))


def duplicate_cases(cases: DataFrame, keys: list[str]) -> DataFrame:
    return cases.groupBy(*keys).agg(F.count(F.lit(1)).alias("cases")).filter("cases > 1")


def missing_cases(cases: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    return expected.select(key).distinct().join(cases.select(key), key, "left_anti")


def stage_overlap(dev: DataFrame, validation: DataFrame) -> DataFrame:
    """Categories in both stages; sound stages share none."""
    return dev.select("category").intersect(validation.select("category"))


def mismatches(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """(keys, fields): rows of both sides whose fields differ, with the names of those that do."""
    other = right.select(*keys, *[F.col(f).alias(f"other_{f}") for f in fields])
    return left.join(other, keys).select(*keys, _differing(fields).alias("fields")).filter(F.size("fields") > 0)
