"""The anomaly data model over the driver tables, and the standard flow from features to scores.

A category is an embedding's label and an image its id. Of the 64 numbers of an embedding, two halves are
layers 3 and 6, each with a 2 x 2 grid of patches of 8 numbers. Three of four images are for training. The
test images of a category are its own (normal) and those of the next label (anomalous), whose masks are
one quadrant of the map.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.functions.storage import stored
from heddle.operators import calibration, features, maps, memory, nearest, reliability, sampling

LAYERS = {3: 0, 6: 32}
PATCHES, WIDTH, MAP_SIZE = 4, 8, 8
#: Parameters of the registered flow.
RATIO, EPSILON, IMAGE_TOPK, PIXEL_TOPK = 0.5, 1e-6, 0.1, 0.05


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def kept(method):
    """The step's table is made once for a flow, and written to the shared folder: later steps read it several
    times, plan it as a scan, and survive the loss of executors."""

    @wraps(method)
    def once(self):
        if method.__name__ not in self.made:
            self.made[method.__name__] = stored(method(self))
        return self.made[method.__name__]

    return once


class Flow:
    """Every step's table, built on demand from one directory of driver tables.

    Steps are kept within a flow. A query makes a flow of its own, so that it reads its tables; a caller who wants
    several results of one state of the tables asks one flow for them.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.embeddings, self.made = spark, read(spark, sf_dir, "embeddings"), {}

    def tokens(self) -> DataFrame:
        """(category, image_id, layer, tokens): a class token of zeros, and the patches."""
        numbers = F.transform("embedding", lambda x: x.cast("double"))
        rows = []
        for layer, offset in LAYERS.items():
            parts = [F.slice(numbers, offset + WIDTH * p + 1, WIDTH) for p in range(PATCHES)]
            first = F.transform(parts[0], lambda x: x * 0.0)
            rows.append(self.embeddings.select(F.col("label").cast("string").alias("category"), F.col("vec_id").alias("image_id"), F.lit(layer).alias("layer"), F.array(first, *parts).alias("tokens")))
        return rows[0].unionByName(rows[1])

    def patches(self) -> DataFrame:
        return features.patches_of(self.tokens(), list(LAYERS))

    def features(self) -> DataFrame:
        return features.tokens_to_patches(self.tokens(), list(LAYERS))

    def images(self) -> DataFrame:
        return self.embeddings.select(F.col("label").cast("string").alias("category"), F.col("vec_id").alias("image_id"), (F.col("vec_id") % 4 < 3).alias("is_train"))

    def normal(self) -> DataFrame:
        return self.images().filter("is_train")

    def normal_splits(self) -> DataFrame:
        return sampling.split_normal(self.normal())

    @kept
    def splits(self) -> DataFrame:
        return sampling.split_calibration(self.normal_splits())

    @kept
    def bank(self) -> DataFrame:
        return memory.memory_bank(self.features(), self.splits(), PATCHES, RATIO)

    def calibration_features(self) -> DataFrame:
        chosen = self.splits().filter("role != 'memory'").select("category", "image_id")
        return features.with_coordinates(self.features().join(chosen, ["category", "image_id"], "left_semi"), PATCHES)

    def test_images(self) -> DataFrame:
        own = self.images().filter("NOT is_train").select("category", "image_id", F.lit(0).alias("label"))
        other = own.select(((F.col("category").cast("int") + 9) % 10).cast("string").alias("category"), "image_id", F.lit(1).alias("label"))
        return own.unionByName(other)

    def test_patches(self) -> DataFrame:
        return self.features().drop("category").join(self.test_images().select("category", "image_id"), "image_id")

    def test_features(self) -> DataFrame:
        return features.with_coordinates(self.test_patches(), PATCHES)

    @kept
    def reliability(self) -> DataFrame:
        return reliability.spatial_reliability(self.calibration_features())

    @kept
    def weights(self) -> DataFrame:
        return reliability.spatial_weights(self.reliability())

    @kept
    def calibration_scores(self) -> DataFrame:
        return nearest.nearest(self.calibration_features(), self.bank(), self.weights())

    @kept
    def test_scores(self) -> DataFrame:
        return nearest.nearest(self.test_features(), self.bank(), self.weights())

    @kept
    def layer_calibration(self) -> DataFrame:
        return calibration.median_mad(self.calibration_scores(), EPSILON)

    def _maps(self, scores: DataFrame) -> DataFrame:
        fused = calibration.fused(calibration.calibrated(scores, self.layer_calibration()))
        return maps.upsampled(maps.patch_grids(fused), MAP_SIZE)

    def fused(self) -> DataFrame:
        return calibration.fused(calibration.calibrated(self.test_scores(), self.layer_calibration()))

    @kept
    def all_calibration_maps(self) -> DataFrame:
        return self._maps(self.calibration_scores())

    def calibration_maps(self, role: str | None = None) -> DataFrame:
        rows = self.all_calibration_maps()
        return rows.join(self.splits().filter(F.col("role") == role).select("category", "image_id"), ["category", "image_id"], "left_semi") if role else rows

    @kept
    def test_maps(self) -> DataFrame:
        return self._maps(self.test_scores())

    def image_scores(self, rows: DataFrame) -> DataFrame:
        return maps.image_scores(rows, "topk_mean", IMAGE_TOPK)

    @kept
    def category_calibration(self) -> DataFrame:
        fit = self.calibration_maps("threshold_fit")
        return calibration.category_calibration(fit, self.calibration_maps("normal_validation"), self.image_scores(fit), self.splits(), topk_fraction=PIXEL_TOPK)

    @kept
    def labelled_images(self) -> DataFrame:
        return self.image_scores(self.test_maps()).join(self.test_images(), ["category", "image_id"])

    def masks(self) -> DataFrame:
        """(image_id, mask) of anomalous images: one quadrant."""
        half, at = MAP_SIZE // 2, F.floor(F.col("image_id") / 4) % 4
        inside = lambda i: (F.floor(i % MAP_SIZE / half) == at % 2) & (F.floor(i / (MAP_SIZE * half)) == F.floor(at / 2))
        mask = F.transform(F.sequence(F.lit(0), F.lit(MAP_SIZE * MAP_SIZE - 1)), lambda i: inside(i).cast("int"))
        return self.images().filter("NOT is_train").select("image_id", mask.alias("mask"))

    def labelled_pixels(self) -> DataFrame:
        rows = self.test_maps().join(self.test_images(), ["category", "image_id"])
        normal, anomalous = (maps.pixel_labels(rows.filter(F.col("label") == v).drop("label"), m) for v, m in ((0, self.masks().limit(0)), (1, self.masks())))
        return normal.unionByName(anomalous)


def scored_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(category, score, label) of line items: the price as a score of returns."""
    return read(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("category"), F.col("l_extendedprice").alias("score"), (F.col("l_returnflag") == "R").cast("int").alias("label"))


def scored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(category, score, label) of events, with many equal scores."""
    return read(spark, sf_dir, "events").select((F.col("user_id") % 10).cast("string").alias("category"), F.round("value", 0).alias("score"), (F.col("event_type") == "error").cast("int").alias("label"))


def supplier_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(category, image_id, map) with the prices of each supplier's line items as a map."""
    rows = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("image_id")).agg(F.sort_array(F.collect_list("l_extendedprice")).alias("map"))
    return rows.select((F.col("image_id") % 10).cast("string").alias("category"), "image_id", "map")


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case metrics from line items: methods by return flag, split seeds by part, categories by supplier."""
    method = F.when(F.col("l_returnflag") == "A", "global_quantile").when(F.col("l_returnflag") == "N", "image_max_quantile").otherwise("image_topk_quantile")
    rows = read(spark, sf_dir, "lineitem").groupBy(method.alias("method"), (42 + F.col("l_partkey") % 3).cast("int").alias("threshold_split_seed"), (F.col("l_suppkey") % 10).cast("int").alias("c"))
    made = rows.agg(F.avg("l_discount").alias("f1"), F.avg("l_tax").alias("iou"), F.avg("l_quantity").alias("q"), F.count(F.lit(1)).alias("n"))
    return made.select(
        "method", "threshold_split_seed", F.col("c").cast("string").alias("category"), (10 * F.col("f1")).alias("pixel_F1_calibrated"), (10 * F.col("iou")).alias("pixel_IoU_calibrated"),
        (0.5 + 0.01 * F.col("c")).alias("pixel_F1_oracle"), (F.col("q") / 1000).alias("normal_pixel_positive_rate"), (F.col("q") / 100).alias("normal_image_positive_rate"), F.col("n").alias("normal_validation_images"),
    )


def layer_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layer metrics from line items: cases by part, categories by supplier."""
    from heddle.operators.reports import LAYER_CASES

    name = F.element_at(F.array(*map(F.lit, LAYER_CASES)), (F.col("o") + 1).cast("int"))
    rows = read(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") % 5).cast("int").alias("o"), (F.col("l_suppkey") % 10).cast("int").alias("c"))
    made = rows.agg(F.avg("l_discount").alias("d"), F.avg("l_tax").alias("t"), F.avg("l_quantity").alias("q"))
    return made.select(
        name.alias("case"), F.col("o").alias("case_order"), F.col("c").cast("string").alias("category"), (10 * F.col("d")).alias("image_AUROC"), (10 * F.col("t")).alias("image_F1_calibrated"), (F.col("q") / 50).alias("image_F1_oracle"),
        (0.5 + 5 * F.col("d")).alias("pixel_AUROC"), (5 * F.col("t")).alias("pixel_F1_calibrated"), (F.col("q") / 40).alias("pixel_F1_oracle"),
    )


#: A configuration with the fields that fingerprints read: fixed values.
CONFIG = {
    "experiment": {"seed": 42}, "data": {"dataset": "suppliers", "image_size": 8, "resize_mode": "resize", "calibration_fraction": 0.2},
    "model": {"checkpoint": "none", "active_layers": [3, 6], "token_norm": "none"}, "memory": {"sampling": "random", "ratio": 0.5, "projection_dim": 0, "max_candidates": 1000},
    "retrieval": {"spatial_mode": "adaptive", "fixed_lambda": 0.05, "query_chunk_size": 64, "bank_chunk_size": 64, "lambda_max": 0.1, "tau_quantile": 0.8},
    "calibration": {"mad_epsilon": 0.25, "threshold_fit_fraction": 0.5, "threshold_split_seed": 42, "pixel_threshold_method": "global_quantile", "pixel_quantile": 0.995, "pixel_image_quantile": 0.95, "pixel_topk_fraction": 0.05, "image_quantile": 0.99, "clamp_min_zero": True},
    "inference": {"gaussian_sigma": 0.0, "image_score": "topk_mean", "image_topk_fraction": 0.1}, "evaluation": {"compute_oracle_f1": True},
}


def config_json(**changes: Column) -> Column:
    """CONFIG as JSON, with columns for some of its fields: part__field=column."""
    given = {tuple(name.split("__")): value for name, value in changes.items()}
    parts = []
    for part, fields in CONFIG.items():
        own = {name: F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v) for name, v in fields.items()} | {name: v for (p, name), v in given.items() if p == part}
        parts.append(F.struct(*[v.alias(name) for name, v in own.items()]).alias(part))
    return F.to_json(F.struct(*parts))


def marked_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, case_dir, categories, config_json, metrics_json, and a marker's fields) for each supplier, a case whose
    categories are its return flags. Faults are planted by the supplier's key: every 5th is incomplete, every 7th
    has another seed, every 11th a stale fingerprint, every 13th no marker, every 17th metrics in another order."""
    from heddle.functions.fingerprints import config_fingerprint

    rows = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.sort_array(F.collect_set("l_returnflag")).alias("categories"))
    every = lambda n: F.col("k") % n == 0
    done = F.when(every(5), F.slice("categories", 1, F.size("categories") - 1)).otherwise(F.col("categories"))
    listed = F.transform(F.when(every(17), F.reverse("categories")).otherwise(F.col("categories")), lambda c: F.struct(c.alias("category")))
    rows = rows.withColumn("config_json", config_json(data__categories=F.col("categories"))).withColumn("metrics_json", F.to_json(F.struct(listed.alias("categories"))))
    config = CONFIG["calibration"]
    marker = {
        "status": F.when(every(5), "incomplete").otherwise("complete"), "expected_categories": F.col("categories"), "completed_categories": done, "expected_count": F.size("categories"), "completed_count": F.size(done),
        "seed": F.when(every(7), 43).otherwise(42), "threshold_split_seed": F.lit(config["threshold_split_seed"]), "pixel_threshold_method": F.lit(config["pixel_threshold_method"]), "active_layers": F.array(F.lit(3), F.lit(6)),
        "spatial_mode": F.lit("adaptive"), "config_fingerprint": F.when(every(11), "stale").otherwise(config_fingerprint(F.col("config_json"))),
    }
    return rows.select("k", F.col("k").cast("string").alias("case_dir"), "categories", "config_json", "metrics_json", *[c.alias(f) for f, c in marker.items()])


def _faulty(n: int) -> Column:
    return F.col("k") % n == 0


def gated_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, method, threshold_split_seed, config_json, metrics_json): a case for each supplier, with faults by its key."""
    from heddle.operators.reports import METHODS

    rows = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k")).distinct()
    method = F.when(_faulty(31), "another").otherwise(F.element_at(F.array(*map(F.lit, METHODS)), (F.col("k") % 3 + 1).cast("int")))
    config = config_json(
        experiment__seed=F.when(_faulty(5), 43).otherwise(42), experiment__protocol_stage=F.when(_faulty(7), "validation").otherwise("development"), data__categories=F.array(*map(F.lit, "abc")),
        calibration__pixel_quantile=F.when(_faulty(11), 0.9).otherwise(0.995), memory__ratio=F.when(_faulty(13), 0.25).otherwise(0.5), model__active_layers=F.when(_faulty(29), F.array(F.lit(6), F.lit(3))).otherwise(F.array(F.lit(3), F.lit(6))),
    )
    row = lambda c: F.struct(F.lit(c).alias("category"), (F.when(_faulty(19), "same_images").otherwise("held_out_from_threshold_fit") if c == "b" else F.lit("held_out_from_threshold_fit")).alias("normal_diagnostic_mode"), (F.when(_faulty(23), 0).otherwise(2) if c == "c" else F.lit(2)).alias("normal_validation_images"))
    listed = F.array(*map(row, "abc"))
    metrics = F.to_json(F.struct(F.when(_faulty(17), F.reverse(listed)).otherwise(listed).alias("categories")))
    return rows.select("k", method.alias("method"), (42 + F.floor(F.col("k") / 3) % 3).cast("int").alias("threshold_split_seed"), config.alias("config_json"), metrics.alias("metrics_json"))


def gated_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, case, config_json, metrics_json): a layer study for each supplier, whose cases are its line numbers; each differs in one of nine fields."""
    from heddle.operators.reports import LAYER_CASES

    rows = read(spark, sf_dir, "lineitem").filter("l_linenumber <= 5").select(F.col("l_suppkey").alias("k"), F.col("l_linenumber").alias("n")).distinct()
    other = lambda i, a, b: F.when((F.col("k") + F.col("n")) % 9 == i, b).otherwise(a)
    config = config_json(
        experiment__seed=other(0, 42, 7), data__image_size=other(1, 8, 16), data__calibration_fraction=other(2, 0.2, 0.25), model__checkpoint=other(3, "none", "some"), model__token_norm=other(4, "none", "l2"),
        memory__sampling=other(5, "random", "k_center"), memory__ratio=other(6, 0.5, 0.1), retrieval__spatial_mode=other(7, "adaptive", "none"), retrieval__lambda_max=other(8, 0.1, 0.2),
    )
    listed = F.array(*[F.struct(F.lit(c).alias("category")) for c in "abc"])
    metrics = F.to_json(F.struct(F.when(F.col("n") % 4 == 0, F.reverse(listed)).otherwise(listed).alias("categories")))
    return rows.select("k", F.element_at(F.array(*map(F.lit, LAYER_CASES)), F.col("n").cast("int")).alias("case"), config.alias("config_json"), metrics.alias("metrics_json"))


def staged_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, dev_json, validation_json, selection_json, validation_selection_json): summaries of two stages for each customer with orders, with faults by its key."""
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")).distinct()
    method = F.lit("global_quantile")
    names = lambda low, high: F.array(*[F.lit(f"c{i}") for i in range(low, high)])
    selection = lambda kept: F.to_json(F.struct(method.alias("selected_method"), F.lit("f1").alias("selected_protocol_fingerprint"), F.struct(F.lit(0.995).alias("pixel_quantile")).alias("selected_parameters"), kept.alias("note")))
    mode = lambda n: F.when(_faulty(n), "same_images").otherwise("held_out_from_threshold_fit").alias("normal_diagnostic_mode")
    dev = F.struct(F.when(_faulty(2), "validation").otherwise("development").alias("stage"), F.lit(42).alias("model_seed"), F.array(F.lit(42), F.lit(43)).alias("threshold_split_seeds"), F.lit("b1").alias("base_protocol_fingerprint"), mode(29), names(0, 5).alias("categories"))
    shared = F.when(_faulty(37) & _faulty(41), names(4, 13)).when(_faulty(37), names(4, 14)).when(_faulty(41), names(5, 14)).otherwise(names(5, 15))
    validation = F.struct(
        F.when(_faulty(3), "development").otherwise("validation").alias("stage"), F.when(_faulty(7), F.array(method, F.lit("other"))).otherwise(F.array(method)).alias("methods"), F.when(_faulty(11), 43).otherwise(42).alias("model_seed"),
        F.when(_faulty(13), F.array(F.lit(42))).otherwise(F.array(F.lit(42), F.lit(43))).alias("threshold_split_seeds"), F.when(_faulty(17), "b2").otherwise("b1").alias("base_protocol_fingerprint"),
        F.struct(F.when(_faulty(19), "f2").otherwise("f1").alias("global_quantile")).alias("method_protocol_fingerprints"), F.struct(F.struct(F.when(_faulty(23), 0.9).otherwise(0.995).alias("pixel_quantile")).alias("global_quantile")).alias("threshold_parameters"), mode(31), shared.alias("categories"),
    )
    return rows.select("k", F.to_json(dev).alias("dev_json"), F.to_json(validation).alias("validation_json"), selection(F.lit("kept")).alias("selection_json"), selection(F.when(_faulty(5), "changed").otherwise("kept")).alias("validation_selection_json"))
