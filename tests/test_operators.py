"""Hand-computed cases of every family of the anomaly jobs."""

import itertools
import json
import copy
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from heddle.functions import fingerprints
from heddle.functions import statistics
from heddle.functions.statistics import exact_median, exact_quantile, exact_quantiles, lower_median, nan_mean, running_sums
from heddle.functions.vectors import grid_side, l2_normalised
from heddle.plans import adapters
from heddle.operators import gates, calibration, features, maps, memory, metrics, nearest, reports, sampling
from heddle.operators import reliability as rel

FEATURES = "category string, image_id long, layer int, patch_id int, v array<double>"


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def random_features(spark, images=3, patches=4, dims=8, layers=(3,), seed=1):
    rng = np.random.default_rng(seed)
    out = []
    for layer in layers:
        for i in range(images):
            for p in range(patches):
                v = rng.standard_normal(dims)
                out.append(("a", i, layer, p, [float(x) for x in v / np.linalg.norm(v)]))
    return spark.createDataFrame(out, FEATURES)


def test_patch_grid(spark):
    got = features.with_coordinates(spark.createDataFrame([(i,) for i in range(4)], "patch_id int"), 4)
    assert rows(got, "patch_id") == [(0, 0.0, 0.0), (1, 1.0, 0.0), (2, 0.0, 1.0), (3, 1.0, 1.0)]
    with pytest.raises(ValueError):
        grid_side(5)
    one = features.with_coordinates(spark.createDataFrame([(0,)], "patch_id int"), 1).first()
    assert (one.x, one.y) == (0.0, 0.0)


def test_zero_vector_stays_zero(spark):
    got = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "v array<double>").select(l2_normalised(F.col("v")).alias("v")).collect()
    assert got[0].v == [0.0, 0.0] and got[1].v == [0.6, 0.8]


def test_layer_selection():
    assert features.selected_layers([6, 3, 6], 12) == [3, 6]
    for wrong in ([], [0], [13]):
        with pytest.raises(ValueError):
            features.selected_layers(wrong, 12)


@pytest.mark.parametrize("n, fraction, taken", [(20, 0.2, 4), (2, 0.2, 1), (3, 0.01, 2)])
def test_normal_split(spark, n, fraction, taken):
    images = spark.createDataFrame([("a", i) for i in range(n)], "category string, image_id long")
    first, again = (rows(sampling.split_normal(images, fraction, 42), "image_id") for _ in range(2))
    assert first == again and len(first) == n
    assert sum(r[2] == "calibration" for r in first) == taken


def test_calibration_split_rounds_half_to_even(spark):
    splits = spark.createDataFrame([("a", i, "calibration") for i in range(5)], "category string, image_id long, role string")
    got = [r[2] for r in rows(sampling.split_calibration(splits, 0.5, 1042), "image_id")]
    assert (got.count("threshold_fit"), got.count("normal_validation")) == (2, 3)
    with pytest.raises(ValueError):
        sampling.split_calibration(splits, 1.0)


def test_samples_have_exact_sizes_over_many_buckets(spark):
    many = spark.range(20_000).select(F.lit("a").alias("category"), F.lit(3).alias("layer"), F.col("id").alias("image_id"), F.lit(0).alias("patch_id"))
    got = sampling.sample_patches(many, 0.1)
    assert got.count() == got.distinct().count() == 2000
    ranked = many.withColumn("h", sampling.order_hash(F.lit(45), "image_id", "patch_id")).orderBy("h", "image_id").limit(2000)
    assert {r.image_id for r in ranked.collect()} == {r.image_id for r in got.collect()}


def test_memory_bank(spark):
    own = random_features(spark)
    splits = spark.createDataFrame([("a", i, "memory") for i in range(3)], "category string, image_id long, role string")
    bank = memory.memory_bank(own, splits, 4, 0.5)
    assert bank.count() == 6 and {r.bank_id for r in bank.collect()} == set(range(6))
    faults = memory.bank_faults(bank).first()
    assert (faults.rows, faults.not_finite, faults.other_width, faults.outside) == (6, 0, 0, 0)
    assert memory.memory_bank(own, splits, 4, 0.5, "kcenter").count() == 6
    with pytest.raises(ValueError):
        memory.memory_bank(own, splits, 4, 0.5, "nothing")


def test_k_center_covers_better_with_every_center(spark):
    own = random_features(spark, 10, 4)
    chosen = memory.k_center(own, 0.5)
    v = np.array([r.v for r in own.orderBy("image_id", "patch_id").collect()])
    centers = np.array([r.v for r in chosen.orderBy("nth").collect()])
    radius = [(1 - v @ centers[:k].T).min(axis=1).max() for k in range(1, len(centers) + 1)]
    assert len(centers) == 20 and all(a >= b - 1e-12 for a, b in zip(radius, radius[1:], strict=False))
    assert memory.k_center(own, 0.5, parts=3).count() == 20
    assert memory.k_center(own, 1.0, most=7).count() == 7


def test_k_center_of_projected_vectors_keeps_their_width(spark):
    own = random_features(spark, 5, 4)
    chosen = memory.k_center(own, 0.5, projection=4, entries="sign")
    assert chosen.count() == memory.k_center(own, 0.5).count() and {len(r.v) for r in chosen.collect()} == {8}
    for layer, group in itertools.groupby(sorted(own.collect(), key=lambda r: (r.layer, r.image_id, r.patch_id)), key=lambda r: r.layer):
        group = list(group)
        v = memory.projected(np.array([r.v for r in group]), 4, 42, "sign")
        assert np.allclose(v, (lambda x: x / np.linalg.norm(x, axis=1, keepdims=True))(np.array([r.v for r in group]) @ memory.signs(8, 4, 42)))
        mine = [(r.image_id, r.patch_id) for r in sorted(chosen.filter(F.col("layer") == layer).collect(), key=lambda r: r.nth)]
        at = [(r.image_id, r.patch_id) for r in group]
        assert mine == [at[k] for k in memory.greedy_centers(v, at.index(mine[0]), len(mine))]


def test_normal_projection_keeps_distances():
    """The entries are normal, and distances of projected pairs are near those before: the error falls with the root of the width."""
    entries = memory.normals(200, 100, 42) * 10
    assert abs(entries.mean()) < 0.02 and abs(entries.std() - 1) < 0.02 and abs((entries**4).mean() - 3) < 0.2
    assert (memory.normals(3, 2, 1) == memory.normals(3, 2, 1)).all() and (memory.normals(3, 2, 1) != memory.normals(3, 2, 2)).all()
    v = np.random.default_rng(5).standard_normal((60, 200))
    first, second = np.triu_indices(60, 1)
    apart = lambda x: np.linalg.norm(x[first] - x[second], axis=1)
    error = {d: np.std(apart(v @ memory.normals(200, d, 7)) / apart(v) - 1) for d in (25, 100)}
    assert error[25] < 1.5 / np.sqrt(2 * 25) and error[100] < 1.5 / np.sqrt(2 * 100)


def test_bank_ids_are_dense_and_need_no_window_of_a_category(spark, monkeypatch):
    own = random_features(spark, 40, 4)
    monkeypatch.setattr(memory, "NUMBERED", 3)
    made = memory.numbered(own.withColumn("image_id", F.col("image_id") * 7 - 50))
    by_layer = itertools.groupby(sorted(made.collect(), key=lambda r: (r.category, r.layer, r.image_id, r.patch_id)), key=lambda r: (r.category, r.layer))
    assert all([r.bank_id for r in group] == list(range(160)) for _, group in by_layer)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert len(windows) == 2 and [line for line in windows if "row_number()" in line and "span" in line]


def test_projection_only_reduces(spark):
    own = random_features(spark)
    assert {len(r.v) for r in memory.random_projection(own, 3).collect()} == {3}
    same = memory.random_projection(own, 8).orderBy("image_id", "patch_id").first()
    assert np.allclose(same.v, own.orderBy("image_id", "patch_id").first().v)


@pytest.mark.parametrize("entries", ["sign", "normal"])
def test_projection_gives_a_row_the_same_bits_in_any_batch(entries):
    v = np.random.default_rng(8).standard_normal((40, 60))
    whole = memory.projected(v, 7, 42, entries)
    assert all((memory.projected(v[at : at + n], 7, 42, entries) == whole[at : at + n]).all() for n in (1, 3, 40) for at in range(0, 40, n))


def test_projection_of_nulls_and_short_vectors(spark):
    vectors = [[3.0, None, 4.0], [1.0, 2.0], None, [None, None, None], []]
    own = spark.createDataFrame([("a", n, 3, 0, v) for n, v in enumerate(vectors)], FEATURES).repartition(2)
    known = {n: [x or 0.0 for x in v] + [0.0] * (3 - len(v)) for n, v in enumerate(vectors) if v}
    want = {n: list(memory.projected(np.array([v]), 2, 42)[0]) if any(v) else [None, None] for n, v in known.items()}
    got = {r.image_id: r.v for r in memory.random_projection(own, 2).collect()}
    assert got == want | {1: [1 / 5**0.5, 2 / 5**0.5], 2: None, 4: []}
    got = {r.image_id: r.v for r in memory.random_projection(own, 2, width=3).collect()}
    assert got == want | {2: [None, None], 4: [None, None]}


def test_nearest_breaks_ties_by_id_and_place(spark):
    bank = spark.createDataFrame([("a", 3, 0, 9, 0.0, 0.0, [1.0, 0.0]), ("a", 3, 1, 9, 1.0, 1.0, [1.0, 0.0])], "category string, layer int, bank_id long, source_id long, x double, y double, v array<double>")
    query = spark.createDataFrame([("a", 1, 3, 3, 1.0, 1.0, [1.0, 0.0])], "category string, image_id long, layer int, patch_id int, x double, y double, v array<double>")
    assert nearest.nearest(query, bank, 0.0).first().bank_id == 0
    assert nearest.nearest(query, bank, 0.1).first().bank_id == 1
    with pytest.raises(ValueError):
        nearest.nearest(query, bank, -1.0)


@pytest.mark.parametrize("weight", [0.0, 0.3])
@pytest.mark.parametrize("blocks", [(1024, 4096), (3, 2)])
def test_nearest_equals_join(spark, monkeypatch, weight, blocks):
    monkeypatch.setattr(nearest, "SLICES", 2 if blocks[0] == 3 else 64)
    query = features.with_coordinates(random_features(spark, 4, 4, seed=2), 4)
    bank = features.with_coordinates(random_features(spark, 5, 4, seed=3), 4).withColumn("bank_id", F.col("image_id") * 4 + F.col("patch_id"))
    got = rows(nearest.nearest(query, bank, weight, *blocks), "image_id", "patch_id")
    want = rows(nearest.nearest_by_join(query, bank, weight), "image_id", "patch_id")
    assert [r[:4] + r[5:] for r in got] == [r[:4] + r[5:] for r in want]
    assert np.allclose([r[4] for r in got], [r[4] for r in want])


def test_nearest_sends_a_bank_once_a_slice(spark, monkeypatch):
    """However many blocks of queries there are, and a query once a block of the bank."""
    monkeypatch.setattr(nearest, "SLICES", 3)
    bank = features.with_coordinates(random_features(spark, 5, 4, seed=3), 4).withColumn("bank_id", F.col("image_id") * 4 + F.col("patch_id"))
    for images in (12, 48):
        query = features.with_coordinates(random_features(spark, images, 4, seed=2), 4)
        sent = dict(nearest.arranged(query, bank, 0.1, 4, 8).groupBy("is_query").count().collect())
        assert sent == {False: 3 * bank.count(), True: 3 * query.count()}  # 3 slices, and 20 rows in blocks of 8
    assert nearest.nearest(query, bank.limit(0)).count() == nearest.nearest(query.limit(0), bank).count() == 0


def test_reliability_needs_two_images(spark):
    one = random_features(spark, 1, 4)
    with pytest.raises(Exception, match="reliability needs two"):
        rel.spatial_reliability(one).collect()
    single = rel.spatial_reliability(random_features(spark, 3, 4).filter("patch_id = 0")).first()
    assert single.cross_position_distance == 0.0 and single.same_position_distance > 0
    plan = rel.mean_pair_distance(one, ["category", "layer", "image_id"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "explode" not in plan
    splits = spark.createDataFrame([("a", 1, "calibration"), ("a", 2, "memory")], "category string, image_id long, role string")
    with pytest.raises(Exception, match="both parts need one"):
        sampling.split_calibration(splits).collect()


def test_reliability_ranks_aligned_places_higher(spark):
    rng = np.random.default_rng(0)

    def table(base):
        out = []
        for i in range(4):
            for p in range(4):
                v = base(p) + 0.001 * rng.standard_normal(4)
                out.append(("a", i, 3, p, [float(x) for x in v / np.linalg.norm(v)]))
        return spark.createDataFrame(out, FEATURES)

    aligned = rel.spatial_reliability(table(lambda p: np.eye(4)[p])).first().reliability
    uniform = rel.spatial_reliability(table(lambda p: np.ones(4))).first().reliability
    assert aligned > uniform


def test_pair_distance_equals_brute_force(spark):
    own = random_features(spark, 5, 1)
    v = np.array([r.v for r in own.collect()])
    want = np.mean([1 - v[i] @ v[j] for i in range(5) for j in range(i + 1, 5)])
    assert math.isclose(rel.mean_pair_distance(own, ["category", "layer", "patch_id"]).first().distance, want, rel_tol=1e-9)


def test_tau_and_weights(spark):
    table = spark.createDataFrame([("a", 3, 1.0), ("a", 6, 2.0), ("b", 3, 3.0), ("b", 6, 4.0)], "category string, layer int, reliability double")
    assert rows(rel.layer_tau(table, 0.5), "layer") == [(3, 2.0), (6, 3.0)]
    one = spark.createDataFrame([("a", 3, 2.0)], "category string, layer int, reliability double")
    assert math.isclose(rel.spatial_weights(one).first().spatial_weight, 0.05)
    assert rel.spatial_weights(one, "none").first().spatial_weight == 0.0
    assert rel.spatial_weights(one, "fixed", 0.07).first().spatial_weight == 0.07
    with pytest.raises(ValueError):
        rel.spatial_weights(one, "other")


def test_median_mad_and_clamp(spark):
    scores = spark.createDataFrame([("a", 3, float(x)) for x in (1, 2, 3, 100)], "category string, layer int, score double")
    got = calibration.median_mad(scores, 1e-6)
    assert (got.first().median, got.first().mad) == (2.0, 1.0)
    assert sorted(r.score for r in calibration.calibrated(scores, got, clamp=True).collect()) == [0.0, 0.0, 1.0, 98.0]
    flat = spark.createDataFrame([("a", 3, 5.0)] * 3, "category string, layer int, score double")
    assert calibration.median_mad(flat, 1e-6).first().mad == 1e-6


def test_pixel_thresholds_and_diagnostics(spark):
    table = spark.createDataFrame([("a", 0, [0.0, 1.0, 2.0, 3.0]), ("a", 1, [0.0, 2.0, 4.0, 6.0])], "category string, image_id long, map array<double>")
    for method, want in (("global_quantile", 2.0), ("image_max_quantile", 4.5), ("image_topk_quantile", 3.75)):
        assert calibration.pixel_threshold(table, method, 0.5, 0.5, 0.5).first().pixel_threshold == want
    got = calibration.normal_diagnostics(table, spark.createDataFrame([("a", 4.0)], "category string, pixel_threshold double")).first()
    assert (got.normal_pixel_positive_rate, got.normal_image_positive_rate) == (0.25, 0.5)
    with pytest.raises(ValueError):
        calibration.pixel_threshold(table, "other")


def test_image_scores(spark):
    table = spark.createDataFrame([("a", 0, [3.0, 0.0, 2.0, 1.0])], "category string, image_id long, map array<double>")
    assert maps.image_scores(table, "topk_mean", 0.5).first().image_score == 2.5
    assert maps.image_scores(table, "max").first().image_score == 3.0
    assert math.isclose(maps.image_scores(table, "q99").first().image_score, np.quantile([0, 1, 2, 3], 0.99))
    with pytest.raises(ValueError):
        maps.image_scores(table, "topk_mean", 0.0)


def test_upsampling_and_smoothing():
    assert np.allclose(maps.upsampling(2, 4), [[1, 0], [0.75, 0.25], [0.25, 0.75], [0, 1]])
    assert np.allclose(maps.upsampling(1, 3), 1)
    weights = maps.smoothing(5, 1.0)
    assert np.allclose(weights.sum(axis=1), 1) and np.allclose(weights @ np.ones(5), 1)


def test_binary_metrics(spark):
    scored = spark.createDataFrame([("a", 0, 0.1), ("a", 0, 0.2), ("a", 1, 0.8), ("a", 1, 0.9)], "category string, label int, score double")
    got = metrics.ranking(scored).first()
    assert (got.auroc, got.average_precision, got.f1_oracle, got.threshold_oracle) == (1.0, 1.0, 1.0, 0.8)
    fixed = metrics.at_threshold(scored, spark.createDataFrame([("a", 0.85)], "category string, threshold double")).first()
    assert math.isclose(fixed.f1_calibrated, 2 / 3) and fixed.iou_calibrated == 0.5


def test_metrics_without_one_class(spark):
    scored = spark.createDataFrame([("a", 0, 0.1), ("a", 0, 0.2)], "category string, label int, score double")
    got = metrics.ranking(scored).first()
    assert math.isnan(got.auroc) and math.isnan(got.average_precision) and got.f1_oracle == 0.0
    fixed = metrics.at_threshold(scored, spark.createDataFrame([("a", 0.5)], "category string, threshold double")).first()
    assert (fixed.f1_calibrated, fixed.iou_calibrated) == (0.0, 1.0)


def test_ranged_sums_equal_windows(spark):
    rng = np.random.default_rng(5)
    scored = spark.createDataFrame([("ab"[i % 2], int(rng.integers(2)), float(rng.integers(50))) for i in range(400)], "category string, label int, score double")
    counts = metrics.histogram(scored)
    for descending in (False, True):
        window = Window.partitionBy("category").orderBy(F.desc("score") if descending else F.asc("score")).rowsBetween(Window.unboundedPreceding, 0)
        want = counts.withColumn("running_p", F.sum("p").over(window)).withColumn("running_n", F.sum("n").over(window))
        assert rows(running_sums(counts, ["category"], "score", ["p", "n"], descending, 7), "category", "score") == rows(want, "category", "score")


def test_values_of_one_hot_value(spark):
    table = spark.createDataFrame([("a", 0.0)] * 3000 + [("a", float(i)) for i in range(1, 1001)], "category string, x double")
    assert exact_median(table, ["category"], "x").first().median == 0.0
    assert abs(exact_quantile(table, ["category"], "x", 0.9).first()["quantile"] - np.quantile([0.0] * 3000 + list(range(1, 1001)), 0.9)) < 1e-9


def moved(spark) -> int:
    """Bytes that shuffles have written so far."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    every = spark.sparkContext._jsc.sc().statusStore().executorList(True)
    return sum(every.apply(i).totalShuffleWrite() for i in range(every.size()))


def test_quantiles_move_the_bracket_alone(spark, tmp_path):
    spark.range(0, 8_000_000, 1, 4).selectExpr("CAST(id % 2 AS STRING) AS category", "CAST(hash(id) AS DOUBLE) + id / 1e7 AS x").write.parquet(str(tmp_path / "t"))
    table, before = spark.read.parquet(str(tmp_path / "t")), moved(spark)
    got = {r.category: r["quantile"] for r in exact_quantile(table, ["category"], "x", 0.25).collect()}
    assert moved(spark) - before < 0.01 * 8_000_000 * 8
    want = dict(duckdb.sql(f"SELECT category, quantile_cont(x, 0.25) FROM '{tmp_path}/t/*.parquet' GROUP BY 1").fetchall())
    assert got.keys() == want.keys() and all(math.isclose(got[c], q, rel_tol=1e-12) for c, q in want.items())


def test_brackets_that_miss_are_widened_and_large_ones_ranged(spark, monkeypatch):
    table = spark.range(0, 30_000, 1, 3).selectExpr("CAST(id % 3 AS STRING) AS category", "CAST(hash(id) AS DOUBLE) AS x").unionByName(spark.createDataFrame([("few", 1.0), ("few", 2.0), ("none", None)], "category string, x double"))
    want = {r.category: r.m for r in table.groupBy("category").agg(F.percentile("x", F.lit(0.37)).alias("m")).filter("category != 'none'").collect()}
    monkeypatch.setattr(statistics, "SLACK", 1e-4)
    monkeypatch.setattr(statistics, "ACCURACY", 10)
    monkeypatch.setattr(statistics, "ORDERED", 20)
    got = {r.category: r["quantile"] for r in exact_quantile(table, ["category"], "x", 0.37).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[c], want[c], rel_tol=1e-12) for c in want)


def test_plan_of_ranking_moves_its_rows_twice(spark):
    scored = spark.range(1000).selectExpr("CAST(id % 2 AS STRING) AS category", "CAST(id % 3 = 0 AS INT) AS label", "CAST(id AS DOUBLE) AS score")
    plan = metrics.ranking(scored)._jdf.queryExecution().executedPlan().toString()
    by = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]
    assert "SortMergeJoin" not in plan and len(by) == 3  # the histogram, the ranges, and a row per category and task


def test_exact_quantile_equals_percentile(spark):
    rng = np.random.default_rng(6)
    values = {c: rng.normal(size=n) for c, n in (("a", 20_000), ("b", 1), ("c", 17))}
    table = spark.createDataFrame([(c, float(x)) for c, v in values.items() for x in v], "category string, x double")
    for q in (0.0, 0.3, 0.995, 1.0):
        got = {r.category: r["quantile"] for r in exact_quantile(table, ["category"], "x", q).collect()}
        assert all(math.isclose(got[c], np.quantile(v, q), rel_tol=1e-9, abs_tol=1e-12) for c, v in values.items())


def test_means_skip_nan(spark):
    table = spark.createDataFrame([("a", 1.0, float("nan")), ("b", 3.0, float("nan"))], "category string, x double, y double")
    got = table.agg(nan_mean("x").alias("x"), nan_mean("y").alias("y")).first()
    assert got.x == 2.0 and math.isnan(got.y)
    mean = metrics.with_mean_row(table).filter("category = 'mean'").first()
    assert mean.x == 2.0 and math.isnan(mean.y)
    assert table.agg(lower_median("x").alias("m")).first().m == 1.0


def case_table(spark):
    out = []
    for k, method in enumerate(reports.METHODS):
        for seed in (42, 43):
            for category in ("bottle", "grid"):
                f1 = 0.5 + 0.01 * k if category == "bottle" else 0.4 + 0.001 * (seed - 42)
                out.append((method, seed, category, f1, f1 - 0.1, 0.7 if category == "bottle" else 0.6, 0.01 + f1 / 100, 0.1 + f1 / 10, 1, "held_out_from_threshold_fit", 42))
    return spark.createDataFrame(out, "method string, threshold_split_seed int, category string, pixel_F1_calibrated double, pixel_IoU_calibrated double, pixel_F1_oracle double, normal_pixel_positive_rate double, normal_image_positive_rate double, normal_validation_images int, normal_diagnostic_mode string, model_seed int")


def test_threshold_reports(spark):
    table = case_table(spark)
    stability = reports.threshold_split_stability(table)
    assert stability.count() == 3 and reports.select_method(stability).first().method == "global_quantile"
    assert reports.oracle_baseline(table).first().max_difference == 0.0


def study(spark, change=lambda method, seed, config, rows: None, methods=reports.METHODS):
    """A threshold study of some methods and two split seeds, whose cases `change` spoils."""
    out = []
    for method in methods:
        for seed in (42, 43):
            config = copy.deepcopy(adapters.CONFIG)
            config["experiment"]["protocol_stage"] = "development" if len(methods) > 1 else "validation"
            config["data"]["categories"] = ["bottle", "grid"]
            config["calibration"]["pixel_threshold_method"] = method
            rows = [{"category": c, "normal_diagnostic_mode": "held_out_from_threshold_fit", "normal_validation_images": 1} for c in ("bottle", "grid")]
            change(method, seed, config, rows)
            out.append((method, seed, json.dumps(config), json.dumps({"categories": rows})))
    return spark.createDataFrame(out, "method string, threshold_split_seed int, config_json string, metrics_json string")


KEYS = ["method", "threshold_split_seed"]
TOPK, MAXQ = "image_topk_quantile", "image_max_quantile"


def spoil(path, value, when=lambda m, s: (m, s) == (TOPK, 43)):
    def change(method, seed, config, rows):
        part, name = path.split(".")
        if when(method, seed):
            if value is None:
                config[part].pop(name)
            else:
                config[part][name] = value

    return change


@pytest.mark.parametrize(
    "change, rule, cases",
    [
        (spoil("experiment.protocol_stage", "validation"), "stage", {(TOPK, 43)}),
        (spoil("experiment.seed", 7, lambda m, s: m == MAXQ), "model seed", {(MAXQ, 42), (MAXQ, 43)}),  # a whole method
        (spoil("memory.ratio", 0.1), "base protocol", {(TOPK, 43)}),
        (spoil("model.active_layers", [6, 3], lambda m, s: m == MAXQ), "base protocol", {(MAXQ, 42), (MAXQ, 43)}),
        (spoil("inference.gaussian_sigma", None), "base protocol", {(TOPK, 43)}),
        (spoil("calibration.pixel_threshold_method", "other"), "threshold parameters", {(TOPK, 43)}),
    ],
)
def test_threshold_gate_finds_each_fault(spark, change, rule, cases):
    found = {(r.rule, r.method, r.threshold_split_seed) for r in gates.threshold_faults(study(spark, change), KEYS).collect()}
    assert found == {(rule, *c) for c in cases}


def test_threshold_gate_reads_metrics_and_methods(spark):
    assert gates.threshold_faults(study(spark), KEYS).count() == 0
    assert gates.threshold_faults(study(spark, methods=(TOPK,)), KEYS, (TOPK,)).count() == 0
    # Numbers are alike however they are written.
    assert gates.threshold_faults(study(spark, spoil("data.image_size", 8.0)), KEYS).count() == 0

    def rows_spoiled(method, seed, config, rows):
        if (method, seed) == (MAXQ, 42):
            rows.reverse()
            rows[0]["normal_diagnostic_mode"] = "same_images"
            del rows[1]["normal_validation_images"]

    got = {(r.rule, r.method, r.path) for r in gates.threshold_faults(study(spark, rows_spoiled), KEYS).collect()}
    assert got == {("category order", MAXQ, "categories"), ("not held out", MAXQ, "grid"), ("no validation images", MAXQ, "bottle")}
    broken = study(spark).filter(f"method != '{MAXQ}' AND NOT (method = '{TOPK}' AND threshold_split_seed = 43)").unionByName(study(spark, methods=("odd", "odd2")).filter("method = 'odd'"))
    assert {(r.rule, r.path) for r in gates.threshold_faults(broken, KEYS).collect()} == {("missing method", MAXQ), ("missing split seeds", TOPK), ("unexpected method", "odd")}


def test_values_of_a_path_are_counted_over_all_cases(spark):
    values = gates.config_values(study(spark, spoil("memory.ratio", 0.1)), KEYS)
    counted = {r.path: (r.different, r.cases) for r in gates.spread(values).collect()}
    assert counted["memory.ratio"] == (2, 6) and counted["experiment.seed"] == (1, 6) and counted["calibration.pixel_threshold_method"] == (3, 6)


@pytest.mark.parametrize("path, value", [("experiment.seed", 1), ("data.image_size", 1), ("data.calibration_fraction", 0.9), ("model.checkpoint", "x"), ("model.token_norm", "x"), ("memory.sampling", "x"), ("memory.ratio", 0.9), ("retrieval.spatial_mode", "x"), ("retrieval.lambda_max", None)])
def test_layer_gate_finds_each_field(spark, path, value):
    rows = []
    for case in reports.LAYER_CASES:
        config = copy.deepcopy(adapters.CONFIG)
        config["model"]["active_layers"] = [len(rows)]  # may differ
        if case == "block9":
            spoil(path, value, lambda m, s: True)("", 0, config, [])
        listed = ["b", "a"] if case == "block12" else ["a", "b"]
        rows.append((1, case, json.dumps(config), json.dumps({"categories": [{"category": c} for c in listed]})))
    table = spark.createDataFrame(rows, "k int, case string, config_json string, metrics_json string")
    assert {tuple(r)[1:] for r in gates.layer_faults(table, ["k", "case"], ["k"]).collect()} == {("block9", "protocol", path), ("block12", "category order", "categories")}
    assert ("block3", "missing case", None) in {tuple(r)[1:] for r in gates.layer_faults(table.filter("case != 'block3'"), ["k", "case"], ["k"]).collect()}


def test_selection_ignores_pixel_f1(spark):
    names = [f"{m}_{s}_across_splits" for m in ("normal_image_positive_rate", "normal_pixel_positive_rate") for s in ("mean", "std")]
    table = spark.createDataFrame([("image_topk_quantile", 0.9, 0.10, 0.02, 0.010, 0.001), ("global_quantile", 0.2, 0.02, 0.01, 0.001, 0.0001)], ["method", "pixel_F1_calibrated_mean_across_splits", *names])
    assert reports.select_method(table).first().method == "global_quantile"


def test_layer_reports(spark):
    out = [(case, i, category, *[0.8 + 0.01 * i + 0.001 * j] * 6) for i, case in enumerate(reports.LAYER_CASES) for j, category in enumerate(("bottle", "screw"))]
    table = spark.createDataFrame(out, ["case", "case_order", "category", *reports.LAYER_METRICS])
    assert reports.layer_ablation_means(table).count() == 5
    assert rows(reports.layer_win_counts(table), "case") == [("block12", 2)]
    wide = reports.layer_ablation_per_category(table).orderBy("category").first()
    assert math.isclose(wide.fusion_minus_best_single, 0.01)
    expected = spark.createDataFrame([(c,) for c in (*reports.LAYER_CASES, "block1")], "case string")
    assert rows(reports.missing_cases(table, expected, "case"), "case") == [("block1",)]


def test_gates(spark):
    table = case_table(spark)
    assert reports.duplicate_cases(table, ["method", "threshold_split_seed"]).count() == 6
    grid = reports.case_grid(table.select("method"), table.select("threshold_split_seed"))
    done = table.filter("threshold_split_seed = 42")
    assert grid.count() == 6 and reports.pending_cases(grid, done, ["method", "threshold_split_seed"]).count() == 3
    assert reports.stage_overlap(table, table.filter("category = 'grid'")).count() == 1
    other = table.withColumn("model_seed", F.when(F.col("category") == "grid", 1).otherwise(42))
    keys = ["method", "threshold_split_seed", "category"]
    assert {tuple(r.fields) for r in reports.mismatches(table, other, keys, ["model_seed", "normal_validation_images"]).collect()} == {("model_seed",)}


def test_completion_manifest_and_resume(spark):
    from heddle.plans.adapters import config_json

    config = spark.range(1).select(config_json(data__categories=F.array(F.lit("a"), F.lit("b")))).first()[0]
    fingerprint = spark.createDataFrame([(config,)], "c string").select(fingerprints.config_fingerprint(F.col("c"))).first()[0]
    good = {"status": "complete", "expected_categories": ["a", "b"], "completed_categories": ["a", "b"], "expected_count": 2, "completed_count": 2, "seed": 42, "threshold_split_seed": 42, "pixel_threshold_method": "global_quantile", "active_layers": [3, 6], "spatial_mode": "adaptive", "config_fingerprint": fingerprint}
    metrics_of = lambda *names: json.dumps({"categories": [{"category": n} for n in names]})
    cases = [("good", good, metrics_of("a", "b")), ("none", None, metrics_of("a", "b")), ("order", good, metrics_of("b", "a")), ("no metrics", good, None)]
    cases += [(name, good | {name: other}, metrics_of("a", "b")) for name, other in (("status", "incomplete"), ("completed_count", 1), ("seed", 7), ("active_layers", [3]), ("config_fingerprint", "x"))]
    rows = spark.createDataFrame([(n, config, m, marker and json.dumps(marker)) for n, marker, m in cases], "case_dir string, config_json string, metrics_json string, marker_json string")
    got = {r.case_dir: r.fields for r in reports.completion_faults(rows).collect()}
    assert got == {"none": ["marker"], "order": ["categories"], "no metrics": ["categories"]} | {n: [n] for n in ("status", "completed_count", "seed", "active_layers", "config_fingerprint")}
    desired = spark.createDataFrame([(n, ["a", "b"], fingerprint) for n, _, _ in cases], "case_dir string, categories array<string>, config_fingerprint string")
    markers = spark.createDataFrame([(n, *[m[f] for f in ("status", "expected_categories", "completed_categories", "expected_count", "completed_count", "config_fingerprint")]) for n, m, _ in cases if m], "case_dir string, status string, expected_categories array<string>, completed_categories array<string>, expected_count int, completed_count int, config_fingerprint string")
    assert {r.case_dir: r.found for r in reports.cases_to_run(desired, markers, ["case_dir"]).collect()} == {"none": False, "status": True, "completed_count": True, "config_fingerprint": True}
