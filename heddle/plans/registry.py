"""All registered queries of the anomaly jobs and their DuckDB forms."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextlib import suppress
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from heddle.functions import fingerprints
from heddle.functions.statistics import exact_quantiles
from heddle.functions.storage import shared_folder, stored
from heddle.functions.vectors import six_digits
from heddle.operators import calibration, features, gates, maps, memory, metrics, nearest, reports, sampling
from heddle.operators import reliability as rel
from heddle.plans import adapters
from heddle.plans import oracles as sql
from heddle.plans.adapters import MAP_SIZE, PATCHES, PIXEL_TOPK, Flow
from heddle.sources import artifacts
from heddle.streaming.scoring import decide_arrivals, image_decisions, score_arrivals

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six digits, also in arrays, for comparison between engines."""
    out = []
    for f in df.schema:
        kind = f.dataType.simpleString()
        c = F.col(f"`{f.name}`")
        out.append((F.round(c, 6) if kind == "double" else F.transform(c, six_digits) if kind == "array<double>" else c).alias(f.name))
    return df.select(*out)


def query(oracle: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


# Features, splits, memory


@query(sql.flow("SELECT category, image_id, layer, patch_id, list_transform(v, lambda x: round(x, 6)) AS v FROM features"))
def l2_normalize(spark, d):
    return features.normalised(Flow(spark, d).patches())


@query(sql.flow("SELECT category, image_id, layer, patch_id, list_transform(v, lambda x: round(x, 6)) AS v FROM features WHERE layer = 6 AND category IN ('1', '2')"))
def tokens_to_patches(spark, d):
    return features.tokens_to_patches(Flow(spark, d).tokens().filter(F.col("category").isin("1", "2")), [6, 6])


@query(sql.flow("SELECT category, image_id, layer, patch_id, list_transform(v, lambda x: round(x, 6)) AS v FROM features WHERE layer = 6"))
def tokens_to_patches_all_categories(spark, d):
    return features.tokens_to_patches(Flow(spark, d).tokens(), [6, 6])


@query(sql.flow("SELECT category, image_id, layer, patch_id, CAST(patch_id % 2 AS DOUBLE) AS x, CAST(patch_id // 2 AS DOUBLE) AS y FROM features"))
def patch_coordinates(spark, d):
    return features.with_coordinates(Flow(spark, d).features(), PATCHES).drop("v")


@query(sql.flow("SELECT * FROM normal_splits"))
def split_normal(spark, d):
    return Flow(spark, d).normal_splits()


@query(sql.flow("SELECT * FROM splits"))
def split_calibration(spark, d):
    return Flow(spark, d).splits()


@query(sql.flow("""SELECT category, list_sort(coalesce(list(image_id) FILTER (WHERE role = 'memory'), [])) AS memory, list_sort(coalesce(list(image_id) FILTER (WHERE role <> 'memory'), [])) AS calibration,
 list_sort(coalesce(list(image_id) FILTER (WHERE role = 'threshold_fit'), [])) AS threshold_fit, list_sort(coalesce(list(image_id) FILTER (WHERE role = 'normal_validation'), [])) AS normal_validation FROM splits GROUP BY category"""))
def split_manifest(spark, d):
    return sampling.split_manifest(Flow(spark, d).splits())


@query(sql.flow("SELECT category, count(*) AS images, count(*) AS covered, CAST(0 AS BIGINT) AS uncovered FROM normal_splits WHERE role = 'calibration' GROUP BY category"))
def split_coverage(spark, d):
    flow = Flow(spark, d)
    return sampling.split_coverage(flow.normal_splits().filter("role = 'calibration'"), flow.splits())


@query(sql.flow("SELECT category, layer, image_id, patch_id FROM memory_sample"))
def memory_random(spark, d):
    flow = Flow(spark, d)
    own = flow.features().join(flow.splits().filter("role = 'memory'"), ["category", "image_id"], "left_semi")
    return sampling.sample_patches(own, adapters.RATIO).select("category", "layer", "image_id", "patch_id")


@query(sql.flow("SELECT category, layer, image_id, patch_id, n AS k_of FROM (SELECT *, row_number() OVER (PARTITION BY category, layer ORDER BY md5((42 + layer) || ':' || image_id || ':' || patch_id), image_id, patch_id) AS nth, count(*) OVER (PARTITION BY category, layer) AS n FROM features) WHERE nth <= 50"))
def memory_candidate_cap(spark, d):
    return sampling.cap_candidates(Flow(spark, d).features(), 50).select("category", "layer", "image_id", "patch_id", "k_of")


@query("WITH RECURSIVE " + sql.FLOW.strip() + """,
pool AS (SELECT category, layer, list(v ORDER BY image_id, patch_id) AS vs, list(image_id ORDER BY image_id, patch_id) AS ids, list(patch_id ORDER BY image_id, patch_id) AS ps,
                list(md5((42 + layer) || ':' || image_id || ':' || patch_id) ORDER BY image_id, patch_id) AS hs, CAST(greatest(1, round_even(count(*) * 0.25::DOUBLE, 0)) AS INT) AS k FROM memory_ranked GROUP BY ALL),
walk AS (
  SELECT category, layer, vs, ids, ps, k, 0 AS nth, list_position(hs, list_min(hs)) AS pick, list_transform(vs, lambda v: 1 - list_inner_product(v, vs[list_position(hs, list_min(hs))])) AS away FROM pool
  UNION ALL
  SELECT category, layer, vs, ids, ps, k, nth + 1, nx, list_transform(list_zip(away, vs), lambda z: least(z[1], 1 - list_inner_product(z[2], vs[nx])))
  FROM (SELECT *, list_position(away, list_max(away)) AS nx FROM walk WHERE nth + 1 < k))
SELECT category, layer, nth, ids[pick] AS image_id, ps[pick] AS patch_id FROM walk""")
def memory_kcenter(spark, d):
    flow = Flow(spark, d)
    own = flow.features().join(flow.splits().filter("role = 'memory'"), ["category", "image_id"], "left_semi")
    return memory.k_center(own, 0.25).drop("v")


SIGNED = "list_transform(range(4), lambda j: list_sum(list_transform(range(8), lambda i: v[i + 1] * CASE WHEN substr(md5('42:' || i || ':' || j), 1, 1) < '8' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END)) / 2)"
#: Box and Muller on two words of 52 bits of each entry's MD5.
_WORD = "('0x' || substr(md5('42:' || i || ':' || j), {at}, 13))::BIGINT::DOUBLE"
_NORMAL = f"sqrt(-2 * ln(({_WORD.format(at=1)} + 1) / 4503599627370496::DOUBLE)) * cos(2 * pi() * {_WORD.format(at=14)} / 4503599627370496::DOUBLE)"
NORMAL = f"list_transform(range(4), lambda j: list_sum(list_transform(range(8), lambda i: v[i + 1] * {_NORMAL})) / 2)"
UNIT = "list_transform(p, lambda x: x / greatest(sqrt(list_sum(list_transform(p, lambda y: y * y))), 1e-12::DOUBLE))"


@query(sql.flow(f"SELECT category, image_id, layer, patch_id, list_transform({UNIT}, lambda x: round(x, 6)) AS v FROM (SELECT category, image_id, layer, patch_id, {SIGNED} AS p FROM features)"))
def random_projection(spark, d):
    return memory.random_projection(Flow(spark, d).features(), 4, entries="sign", width=adapters.WIDTH)


@query("WITH RECURSIVE " + sql.FLOW.strip() + f""",
narrow AS (SELECT category, layer, image_id, patch_id, {UNIT} AS v FROM (SELECT category, layer, image_id, patch_id, {SIGNED} AS p FROM memory_ranked)),
pool AS (SELECT category, layer, list(v ORDER BY image_id, patch_id) AS vs, list(image_id ORDER BY image_id, patch_id) AS ids, list(patch_id ORDER BY image_id, patch_id) AS ps,
                list(md5((42 + layer) || ':' || image_id || ':' || patch_id) ORDER BY image_id, patch_id) AS hs, CAST(greatest(1, round_even(count(*) * 0.25::DOUBLE, 0)) AS INT) AS k FROM narrow GROUP BY ALL),
walk AS (
  SELECT category, layer, vs, ids, ps, k, 0 AS nth, list_position(hs, list_min(hs)) AS pick, list_transform(vs, lambda v: 1 - list_inner_product(v, vs[list_position(hs, list_min(hs))])) AS away FROM pool
  UNION ALL
  SELECT category, layer, vs, ids, ps, k, nth + 1, nx, list_transform(list_zip(away, vs), lambda z: least(z[1], 1 - list_inner_product(z[2], vs[nx])))
  FROM (SELECT *, list_position(away, list_max(away)) AS nx FROM walk WHERE nth + 1 < k))
SELECT category, layer, nth, ids[pick] AS image_id, ps[pick] AS patch_id FROM walk""")
def memory_kcenter_projected(spark, d):
    flow = Flow(spark, d)
    own = flow.features().join(flow.splits().filter("role = 'memory'"), ["category", "image_id"], "left_semi")
    return memory.k_center(own, 0.25, projection=4, entries="sign").drop("v")


@query(ORACLES["random_projection"].replace(SIGNED, NORMAL))
def normal_projection(spark, d):
    return memory.random_projection(Flow(spark, d).features(), 4, width=adapters.WIDTH)


@query(ORACLES["memory_kcenter_projected"].replace(SIGNED, NORMAL))
def memory_kcenter_normal(spark, d):
    flow = Flow(spark, d)
    own = flow.features().join(flow.splits().filter("role = 'memory'"), ["category", "image_id"], "left_semi")
    return memory.k_center(own, 0.25, projection=4).drop("v")


@query(sql.flow("SELECT category, layer, bank_id, source_id, patch_id, x, y, list_transform(v, lambda x: round(x, 6)) AS v FROM bank"))
def memory_bank(spark, d):
    return Flow(spark, d).bank()


@query(sql.flow("SELECT category, count(*) AS memory_entries FROM bank GROUP BY category"))
def memory_entries(spark, d):
    return memory.memory_entries(Flow(spark, d).bank())


@query(sql.flow("SELECT category, layer, count(*) AS rows, CAST(0 AS BIGINT) AS not_finite, CAST(0 AS BIGINT) AS other_width, CAST(0 AS BIGINT) AS outside FROM bank GROUP BY ALL"))
def memory_bank_checks(spark, d):
    return memory.bank_faults(Flow(spark, d).bank())


# Nearest neighbours


@query(sql.flow("SELECT category, image_id, layer, patch_id, round(min(cosine), 6) AS score, arg_min(bank_id, (cosine, bank_id)) AS bank_id FROM calibration_pairs GROUP BY ALL"))
def nn_cosine(spark, d):
    flow = Flow(spark, d)
    return nearest.nearest(flow.calibration_features(), flow.bank(), 0.0)


@query(sql.flow("SELECT category, image_id, layer, patch_id, round(min(cosine + 0.1::DOUBLE * apart), 6) AS score, arg_min(bank_id, (cosine + 0.1::DOUBLE * apart, bank_id)) AS bank_id FROM calibration_pairs GROUP BY ALL"))
def nn_spatial(spark, d):
    flow = Flow(spark, d)
    return nearest.nearest(flow.calibration_features(), flow.bank(), 0.1)


@query(sql.flow("SELECT category, image_id, layer, patch_id, round(score, 6) AS score FROM test_scores"))
def patch_scores(spark, d):
    return Flow(spark, d).test_scores().drop("bank_id")


# Reliability and weights


@query(sql.flow("SELECT category, layer, round(same_position_distance, 6) AS same_position_distance FROM same_place"))
def reliability_same_position(spark, d):
    return rel.same_position_distance(Flow(spark, d).calibration_features()).drop("images")


@query(sql.flow("SELECT category, layer, round(cross_position_distance, 6) AS cross_position_distance FROM cross_place"))
def reliability_cross_position(spark, d):
    return rel.cross_position_distance(Flow(spark, d).calibration_features())


@query(sql.flow("SELECT category, layer, round(same_position_distance, 6) AS same_position_distance, round(cross_position_distance, 6) AS cross_position_distance, round(reliability, 6) AS reliability FROM reliability"))
def spatial_reliability(spark, d):
    return Flow(spark, d).reliability()


@query(sql.flow("SELECT layer, round(tau, 6) AS tau FROM tau"))
def layer_tau(spark, d):
    return rel.layer_tau(Flow(spark, d).reliability())


@query(sql.flow("SELECT category, layer, round(spatial_weight, 6) AS spatial_weight FROM weights"))
def spatial_weights_adaptive(spark, d):
    return Flow(spark, d).weights()


@query(sql.flow("SELECT 'adaptive' AS mode, category, layer, round(spatial_weight, 6) AS spatial_weight FROM weights UNION ALL SELECT 'none', category, layer, 0.0 FROM weights UNION ALL SELECT 'fixed', category, layer, 0.05 FROM weights"))
def spatial_weights_modes(spark, d):
    rows = Flow(spark, d).reliability()
    made = [rel.spatial_weights(rows, mode).select(F.lit(mode).alias("mode"), "category", "layer", "spatial_weight") for mode in ("adaptive", "none", "fixed")]
    return made[0].unionByName(made[1]).unionByName(made[2])


@query(sql.flow("SELECT layer, round(tau, 6) AS tau, category, round(reliability, 6) AS reliability FROM reliability JOIN tau USING (layer)"))
def reliability_summary(spark, d):
    rows = rel.reliability_summary(Flow(spark, d).reliability())
    return rows.select("layer", "tau", F.explode("reliability_by_category").alias("category", "reliability"))


# Calibration and thresholds


@query(sql.flow("SELECT category, layer, round(median, 6) AS median, round(mad, 6) AS mad FROM layer_calibration"))
def median_mad(spark, d):
    return Flow(spark, d).layer_calibration()


@query(sql.flow("SELECT category, image_id, layer, patch_id, round(greatest((score - median) / mad, 0), 6) AS score FROM test_scores JOIN layer_calibration USING (category, layer)"))
def calibrate_scores(spark, d):
    flow = Flow(spark, d)
    return calibration.calibrated(flow.test_scores(), flow.layer_calibration(), clamp=True).drop("bank_id")


@query(sql.flow("SELECT category, image_id, patch_id, round(score, 6) AS score FROM fused"))
def fused_scores(spark, d):
    return Flow(spark, d).fused()


@query(sql.lines("SELECT category, image_id, max(score) AS image_score FROM supplier_pixels GROUP BY ALL"))
def image_score_max(spark, d):
    return maps.image_scores(adapters.supplier_maps(spark, d), "max")


@query(sql.lines("SELECT category, image_id, round(quantile_cont(score, 0.99), 6) AS image_score FROM supplier_pixels GROUP BY ALL"))
def image_score_q99(spark, d):
    return maps.image_scores(adapters.supplier_maps(spark, d), "q99")


TOP_MEANS = "SELECT category, image_id, avg(score) AS image_score FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC) AS nth, count(*) OVER (PARTITION BY image_id) AS n FROM supplier_pixels) WHERE nth <= greatest(1, round_even(n * 0.05::DOUBLE, 0)) GROUP BY ALL"


@query(sql.lines(f"SELECT category, image_id, round(image_score, 3) AS image_score FROM ({TOP_MEANS})"))
def image_score_topk(spark, d):
    return maps.image_scores(adapters.supplier_maps(spark, d), "topk_mean", 0.05).withColumn("image_score", F.round("image_score", 3))


@query(sql.lines("SELECT category, round(quantile_cont(score, 0.995), 6) AS pixel_threshold FROM supplier_pixels GROUP BY category"))
def pixel_threshold_global(spark, d):
    return calibration.pixel_threshold(adapters.supplier_maps(spark, d), "global_quantile")


@query(sql.lines("SELECT category, round(quantile_cont(m, 0.95), 6) AS pixel_threshold FROM (SELECT category, image_id, max(score) AS m FROM supplier_pixels GROUP BY ALL) GROUP BY category"))
def pixel_threshold_image_max(spark, d):
    return calibration.pixel_threshold(adapters.supplier_maps(spark, d), "image_max_quantile")


@query(sql.lines(f"SELECT category, round(quantile_cont(image_score, 0.95), 3) AS pixel_threshold FROM ({TOP_MEANS}) GROUP BY category"))
def pixel_threshold_image_topk(spark, d):
    return calibration.pixel_threshold(adapters.supplier_maps(spark, d), "image_topk_quantile", topk_fraction=0.05).withColumn("pixel_threshold", F.round("pixel_threshold", 3))


@query(sql.lines("SELECT category, round(quantile_cont(score, 0.25), 6) AS q25, round(quantile_cont(score, 0.5), 6) AS q50 FROM lines GROUP BY category"))
def quantile_bracketed(spark, d):
    rows = adapters.scored_lines(spark, d)
    return exact_quantiles(rows, ["category"], "score", {"q25": 0.25, "q50": 0.5})


@query(sql.flow("SELECT category, round(image_threshold, 6) AS image_threshold FROM image_thresholds"))
def image_threshold(spark, d):
    flow = Flow(spark, d)
    return calibration.image_threshold(flow.image_scores(flow.calibration_maps("threshold_fit")))


@query(sql.flow("SELECT category, round(normal_pixel_positive_rate, 6) AS normal_pixel_positive_rate, round(normal_image_positive_rate, 6) AS normal_image_positive_rate FROM diagnostics"))
def normal_diagnostics(spark, d):
    flow = Flow(spark, d)
    return calibration.normal_diagnostics(flow.calibration_maps("normal_validation"), calibration.pixel_threshold(flow.calibration_maps("threshold_fit")))


@query(sql.flow("""SELECT category, round(pixel_threshold, 6) AS pixel_threshold, round(image_threshold, 6) AS image_threshold, round(normal_pixel_positive_rate, 6) AS normal_pixel_positive_rate, round(normal_image_positive_rate, 6) AS normal_image_positive_rate,
 count(*) FILTER (WHERE role = 'memory') AS memory_images, count(*) FILTER (WHERE role = 'threshold_fit') AS threshold_fit_images, count(*) FILTER (WHERE role = 'normal_validation') AS normal_validation_images,
 count(*) FILTER (WHERE role <> 'memory') AS normalization_fit_images, 'global_quantile' AS pixel_threshold_method, 'held_out_from_threshold_fit' AS normal_diagnostic_mode
 FROM splits JOIN pixel_thresholds USING (category) JOIN image_thresholds USING (category) JOIN diagnostics USING (category) GROUP BY ALL"""))
def category_calibration(spark, d):
    return Flow(spark, d).category_calibration()


@query(sql.flow("SELECT category, image_id, round(image_score, 6) AS image_score, label, CAST(image_score >= image_threshold AS INT) AS predicted FROM labelled_images JOIN image_thresholds USING (category)"))
def threshold_predictions(spark, d):
    flow = Flow(spark, d)
    limits = calibration.image_threshold(flow.image_scores(flow.calibration_maps("threshold_fit")))
    return calibration.threshold_predictions(flow.labelled_images(), limits, "image_score", "image_threshold")


# Maps


@query(sql.flow("SELECT category, image_id, CAST(px AS INT) AS px, CAST(py AS INT) AS py, round(score, 6) AS score FROM pixels"))
def upsample_maps(spark, d):
    return maps.pixels(Flow(spark, d).test_maps(), MAP_SIZE)


@query("WITH " + sql.FLOW.strip() + """,
kernel AS (SELECT o, exp(-0.5::DOUBLE * o * o) / sum(exp(-0.5::DOUBLE * o * o)) OVER () AS w FROM range(-4, 5) r(o)),
blur AS (SELECT i, CASE WHEN src < 0 THEN -1 - src WHEN src > 7 THEN 15 - src ELSE src END AS j, sum(w) AS w FROM (SELECT i, i + o AS src, w FROM range(8) r(i), kernel) GROUP BY ALL)
SELECT category, image_id, CAST(bx.i AS INT) AS px, CAST(by_.i AS INT) AS py, round(sum(score * bx.w * by_.w), 6) AS score FROM pixels JOIN blur bx ON bx.j = px JOIN blur by_ ON by_.j = py GROUP BY ALL""")
def gaussian_smooth(spark, d):
    return maps.pixels(maps.smoothed(Flow(spark, d).test_maps(), 1.0), MAP_SIZE)


@query(sql.flow("SELECT category, image_id, round(score, 6) AS score, label FROM labelled_pixels"))
def pixel_labels(spark, d):
    return Flow(spark, d).labelled_pixels()


@query(sql.flow("""SELECT category, image_id, round(image_score, 6) AS image_score, label, CAST(rank AS INT) AS rank, round(pixel_threshold, 6) AS pixel_threshold, predicted_mask, round(greatest(2.5::DOUBLE * pixel_threshold, 1e-6), 6) AS color_ceiling
 FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY image_score DESC, image_id) AS rank FROM labelled_images) JOIN pixel_thresholds USING (category)
 JOIN (SELECT category, image_id, list(CAST(score >= pixel_threshold AS INT) ORDER BY py, px) AS predicted_mask FROM pixels JOIN pixel_thresholds USING (category) GROUP BY ALL) USING (category, image_id) WHERE rank <= 5"""))
def top_anomalies(spark, d):
    flow = Flow(spark, d)
    rows = flow.test_maps()
    scored = rows.join(flow.image_scores(rows), ["category", "image_id"]).join(flow.test_images(), ["category", "image_id"])
    return maps.top_anomalies(scored, calibration.pixel_threshold(flow.calibration_maps("threshold_fit")), 5)


# Metrics


@query(sql.lines("SELECT category, round(auroc, 6) AS auroc FROM ranks").replace("\nSELECT category, round", ",\n" + sql.ranking("lines") + "\nSELECT category, round"))
def auroc(spark, d):
    return metrics.ranking(adapters.scored_lines(spark, d)).select("category", "auroc")


@query(sql.lines("SELECT category, round(average_precision, 6) AS average_precision FROM ranks").replace("\nSELECT category, round", ",\n" + sql.ranking("lines") + "\nSELECT category, round"))
def average_precision(spark, d):
    return metrics.ranking(adapters.scored_lines(spark, d)).select("category", "average_precision")


RANKING_EVENTS = "WITH " + sql.LINES.strip() + ",\n" + sql.ranking("scored_events") + "\nSELECT category, round(auroc, 6) AS auroc, round(average_precision, 6) AS average_precision, round(f1_oracle, 6) AS f1_oracle, round(threshold_oracle, 6) AS threshold_oracle FROM ranks JOIN best USING (category)"


@query("WITH " + sql.LINES.strip() + ",\n" + sql.ranking("lines") + "\nSELECT category, round(f1_oracle, 6) AS f1_oracle, round(threshold_oracle, 6) AS threshold_oracle FROM best")
def oracle_f1(spark, d):
    return metrics.ranking(adapters.scored_lines(spark, d)).select("category", "f1_oracle", "threshold_oracle")


@query(RANKING_EVENTS)
def ranking_with_ties(spark, d):
    return metrics.ranking(adapters.scored_events(spark, d))


@query("WITH " + sql.LINES.strip() + ",\nlimits AS (SELECT category, quantile_cont(score, 0.75) AS threshold FROM lines GROUP BY category),\n" + sql.fixed("lines", "score", "limits", "threshold") + "\nSELECT category, round(f1_calibrated, 6) AS f1_calibrated, round(iou_calibrated, 6) AS iou_calibrated FROM fixed")
def f1_iou_at_threshold(spark, d):
    rows = adapters.scored_lines(spark, d)
    return metrics.at_threshold(rows, exact_quantiles(rows, ["category"], "score", {"threshold": 0.75}))


def _both_levels(select: str) -> str:
    image, pixel = sql.ranking("labelled_images", "image_score"), sql.ranking("labelled_pixels")
    for name in ("hist", "sums", "totals", "ranks", "best"):
        pixel = pixel.replace(f"{name} AS (", f"pixel_{name} AS (").replace(f"FROM {name} ", f"FROM pixel_{name} ").replace(f"JOIN {name} ", f"JOIN pixel_{name} ")
    parts = [sql.FLOW.strip(), image, pixel, sql.fixed("labelled_images", "image_score", "image_thresholds", "image_threshold"), sql.fixed("labelled_pixels", "score", "pixel_thresholds", "pixel_threshold", "pixel_fixed")]
    columns = ", ".join(f"round({t}.{c}, 6) AS {level}_{name}" for level, (ranks, fixed, best) in {"image": ("ranks", "fixed", "best"), "pixel": ("pixel_ranks", "pixel_fixed", "pixel_best")}.items() for t, c, name in ((ranks, "auroc", "AUROC"), (ranks, "average_precision", "AUPR"), (fixed, "f1_calibrated", "F1_calibrated"), (fixed, "iou_calibrated", "IoU_calibrated"), (best, "f1_oracle", "F1_oracle"), (best, "threshold_oracle", "threshold_oracle")))
    rows = f"metric_rows AS (SELECT category, {columns}, round(image_threshold, 6) AS image_threshold, round(pixel_threshold, 6) AS pixel_threshold, test_images FROM ranks JOIN fixed USING (category) JOIN best USING (category) JOIN pixel_ranks USING (category) JOIN pixel_fixed USING (category) JOIN pixel_best USING (category) JOIN image_thresholds USING (category) JOIN pixel_thresholds USING (category) JOIN (SELECT category, count(*) AS test_images FROM test_images GROUP BY category) USING (category))"
    return "WITH " + ",\n".join([*parts, rows]) + "\n" + select


def _metric_rows(spark, d) -> DataFrame:
    flow = Flow(spark, d)
    limits = flow.category_calibration()
    return metrics.category_metrics(flow.labelled_images().withColumnRenamed("image_score", "score"), flow.labelled_pixels(), limits)


@query(_both_levels("SELECT * FROM metric_rows"))
def category_metrics(spark, d):
    return _metric_rows(spark, d)


NUMBERS = ("image_AUROC", "image_AUPR", "image_F1_calibrated", "image_IoU_calibrated", "image_F1_oracle", "image_threshold_oracle", "pixel_AUROC", "pixel_AUPR", "pixel_F1_calibrated", "pixel_IoU_calibrated", "pixel_F1_oracle", "pixel_threshold_oracle", "image_threshold", "pixel_threshold")


@query(_both_levels("SELECT * REPLACE (CAST(test_images AS DOUBLE) AS test_images) FROM metric_rows UNION ALL SELECT 'mean', " + ", ".join(f"round(avg({c}) FILTER (WHERE NOT isnan({c})), 5)" for c in NUMBERS) + ", round(avg(test_images), 5) FROM metric_rows").replace("SELECT * REPLACE", "SELECT category, " + ", ".join(f"round({c}, 5) AS {c}" for c in NUMBERS) + ", CAST(test_images AS DOUBLE) AS test_images FROM metric_rows UNION ALL SELECT * FROM (SELECT * REPLACE").replace(" FROM metric_rows UNION ALL SELECT * FROM (SELECT * REPLACE (CAST(test_images AS DOUBLE) AS test_images) FROM metric_rows", " FROM metric_rows"))
def metrics_summary(spark, d):
    rows = metrics.with_mean_row(rounded(_metric_rows(spark, d)))
    return rows.select(*[F.round(c, 5).alias(c) if c != "category" else F.col(c) for c in rows.columns])


@query("WITH d AS (SELECT CAST(user_id % 10 AS VARCHAR) AS category, value / 1000 AS seconds FROM events WHERE value IS NOT NULL) SELECT category, round(sum(seconds), 6) AS inference_seconds, round(1000 * sum(seconds) / count(*), 6) AS ms_per_image FROM d GROUP BY category")
def latency_per_image(spark, d):
    rows = adapters.read(spark, d, "events").filter("value IS NOT NULL").select((F.col("user_id") % 10).cast("string").alias("category"), (F.col("value") / 1000).alias("seconds"))
    return metrics.latency(rows)


@query("WITH RECURSIVE " + sql.FLOW.strip() + ",\n" + sql.ranking("labelled_images", "image_score") + "\nSELECT category, round(auroc, 6) AS auroc FROM ranks")
def auroc_pipeline(spark, d):
    rows = Flow(spark, d).labelled_images().withColumnRenamed("image_score", "score")
    return metrics.ranking(rows).select("category", "auroc")


# Reports


ALL_PARTS = ("mean", "std", "min", "max", "range")


@query(sql.cases(f"SELECT method, count(DISTINCT threshold_split_seed) AS threshold_splits, count(DISTINCT category) AS categories, {sql.described(sql.METRICS, ALL_PARTS)} FROM enriched GROUP BY method"))
def threshold_stability(spark, d):
    return reports.threshold_stability(adapters.cases(spark, d))


BY_SPLIT = "SELECT method, threshold_split_seed, " + ", ".join(f"avg({m}) AS {m}" for m in sql.METRICS) + " FROM enriched GROUP BY ALL"
ROUND_METRICS = ", ".join(f"round({m}, 6) AS {m}" for m in sql.METRICS)


@query(sql.cases(f"SELECT method, threshold_split_seed, {ROUND_METRICS} FROM ({BY_SPLIT})"))
def threshold_by_split(spark, d):
    return reports.threshold_by_split(adapters.cases(spark, d))


@query(sql.cases(f"SELECT category, method, {sql.described(sql.METRICS, ('mean', 'std', 'max'))} FROM enriched GROUP BY ALL"))
def threshold_per_category(spark, d):
    return reports.threshold_per_category(adapters.cases(spark, d))


SPLIT_STABILITY = f"SELECT method, {sql.described(sql.METRICS, ('mean', 'std', 'range'), '_across_splits')} FROM ({BY_SPLIT}) GROUP BY method"


@query(sql.cases(SPLIT_STABILITY))
def threshold_split_stability(spark, d):
    return reports.threshold_split_stability(adapters.cases(spark, d))


@query(sql.cases("SELECT category, round(avg(pixel_F1_oracle), 6) AS pixel_F1_oracle, round(max(pixel_F1_oracle) - min(pixel_F1_oracle), 6) AS max_difference, max(pixel_F1_oracle) - min(pixel_F1_oracle) <= 1e-8 AS shared FROM cases GROUP BY category"))
def shared_oracle(spark, d):
    return reports.shared_oracle(adapters.cases(spark, d))


I, P = "normal_image_positive_rate", "normal_pixel_positive_rate"
SELECTED = f"""(SELECT * FROM (SELECT method, avg({I}) AS im, stddev_pop({I}) AS isd, avg({P}) AS pm, stddev_pop({P}) AS psd FROM ({BY_SPLIT}) GROUP BY method)
 ORDER BY im + isd, pm + psd, isd, psd, list_position(['global_quantile', 'image_max_quantile', 'image_topk_quantile'], method) LIMIT 1)"""


@query(sql.cases(f"SELECT * FROM ({SPLIT_STABILITY}) WHERE method = (SELECT method FROM {SELECTED})"))
def select_threshold_method(spark, d):
    return reports.select_method(reports.threshold_split_stability(adapters.cases(spark, d)))


@query(sql.cases(f"""SELECT 1 AS schema_version, method AS selected_method, '{reports.SELECTION_RULE}' AS selection_rule, round(im, 6) AS image_mean, round(isd, 6) AS image_std, round(im + isd, 6) AS image_risk,
 round(pm, 6) AS pixel_mean, round(psd, 6) AS pixel_std, round(pm + psd, 6) AS pixel_risk, (SELECT list_sort(list(DISTINCT threshold_split_seed)) FROM cases) AS threshold_split_seeds, (SELECT list_sort(list(DISTINCT category)) FROM cases) AS development_categories,
 (SELECT round(avg(m), 6) FROM (SELECT avg(pixel_F1_oracle) AS m FROM cases GROUP BY category)) AS mean_pixel_F1_oracle, (SELECT round(max(x), 6) FROM (SELECT max(pixel_F1_oracle) - min(pixel_F1_oracle) AS x FROM cases GROUP BY category)) AS max_difference FROM {SELECTED}"""))
def selection_manifest(spark, d):
    return reports.selection_manifest(adapters.cases(spark, d))


@query(sql.cases('SELECT "case", case_order, ' + ", ".join(f"round(avg({m}), 6) AS {m}" for m in reports.LAYER_METRICS) + " FROM layer_cases GROUP BY ALL"))
def layer_ablation_means(spark, d):
    return reports.layer_ablation_means(adapters.layer_cases(spark, d))


@query(sql.cases("SELECT category, best_single_layer, round(best_single_pixel_AUROC, 6) AS best_single_pixel_AUROC FROM best_single"))
def best_single_layer(spark, d):
    return reports.best_single_layer(adapters.layer_cases(spark, d))


@query(sql.cases('SELECT best_single_layer AS "case", count(*) AS wins FROM best_single GROUP BY ALL'))
def layer_win_counts(spark, d):
    return reports.layer_win_counts(adapters.layer_cases(spark, d))


@query(sql.cases("SELECT category, " + ", ".join(f"round(max(l.{m}) FILTER (WHERE l.\"case\" = '{c}'), 6) AS {c}_{m}" for c in reports.LAYER_CASES for m in ("pixel_AUROC", "pixel_F1_oracle")) + """, any_value(best_single_layer) AS best_single_layer, round(any_value(best_single_pixel_AUROC), 6) AS best_single_pixel_AUROC,
 round(max(pixel_AUROC) FILTER (WHERE "case" = 'fusion_3_6_9_12'), 6) AS fusion_pixel_AUROC, round(max(pixel_AUROC) FILTER (WHERE "case" = 'fusion_3_6_9_12') - any_value(best_single_pixel_AUROC), 6) AS fusion_minus_best_single FROM layer_cases l JOIN best_single USING (category) GROUP BY category"""))
def layer_ablation_per_category(spark, d):
    return reports.layer_ablation_per_category(adapters.layer_cases(spark, d))


def _stages(spark, d) -> tuple[DataFrame, DataFrame]:
    rows = reports.enriched(adapters.cases(spark, d)).filter("method = 'global_quantile'")
    by = lambda part: rows.filter(part).groupBy("threshold_split_seed").agg(*[F.avg(m).alias(m) for m in reports.METRICS])
    return by("category < '5'"), by("category >= '5'")


STAGES = ",\n".join(f"{name} AS (SELECT threshold_split_seed, {', '.join(f'avg({m}) AS {m}' for m in sql.METRICS)} FROM enriched WHERE method = 'global_quantile' AND category {part} '5' GROUP BY threshold_split_seed)" for name, part in (("dev", "<"), ("validation", ">=")))
FULL = "SELECT threshold_split_seed, " + ", ".join(f"(5.0::DOUBLE * d.{m} + 10.0::DOUBLE * v.{m}) / 15.0::DOUBLE AS {m}" for m in sql.METRICS) + " FROM dev d JOIN validation v USING (threshold_split_seed)"


@query("WITH " + sql.CASES.strip() + f",\n{STAGES}\nSELECT threshold_split_seed, {ROUND_METRICS} FROM ({FULL})")
def protocol_full_by_split(spark, d):
    return reports.protocol_full_by_split(*_stages(spark, d))


@query("WITH " + sql.CASES.strip() + f",\n{STAGES},\nfull_ AS ({FULL})\n" + " UNION ALL ".join(f"SELECT '{g}' AS \"group\", '{s}' AS source, {n} AS categories, count(*) AS threshold_splits, {sql.described(sql.METRICS, ('mean', 'std'))} FROM {t}" for g, s, n, t in (("dev", "selection_stage", 5, "dev"), ("validation", "locked_validation", 10, "validation"), ("full", "derived_dev_plus_locked_validation", 15, "full_"))))
def protocol_comparison(spark, d):
    return reports.protocol_comparison(*_stages(spark, d))


@query(sql.cases("SELECT m.method, s.threshold_split_seed FROM (SELECT DISTINCT method FROM cases) m, (SELECT DISTINCT threshold_split_seed FROM cases) s"))
def case_grid(spark, d):
    rows = adapters.cases(spark, d)
    return reports.case_grid(rows.select("method"), rows.select("threshold_split_seed"))


COMPLETE = "SELECT method, threshold_split_seed FROM cases GROUP BY ALL HAVING avg(normal_image_positive_rate) > 0.255"


@query(sql.cases(f"SELECT m.method, s.threshold_split_seed FROM (SELECT DISTINCT method FROM cases) m, (SELECT DISTINCT threshold_split_seed FROM cases) s WHERE (m.method, s.threshold_split_seed) NOT IN ({COMPLETE})"))
def pending_cases(spark, d):
    rows = adapters.cases(spark, d)
    done = rows.groupBy("method", "threshold_split_seed").agg(F.avg("normal_image_positive_rate").alias("r")).filter("r > 0.255")
    return reports.pending_cases(reports.case_grid(rows.select("method"), rows.select("threshold_split_seed")), done, ["method", "threshold_split_seed"])


@query("SELECT l_orderkey, l_linenumber, count(*) AS cases FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_cases(spark, d):
    return reports.duplicate_cases(adapters.read(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def missing_cases(spark, d):
    return reports.missing_cases(adapters.read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), adapters.read(spark, d, "customer"), "c_custkey")


#: Written from the rules of the threshold study; the moduli are those of `adapters.gated_cases`.
THRESHOLD_FAULTS = """WITH c AS (SELECT DISTINCT l_suppkey AS k FROM lineitem)
SELECT k, 'model seed' AS rule, 'experiment.seed' AS path FROM c WHERE k % 5 = 0
UNION ALL SELECT k, 'stage', 'experiment.protocol_stage' FROM c WHERE k % 7 = 0
UNION ALL SELECT k, 'threshold parameters', 'calibration.pixel_quantile' FROM c WHERE k % 11 = 0
UNION ALL SELECT k, 'base protocol', 'calibration.pixel_quantile' FROM c WHERE k % 11 = 0
UNION ALL SELECT k, 'base protocol', 'memory.ratio' FROM c WHERE k % 13 = 0
UNION ALL SELECT k, 'base protocol', 'model.active_layers' FROM c WHERE k % 29 = 0
UNION ALL SELECT k, 'category order', 'categories' FROM c WHERE k % 17 = 0
UNION ALL SELECT k, 'not held out', 'b' FROM c WHERE k % 19 = 0
UNION ALL SELECT k, 'no validation images', 'c' FROM c WHERE k % 23 = 0
UNION ALL SELECT DISTINCT NULL, 'unexpected method', 'another' FROM c WHERE k % 31 = 0"""


@query(THRESHOLD_FAULTS.replace("FROM c WHERE", "FROM c WHERE k % 31 <> 0 AND").replace("k % 31 <> 0 AND k % 31 = 0", "k % 31 = 0"))
def protocol_violations(spark, d):
    return gates.threshold_faults(adapters.gated_cases(spark, d), ["k"])


@query("""WITH c AS (SELECT DISTINCT l_suppkey AS k, l_linenumber AS n FROM lineitem WHERE l_linenumber <= 5), s AS (SELECT DISTINCT k FROM c),
labels AS (SELECT k, n, ['block3', 'block6', 'block9', 'block12', 'fusion_3_6_9_12'][n] AS "case" FROM c),
ref AS (SELECT k, min(n) AS n FROM c GROUP BY k)
SELECT l.k, "case", 'protocol' AS rule, path FROM labels l JOIN ref r ON l.k = r.k AND l.n <> r.n,
 (SELECT unnest(['experiment.seed', 'data.image_size', 'data.calibration_fraction', 'model.checkpoint', 'model.token_norm', 'memory.sampling', 'memory.ratio', 'retrieval.spatial_mode', 'retrieval.lambda_max']) AS path, unnest(range(9)) AS i) p
 WHERE ((l.k + l.n) % 9 = i) <> ((l.k + r.n) % 9 = i)
UNION ALL SELECT l.k, "case", 'category order', 'categories' FROM labels l JOIN ref r ON l.k = r.k WHERE (l.n % 4 = 0) <> (r.n % 4 = 0)
UNION ALL SELECT k, m, 'missing case', NULL FROM s, (SELECT unnest(['block3', 'block6', 'block9', 'block12', 'fusion_3_6_9_12']) AS m) WHERE (k, m) NOT IN (SELECT k, "case" FROM labels)""")
def layer_protocol_faults(spark, d):
    return gates.layer_faults(adapters.gated_layers(spark, d), ["k", "case"], ["k"])


@query("""SELECT k, list_filter([CASE WHEN k % 2 = 0 THEN 'dev stage' END, CASE WHEN k % 3 = 0 THEN 'validation stage' END, CASE WHEN k % 5 = 0 THEN 'selection kept' END, CASE WHEN k % 7 = 0 THEN 'only the selected method' END,
 CASE WHEN k % 11 = 0 THEN 'model seed' END, CASE WHEN k % 13 = 0 THEN 'split seeds' END, CASE WHEN k % 17 = 0 THEN 'base protocol' END, CASE WHEN k % 19 = 0 THEN 'selected protocol' END, CASE WHEN k % 23 = 0 THEN 'locked parameters' END,
 CASE WHEN k % 29 = 0 THEN 'dev diagnostics' END, CASE WHEN k % 31 = 0 THEN 'validation diagnostics' END, CASE WHEN k % 37 = 0 THEN 'disjoint categories' END, CASE WHEN k % 41 = 0 THEN 'category counts' END], lambda x: x IS NOT NULL) AS rules
 FROM (SELECT DISTINCT o_custkey AS k FROM orders) WHERE len(rules) > 0""")
def stage_protocol_faults(spark, d):
    return gates.stage_faults(adapters.staged_pairs(spark, d), ["k"])


@query("SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS category FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT CAST(l_suppkey AS VARCHAR) FROM lineitem WHERE l_returnflag = 'R'")
def stage_overlap(spark, d):
    rows = adapters.read(spark, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("category"), "l_returnflag")
    return reports.stage_overlap(rows.filter("l_returnflag = 'A'"), rows.filter("l_returnflag = 'R'"))


LABELS = "SELECT o_orderkey, CASE WHEN len(l) = 1 THEN 'block' || l[1] ELSE 'fusion_' || array_to_string(l, '_') END AS case_label FROM (SELECT l_orderkey AS o_orderkey, list_sort(list(DISTINCT l_linenumber)) AS l FROM lineitem GROUP BY 1)"


@query(LABELS)
def case_label(spark, d):
    rows = adapters.read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_set("l_linenumber")).alias("layers"))
    return rows.select("o_orderkey", reports.case_label(F.col("layers")).alias("case_label"))


FAULTS = """SELECT CAST(k AS VARCHAR) AS case_dir, fields FROM (SELECT k, list_concat(CASE WHEN k % 13 = 0 THEN ['marker'] ELSE list_filter([CASE WHEN k % 5 = 0 THEN 'status' END, CASE WHEN k % 5 = 0 THEN 'completed_categories' END,
 CASE WHEN k % 5 = 0 THEN 'completed_count' END, CASE WHEN k % 7 = 0 THEN 'seed' END, CASE WHEN k % 11 = 0 THEN 'config_fingerprint' END], lambda x: x IS NOT NULL) END, CASE WHEN k % 17 = 0 AND n > 1 THEN ['categories'] ELSE [] END) AS fields
 FROM (SELECT l_suppkey AS k, count(DISTINCT l_returnflag) AS n FROM lineitem GROUP BY 1)) WHERE len(fields) > 0"""


@query(FAULTS)
def completion_faults(spark, d):
    rows = adapters.marked_cases(spark, d)
    marker = F.when(F.col("k") % 13 != 0, F.to_json(F.struct(*[x.split()[0] for x in reports.MARKER.split(", ")])))
    return reports.completion_faults(rows.select("case_dir", "config_json", "metrics_json", marker.alias("marker_json")))


@query("SELECT CAST(k AS VARCHAR) AS case_dir, k % 13 <> 0 AS found FROM (SELECT DISTINCT l_suppkey AS k FROM lineitem) WHERE k % 5 = 0 OR k % 11 = 0 OR k % 13 = 0")
def cases_to_run(spark, d):
    rows = adapters.marked_cases(spark, d)
    desired = rows.select("case_dir", "categories", fingerprints.config_fingerprint(F.col("config_json")).alias("config_fingerprint"))
    markers = rows.filter("k % 13 != 0").select("case_dir", "status", "expected_categories", "completed_categories", "expected_count", "completed_count", "config_fingerprint")
    return reports.cases_to_run(desired, markers, ["case_dir"])


@query(sql.cases(f"""SELECT k, fields FROM (SELECT k, list_filter([CASE WHEN p OR m THEN 'selected_parameters' END, CASE WHEN s THEN 'model_seed' END, CASE WHEN p OR s THEN 'base_protocol_fingerprint' END,
 CASE WHEN p OR s OR m THEN 'selected_protocol_fingerprint' END, CASE WHEN k % 11 = 0 THEN 'threshold_split_seeds' END], lambda x: x IS NOT NULL) AS fields
 FROM (SELECT k, k % 5 = 0 AS p, k % 7 = 0 AS s, ['global_quantile', 'image_max_quantile', 'image_topk_quantile'][k % 3 + 1] <> (SELECT method FROM {SELECTED}) AS m FROM (SELECT DISTINCT l_suppkey AS k FROM lineitem))) WHERE len(fields) > 0"""))
def manifest_faults(spark, d):
    methods = F.array(*map(F.lit, reports.METHODS))
    configs = spark.range(len(reports.METHODS)).select(methods[F.col("id").cast("int")].alias("method")).withColumn("config_json", adapters.config_json(calibration__pixel_threshold_method=F.col("method")))
    rows = adapters.read(spark, d, "lineitem").select(F.col("l_suppkey").alias("k")).distinct()
    own = adapters.config_json(calibration__pixel_threshold_method=methods[(F.col("k") % 3).cast("int")], calibration__pixel_quantile=F.when(F.col("k") % 5 == 0, 0.9).otherwise(0.995), experiment__seed=F.when(F.col("k") % 7 == 0, 43).otherwise(42))
    seeds = F.when(F.col("k") % 11 == 0, F.array(F.lit(42), F.lit(43))).otherwise(F.array(F.lit(44), F.lit(42), F.lit(43)))
    return reports.manifest_faults(reports.selection_manifest(adapters.cases(spark, d), configs), rows.select("k", own.alias("config_json"), seeds.alias("threshold_split_seeds")), ["k"])


@query("""SELECT o_orderkey, sha256('{"customer":{"key":' || o_custkey || '},"order":' || o_orderkey || ',"status":"' || o_orderstatus || '"}') AS fingerprint FROM orders""")
def config_fingerprints(spark, d):
    rows = adapters.read(spark, d, "orders")
    text = F.to_json(F.struct(F.col("o_orderstatus").alias("status"), F.lit("/elsewhere").alias("_config_path"), F.col("o_orderkey").alias("order"), F.struct(F.col("o_custkey").alias("key")).alias("customer")))
    return rows.withColumn("config_json", text).select("o_orderkey", fingerprints.config_fingerprint(F.col("config_json")).alias("fingerprint"))


# What is written and read again, or arrives as a stream


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/heddle-{uuid.uuid4().hex}"


@query(sql.flow("SELECT category, layer, bank_id, source_id, patch_id, x, y, list_transform(v, lambda x: round(x, 6)) AS v FROM bank"))
def memory_bank_stored(spark, d):
    path = _folder(spark)
    artifacts.write_bank(Flow(spark, d).bank(), path, ratio=adapters.RATIO)
    return artifacts.read_bank(spark, path)


@query(sql.flow("SELECT f.category, f.layer, f.image_id, f.patch_id, s.role, list_transform(f.v, lambda x: round(x, 6)) AS v FROM features f JOIN splits s ON f.category = s.category AND f.image_id = s.image_id WHERE s.role <> 'memory'"))
def calibration_features_stored(spark, d):
    flow, path = Flow(spark, d), _folder(spark)
    artifacts.write_calibration_features(flow.features(), flow.splits(), PATCHES, path)
    return artifacts.read_calibration_features(spark, path).select("category", "layer", "image_id", "patch_id", "role", "v")


@query(sql.flow("SELECT r.category, r.layer, round(r.reliability, 6) AS reliability, round(t.tau, 6) AS tau, round(w.spatial_weight, 6) AS spatial_weight, round(m.median, 6) AS median, round(m.mad, 6) AS mad FROM reliability r JOIN tau t ON r.layer = t.layer JOIN weights w ON r.category = w.category AND r.layer = w.layer JOIN layer_calibration m ON r.category = m.category AND r.layer = m.layer"))
def calibration_stored(spark, d):
    flow, path = Flow(spark, d), _folder(spark)
    artifacts.write_calibration(flow.reliability(), rel.layer_tau(flow.reliability()), flow.weights(), flow.layer_calibration(), path)
    return artifacts.read_calibration(spark, path)


@query(ORACLES["category_metrics"])
def summary_stored(spark, d):
    path, rows = _folder(spark), stored(_metric_rows(spark, d))
    artifacts.write_summary(rows, path)
    return spark.read.schema(StructType().add("categories", ArrayType(rows.schema))).json(f"{path}/json").select(F.inline("categories"))


@query(ORACLES["threshold_stability"])
def bundle_stored(spark, d):
    path, rows = _folder(spark), stored(reports.threshold_stability(adapters.cases(spark, d)))
    artifacts.write_bundle({"stability": rows}, spark.range(1).select(F.lit("development").alias("stage")), path)
    return spark.read.schema(StructType().add("stability", ArrayType(rows.schema))).json(path).select(F.inline("stability"))


@query(ORACLES["threshold_by_split"])
def runs_published(spark, d):
    """A run for each method, of which one fails after its first table; what is then still to be done is run again."""
    root, rows = _folder(spark), stored(adapters.cases(spark, d))
    names = stored(rows.select("category").distinct())
    methods = spark.createDataFrame([(m, m) for m in reports.METHODS], "case_dir string, config_fingerprint string")
    wanted = methods.crossJoin(names.agg(F.sort_array(F.collect_set("category")).alias("categories")))

    def lost():
        raise OSError("a table that can't be made")

    def publish(method: str, extra: dict) -> None:
        own = rows.filter(F.col("method") == method)
        marker = lambda: artifacts.completion_marker(names, own, 42, 42, method, list(adapters.LAYERS), "adaptive", method)
        artifacts.publish_run(spark, f"{root}/{method}", {"by_split": lambda: reports.threshold_by_split(own), **extra}, marker)

    for method in reports.METHODS:
        with suppress(OSError):
            publish(method, {"more": lost} if method == reports.METHODS[1] else {})
    # As many as there are methods.
    for case in reports.cases_to_run(wanted, artifacts.published_markers(spark, root), ["case_dir"]).collect():
        publish(case.case_dir, {})
    done = artifacts.published_markers(spark, root).collect()
    tables = [artifacts.read_run(spark, f"{root}/{case.case_dir}", "by_split") for case in done]
    return reduce(DataFrame.unionByName, tables)


@query("SELECT '| nation | customers | balance |' AS value UNION ALL SELECT '|---|---:|---:|' UNION ALL SELECT '| ' || n || ' | ' || c || ' | ' || printf('%.6f', b) || ' |' FROM (SELECT n_name AS n, count(*) AS c, max(c_acctbal) AS b FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)")
def report_markdown(spark, d):
    rows = adapters.read(spark, d, "customer").join(adapters.read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    made = rows.groupBy(F.col("n_name").alias("nation")).agg(F.count(F.lit(1)).alias("customers"), F.max("c_acctbal").alias("balance"))
    return artifacts.markdown(made, ["nation"])


@query(ORACLES["calibrate_scores"])
def streamed_scores(spark, d):
    flow, path = Flow(spark, d), _folder(spark)
    flow.test_patches().select("category", "image_id", "layer", "patch_id", "v").write.parquet(f"{path}/arrivals")
    score_arrivals(spark, f"{path}/arrivals", flow.bank(), flow.weights(), flow.layer_calibration(), f"{path}/scores", f"{path}/progress", PATCHES, clamp=True).awaitTermination()
    return spark.read.parquet(f"{path}/scores").select("category", "image_id", "layer", "patch_id", "score")


@query(sql.flow("SELECT category, image_id, round(image_score, 6) AS image_score, CAST(image_score >= image_threshold AS INT) AS predicted FROM labelled_images JOIN image_thresholds USING (category)"))
def streamed_decisions(spark, d):
    """Every image's patches are spread over several files, of which two are read at a time."""
    flow, path = Flow(spark, d), _folder(spark)
    flow.test_patches().select("category", "image_id", "layer", "patch_id", "v").repartition(8, "layer", "patch_id").write.parquet(f"{path}/arrivals")
    limits = stored(calibration.image_threshold(flow.image_scores(flow.calibration_maps("threshold_fit"))))
    bank, weights, layers = flow.bank(), flow.weights(), flow.layer_calibration()
    decide = lambda patches: image_decisions(patches, bank, weights, layers, limits, PATCHES, MAP_SIZE, topk_fraction=adapters.IMAGE_TOPK)
    decide_arrivals(spark, f"{path}/arrivals", list(adapters.LAYERS), PATCHES, decide, f"{path}/decisions", f"{path}/progress", files_per_batch=2).awaitTermination()
    return spark.read.parquet(f"{path}/decisions").filter("complete").select("category", "image_id", "image_score", "predicted")


# The same checks over tables with planted faults, so that they have something to find


@query(sql.flow("SELECT category, layer, count(*) AS rows, count(*) FILTER (WHERE bank_id % 7 = 0 AND bank_id % 11 <> 0) AS not_finite, count(*) FILTER (WHERE bank_id % 11 = 0) AS other_width, count(*) FILTER (WHERE bank_id % 13 = 0) AS outside FROM bank GROUP BY ALL"))
def memory_bank_faults(spark, d):
    every = lambda n: F.col("bank_id") % n == 0
    nan = F.when(every(7), F.transform("v", lambda x, i: F.when(i == 7, float("nan")).otherwise(x))).otherwise(F.col("v"))
    bank = Flow(spark, d).bank().withColumn("v", nan).withColumn("v", F.when(every(11), F.slice("v", 1, 7)).otherwise(F.col("v")))
    return memory.bank_faults(bank.withColumn("x", F.when(every(13), 2.0).otherwise(F.col("x"))))


@query(sql.flow("SELECT category, count(*) AS images, count(*) FILTER (WHERE image_id % 5 <> 0 AND image_id % 7 <> 0) AS covered, count(*) FILTER (WHERE image_id % 5 = 0 OR image_id % 7 = 0) AS uncovered FROM normal_splits WHERE role = 'calibration' GROUP BY category"))
def split_coverage_faults(spark, d):
    flow = Flow(spark, d)
    twice = flow.splits().filter("image_id % 7 = 0 AND image_id % 5 != 0")
    return sampling.split_coverage(flow.normal_splits().filter("role = 'calibration'"), flow.splits().filter("image_id % 5 != 0").unionByName(twice))


@query("""SELECT category, round(avg(o), 6) AS pixel_F1_oracle, round(max(o) - min(o), 6) AS max_difference, max(o) - min(o) <= 1e-8 AS shared
 FROM (SELECT CAST(l_suppkey % 10 AS VARCHAR) AS category, CASE WHEN l_suppkey % 10 < 5 THEN 0.5::DOUBLE ELSE l_discount END AS o FROM lineitem) GROUP BY category""")
def shared_oracle_differences(spark, d):
    other = F.when(F.col("l_suppkey") % 10 < 5, 0.5).otherwise(F.col("l_discount"))
    return reports.shared_oracle(adapters.read(spark, d, "lineitem").select((F.col("l_suppkey") % 10).cast("string").alias("category"), other.alias("pixel_F1_oracle")))


@query("""SELECT vec_id AS image_id, list_transform(v, lambda x: round(x / greatest(sqrt(list_sum(list_transform(v, lambda y: y * y))), 1e-12::DOUBLE), 6) + 0.0::DOUBLE) AS v
 FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * (vec_id % 5)) AS v FROM embeddings)""")
def l2_normalize_scaled(spark, d):
    rows = adapters.read(spark, d, "embeddings").select(F.col("vec_id").alias("image_id"), F.transform("embedding", lambda x: x.cast("double") * (F.col("vec_id") % 5)).alias("v"))
    # Adding zero makes a negative zero a plain one, after rounding as in the SQL.
    return rounded(features.normalised(rows)).withColumn("v", F.transform("v", lambda x: x + 0.0))


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)")
def missing_cases_of_parts(spark, d):
    sold = adapters.read(spark, d, "lineitem").filter("l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey"))
    return reports.missing_cases(sold, adapters.read(spark, d, "part"), "p_partkey")
