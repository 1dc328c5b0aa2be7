"""DuckDB forms of the registered queries: a chain of named tables, and one SELECT per query.

Doubles are rounded to six digits on both sides.
"""

from __future__ import annotations

#: Tables of the standard flow, in order of need. All arithmetic is in DOUBLE.
FLOW = r"""
layers(layer, off) AS (VALUES (3, 0), (6, 32)),
places(patch_id) AS (VALUES (0), (1), (2), (3)),
raw AS (
  SELECT CAST(label AS VARCHAR) AS category, vec_id AS image_id, layer, patch_id,
         list_transform(list_slice(embedding, off + 8 * patch_id + 1, off + 8 * patch_id + 8), lambda x: CAST(x AS DOUBLE)) AS v
  FROM embeddings, layers, places),
features AS (
  SELECT category, image_id, layer, patch_id, list_transform(v, lambda x: x / n) AS v
  FROM (SELECT *, greatest(sqrt(list_sum(list_transform(v, lambda y: y * y))), 1e-12) AS n FROM raw)),
images AS (SELECT CAST(label AS VARCHAR) AS category, vec_id AS image_id, vec_id % 4 < 3 AS is_train FROM embeddings),
normal_ranked AS (
  SELECT *, row_number() OVER (PARTITION BY category ORDER BY md5('42:' || image_id), image_id) AS nth, count(*) OVER (PARTITION BY category) AS n
  FROM images WHERE is_train),
normal_splits AS (
  SELECT category, image_id, CASE WHEN nth <= least(greatest(2, CAST(round_even(n * 0.2::DOUBLE, 0) AS BIGINT)), n - 1) THEN 'calibration' ELSE 'memory' END AS role FROM normal_ranked),
fit_ranked AS (
  SELECT *, row_number() OVER (PARTITION BY category ORDER BY md5('1042:' || image_id), image_id) AS nth, count(*) OVER (PARTITION BY category) AS n
  FROM normal_splits WHERE role = 'calibration'),
splits AS (
  SELECT category, image_id, role FROM normal_splits WHERE role = 'memory'
  UNION ALL SELECT category, image_id, CASE WHEN nth <= least(greatest(1, CAST(round_even(n * 0.5::DOUBLE, 0) AS BIGINT)), n - 1) THEN 'threshold_fit' ELSE 'normal_validation' END FROM fit_ranked),
memory_ranked AS (
  SELECT f.*, row_number() OVER (PARTITION BY category, layer ORDER BY md5((42 + layer) || ':' || image_id || ':' || patch_id), image_id, patch_id) AS nth, count(*) OVER (PARTITION BY category, layer) AS n
  FROM features f JOIN splits USING (category, image_id) WHERE role = 'memory'),
memory_sample AS (SELECT category, layer, image_id, patch_id, v FROM memory_ranked WHERE nth <= greatest(1, CAST(round_even(n * 0.5::DOUBLE, 0) AS BIGINT))),
bank AS (
  SELECT category, layer, row_number() OVER (PARTITION BY category, layer ORDER BY image_id, patch_id) - 1 AS bank_id, image_id AS source_id, patch_id,
         CAST(patch_id % 2 AS DOUBLE) AS x, CAST(patch_id // 2 AS DOUBLE) AS y, v FROM memory_sample),
calibration_features AS (
  SELECT f.*, CAST(patch_id % 2 AS DOUBLE) AS x, CAST(patch_id // 2 AS DOUBLE) AS y FROM features f JOIN splits s USING (category, image_id) WHERE s.role <> 'memory'),
test_images AS (
  SELECT category, image_id, 0 AS label FROM images WHERE NOT is_train
  UNION ALL SELECT CAST((CAST(category AS INT) + 9) % 10 AS VARCHAR), image_id, 1 FROM images WHERE NOT is_train),
test_features AS (
  SELECT t.category, f.image_id, f.layer, f.patch_id, f.v, CAST(patch_id % 2 AS DOUBLE) AS x, CAST(patch_id // 2 AS DOUBLE) AS y FROM features f JOIN test_images t USING (image_id)),
place_sums AS (
  SELECT category, layer, patch_id, d, sum(v[d]) AS s, sum(v[d] * v[d]) AS q, count(*) AS n FROM calibration_features, range(1, 9) r(d) GROUP BY ALL),
place_distance AS (
  SELECT category, layer, patch_id, CASE WHEN max(n) > 1 THEN 1 - (sum(s * s) - sum(q)) / (CAST(max(n) AS DOUBLE) * (max(n) - 1)) ELSE 0.0::DOUBLE END AS distance FROM place_sums GROUP BY ALL),
image_sums AS (
  SELECT category, layer, image_id, d, sum(v[d]) AS s, sum(v[d] * v[d]) AS q, count(*) AS n FROM calibration_features, range(1, 9) r(d) GROUP BY ALL),
image_distance AS (
  SELECT category, layer, image_id, CASE WHEN max(n) > 1 THEN 1 - (sum(s * s) - sum(q)) / (CAST(max(n) AS DOUBLE) * (max(n) - 1)) ELSE 0.0::DOUBLE END AS distance FROM image_sums GROUP BY ALL),
same_place AS (SELECT category, layer, quantile_disc(distance, 0.5) AS same_position_distance FROM place_distance GROUP BY ALL),
cross_place AS (SELECT category, layer, quantile_disc(distance, 0.5) AS cross_position_distance FROM image_distance GROUP BY ALL),
reliability AS (SELECT *, cross_position_distance / (same_position_distance + 1e-8::DOUBLE) AS reliability FROM same_place JOIN cross_place USING (category, layer)),
tau AS (SELECT layer, quantile_cont(reliability, 0.8) AS tau FROM reliability GROUP BY layer),
weights AS (SELECT category, layer, CASE WHEN reliability + tau > 0 THEN 0.1::DOUBLE * reliability / (reliability + tau) ELSE 0.0::DOUBLE END AS spatial_weight FROM reliability JOIN tau USING (layer)),
calibration_pairs AS (
  SELECT q.category, q.image_id, q.layer, q.patch_id, b.bank_id, 1 - list_inner_product(q.v, b.v) AS cosine, sqrt((q.x - b.x) * (q.x - b.x) + (q.y - b.y) * (q.y - b.y)) AS apart
  FROM calibration_features q JOIN bank b USING (category, layer)),
calibration_scores AS (SELECT category, image_id, layer, patch_id, min(cosine + spatial_weight * apart) AS score FROM calibration_pairs JOIN weights USING (category, layer) GROUP BY ALL),
test_scores AS (
  SELECT q.category, q.image_id, q.layer, q.patch_id, min(1 - list_inner_product(q.v, b.v) + w.spatial_weight * sqrt((q.x - b.x) * (q.x - b.x) + (q.y - b.y) * (q.y - b.y))) AS score
  FROM test_features q JOIN bank b USING (category, layer) JOIN weights w USING (category, layer) GROUP BY ALL),
medians AS (SELECT category, layer, quantile_disc(score, 0.5) AS median FROM calibration_scores GROUP BY ALL),
layer_calibration AS (
  SELECT category, layer, any_value(median) AS median, greatest(quantile_disc(abs(score - median), 0.5), 1e-6) AS mad FROM calibration_scores JOIN medians USING (category, layer) GROUP BY ALL),
axis AS (
  SELECT i, s, CASE WHEN s = lo AND s = hi THEN 1.0::DOUBLE WHEN s = lo THEN 1 - w WHEN s = hi THEN w END AS a
  FROM (SELECT i, src - floor(src) AS w, CAST(floor(src) AS BIGINT) AS lo, least(CAST(floor(src) AS BIGINT) + 1, 1) AS hi
        FROM (SELECT i, greatest(0.0::DOUBLE, (i + 0.5::DOUBLE) * 2 / 8 - 0.5::DOUBLE) AS src FROM range(8) r(i))), range(2) g(s)
  WHERE s = lo OR s = hi),
calibration_fused AS (
  SELECT category, image_id, patch_id, avg((score - median) / mad) AS score FROM calibration_scores JOIN layer_calibration USING (category, layer) GROUP BY ALL),
calibration_pixels AS (
  SELECT category, image_id, ax.i AS px, ay.i AS py, sum(score * ax.a * ay.a) AS score FROM calibration_fused JOIN axis ax ON ax.s = patch_id % 2 JOIN axis ay ON ay.s = patch_id // 2 GROUP BY ALL),
fused AS (SELECT category, image_id, patch_id, avg((score - median) / mad) AS score FROM test_scores JOIN layer_calibration USING (category, layer) GROUP BY ALL),
pixels AS (
  SELECT category, image_id, ax.i AS px, ay.i AS py, sum(score * ax.a * ay.a) AS score FROM fused JOIN axis ax ON ax.s = patch_id % 2 JOIN axis ay ON ay.s = patch_id // 2 GROUP BY ALL),
image_scores AS (
  SELECT category, image_id, avg(score) AS image_score
  FROM (SELECT *, row_number() OVER (PARTITION BY category, image_id ORDER BY score DESC) AS nth FROM pixels) WHERE nth <= 6 GROUP BY ALL),
fit_image_scores AS (
  SELECT category, image_id, avg(score) AS image_score
  FROM (SELECT p.*, row_number() OVER (PARTITION BY category, image_id ORDER BY score DESC) AS nth FROM calibration_pixels p JOIN splits USING (category, image_id) WHERE role = 'threshold_fit') WHERE nth <= 6 GROUP BY ALL),
pixel_thresholds AS (SELECT category, quantile_cont(score, 0.995) AS pixel_threshold FROM calibration_pixels JOIN splits USING (category, image_id) WHERE role = 'threshold_fit' GROUP BY ALL),
image_thresholds AS (SELECT category, quantile_cont(image_score, 0.99) AS image_threshold FROM fit_image_scores GROUP BY ALL),
diagnostics AS (
  SELECT category, sum(hits) / sum(pixels) AS normal_pixel_positive_rate, avg(CAST(hits > 0 AS DOUBLE)) AS normal_image_positive_rate
  FROM (SELECT category, image_id, CAST(count(*) FILTER (WHERE score >= pixel_threshold) AS DOUBLE) AS hits, count(*) AS pixels
        FROM calibration_pixels JOIN splits USING (category, image_id) JOIN pixel_thresholds USING (category) WHERE role = 'normal_validation' GROUP BY ALL) GROUP BY ALL),
labelled_images AS (SELECT category, image_id, image_score, label FROM image_scores JOIN test_images USING (category, image_id)),
labelled_pixels AS (
  SELECT category, image_id, score, CASE WHEN label = 1 AND px // 4 = (image_id // 4) % 4 % 2 AND py // 4 = ((image_id // 4) % 4) // 2 THEN 1 ELSE 0 END AS label
  FROM pixels JOIN test_images USING (category, image_id))
"""

CASES = r"""
cases AS (
  SELECT CASE l_returnflag WHEN 'A' THEN 'global_quantile' WHEN 'N' THEN 'image_max_quantile' ELSE 'image_topk_quantile' END AS method, CAST(42 + l_partkey % 3 AS INT) AS threshold_split_seed,
         CAST(l_suppkey % 10 AS VARCHAR) AS category, 10 * avg(l_discount) AS pixel_F1_calibrated, 10 * avg(l_tax) AS pixel_IoU_calibrated, 0.5::DOUBLE + 0.01::DOUBLE * (l_suppkey % 10) AS pixel_F1_oracle,
         avg(l_quantity) / 1000 AS normal_pixel_positive_rate, avg(l_quantity) / 100 AS normal_image_positive_rate, count(*) AS normal_validation_images
  FROM lineitem GROUP BY l_returnflag, l_partkey % 3, l_suppkey % 10),
enriched AS (SELECT *, pixel_F1_oracle - pixel_F1_calibrated AS oracle_gap FROM cases),
layer_cases AS (
  SELECT (['block3', 'block6', 'block9', 'block12', 'fusion_3_6_9_12'])[l_partkey % 5 + 1] AS "case", CAST(l_partkey % 5 AS INT) AS case_order, CAST(l_suppkey % 10 AS VARCHAR) AS category,
         10 * avg(l_discount) AS image_AUROC, 10 * avg(l_tax) AS image_F1_calibrated, avg(l_quantity) / 50 AS image_F1_oracle, 0.5::DOUBLE + 5 * avg(l_discount) AS pixel_AUROC, 5 * avg(l_tax) AS pixel_F1_calibrated, avg(l_quantity) / 40 AS pixel_F1_oracle
  FROM lineitem GROUP BY l_partkey % 5, l_suppkey % 10),
best_single AS (
  SELECT category, "case" AS best_single_layer, pixel_AUROC AS best_single_pixel_AUROC
  FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY pixel_AUROC DESC, case_order) AS nth FROM layer_cases WHERE "case" <> 'fusion_3_6_9_12') WHERE nth = 1)
"""

LINES = r"""
lines AS (SELECT l_linestatus AS category, l_extendedprice AS score, CAST(l_returnflag = 'R' AS INT) AS label FROM lineitem),
scored_events AS (SELECT CAST(user_id % 10 AS VARCHAR) AS category, round(value, 0) AS score, CAST(event_type = 'error' AS INT) AS label FROM events),
supplier_pixels AS (SELECT CAST(l_suppkey % 10 AS VARCHAR) AS category, l_suppkey AS image_id, l_extendedprice AS score FROM lineitem)
"""

METRICS = ("pixel_F1_calibrated", "pixel_IoU_calibrated", "pixel_F1_oracle", "normal_pixel_positive_rate", "normal_image_positive_rate", "oracle_gap")


def flow(select: str) -> str:
    return f"WITH {FLOW.strip()}\n{select}"


def cases(select: str) -> str:
    return f"WITH {CASES.strip()}\n{select}"


def lines(select: str) -> str:
    return f"WITH {LINES.strip()}\n{select}"


def r6(expression: str, name: str | None = None) -> str:
    return f"round({expression}, 6) AS {name or expression}"


def ranking(table: str, score: str = "score") -> str:
    """Tables hist, sums, totals and ranks: all ranking metrics of (category, score, label)."""
    return f"""hist AS (SELECT category, {score} AS score, CAST(sum(label) AS BIGINT) AS p, CAST(sum(1 - label) AS BIGINT) AS n FROM {table} GROUP BY ALL),
sums AS (SELECT *, CAST(sum(p) OVER w AS DOUBLE) AS tp, CAST(sum(n) OVER w AS DOUBLE) AS fp FROM hist WINDOW w AS (PARTITION BY category ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
totals AS (SELECT category, CAST(sum(p) AS DOUBLE) AS pos, CAST(sum(n) AS DOUBLE) AS neg FROM hist GROUP BY ALL),
ranks AS (
  SELECT category, CASE WHEN any_value(pos) > 0 AND any_value(neg) > 0 THEN sum(p * (neg - fp + n / 2.0::DOUBLE)) / (any_value(pos) * any_value(neg)) ELSE 'nan'::DOUBLE END AS auroc,
         CASE WHEN any_value(pos) > 0 AND any_value(neg) > 0 THEN sum(p * tp / (tp + fp)) / any_value(pos) ELSE 'nan'::DOUBLE END AS average_precision
  FROM sums JOIN totals USING (category) GROUP BY category),
best AS (
  SELECT category, f1 AS f1_oracle, score AS threshold_oracle
  FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY f1 DESC, score) AS nth FROM (SELECT category, score, CASE WHEN pos > 0 THEN 2 * tp / (tp + fp + pos) ELSE 0.0::DOUBLE END AS f1 FROM sums JOIN totals USING (category))) WHERE nth = 1)"""


def fixed(table: str, score: str, thresholds: str, threshold: str, name: str = "fixed") -> str:
    """A table of F1 and IoU at a category's threshold."""
    return f"""{name} AS (
  SELECT category, CASE WHEN tp + fp + fn > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) ELSE 0.0::DOUBLE END AS f1_calibrated, CASE WHEN tp + fp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fp + fn) ELSE 1.0::DOUBLE END AS iou_calibrated
  FROM (SELECT category, count(*) FILTER (WHERE {score} >= {threshold} AND label = 1) AS tp, count(*) FILTER (WHERE {score} >= {threshold} AND label = 0) AS fp, count(*) FILTER (WHERE {score} < {threshold} AND label = 1) AS fn
        FROM {table} JOIN {thresholds} USING (category) GROUP BY category))"""


def described(metrics: tuple[str, ...], parts: tuple[str, ...], suffix: str = "") -> str:
    made = {"mean": "avg({m})", "std": "stddev_pop({m})", "min": "min({m})", "max": "max({m})", "range": "max({m}) - min({m})"}
    return ", ".join(r6(made[p].format(m=m), f"{m}_{p}{suffix}") for m in metrics for p in parts)
