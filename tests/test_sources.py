"""Images, artifacts, fingerprints, streaming, and the small end-to-end tree."""

import hashlib
import json
import struct
import time
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from heddle.functions import fingerprints
from heddle.operators import calibration, features, maps, memory, nearest, reports, sampling
from heddle.operators.features import FEATURES
from heddle.sources import artifacts, images
from heddle.streaming.scoring import decide_arrivals, score_arrivals


def png(path, pixels):
    height, width = pixels.shape[:2]
    kind = 2 if pixels.ndim == 3 else 0
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    raw = b"".join(b"\0" + row.astype(np.uint8).tobytes() for row in pixels)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


@pytest.fixture
def tree(tmp_path):
    """Bolts on a dark plate, with a bright stain in the lower right of every faulty one."""
    root = tmp_path / "plates"
    plate = lambda shade: np.full((24, 18, 3), shade)
    for i in range(10):
        png(root / f"bolt/train/good/{i:03}.png", plate(60 + i % 3))
    for i in range(2):
        png(root / f"bolt/test/good/{i:03}.png", plate(61))
        stained, mask = plate(61), np.zeros((24, 18))
        stained[12:, 10:], mask[12:, 10:] = 210, 255
        png(root / f"bolt/test/stain/{i:03}.png", stained)
        png(root / f"bolt/ground_truth/stain/{i:03}_mask.png", mask)
    return root


def brightness_profile(frame):
    """An extractor: of each quarter of an image the share of pixels in four bands of brightness, and for layer 6 their squares."""
    out = []
    for row in frame.itertuples():
        side = int((len(row.tensor) / 3) ** 0.5)
        light = np.asarray(row.tensor).reshape(3, side, side).max(axis=0)
        edges = np.quantile(np.linspace(-3, 3, 50), [0.25, 0.5, 0.75])
        for patch, (top, left) in enumerate(((0, 0), (0, 1), (1, 0), (1, 1))):
            part = light[top * side // 2 : (top + 1) * side // 2, left * side // 2 : (left + 1) * side // 2]
            share = np.bincount(np.digitize(part.ravel(), edges), minlength=4) / part.size + 0.01 * part.mean()
            out += [(row.category, row.image_id, layer, patch, v / np.linalg.norm(v)) for layer, v in ((3, share + 0.1), (6, share**2 + 0.1))]
    return pd.DataFrame(out, columns=["category", "image_id", "layer", "patch_id", "v"])


def test_records(spark, tree):
    got = images.image_records(spark, str(tree)).collect()
    assert len(got) == 14 and sum(r.is_train for r in got) == 10 and sum(r.label for r in got) == 2
    assert all(r.mask_path.endswith("_mask.png") for r in got if r.label)
    (tree / "bolt/ground_truth/stain/001_mask.png").unlink()
    with pytest.raises(FileNotFoundError):
        images.image_records(spark, str(tree))


def test_image_and_mask_share_geometry(spark, tmp_path):
    red = np.zeros((10, 20, 3))
    red[:, :, 0] = 255
    png(tmp_path / "i/red.png", red)
    png(tmp_path / "m/mask.png", np.full((10, 20), 255))
    tensor = images.tensors(images.decode_images(spark, str(tmp_path / "i")), 16).first().tensor
    want = (1 - images.CHANNEL_MEAN[0]) / images.CHANNEL_STD[0]
    assert len(tensor) == 3 * 256 and np.allclose(tensor[:256], want)
    assert sum(images.masks(images.decode_images(spark, str(tmp_path / "m")), 16).first().mask) == 256
    padded = images.masks(images.decode_images(spark, str(tmp_path / "m")), 16, "pad_resize").first().mask
    assert sum(padded) == 16 * 8


def test_cubic_weights_keep_constants():
    for source, target in ((20, 16), (16, 50), (7, 7)):
        assert np.allclose(images.bicubic_weights(source, target).sum(axis=1), 1)


def test_small_tree_end_to_end(spark, tree):
    records = images.image_records(spark, str(tree)).cache()
    decoded = images.decode_images(spark, str(tree)).join(records.select("path", "category", "image_id"), "path")
    made = images.tensors(decoded.select("path", "height", "width", "channels", "bgr"), 16).join(records.select("path", "category", "image_id"), "path")
    patches = features.extract(made.select("category", "image_id", "tensor"), brightness_profile).cache()
    normal = records.filter("is_train")
    splits = sampling.split_calibration(sampling.split_normal(normal, 0.2), 0.5).cache()
    assert {r.role: r["count"] for r in splits.groupBy("role").count().collect()} == {"memory": 8, "threshold_fit": 1, "normal_validation": 1}
    bank = memory.memory_bank(patches, splits, 4, 0.5).cache()
    assert {r.layer: r["count"] for r in bank.groupBy("layer").count().collect()} == {3: 16, 6: 16}
    placed = features.with_coordinates(patches, 4)
    tests = records.filter("NOT is_train").select("image_id", "label")
    scores = nearest.nearest(placed.join(tests.select("image_id"), "image_id"), bank, 0.05)
    fit = nearest.nearest(placed.join(splits.filter("role != 'memory'").select("image_id"), "image_id"), bank, 0.05)
    fused = calibration.fused(calibration.calibrated(scores, calibration.median_mad(fit)))
    scored = maps.image_scores(maps.upsampled(maps.patch_grids(fused), 16), "topk_mean", 0.1).join(tests, "image_id").collect()
    assert len(scored) == 4
    assert min(r.image_score for r in scored if r.label) > max(r.image_score for r in scored if not r.label)


def test_streaming_scores_each_file_once(spark, tmp_path):
    rows = [("a", i, 3, p, [1.0, 0.0] if (i + p) % 2 else [0.0, 1.0]) for i in range(4) for p in range(4)]
    table = spark.createDataFrame(rows, features.FEATURES)
    table.repartition(2).write.parquet(str(tmp_path / "in"))
    placed = features.with_coordinates(table, 4)
    bank = placed.filter("image_id = 0").withColumn("bank_id", F.col("patch_id").cast("long"))
    limits = spark.createDataFrame([("a", 3, 0.0, 1.0)], "category string, layer int, median double, mad double")
    args = dict(bank=bank, weights=0.1, calibration=limits, out=str(tmp_path / "out"), checkpoint=str(tmp_path / "check"), patch_count=4, files_per_batch=1)
    for _ in range(2):  # a second run finds nothing new
        score_arrivals(spark, str(tmp_path / "in"), **args).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("image_id", "patch_id").collect()
    want = nearest.nearest(placed, bank, 0.1).orderBy("image_id", "patch_id").collect()
    assert [(r.image_id, r.patch_id, round(r.score, 9)) for r in got] == [(r.image_id, r.patch_id, round(r.score, 9)) for r in want]


#: The parts and field names of a configuration are fixed by its format.
CONFIG = {
    "experiment": {"seed": 42}, "data": {"dataset": "toy", "image_size": 16, "resize_mode": "resize", "calibration_fraction": 0.2, "categories": ["é"]},
    "model": {"checkpoint": "none", "active_layers": [3, 6], "token_norm": "none"}, "memory": {"sampling": "random", "ratio": 0.5, "projection_dim": 0, "max_candidates": 10},
    "retrieval": {"spatial_mode": "adaptive", "fixed_lambda": 0.05, "query_chunk_size": 1, "bank_chunk_size": 1, "lambda_max": 0.1, "tau_quantile": 0.8},
    "calibration": {"mad_epsilon": 1e-6, "threshold_fit_fraction": 0.5, "pixel_quantile": 0.995, "pixel_image_quantile": 0.95, "pixel_topk_fraction": 0.01, "image_quantile": 0.99, "clamp_min_zero": True, "pixel_threshold_method": "global_quantile"},
    "inference": {"gaussian_sigma": 0.0, "image_score": "topk_mean", "image_topk_fraction": 0.01}, "evaluation": {"compute_oracle_f1": True},
}


def test_fingerprints(spark):
    other = json.loads(json.dumps(CONFIG))
    other["calibration"]["pixel_threshold_method"] = "image_max_quantile"
    moved = CONFIG | {"_config_path": "/elsewhere"}
    table = spark.createDataFrame([(i, json.dumps(c)) for i, c in enumerate((CONFIG, other, moved))], "i int, c string")
    made = table.select("i", fingerprints.config_fingerprint(F.col("c")).alias("all"), fingerprints.protocol_fingerprint(F.col("c")).alias("base"), fingerprints.protocol_fingerprint(F.col("c"), True).alias("full"), fingerprints.threshold_parameters(F.col("c")).alias("t"))
    a, b, c = made.orderBy("i").collect()
    assert a["all"] == hashlib.sha256(fingerprints.canonical(CONFIG).encode()).hexdigest() == c["all"]
    assert a["base"] == b["base"] and a["full"] != b["full"]
    assert json.loads(b["t"])["pixel_threshold_method"] == "image_max_quantile"


def test_artifacts(spark, tmp_path):
    rows = spark.createDataFrame([("b", 1.0, 2), ("a", float("nan"), 3)], "category string, image_AUROC double, test_images int")
    artifacts.write_summary(rows, str(tmp_path / "summary"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "summary/markdown")).collect()]
    assert lines[0] == "| category | image_AUROC | test_images |" and lines[1] == "|---|---:|---:|"
    assert "| b | 1.000000 | 2.000000 |" in lines and lines[-1].startswith("| mean | 1.000000")
    document = spark.read.json(str(tmp_path / "summary/json")).first()
    assert len(document.categories) == 2
    bank = spark.createDataFrame([("a", 3, 0, 1, 0, 0.0, 0.0, [1.0])], "category string, layer int, bank_id long, source_id long, patch_id int, x double, y double, v array<double>")
    artifacts.write_bank(bank, str(tmp_path / "bank"))
    assert artifacts.read_bank(spark, str(tmp_path / "bank")).select(*bank.columns).collect() == bank.collect()
    bank.withColumn("v", F.array(F.lit(1.0), F.lit(2.0))).write.mode("append").partitionBy("category", "layer").parquet(str(tmp_path / "bank/bank"))
    with pytest.raises(ValueError):  # another width than the metadata's
        artifacts.read_bank(spark, str(tmp_path / "bank"))
    marker = artifacts.completion_marker(rows, rows.filter("category = 'a'"), 42, 1042, "global_quantile", [3, 6], "adaptive", "x").first()
    assert (marker.status, marker.expected_count, marker.completed_count) == ("incomplete", 2, 1)
    artifacts.write_bundle({"rows": rows.select("category")}, spark.createDataFrame([("dev",)], "stage string"), str(tmp_path / "bundle"))
    assert spark.read.json(str(tmp_path / "bundle")).first().stage == "dev"


def test_a_run_that_fails_leaves_no_marker(spark, tmp_path):
    names = spark.createDataFrame([("a",), ("b",)], "category string")
    marker = lambda: artifacts.completion_marker(names, names, 42, 1042, "global_quantile", [3, 6], "adaptive", "x")
    desired = spark.createDataFrame([(case, ["a", "b"], "x") for case in ("one", "two")], "case_dir string, categories array<string>, config_fingerprint string")
    to_run = lambda: {r.case_dir: r.found for r in reports.cases_to_run(desired, artifacts.published_markers(spark, str(tmp_path)), ["case_dir"]).collect()}
    publish = lambda case, **tables: artifacts.publish_run(spark, str(tmp_path / case), tables, marker)
    values = lambda case: sorted(r.category for r in artifacts.read_run(spark, str(tmp_path / case), "metrics").collect())
    assert to_run() == {"one": False, "two": False}
    for case in ("one", "two"):
        publish(case, metrics=lambda: names)
    assert to_run() == {} and values("two") == ["a", "b"]

    def no_table():
        raise RuntimeError("no table")

    for broken in (no_table, lambda: names.select(F.raise_error("no task"))):
        with pytest.raises(Exception, match="no ta"):
            publish("two", metrics=lambda: names.filter("category = 'a'"), scores=broken)
        assert to_run() == {"two": False} and values("one") == ["a", "b"]
        with pytest.raises(FileNotFoundError):
            values("two")
    publish("two", metrics=lambda: names.filter("category = 'b'"))
    assert to_run() == {} and values("two") == ["b"]
    assert len([f for f in (tmp_path / "two").iterdir() if f.name.startswith("attempt-")]) == 1


def test_reports_without_metrics_are_errors(spark, tmp_path):
    for name in ("x", "y"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "resolved_config.json").write_text(json.dumps(CONFIG))
    (tmp_path / "x/metrics_summary.json").write_text("{}")
    with pytest.raises(FileNotFoundError):
        artifacts.read_reports(spark, str(tmp_path))
    (tmp_path / "y/metrics_summary.json").write_text("{}")
    assert artifacts.read_reports(spark, str(tmp_path)).count() == 2


def test_file_digest(spark, tmp_path):
    (tmp_path / "f").write_bytes(b"abc")
    assert images.file_digests(spark, str(tmp_path / "f")).first().sha256 == hashlib.sha256(b"abc").hexdigest()


def test_images_are_decided_once_whatever_the_files(spark, tmp_path):
    """Images split over files, a failure in the middle, a restart, late copies and an image that never is complete."""
    arrivals, out, progress = (str(tmp_path / n) for n in ("arrivals", "out", "progress"))
    patches = [("a", image, layer, p, [float(image), float(layer + p)]) for image in range(6) for layer in (3, 6) for p in range(4)]

    def send(rows):
        spark.createDataFrame(rows, FEATURES).coalesce(1).write.mode("append").parquet(arrivals)

    def decide(found):
        if fails:
            raise RuntimeError("lost")
        return found.groupBy("category", "image_id").agg(F.sum(F.aggregate("v", F.lit(0.0), lambda t, x: t + x)).alias("image_score"), F.count(F.lit(1)).alias("patches"))

    def run(**options):
        decide_arrivals(spark, arrivals, [3, 6], 4, decide, out, progress, files_per_batch=1, **options).awaitTermination()

    fails = False
    send([r for r in patches if r[2] == 3 and r[1] < 5])
    run()
    assert spark.read.parquet(out).count() == 0
    fails = True
    send([r for r in patches if r[2] == 6 and r[1] < 3] + patches[:5])  # some come again
    with pytest.raises(Exception, match="lost"):
        run()
    fails = False
    run()
    send([r for r in patches if r[2] == 6 and r[1] in (3, 4)] + [patches[0], patches[-1]])
    run()
    got = {r.image_id: (r.image_score, r.patches, r.complete) for r in spark.read.parquet(out).collect()}
    want = {i: (float(sum(sum(r[4]) for r in patches if r[1] == i)), 8, True) for i in range(5)}
    assert got == want and spark.read.parquet(out).count() == 5
    time.sleep(1.5)
    send([("b", 1, 3, 0, [0.0, 0.0])])
    run(timeout_ms=1)
    time.sleep(1)
    send([("b", 2, 3, 0, [0.0, 0.0])])
    run(timeout_ms=1)
    late = {(r.category, r.image_id) for r in spark.read.parquet(out).filter("NOT complete").collect()}
    assert ("b", 1) in late and spark.read.parquet(out).filter("complete").count() == 5
