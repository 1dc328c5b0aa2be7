"""Reports and artifacts: reading experiment folders, writing banks, calibrations, summaries and markers."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.operators.features import with_coordinates

#: A published run's marker within its folder, and what its attempts are called.
PUBLISHED, ATTEMPT = "complete", "attempt-"


def read_reports(spark: SparkSession, root: str, name: str = "metrics_summary.json", config: str = "resolved_config.json") -> DataFrame:
    """(case_dir, config_json, report_json) of root/*/; a case with a configuration but no report is an error."""
    texts = lambda file: spark.read.text(f"{root}/*/{file}", wholetext=True).select(F.regexp_extract(F.input_file_name(), r"/([^/]+)/[^/]+$", 1).alias("case_dir"), "value")
    cases = texts(config).withColumnRenamed("value", "config_json")
    found = cases.join(texts(name).withColumnRenamed("value", "report_json"), "case_dir", "left")
    if lacking := found.filter("report_json IS NULL").select("case_dir").take(5):
        raise FileNotFoundError(f"no {name} in {[r.case_dir for r in lacking]}")
    return found


def write_bank(bank: DataFrame, path: str, images: DataFrame | None = None, sampling: str = "random", ratio: float = 0.1) -> None:
    """A bank by category and layer, and beside it what it was made by: sampling, ratio and, with `images`
    (image_id, path), the paths of its sources."""
    bank.write.mode("overwrite").partitionBy("category", "layer").parquet(f"{path}/bank")
    made = bank.groupBy("category", "layer").agg(F.count(F.lit(1)).alias("rows"), F.max(F.size("v")).alias("width")).withColumn("sampling", F.lit(sampling)).withColumn("ratio", F.lit(float(ratio)))
    made.write.mode("overwrite").parquet(f"{path}/metadata")
    if images is not None:
        bank.select("category", F.col("source_id").alias("image_id")).distinct().join(images.select("image_id", "path"), "image_id").write.mode("overwrite").parquet(f"{path}/sources")


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("category", F.col("category").cast("string")).withColumn("layer", F.col("layer").cast("int"))


def read_bank(spark: SparkSession, path: str) -> DataFrame:
    """A written bank; one without rows, or with other rows or widths than its metadata says, is an error."""
    rows = _keyed(spark.read.parquet(f"{path}/bank"))
    if rows.isEmpty():
        raise ValueError(f"no memory bank in {path}")
    found = rows.groupBy("category", "layer").agg(F.count(F.lit(1)).alias("found"), F.min(F.size("v")).alias("narrowest"), F.max(F.size("v")).alias("widest"))
    said = spark.read.parquet(f"{path}/metadata")
    odd = said.join(found, ["category", "layer"], "full").filter("NOT (rows <=> found AND width <=> narrowest AND width <=> widest)").select("category", "layer").take(5)
    if odd:
        raise ValueError(f"the memory bank in {path} differs from its metadata in {[tuple(r) for r in odd]}")
    return rows


def write_calibration_features(features: DataFrame, splits: DataFrame, patch_count: int, path: str) -> None:
    """The patches of calibration images with their places and role, whether fit or validation."""
    own = with_coordinates(features.join(splits.filter("role != 'memory'").select("category", "image_id", "role"), ["category", "image_id"]), patch_count)
    own.write.mode("overwrite").partitionBy("category", "layer").parquet(path)


def read_calibration_features(spark: SparkSession, path: str) -> DataFrame:
    return _keyed(spark.read.parquet(path))


def write_calibration(reliability: DataFrame, tau: DataFrame, weights: DataFrame, layer_calibration: DataFrame, path: str) -> None:
    """The record of a calibration, a row per category and layer: reliability, tau, spatial weight, median and MAD."""
    keys = ["category", "layer"]
    rows = reliability.select(*keys, "reliability").join(tau, "layer").join(weights, keys).join(layer_calibration.select(*keys, "median", "mad"), keys)
    rows.write.mode("overwrite").json(path)


def read_calibration(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("category string, layer int, reliability double, tau double, spatial_weight double, median double, mad double").json(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """A report table with a header; reports are short, so one file."""
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def cell(rows: DataFrame, name: str) -> Column:
    """Whole numbers plain, others with six decimals, text as it is."""
    kind = rows.schema[name].dataType.typeName()
    return F.format_string("%.6f", F.col(name)) if kind in ("double", "float") else F.col(name).cast("string")


def markdown(rows: DataFrame, order: list[str]) -> DataFrame:
    """(value): the lines of a Markdown table, head first, rows by `order`."""
    text = [f.name for f in rows.schema if f.dataType.typeName() == "string"]
    head = rows.sparkSession.createDataFrame([(0, "| " + " | ".join(rows.columns) + " |"), (1, "|" + "|".join("---" if c in text else "---:" for c in rows.columns) + "|")], "at int, value string")
    body = rows.select(F.lit(2).alias("at"), F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(cell(rows, c), F.lit("nan")) for c in rows.columns]), F.lit(" |")).alias("value"), *[F.col(c).alias(f"order_{i}") for i, c in enumerate(order)])
    empty = [F.lit(None).cast(rows.schema[c].dataType).alias(f"order_{i}") for i, c in enumerate(order)]
    return head.select("at", "value", *empty).unionByName(body).orderBy("at", *[f"order_{i}" for i in range(len(order))]).select("value")


def write_markdown(rows: DataFrame, path: str, order: list[str]) -> None:
    markdown(rows, order).coalesce(1).write.mode("overwrite").text(path)


def write_summary(rows: DataFrame, path: str) -> None:
    """Metric rows as CSV, as JSON with their means, and as Markdown with a mean row."""
    from heddle.operators.metrics import with_mean_row

    write_csv(rows.orderBy("category"), f"{path}/csv")
    both = with_mean_row(rows)
    write_markdown(both.withColumn("last", (F.col("category") == "mean").cast("int")).drop("last"), f"{path}/markdown", ["category"])
    packed = rows.agg(F.sort_array(F.collect_list(F.struct("category", *[c for c in rows.columns if c != "category"]))).alias("categories"))
    mean = both.filter("category = 'mean'").select(F.struct(*[c for c in both.columns if c != "category"]).alias("mean"))
    write_json(packed.crossJoin(mean), f"{path}/json")


def write_bundle(tables: dict[str, DataFrame], fields: DataFrame, path: str) -> None:
    """One document: the one row of `fields`, and each report table as a list."""
    out = fields
    for name, rows in tables.items():
        out = out.crossJoin(rows.agg(F.sort_array(F.collect_list(F.struct(*rows.columns))).alias(name)))
    write_json(out, path)


def completion_marker(expected: DataFrame, completed: DataFrame, seed: int, split_seed: int, method: str, layers: list[int], mode: str, fingerprint: str) -> DataFrame:
    """One row that says which categories were to be done and which are; it is written last."""
    names = lambda rows, to: rows.agg(F.sort_array(F.collect_set("category")).alias(to))
    both = names(expected, "expected_categories").crossJoin(names(completed, "completed_categories"))
    status = F.when(F.col("expected_categories") == F.col("completed_categories"), "complete").otherwise("incomplete")
    return both.select(
        status.alias("status"), "expected_categories", "completed_categories", F.size("expected_categories").alias("expected_count"), F.size("completed_categories").alias("completed_count"), F.lit(seed).alias("seed"),
        F.lit(split_seed).alias("threshold_split_seed"), F.lit(method).alias("pixel_threshold_method"), F.array(*map(F.lit, layers)).alias("active_layers"), F.lit(mode).alias("spatial_mode"), F.lit(fingerprint).alias("config_fingerprint"),
    )


def publish_run(spark: SparkSession, path: str, tables: dict[str, Callable[[], DataFrame]], marker: Callable[[], DataFrame]) -> None:
    """A run's tables and its one-row marker in the folder `path`, so that a run which fails half-way shows as not done.

    The marker of an earlier run goes first. Tables are made in turn and written to the folder of this attempt; the marker,
    which names the attempt, is written there too and moved to its place when all else is done. Earlier attempts go last.
    """
    at = lambda name: spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    files = at(PUBLISHED).getFileSystem(spark._jsc.hadoopConfiguration())
    files.delete(at(PUBLISHED), True)
    attempt = f"{ATTEMPT}{uuid.uuid4().hex}"
    for name, make in tables.items():
        make().write.parquet(f"{path}/{attempt}/{name}")
    marker().withColumn("attempt", F.lit(attempt)).coalesce(1).write.json(f"{path}/{attempt}/{PUBLISHED}")
    if not files.rename(at(f"{attempt}/{PUBLISHED}"), at(PUBLISHED)):
        raise OSError(f"the marker of {attempt} could not be moved to {path}/{PUBLISHED}")
    for found in files.listStatus(at("")):
        name = found.getPath().getName()
        if name.startswith(ATTEMPT) and name != attempt:
            files.delete(found.getPath(), True)


def published_markers(spark: SparkSession, root: str) -> DataFrame:
    """(case_dir, the marker's fields, attempt) of the runs root/*/ that are published; none where no marker is."""
    from heddle.operators.reports import MARKER

    schema, places = f"{MARKER}, attempt string", spark._jvm.org.apache.hadoop.fs.Path(f"{root}/*/{PUBLISHED}")
    found = places.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(places)
    if not found:
        return spark.createDataFrame([], f"case_dir string, {schema}")
    rows = spark.read.schema(schema).json(f"{root}/*/{PUBLISHED}")
    return rows.select(F.regexp_extract(F.input_file_name(), rf"/([^/]+)/{PUBLISHED}/[^/]+$", 1).alias("case_dir"), "*")


def read_run(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A table of the published run in the folder `path`; a run without a marker is an error."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{PUBLISHED}")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        raise FileNotFoundError(f"no published run in {path}")
    attempt = spark.read.schema("attempt string").json(f"{path}/{PUBLISHED}").first().attempt
    return spark.read.parquet(f"{path}/{attempt}/{table}")
