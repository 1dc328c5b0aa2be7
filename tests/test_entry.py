"""The driver contract, and a sample of queries against their DuckDB forms."""

import os
from functools import reduce

import duckdb
import numpy as np
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import __spark_entry__
from heddle.operators import memory
from heddle.plans import registry

SAMPLE = ["tokens_to_patches", "split_calibration", "memory_kcenter", "memory_kcenter_normal", "normal_projection", "memory_bank", "spatial_reliability", "nn_spatial", "auroc", "ranking_with_ties", "pixel_threshold_global", "quantile_bracketed", "f1_iou_at_threshold", "threshold_split_stability", "selection_manifest", "protocol_violations", "layer_protocol_faults", "stage_protocol_faults", "summary_stored", "bundle_stored", "runs_published"]


def text(value):
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(text, value)) + "]"
    return f"{value:.5f}" if isinstance(value, float) else str(value)


def test_names():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and "auroc_pipeline" in queries and len(registry.QUERIES) > 60


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, data, name):
    db = duckdb.connect()
    for file in os.listdir(data):
        db.sql(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{data}/{file}'")
    got, want = registry.QUERIES[name](spark, data), db.sql(registry.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    left = sorted("|".join(text(r[c]) for c in columns) for r in got.collect())
    right = sorted("|".join(text(dict(zip(want.columns, r, strict=True))[c]) for c in columns) for r in want.fetchall())
    assert left == right


def test_patches_of_all_categories_equal_sql(spark, data):
    test_query_equals_sql(spark, data, "tokens_to_patches_all_categories")
    got = registry.QUERIES["tokens_to_patches_all_categories"](spark, data)
    every = {r.category for r in registry.QUERIES["l2_normalize"](spark, data).select("category").distinct().collect()}
    assert {r.category for r in got.select("category").distinct().collect()} == every and len(every) > 2
    # The older query is a restriction by category of this one.
    some = registry.QUERIES["tokens_to_patches"](spark, data)
    assert got.filter("category IN ('1', '2')").exceptAll(some).count() == some.exceptAll(got).count() == 0 < some.count() < got.count()


def test_queries_read_their_tables_each_time(spark, data, tmp_path):
    """A table that is written anew under the same path gives new results within a session."""
    rows = spark.read.parquet(f"{data}/embeddings.parquet")
    for kept in (rows, rows.filter("label < 5")):
        kept.write.mode("overwrite").parquet(str(tmp_path / "embeddings.parquet"))
        spark.catalog.refreshByPath(str(tmp_path))
        assert registry.QUERIES["split_manifest"](spark, str(tmp_path)).count() == (10 if kept is rows else 5)


def test_scaled_vectors_equal_sql_to_the_letter(spark, data):
    db = duckdb.connect()
    db.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{data}/embeddings.parquet'")
    want = {i: str(v) for i, v in db.sql(registry.ORACLES["l2_normalize_scaled"]).fetchall()}
    got = {r.image_id: str(r.v) for r in registry.QUERIES["l2_normalize_scaled"](spark, data).collect()}
    assert got == want and not any("-0.0," in v or "-0.0]" in v for v in got.values())


def odd_embeddings(spark, data, folder):
    """Numbers that round to a negative zero, halves of the last digit, zeros of both signs, tiny norms, no numbers, parts of vectors."""
    rows = spark.read.parquet(f"{data}/embeddings.parquet").filter("vec_id < 10")
    plain = lambda x, i: x
    changed = [
        plain,
        lambda x, i: F.when(i % 8 == 1, -1e-8).when(i % 8 == 2, 1e-8).otherwise(x),
        lambda x, i: F.when(i % 8 == 0, 1.0).when(i % 8 == 1, 5e-7).when(i % 8 == 2, -5e-7).otherwise(0.0),
        lambda x, i: F.when(i % 3 == 0, x).otherwise(x * -0.0),
        lambda x, i: x * 1e-14,
        lambda x, i: x * 1e30,
        lambda x, i: F.when(i % 8 == 3, float("nan")).when(i % 8 == 4, float("inf")).otherwise(x),
        lambda x, i: F.when(i % 5 != 0, x),
    ]
    vectors = [F.transform("embedding", change) for change in changed] + [F.lit(None), F.slice("embedding", 1, 60), F.slice("embedding", 1, 0)]
    parts = [rows.select((F.col("vec_id") + 100 * n).alias("vec_id"), v.cast("array<float>").alias("embedding"), "label") for n, v in enumerate(vectors)]
    reduce(DataFrame.unionByName, parts).write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


def letters(spark, folder, name):
    """The rows of a query and of its SQL, as text of all digits and signs."""
    db = duckdb.connect()
    db.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet/*.parquet'")
    want = db.sql(registry.ORACLES[name])
    return sorted(str([r[c] for c in want.columns]) for r in registry.QUERIES[name](spark, folder).collect()), sorted(str(list(r)) for r in want.fetchall())


@pytest.mark.parametrize("name", ["l2_normalize", "tokens_to_patches_all_categories", "l2_normalize_scaled"])
def test_normalised_odd_vectors_equal_sql_to_the_letter(spark, data, tmp_path, name):
    got, want = letters(spark, odd_embeddings(spark, data, tmp_path), name)
    assert got == want and (any("-0.0," in row for row in got) == (name != "l2_normalize_scaled"))


@pytest.mark.parametrize("name", ["random_projection", "normal_projection"])
def test_projected_odd_vectors_equal_sql_to_the_letter(spark, data, tmp_path, name):
    got, want = letters(spark, odd_embeddings(spark, data, tmp_path), name)
    assert got == want and any("None, None, None, None" in row for row in got)


@pytest.mark.parametrize("name", ["random_projection", "normal_projection"])
def test_projection_that_rounds_to_a_negative_zero_equals_sql(spark, tmp_path, name):
    """Vectors of two numbers, the second a bit more or less than would make the first projected one zero."""
    entries = (memory.signs if name == "random_projection" else memory.normals)(8, 4, 42)
    ratio = float(-entries[0, 0] / entries[1, 0])
    more = float(2.5e-7 * np.linalg.norm(entries[0] + ratio * entries[1]) / entries[1, 0])
    patches = [[1.0, ratio + x, *[0.0] * 6] for x in (more, -more)]
    spark.createDataFrame([(n, patch * 8, 1) for n, patch in enumerate(patches)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got, want = letters(spark, str(tmp_path), name)
    assert got == want and any("[-0.0," in row for row in got) and any("[0.0," in row for row in got)


@pytest.mark.parametrize("name, entries", [("random_projection", "sign"), ("normal_projection", "normal")])
def test_projection_equals_sql_to_the_last_bit_before_rounding(data, name, entries):
    db = duckdb.connect()
    db.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{data}/embeddings.parquet'")
    flow, made = registry.ORACLES[name].split("\nSELECT", 1)
    p = registry.SIGNED if entries == "sign" else registry.NORMAL
    assert p in made and registry.UNIT in made
    found = db.sql(f"{flow}\nSELECT v, {registry.UNIT} AS unit FROM (SELECT v, {p} AS p FROM features)").fetchall()
    v, unit = (np.array(x) for x in zip(*found, strict=True))
    assert (memory.projected(v, 4, 42, entries) == unit).all()


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 10
