"""Memory banks of normal patches: random samples and greedy k-center coresets."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heddle.functions.statistics import rounded_count
from heddle.functions.storage import stored
from heddle.functions.vectors import LEAST_NORM
from heddle.operators.features import with_coordinates
from heddle.operators.sampling import cap_candidates, order_hash, sample_patches


#: Images whose patches a window numbers at once.
NUMBERED = 256
#: Rows whose components are summed at once, which then stay in the CPU's cache.
SUMMED = 1024


def sign_factors(width: int, dimensions: int, seed: int) -> tuple[np.ndarray]:
    """A seeded matrix of random signs; any SQL engine can make the same from MD5."""
    sign = lambda i, j: 1.0 if hashlib.md5(f"{seed}:{i}:{j}".encode()).hexdigest() < "8" else -1.0
    return (np.array([[sign(i, j) for j in range(dimensions)] for i in range(width)]),)


def signs(width: int, dimensions: int, seed: int) -> np.ndarray:
    """A seeded matrix of random signs over the root of `dimensions`."""
    return sign_factors(width, dimensions, seed)[0] / np.sqrt(dimensions)


def normal_factors(width: int, dimensions: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Two matrices whose products, entry by entry, are seeded normal numbers: each entry's MD5 gives two uniform numbers
    of 52 bits, and these a normal one (Box and Muller), so that any SQL engine can make the same."""

    def factors(i: int, j: int) -> tuple[float, float]:
        digest = hashlib.md5(f"{seed}:{i}:{j}".encode()).hexdigest()
        first, second = (int(digest[:13], 16) + 1) / 2**52, int(digest[13:26], 16) / 2**52
        return math.sqrt(-2 * math.log(first)), math.cos(2 * math.pi * second)

    radius, cosine = np.array([[factors(i, j) for j in range(dimensions)] for i in range(width)]).transpose(2, 0, 1)
    return radius, cosine


def normals(width: int, dimensions: int, seed: int) -> np.ndarray:
    """A seeded matrix of normal numbers over the root of `dimensions`."""
    radius, cosine = normal_factors(width, dimensions, seed)
    return radius * cosine / np.sqrt(dimensions)


def projected(v: np.ndarray, dimensions: int, seed: int, entries: str = "normal") -> np.ndarray:
    """The rows of `v` projected to `dimensions`, if that is fewer, by a matrix of `normal` or `sign` entries, and normalised.

    Sums run in the order of the components, and a component is multiplied by one factor of its entry after the other, so
    that a row gives the same bits in any batch, and in SQL.
    """
    if 0 < dimensions < v.shape[1]:
        factors = {"normal": normal_factors, "sign": sign_factors}[entries](v.shape[1], dimensions, seed)
        sums = np.zeros((len(v), dimensions))
        for at in range(0, len(v), SUMMED):
            for x, *row in zip(v[at : at + SUMMED].T, *factors, strict=True):
                sums[at : at + SUMMED] += reduce(np.multiply, row, x[:, None])
        v = sums / np.sqrt(dimensions)
    squares = np.zeros(len(v))
    for x in v.T:
        squares += x * x
    return v / np.maximum(np.sqrt(squares), LEAST_NORM)[:, None]


def random_projection(features: DataFrame, dimensions: int, seed: int = 42, entries: str = "normal", width: int = 0) -> DataFrame:
    """`features` with `v` projected by a seeded matrix of `normal` or `sign` entries, if that is narrower, and normalised.

    A null component adds nothing to a sum. A vector that is null or cut short counts as `width` wide; one that is projected
    without having a number gives nulls.
    """

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            if not len(batch):
                continue
            at = batch.schema.get_field_index("v")
            old = batch.column(at)
            size, given = pc.fill_null(pc.list_value_length(old), 0).to_numpy(), old.flatten()
            v = np.zeros((len(batch), max(int(size.max()), width)))
            inside = np.arange(v.shape[1]) < size[:, None]
            known = np.zeros(v.shape, bool)
            v[inside], known[inside] = pc.fill_null(given, 0.0).to_numpy(), given.is_valid().to_numpy(zero_copy_only=False)
            narrowed = np.maximum(size, width) > dimensions if dimensions > 0 else np.zeros(len(batch), bool)
            if narrowed.any():
                inside[narrowed], known[narrowed] = np.arange(v.shape[1]) < dimensions, known[narrowed].any(axis=1, keepdims=True)
                v[narrowed, :dimensions] = projected(v[narrowed], dimensions, seed, entries)
            v[~narrowed] = projected(v[~narrowed], 0, seed)
            ends = pa.array(np.concatenate([[0], inside.sum(axis=1).cumsum()]), pa.int32())
            new = pa.ListArray.from_arrays(ends, pa.array(v[inside], mask=~known[inside]), mask=pa.array(pc.is_null(old).to_numpy(zero_copy_only=False) & ~narrowed))
            yield batch.set_column(at, "v", new)

    return features.mapInArrow(batches, features.schema)


def greedy_centers(v: np.ndarray, first: int, k: int) -> list[int]:
    """Rows in order of choice: after `first`, always the one farthest from all chosen; the lowest of equals."""
    out, distance = [first], 1 - v @ v[first]
    while len(out) < min(k, len(v)):
        nxt = int(np.argmax(distance))
        out.append(nxt)
        distance = np.minimum(distance, 1 - v @ v[nxt])
    return out


def k_center(features: DataFrame, ratio: float = 0.1, most: int = 50_000, seed: int = 42, parts: int = 1, projection: int = 0, entries: str = "normal") -> DataFrame:
    """(category, layer, nth, image_id, patch_id) of a greedy k-center coreset of each category and layer.

    A group has at most `most` candidates, a seeded sample, while k is a part of the full group. With
    `parts` over 1, coresets of seeded parts are merged by a last greedy pass over their union: an
    approximation for groups that one task should not hold. Distances are taken between vectors projected
    to `projection` dimensions by a matrix of `entries`, if that is fewer and not 0; the coreset's vectors
    keep their width.
    """
    if not 0 < ratio <= 1:
        raise ValueError("the ratio lies above 0 and is at most 1")
    rows = cap_candidates(features, most, seed)
    k = F.least(F.greatest(F.lit(1), rounded_count(F.col("k_of"), ratio)), F.lit(most))
    rows = rows.select("category", "layer", "image_id", "patch_id", "v", k.alias("k"), order_hash(F.lit(seed) + F.col("layer"), "image_id", "patch_id").alias("hash"))
    schema = "category string, layer int, image_id long, patch_id int, v array<double>, k long, hash string, nth int"

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["image_id", "patch_id"], ignore_index=True)
        v = np.stack(group["v"].to_numpy())
        at = greedy_centers(projected(v, projection, seed, entries) if projection else v, int(group["hash"].argmin()), int(group["k"].iloc[0]))
        return group.iloc[at][["category", "layer", "image_id", "patch_id", "v", "k", "hash"]].assign(nth=np.arange(len(at), dtype=np.int32))

    if parts > 1:
        rows = rows.withColumn("part", F.crc32(F.col("hash").cast("binary")) % parts)
        rows = rows.groupBy("category", "layer", "part").applyInPandas(choose, schema).drop("nth")
    chosen = rows.groupBy("category", "layer").applyInPandas(choose, schema)
    return chosen.select("category", "layer", "nth", "image_id", "patch_id", "v")


def numbered(chosen: DataFrame) -> DataFrame:
    """`chosen` with `bank_id`: a row's place, from 0, by image and patch within its category and layer.

    Images that lie close by id form a span. A window numbers the rows of one span, at most `NUMBERED` images, and adds
    how many lie in the spans before, which come from counts: no task holds the vectors of a category and layer.
    """
    keys = ["category", "layer"]
    rows = chosen.withColumn("span", F.floor(F.col("image_id") / NUMBERED))
    spans = rows.groupBy(*keys, "span").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy(*keys).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(*keys, "span", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy(*keys, "span").orderBy("image_id", "patch_id")) - 1
    return rows.join(spans, [*keys, "span"]).withColumn("bank_id", (F.col("before") + nth).cast("long")).drop("span", "before")


def memory_bank(features: DataFrame, splits: DataFrame, patch_count: int, ratio: float = 0.1, sampling: str = "random", seed: int = 42, projection: int = 0) -> DataFrame:
    """(category, layer, bank_id, source_id, patch_id, x, y, v) sampled from the patches of memory images."""
    own = features.join(splits.filter("role = 'memory'").select("category", "image_id"), ["category", "image_id"], "left_semi")
    if sampling == "random":
        chosen = sample_patches(own, ratio, seed)
    elif sampling == "kcenter":
        # Written once, since numbering reads it twice.
        chosen = stored(k_center(own, ratio, seed=seed, projection=projection))
    else:
        raise ValueError(f"no such sampling: {sampling}")
    rows = with_coordinates(numbered(chosen), patch_count)
    return rows.select("category", "layer", "bank_id", F.col("image_id").alias("source_id"), "patch_id", "x", "y", "v")


def memory_entries(bank: DataFrame) -> DataFrame:
    return bank.groupBy("category").agg(F.count(F.lit(1)).alias("memory_entries"))


def bank_faults(bank: DataFrame) -> DataFrame:
    """Per category and layer: rows, and how many have no finite numbers, another width or a place outside the grid."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    width = bank.groupBy("category", "layer").agg(F.max(F.size("v")).alias("width"))
    rows = bank.join(width, ["category", "layer"])
    count = lambda wrong: F.sum(wrong.cast("long"))
    return rows.groupBy("category", "layer").agg(F.count(F.lit(1)).alias("rows"), count(~finite).alias("not_finite"), count(F.size("v") != F.col("width")).alias("other_width"), count(~(F.col("x").between(0, 1) & F.col("y").between(0, 1))).alias("outside"))
