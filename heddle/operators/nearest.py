"""Nearest neighbours, exact, under cosine distance plus a weighed distance of places.

Queries of a category and layer are dealt to at most `SLICES` slices, the bank to blocks. Rows of a slice and block
lie together, the bank's first: a task holds one block as arrays and multiplies the slice's queries by it as they pass,
so that pairs are never rows, and what is held is a block, whatever the size of a category. The bank is sent once for
each slice, a query once for each block of its bank, which is one for banks of up to `BANK_BLOCK` rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tasks that a category and layer are searched by; each gets a copy of its bank.
SLICES = 64
#: Rows of a bank that a task holds: 100 MB for 768 numbers each.
BANK_BLOCK = 16_384
#: Queries that are multiplied by a block at once.
AT_ONCE = 256
_KEYS = ["category", "layer", "slice", "block"]


def arranged(queries: DataFrame, bank: DataFrame, weights: DataFrame | float = 0.0, query_block: int = 1024, bank_block: int = BANK_BLOCK) -> DataFrame:
    """(category, layer, slice, block, is_query, weight, id, patch_id, x, y, v): both sides' rows by slice and block, the bank's first."""
    group = ["category", "layer"]
    parts = lambda rows, per, name: rows.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / per).alias(name))
    # A row per category and layer.
    sizes = parts(queries, query_block, "slices").withColumn("slices", F.least("slices", F.lit(SLICES))).join(parts(bank, bank_block, "blocks"), group)
    if isinstance(weights, DataFrame):
        sizes = sizes.join(weights.select(*group, F.col("spatial_weight").alias("weight")), group)
    elif weights < 0:
        raise ValueError("the spatial weight is negative")
    else:
        sizes = sizes.withColumn("weight", F.lit(float(weights)))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    part = lambda n, *ids: F.pmod(F.xxhash64(*ids), F.col(n))

    def side(rows: DataFrame, slices: Column, blocks: Column, is_query: bool, *ids: Column) -> DataFrame:
        put = rows.join(sizes, group).select(*group, slices.alias("slice"), F.lit(is_query).alias("is_query"), "weight", "blocks", *ids, "x", "y", "v")
        return put.select(*group, "slice", blocks.alias("block"), "is_query", "weight", "id", "patch_id", "x", "y", "v")

    left = side(queries, part("slices", "image_id", "patch_id"), every("blocks"), True, F.col("image_id").cast("long").alias("id"), F.col("patch_id").cast("int"))
    right = side(bank, every("slices"), part("blocks", "id"), False, F.col("bank_id").cast("long").alias("id"), F.lit(0).alias("patch_id"))
    return left.unionByName(right).repartition(*_KEYS).sortWithinPartitions(*_KEYS, "is_query")


def runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple, bool, pa.RecordBatch]]:
    """The parts of a batch that have the same key and side."""
    if not batch.num_rows:
        return
    keys = batch.select([*_KEYS, "is_query"]).to_pandas()
    starts = np.flatnonzero((keys != keys.shift()).any(axis=1).to_numpy())
    for start, end in zip(starts, [*starts[1:], len(keys)], strict=True):
        row = keys.iloc[start]
        yield tuple(row[_KEYS]), bool(row["is_query"]), batch.slice(start, end - start)


def arrays(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(id, x, y, v) of rows, the last as a matrix."""
    plain = [rows.column(name).to_numpy(zero_copy_only=False) for name in ("id", "x", "y")]
    return *plain, rows.column("v").flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1)


def search(query: tuple, bank: tuple, weight: float) -> tuple[np.ndarray, np.ndarray]:
    """For each query the least score and its bank id; the lowest id of equal ones, as the bank is in the order of ids."""
    (_, qx, qy, q), (ids, bx, by, b) = query, bank
    score, found = np.empty(len(q)), np.empty(len(q), dtype=np.int64)
    for at in range(0, len(q), AT_ONCE):
        part = slice(at, at + AT_ONCE)
        away = 1 - q[part] @ b.T
        if weight > 0:
            dx, dy = qx[part, None] - bx[None, :], qy[part, None] - by[None, :]
            away = away + weight * np.sqrt(dx * dx + dy * dy)
        best = away.argmin(axis=1)
        score[part], found[part] = away[np.arange(len(best)), best], ids[best]
    return score, found


def nearest(queries: DataFrame, bank: DataFrame, weights: DataFrame | float = 0.0, query_block: int = 1024, bank_block: int = BANK_BLOCK) -> DataFrame:
    """(category, image_id, layer, patch_id, score, bank_id) for `queries` (category, image_id, layer, patch_id, x, y, v).

    `weights` is one number, or (category, layer, spatial_weight).
    """

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, held = None, [], None
        for batch in stream:
            for own, is_query, rows in runs(batch):
                if not is_query:
                    if own != key:
                        key, parts, held = own, [], None
                    parts.append(arrays(rows))
                elif own == key:  # else the block got none of the bank's rows
                    if held is None:
                        whole = [np.concatenate(p) for p in zip(*parts, strict=True)]
                        order, parts = np.argsort(whole[0]), []
                        held = tuple(p[order] for p in whole)
                    score, bank_id = search(arrays(rows), held, rows.column("weight")[0].as_py())
                    out = [rows.column("category"), rows.column("id"), rows.column("layer"), rows.column("patch_id"), pa.array(score), pa.array(bank_id)]
                    yield pa.record_batch(out, names=["category", "image_id", "layer", "patch_id", "score", "bank_id"])

    found = arranged(queries, bank, weights, query_block, bank_block).mapInArrow(batches, "category string, image_id long, layer int, patch_id int, score double, bank_id long")
    best = found.groupBy("category", "image_id", "layer", "patch_id").agg(F.min(F.struct("score", "bank_id")).alias("best"))
    return best.select("category", "image_id", "layer", "patch_id", "best.score", "best.bank_id")


def nearest_by_join(queries: DataFrame, bank: DataFrame, weight: float = 0.0) -> DataFrame:
    """The same as one join; every pair is a row, so it is for small banks and for tests."""
    from heddle.functions.vectors import dot

    other = bank.select("category", "layer", "bank_id", F.col("x").alias("bx"), F.col("y").alias("by"), F.col("v").alias("bv"))
    apart = F.sqrt((F.col("x") - F.col("bx")) ** 2 + (F.col("y") - F.col("by")) ** 2)
    score = 1 - dot(F.col("v"), F.col("bv")) + F.lit(float(weight)) * apart
    best = queries.join(other, ["category", "layer"]).groupBy("category", "image_id", "layer", "patch_id").agg(F.min(F.struct(score.alias("score"), "bank_id")).alias("best"))
    return best.select("category", "image_id", "layer", "patch_id", "best.score", "best.bank_id")
