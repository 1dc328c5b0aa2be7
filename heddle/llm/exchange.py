"""Counts that blocks of rows add up and look up again, moved as arrays.

A block holds the distinct codes (64-bit) of its rows once, with a few values for each. Its codes are dealt to
buckets by hash, a piece for each block and bucket; pieces of a bucket are summed in a tree, `FAN` at a time,
so that however many blocks hold a code, no task gathers more than `FAN` pieces of a bucket. Answers go back
to the blocks in the order of the codes in a piece. A frequent code counts once a block, not once a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pieces that are summed at once.
FAN = 512


def mixed(codes: np.ndarray) -> np.ndarray:
    """Well spread 64-bit codes (the finaliser of splitmix64)."""
    x = codes.astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def bucket_of(codes: np.ndarray, buckets: int) -> np.ndarray:
    return ((mixed(codes) >> np.uint64(8)) % np.uint64(buckets)).astype(np.int64)


def dealt(by: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places of its codes in order) for the buckets that `by`, the codes that deal, come to."""
    if not len(by):
        return
    at = bucket_of(by, buckets)
    # Short integers are sorted by radix.
    order = np.argsort(at.astype(np.uint16) if buckets <= 1 << 16 else at, kind="stable")
    found, starts = np.unique(at[order], return_index=True)
    for bucket, places in zip(found.tolist(), np.split(order, starts[1:]), strict=True):
        yield bucket, places


def add_up(codes: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct codes in order, and the sums of each of `values`."""
    if not len(codes):
        return (codes, *values)
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return (codes[starts], *[np.add.reduceat(v[order], starts, dtype=v.dtype) for v in values])


def joined(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    """The arrays of a binary column, one after the other."""
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def sized(column: pa.ChunkedArray, width: int = 8) -> np.ndarray:
    """How many numbers each value of a binary column holds."""
    return np.array([len(x) // width for x in column.to_pylist()], np.int64)


def narrow(numbers: np.ndarray, below: int) -> bytes:
    """Whole numbers from 0 in as few bytes as `below` allows."""
    return numbers.astype(np.uint8 if below <= 1 << 8 else np.uint16 if below <= 1 << 16 else np.uint32).tobytes()


def widened(data: bytes, below: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8 if below <= 1 << 8 else np.uint16 if below <= 1 << 16 else np.uint32).astype(np.int64)


def squeezed(numbers: np.ndarray, kind: str = "<i4") -> bytes:
    """Numbers of a kind, compressed: all first bytes, all second ones, and so on, since some of these are mostly equal."""
    planes = numbers.astype(kind).view(np.uint8).reshape(-1, np.dtype(kind).itemsize).T
    return len(numbers).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def expanded(data: bytes, kind: str = "<i4") -> np.ndarray:
    """What `squeezed` was given; 32-bit whole numbers as 64-bit ones."""
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data[8:], width * int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True), np.uint8).reshape(width, -1)
    made = np.ascontiguousarray(planes.T).view(kind).ravel()
    return made.astype(np.int64) if kind == "<i4" else made


def tree_sum(pieces: DataFrame, values: dict[str, type], groups: int) -> DataFrame:
    """(bucket, codes, values): one row for each bucket; `pieces` has bucket, grp from 0 below `groups`, codes and `values`."""
    schema = "bucket long, grp long, codes binary, " + ", ".join(f"{name} binary" for name in values)

    def add(table: pa.Table) -> pa.Table:
        sums = add_up(joined(table["codes"], np.uint64), *[joined(table[name], kind) for name, kind in values.items()])
        return pa.table({"bucket": table["bucket"][:1], "grp": [table["up"][0].as_py()], "codes": [sums[0].tobytes()]} | {name: [x.astype(kind).tobytes()] for (name, kind), x in zip(values.items(), sums[1:], strict=True)})

    pieces = pieces.select("bucket", "grp", "codes", *values)
    while True:
        pieces = pieces.withColumn("up", F.floor(F.col("grp") / FAN)).groupBy("bucket", "up").applyInArrow(add, schema)
        groups = -(-groups // FAN)
        if groups <= 1:
            return pieces.drop("grp")


def answered(pieces: DataFrame, table: DataFrame, groups: int, answer: Callable[[pa.Table, pa.Table], Iterator[dict] | list[dict]], schema: str) -> DataFrame:
    """`answer` of the pieces of up to `FAN` blocks and the row of `table` for their bucket, of which each such set of pieces gets a copy."""
    names = [x.split()[0] for x in schema.split(", ")]

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        made = list(answer(left, right)) if left.num_rows else []
        return pa.table({n: [x[n] for x in made] for n in names})

    n_sets = -(-groups // FAN)
    copies = table.withColumn("up", F.explode(F.sequence(F.lit(0), F.lit(n_sets - 1)).cast("array<bigint>")))
    left = pieces.withColumn("up", F.floor(F.col("grp") / FAN))
    return left.groupBy("bucket", "up").cogroup(copies.groupBy("bucket", "up")).applyInArrow(typed(both, schema), schema)


KINDS = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64()}


def typed(made: Callable[..., pa.Table], schema: str) -> Callable[..., pa.Table]:
    """`made` with its columns as in `schema`, also where it has no rows."""
    fields = pa.schema([(name, KINDS[kind]) for name, kind in (x.split() for x in schema.split(", "))])
    return lambda left, right: made(left, right).cast(fields)
