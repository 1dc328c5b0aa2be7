"""Hard negatives by a vertical scan in the manner of BOND.

Rows are dealt to slices, which hold one column for each dimension, and anchors to groups. A task meets one
group with one slice. For each anchor it reads the columns in descending order of the anchor's magnitudes and
keeps the partial inner products of the candidates that are left. What the unread columns can still add lies
between the sums of their least and greatest contributions; candidates whose bounds can't reach a window any
more leave the bitmap. What is left after the last column has exact scores.

The first scan finds each anchor's positives, the best other rows of its label. They fix a window of scores
for each positive, and a second scan over rows of other labels finds the best within it. Lists of slices are
merged in a tree, so that no task holds more than `FAN` lists of a group.

Defined results: rows with a null label or vector, or a null or non-finite component, take no part; a null id
is an id that is no anchor, comes last among ties and has its label unchanged; rows that repeat are rows of
their own, so that a copy of an anchor can be its positive; components beyond 2**24 after scaling count as
2**24 (and below -2**24 as that); missing dimensions of shorter vectors count as zero; an anchor without
positives or negatives gives no row; an empty table gives an empty result. Extra columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import persisted

#: Rows of a slice, anchors of a group, rows whose bitmap is shrunk at a time, and columns read between two looks at the bounds.
SLICE, GROUP, BLOCK, STRIDE = 16384, 1024, 4096, 8
#: Lists that are merged at once.
FAN = 64
#: Components are held within this, so that every score fits a long.
LIMIT = 2**24
#: Beyond all scores, and the id that stands for null.
FAR, NO_ID = 2**62, 2**63 - 1


def prepared(rows: DataFrame, label: Column, vector: Column, anchor: Column, id_col: str, scale: int) -> DataFrame:
    """(key, id, label, v, anchor): the rows that take part, their components scaled and floored."""
    used = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), label.alias("label"), vector.cast("array<double>").alias("v"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    used = used.filter(F.col("label").isNotNull() & F.col("v").isNotNull()).filter(~bad)
    floored = F.transform("v", lambda x: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.floor(x * scale))).cast("int"))
    whole = dict(used.dtypes)["label"] in ("tinyint", "smallint", "int", "bigint")
    code = F.col("label").cast("long") if whole else F.xxhash64("label")
    return used.select(F.monotonically_increasing_id().alias("key"), "id", code.alias("label"), floored.alias("v"), (F.col("anchor") & F.col("id").isNotNull()).alias("anchor"))


def packed(rows: DataFrame, part: Column, dims: int) -> DataFrame:
    """A row per `part`, with its rows in order of label: n and the bytes of key, id, label and of the columns, one dimension after the other."""

    def pack(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by([("label", "ascending"), ("key", "ascending")])
        n, v = table.num_rows, table["v"].combine_chunks()
        lengths = np.diff(v.offsets.to_numpy())
        matrix = np.zeros((n, dims), np.int32)
        if n:
            starts = np.cumsum(lengths) - lengths
            matrix[np.repeat(np.arange(n), lengths), np.arange(lengths.sum()) - np.repeat(starts, lengths)] = v.flatten().to_numpy()
        ids = table["id"].fill_null(NO_ID).to_numpy()
        held = {"part": [table["part"][0].as_py()], "n": [n], "key": [table["key"].to_numpy().tobytes()], "id": [ids.tobytes()], "label": [table["label"].to_numpy().tobytes()], "columns": [np.ascontiguousarray(matrix.T).tobytes()]}
        return pa.table(held, schema=pa.schema([("part", pa.int64()), ("n", pa.int64())] + [(c, pa.binary()) for c in ("key", "id", "label", "columns")]))

    return rows.withColumn("part", part).select("part", "key", "id", "label", "v").groupBy("part").applyInArrow(pack, "part long, n long, key binary, id binary, label binary, columns binary")


def shrink(anchor: np.ndarray, columns: np.ndarray, low: np.ndarray, high: np.ndarray, windows: np.ndarray, best: list[np.ndarray], most: int) -> tuple[np.ndarray, np.ndarray]:
    """(candidates, exact scores) of the columns' rows that can be among the best `most` of a window.

    `low` and `high` bound each column, `windows` has a row (least, greatest) for each window, and `best` the
    scores found so far in each, best first. A candidate as good as the last of a full list stays, as ids decide.
    """
    n, kind = columns.shape[1], columns.dtype.type
    order = np.argsort(-np.abs(anchor), kind="stable")
    ends = np.stack([anchor[order] * low[order], anchor[order] * high[order]])
    rest = np.zeros((2, len(order) + 1), columns.dtype)
    rest[:, :-1] = np.stack([ends.min(0), ends.max(0)])[:, ::-1].cumsum(1)[:, ::-1]
    need = min(max(least, found[most - 1]) if len(found) >= most else least for (least, _), found in zip(windows, best, strict=True))
    top = windows[:, 1].max()
    single = len(windows) == 1 and top >= FAR
    alive, part = None, np.zeros(n, columns.dtype)
    for at in range(0, len(order), STRIDE):
        for d in order[at : at + STRIDE]:
            if anchor[d]:
                part += anchor[d] * (columns[d] if alive is None else columns[d][alive])
        read = min(at + STRIDE, len(order))
        if single and len(part) > 4 * most:  # what the best candidates reach at least, the anchor itself not counted
            last = len(part) - most - 1
            need = max(need, np.partition(part, last)[last] + rest[0, read])
        keep = (part + rest[1, read] >= need) & (part + rest[0, read] <= top)
        left = np.count_nonzero(keep)
        if not left:
            return np.zeros(0, np.int64), np.zeros(0, kind)
        if left < 0.8 * len(part) or read == len(order):
            alive = np.flatnonzero(keep) if alive is None else alive[keep]
            part = part[keep]
    return (np.arange(n) if alive is None else alive), part


def first(scores: np.ndarray, ids: np.ndarray, keys: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best `most` by score, then by smaller id and key."""
    if len(scores) > 4 * most:
        kept = np.flatnonzero(scores >= np.partition(scores, len(scores) - most)[len(scores) - most])
        scores, ids, keys = scores[kept], ids[kept], keys[kept]
    order = np.lexsort((keys, ids, -scores))[:most]
    return scores[order], ids[order], keys[order]


def scan(group: dict, held: dict, windows: np.ndarray, same: bool, most: int, exact: np.dtype) -> list[np.ndarray]:
    """Scores, ids and keys (anchors x windows x most) of the best rows of the slice `held`; rows that are missing have the score -FAR."""
    dims = len(held["columns"]) // 4 // max(held["n"], 1)
    take = lambda x, c: np.frombuffer(x[c], np.int64)
    q = np.frombuffer(group["columns"], np.int32).reshape(dims, group["n"]).T.astype(exact)
    columns = np.frombuffer(held["columns"], np.int32).reshape(dims, held["n"]).astype(exact)
    keys, ids, labels = (take(held, c) for c in ("key", "id", "label"))
    shape = (group["n"], windows.shape[1], most)
    out = [np.full(shape, -FAR), np.full(shape, NO_ID), np.full(shape, -1)]
    bounds = [(at, min(at + BLOCK, held["n"])) for at in range(0, held["n"], BLOCK)]
    ranges = {b: (columns[:, b[0] : b[1]].min(1), columns[:, b[0] : b[1]].max(1)) for b in bounds}
    for i, (own, label) in enumerate(zip(take(group, "key"), take(group, "label"), strict=True)):
        own_windows = windows[i][windows[i][:, 0] <= windows[i][:, 1]]
        places = np.flatnonzero(windows[i][:, 0] <= windows[i][:, 1])
        if not len(places):
            continue
        # Rows are in order of label: those of one label are a run.
        begin, end = np.searchsorted(labels, label, "left"), np.searchsorted(labels, label, "right")
        runs = [(begin, end)] if same else [(0, begin), (end, held["n"])]
        found = [[np.zeros(0, np.int64)] * 3 for _ in places]
        for b in bounds:
            for lo, hi in ((max(b[0], x), min(b[1], y)) for x, y in runs):
                if lo >= hi:
                    continue
                at, scores = shrink(q[i], columns[:, lo:hi], *ranges[b], own_windows.astype(exact), [f[0] for f in found], most)
                at, scores = at + lo, scores.astype(np.int64)
                for w, (least, greatest) in enumerate(own_windows):
                    fits = (scores >= least) & (scores <= greatest) & (keys[at] != own)
                    if fits.any():
                        more = zip(found[w], (scores[fits], ids[at][fits], keys[at][fits]), strict=True)
                        found[w] = list(first(*[np.concatenate(x) for x in more], most))
        for w, parts in zip(places, found, strict=True):
            for o, part in zip(out, parts, strict=True):
                o[i, w, : len(part)] = part
    return out


LISTS = "part long, slice long, n long, scores binary, ids binary, keys binary"


def met(groups: DataFrame, slices: DataFrame, n_groups: int, n_slices: int, same: bool, most: int, exact: str) -> DataFrame:
    """The lists (LISTS) of every group with every slice; `groups` has `windows`, (anchors x windows x 2) longs, or null for all scores."""
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>"))
    left = groups.select(F.col("part"), F.struct("n", "key", "label", "columns", "windows").alias("own")).withColumn("slice", each(n_slices))
    right = slices.select(F.col("part").alias("slice"), F.struct("n", "key", "id", "label", "columns").alias("held")).withColumn("part", each(n_groups))

    def lists(batches):
        for batch in batches:
            for row in batch.to_pylist():
                group = row["own"]
                all_scores = np.broadcast_to(np.array([[-FAR, FAR]]), (group["n"], 1, 2))
                windows = all_scores if group["windows"] is None else np.frombuffer(group["windows"], np.int64).reshape(group["n"], -1, 2)
                made = scan(group, row["held"], windows, same, most, np.dtype(exact))
                yield pa.RecordBatch.from_pydict({"part": [row["part"]], "slice": [row["slice"]], "n": [group["n"]]} | {k: [x.tobytes()] for k, x in zip(("scores", "ids", "keys"), made, strict=True)})

    joined = left.join(right, ["part", "slice"])
    return joined.mapInArrow(lists, LISTS)


def merged(lists: DataFrame, n_slices: int, width: int, most: int) -> DataFrame:
    """One list for each group: lists of neighbouring slices are merged `FAN` at a time until one is left."""

    def merge(table: pa.Table) -> pa.Table:
        n = table["n"][0].as_py()
        stacks = [np.concatenate([np.frombuffer(x.as_py(), np.int64).reshape(n, width, most) for x in table[c]], axis=2) for c in ("scores", "ids", "keys")]
        order = np.lexsort((stacks[2], stacks[1], -stacks[0]))[:, :, :most]
        best = [np.take_along_axis(x, order, 2).tobytes() for x in stacks]
        return pa.table({"part": table["part"][:1], "slice": [table["up"][0].as_py()], "n": [n]} | {k: [x] for k, x in zip(("scores", "ids", "keys"), best, strict=True)})

    while n_slices > 1:
        lists = lists.withColumn("up", F.floor(F.col("slice") / FAN)).groupBy("part", "up").applyInArrow(merge, LISTS)
        n_slices = -(-n_slices // FAN)
    return lists


def mine(rows: DataFrame, label: Column, vector: Column, anchor: Column, id_col: str = "vec_id", scale: int = 256, positives: int = 5, negatives: int = 3, least: int = 50, greatest: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows where `anchor` holds.

    An anchor's positives are the first `positives` other rows of its label; of each, the first `negatives`
    rows of other labels whose score lies within `least` and `greatest` hundredths of the positive's.
    """
    points = persisted(prepared(rows, label, vector, anchor, id_col, scale))
    n, n_anchors, dims, largest = points.agg(F.count(F.lit(1)), F.count_if("anchor"), F.coalesce(F.max(F.size("v")), F.lit(0)), F.coalesce(F.max(F.array_max(F.transform("v", lambda x: F.abs(x)))), F.lit(0))).first()
    dims = max(dims, 1)
    # Sums of doubles are exact up to 2**53.
    exact = "float64" if 4 * dims * largest**2 < 2**53 else "int64"
    n_slices, n_groups = -(-max(n, 1) // SLICE), -(-max(n_anchors, 1) // GROUP)
    deal = lambda parts: F.pmod(F.xxhash64("key"), F.lit(parts))
    slices = persisted(packed(points, deal(n_slices), dims))
    groups = packed(points.filter("anchor"), deal(n_groups), dims).withColumn("windows", F.lit(None).cast("binary"))
    groups = persisted(groups)
    good = persisted(merged(met(groups, slices, n_groups, n_slices, True, positives, exact), n_slices, 1, positives))

    def windows_of(batches):
        for batch in batches:
            for n, scores in zip(batch["n"].to_pylist(), batch["scores"].to_pylist(), strict=True):
                score = np.frombuffer(scores, np.int64).reshape(n, positives)
                known = score > -FAR
                held = np.where(known, score, 0)
                lo, hi = -((-held * least) // 100), (held * greatest) // 100
                yield pa.RecordBatch.from_pydict({"part": batch["part"][:1], "windows": [np.stack([np.where(known, lo, 1), np.where(known, hi, 0)], axis=2).tobytes()]})

    def one_by_one(batches):
        return windows_of(piece for batch in batches for piece in (batch.slice(i, 1) for i in range(batch.num_rows)))

    bounded = groups.drop("windows").join(good.select("part", "n", "scores").mapInArrow(one_by_one, "part long, windows binary"), "part")
    bad = merged(met(persisted(bounded), slices, n_groups, n_slices, False, negatives, exact), n_slices, positives, negatives)
    everything = groups.select("part", F.col("id").alias("anchors")).join(good.select("part", F.col("scores").alias("good_scores"), F.col("ids").alias("good_ids")), "part").join(bad.select("part", "n", "scores", "ids"), "part")

    def listed(batches):
        for batch in batches:
            for row in batch.to_pylist():
                get = lambda c, *shape: np.frombuffer(row[c], np.int64).reshape(row["n"], *shape)  # noqa: B023, E731
                score, ids, good_score, good_id = get("scores", positives, negatives), get("ids", positives, negatives), get("good_scores", positives), get("good_ids", positives)
                i, j, k = np.nonzero(score > -FAR)
                known = lambda x: pa.array(x, pa.int64(), mask=x == NO_ID)
                yield pa.RecordBatch.from_arrays([pa.array(get("anchors")[i]), known(good_id[i, j]), pa.array((k + 1).astype(np.int32)), known(ids[i, j, k]), pa.array(good_score[i, j]), pa.array(score[i, j, k])], names=["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])

    return everything.mapInArrow(listed, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
