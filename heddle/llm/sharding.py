"""Sharding by histogram sort, so that all shards hold nearly the same number of bytes.

Rows have the order (hash of the text, hash of the id): equal texts have neighbouring slots, and a group of
copies is cut only where it is larger than the tolerance. Candidate boundaries are probed by
counting the exact bytes below them over all partitions; each round divides the cells that still hold a
splitter, until every splitter is within tolerance or at a single row. The same search, by rows instead of
bytes, cuts the whole order into runs of about `rows_per_run` rows. Then one exchange by run sorts the rows;
runs follow each other in the order, so slots count through a shard in the order of the keys.

Defined results: a null text has one byte (its end mark) and the checksum of the empty text; null ids
sort as a value of their own; an empty table gives an empty result; rows that repeat id and text stay
together; a table with fewer rows than shards leaves shards empty.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.llm.common import hash60, persisted, whole_text

TOP = (1 << 60) - 1


@dataclass(frozen=True)
class Probe:
    """Keys from `lo` to `hi` in the first part of the order, or in the second where the first is `group`."""

    lo: int
    hi: int
    group: int | None = None

    def covers(self) -> Column:
        part = F.col("k1") if self.group is None else F.col("k2")
        inside = part.between(self.lo, self.hi)
        return inside if self.group is None else inside & (F.col("k1") == self.group)

    def cell(self, cells: int) -> Column:
        part = F.col("k1") if self.group is None else F.col("k2")
        return F.floor((part - F.lit(self.lo)) / F.lit(-(-(self.hi - self.lo + 1) // cells)))


def splitters(keys: DataFrame, shards: int, tolerance: float = 0.005, cells: int = 256) -> list[tuple[int, int]]:
    """`shards - 1` keys (k1, k2); rows below the first belong to shard 0, and so on.

    `keys` has k1, k2 (longs from 0 to TOP) and size. At most shards * cells counts come to the
    driver in a round. `tolerance` is a share of a shard's bytes.
    """
    below = {Probe(0, TOP): 0}
    waiting = dict.fromkeys(range(1, shards), Probe(0, TOP))
    found: dict[int, tuple[int, int]] = {}
    total = None
    while waiting:
        probes = sorted(set(waiting.values()), key=lambda p: (p.lo, p.hi, p.group or 0))
        nth = cell = F.lit(None)
        for i, probe in reversed(list(enumerate(probes))):
            nth, cell = F.when(probe.covers(), F.lit(i)).otherwise(nth), F.when(probe.covers(), probe.cell(cells)).otherwise(cell)
        counted = keys.select("k1", "k2", "size", nth.alias("probe"), cell.alias("cell")).filter("probe IS NOT NULL").groupBy("probe", "cell")
        counts = counted.agg(F.sum("size"), F.min("k1"), F.max("k1"), F.min("k2"), F.max("k2")).collect()
        if total is None:
            total = sum(c[2] for c in counts)
            if not total:
                return [(TOP + 1, 0)] * (shards - 1)
        slack = tolerance * total / shards
        after: dict[Probe, int] = {}
        for i, probe in enumerate(probes):
            own = sorted((c for c in counts if c[0] == i), key=lambda c: c[1])
            for target in [t for t, p in waiting.items() if p == probe]:
                want, passed = total * target / shards, below[probe]
                for _, _, size, lo1, hi1, lo2, hi2 in own:
                    if passed + size >= want:
                        break
                    passed += size
                one = (lo1 == hi1) if probe.group is None else (lo2 == hi2)
                if size > slack and not one:
                    waiting[target] = nxt = Probe(lo1, hi1) if probe.group is None else Probe(lo2, hi2, probe.group)
                    after[nxt] = passed
                elif size > slack and probe.group is None and lo2 < hi2:
                    waiting[target] = nxt = Probe(lo2, hi2, lo1)
                    after[nxt] = passed
                else:
                    left = want - passed <= passed + size - want  # the nearer side
                    end = (lo1, 0) if left else (hi1 + 1, 0)
                    if probe.group is not None:
                        end = (probe.group, lo2 if left else hi2 + 1)
                    found[target] = end
                    del waiting[target]
        below = after
    return [max(found[t] for t in range(1, target + 1)) for target in range(1, shards)]


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = whole_text(text_col)
    size = (F.octet_length(text) + 1).cast("long")
    return docs.select(F.col(id_col).alias("id"), size.alias("size"), F.crc32(text.cast("binary")).alias("crc"), hash60(text).alias("k1"), hash60(F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).alias("k2"))


def below(cuts: list[tuple[int, int]]) -> Column:
    """The number of `cuts` at or below a row's keys. `cuts` are in order."""
    if not cuts:
        return F.lit(0)
    # Counted in an array of constants: a sum of as many comparisons would be too long a plan.
    at = F.array(*[F.struct(F.lit(a).alias("k1"), F.lit(b).alias("k2")) for a, b in cuts])
    return F.size(F.filter(at, lambda c: (c["k1"] < F.col("k1")) | ((c["k1"] == F.col("k1")) & (c["k2"] <= F.col("k2")))))


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 8, rows_per_run: int = 1_000_000, tolerance: float = 0.005) -> DataFrame:
    """One row per document: id, size, text_crc32, shard and slot; a shard's slots are in the order of the keys.

    Runs are at least 4 a shard and at most 1024 in all: the driver holds their splitters, 16 bytes each.
    Rows of one id and text can't be told apart by keys and stay in one run.
    """
    keys = persisted(keyed(docs, id_col, text_col))
    cuts = splitters(keys.select("k1", "k2", "size"), shards, tolerance)
    runs = min(1024, max(4 * shards, keys.count() // rows_per_run))
    ends = sorted(set(splitters(keys.select("k1", "k2", F.lit(1).cast("long").alias("size")), runs, 0.25)) | set(cuts))
    # Shards' own splitters end runs too, so that a run lies in one shard.
    placed = keys.withColumn("run", below(ends))
    shard_of = F.element_at(F.array(*[F.lit(sum(c <= e for c in cuts)) for e in [(-1, -1), *ends]]), F.col("run") + 1)
    placed = placed.withColumn("shard", shard_of)
    # At most 1024 + shards rows, whatever the input.
    sizes = placed.groupBy("shard", "run").agg(F.count(F.lit(1)).alias("n"))
    offset = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("run", offset.alias("offset"))
    nth = F.row_number().over(Window.partitionBy("run").orderBy("k1", "k2", "id")) - 1
    numbered = placed.withColumn("nth", nth).join(F.broadcast(offsets), "run")
    return numbered.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.col("shard").cast("int").alias("shard"), (F.col("offset") + F.col("nth")).cast("long").alias("slot"))
