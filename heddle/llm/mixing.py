"""Mixing sources to target weights by capped water-filling.

Targets share a budget by weight; a source stops at `max_epochs` times its size and its excess goes to
the others by weight, until no source is above its cap. Each source then takes whole repetitions of
every document, and its fractional repetition in a seeded order of documents: leading documents are
taken once more. The document at the boundary is taken whole or left out, whichever comes nearer to the target.

The seeded order is cut by a histogram of hash buckets per source, so that only the documents of one
bucket are ever ranked together, however large the source.

Defined results: null text has no words; a null source is a source of its own, last in order; a source
without words takes none; documents without words are repeated as often as their source is whole; rows that repeat are documents of their own; an empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.llm.common import persisted, whole_text

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in order, repeating.
CYCLE = (5.0, 2.0, 1.0)
#: The order hash has 60 bits; its leading bits name the bucket.
HASH_BITS, BUCKET_BITS = 60, 12


def n_words(text: str | Column) -> Column:
    return F.regexp_count(whole_text(text), F.lit(WORD)).cast("long")


def order_hash(seed: int, id_col: Column) -> Column:
    """60 bits of an MD5, the same in every SQL engine."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, HASH_BITS // 4), 16, 10).cast("long")


def cycled_weights(sources: DataFrame, cycle: tuple[float, ...] = CYCLE) -> DataFrame:
    """`weight` by the order of `source`, null last. The window holds a row per source, not per document."""
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    cycle_at = F.element_at(F.array(*map(F.lit, cycle)), (nth % len(cycle) + 1).cast("int"))
    return sources.withColumn("weight", cycle_at)


def fill(sources: DataFrame, share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """`sources` (source, source_size, weight) with `target`.

    Each round clamps what is above its cap at the present level and raises the level for the rest;
    only the level travels through the driver.
    """
    sources = persisted(sources.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs))))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, budget = 0.0, share * total
    while True:
        over = F.col("cap") <= F.col("weight") * F.lit(level)
        full, weight = sources.agg(F.sum(F.when(over, F.col("cap")).otherwise(F.lit(0.0))), F.sum(F.when(over, F.lit(0.0)).otherwise(F.col("weight")))).first()
        higher = (budget - full) / weight if weight else level
        if not weight or higher <= level:
            break
        level = higher
    target = F.least("cap", F.col("weight") * F.lit(level)) if total else F.lit(0.0)
    return sources.withColumn("target", target).drop("cap", "weight")


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 20, share: float = 1.5, max_epochs: float = 2.0, cycle: tuple[float, ...] = CYCLE) -> DataFrame:
    """One row per document: `row` (the document), size, source_size, target, whole, part and taken.

    `whole` counts its whole repetitions, and `part` has its words if it is taken once more, else 0.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*columns).alias("row")).select("row", F.col(f"row.`{id_col}`").alias("id"), F.col(f"row.`{source_col}`").alias("source"), n_words(F.col(f"row.`{text_col}`")).alias("size"))
    rows = rows.withColumn("hash", order_hash(seed, F.col("id"))).withColumn("bucket", F.shiftright("hash", HASH_BITS - BUCKET_BITS))
    buckets = persisted(rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size")))
    sources = fill(cycled_weights(buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), cycle), share, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    sources = sources.withColumn("whole", whole).withColumn("quota", F.round("target").cast("long") - F.col("whole") * F.col("source_size"))
    # A row per source and bucket: at most 2**BUCKET_BITS in a source's window.
    so_far = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("before", F.coalesce(F.sum("bucket_size").over(so_far), F.lit(0)))
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))  # null is a source too
    buckets = buckets.withColumn("key", key).drop("bucket_size").join(sources.withColumn("key", key).drop("source"), "key").drop("source")
    within = Window.partitionBy("key", "bucket").orderBy("hash", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("key", key).join(buckets, ["key", "bucket"])
    left = F.col("quota") - F.col("before") - F.coalesce(F.sum("size").over(within), F.lit(0))
    placed = placed.withColumn("part", F.when(2 * left > F.col("size"), F.col("size")).otherwise(F.lit(0)).cast("long"))
    return placed.select("row", "size", "source_size", "target", "whole", "part", (F.col("whole") * F.col("size") + F.col("part")).alias("taken"))


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """One row per document: id, size, source_size, target of its source and taken words."""
    used = docs.select(F.col(id_col), F.col(text_col), F.col(source_col))
    return plan(used, id_col, text_col, source_col, **options).select(F.col(f"row.`{id_col}`").alias(id_col), "size", "source_size", "target", "taken")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mixed rows, whole and as they were: a row for each repetition."""
    planned = plan(docs, id_col, text_col, source_col, **options)
    times = F.col("whole") + (F.col("part") > 0).cast("long")
    repeated = planned.select("row", F.explode(F.array_repeat(F.lit(0), times.cast("int"))))
    return repeated.select("row.*")
