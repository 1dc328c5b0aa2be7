"""Exact deduplication by skew-safe combining.

Equal texts meet in three steps, each of which groups by the content itself beside its digest, so that two
texts sharing a digest never merge:

1. within each map task, before anything is moved (the partial aggregation of the first exchange);
2. within a salted digest group: the salt is the map task's, taken on the scan, so that a heavy text is one row
   of each map task and its salts go to different tasks;
3. across the salt winners of a digest, at most `salts` rows for a content.

Documents then find their group by digest. Groups that have more than `HEAVY_ROWS` documents and more than a
`HEAVY`-th part of all, of which there are fewer than `HEAVY` whatever the input, are listed and broadcast; their
documents look them up by digest and spread, which comes from the id and deals a group to `SPREADS` tasks.

Defined results: null text is an empty text; empty texts are equal to each other; an empty table gives
an empty result; null ids lose to any id, and a group of null ids only keeps a null id; rows that repeat
both the id and the text of the keeper are one document (`assign` marks them all kept, `deduplicate`
returns one of them). Extra columns, whatever their names, pass through `deduplicate` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import freed, stored, whole_text

#: Groups of more rows than this, and more than this part of all rows, are spread over several tasks when rows look up their group.
HEAVY_ROWS, HEAVY = 1000, 10_000
#: Tasks that the rows of such a group are dealt to.
SPREADS = 64
#: Runs of white space that aren't already a single space.
WHITE_RUNS = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalised(text: str | Column) -> Column:
    return F.regexp_replace(whole_text(text), WHITE_RUNS, " ")


def sha256(content: Column) -> Column:
    return F.sha2(content, 256)


def keyed(rows: DataFrame, digest) -> DataFrame:
    """`rows` (id, content) with digest, and sha, the digest of SHA-256."""
    rows = rows.withColumn("digest", digest(F.col("content")))
    return rows.withColumn("sha", F.col("digest") if digest is sha256 else sha256(F.col("content")))


def salted(rows: DataFrame, salts: int) -> DataFrame:
    """The first two steps: (digest, salt, content, id, n) from `rows` (id, digest, content), straight from a scan.

    Tasks of the scan combine their own rows before any move; the rows of a salt are those of some tasks.
    """
    return rows.withColumn("salt", F.spark_partition_id() % salts).groupBy("digest", "salt", "content").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))


def groups_of(winners: DataFrame) -> DataFrame:
    """The third step: (digest, content, keep_id, group_size), from at most as many winners of a content as there are salts."""
    return winners.groupBy("digest", "content").agg(F.min("id").alias("keep_id"), F.sum("n").alias("group_size"))


def _resolved(rows: DataFrame, salts: int) -> DataFrame:
    """`rows` (with digest, content) and the keep_id and group_size of their group, null for lone texts."""
    own = rows.select("id", "digest", "content")
    groups = stored(groups_of(salted(own, salts)).drop("content"))
    freed(rows.sparkSession)
    clashing = groups.groupBy("digest").count().filter("count > 1")
    total = groups.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
    # Fewer than HEAVY rows.
    many = F.col("group_size") > max(HEAVY_ROWS, total // HEAVY)
    heavy = stored(groups.filter(many).select("digest").distinct())
    rows = rows.join(F.broadcast(heavy.withColumn("heavy", F.lit(True))), "digest", "left")
    rows = rows.withColumn("spread", F.when(F.col("heavy"), F.pmod(F.xxhash64("id"), F.lit(SPREADS)).cast("int")).otherwise(F.lit(0)))
    every = F.explode(F.when(F.col("heavy"), F.sequence(F.lit(0), F.lit(SPREADS - 1))).otherwise(F.array(F.lit(0)))).alias("spread")
    marked = lambda found: found.join(F.broadcast(heavy.withColumn("heavy", F.lit(True))), "digest", "left")
    if clashing.isEmpty():
        found = marked(groups.filter("group_size > 1")).select("digest", every, "keep_id", "group_size")
        return rows.drop("content").join(found, ["digest", "spread"], "left")
    # Texts that share a digest: their groups are told apart by content.
    found = marked(groups_of(salted(own, salts)).filter("group_size > 1")).select("digest", "content", every, "keep_id", "group_size")
    return rows.join(found, ["digest", "content", "spread"], "left").drop("content")


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16, digest=sha256) -> DataFrame:
    """One row per document: its id, keep_id, group_size, kept and text_sha256."""
    rows = keyed(docs.select(F.col(id_col).alias("id"), normalised(text_col).alias("content")), digest)
    found = _resolved(rows, salts)
    size = F.coalesce("group_size", F.lit(1).cast("long"))
    keep = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return found.select(F.col("id").alias(id_col), keep.alias("keep_id"), size.alias("group_size"), F.col("id").eqNullSafe(keep).alias("kept"), F.col("sha").alias("text_sha256"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16, digest=sha256) -> DataFrame:
    """The rows of `docs` that stay, with their columns as they were."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).select("row", F.col(f"row.`{id_col}`").alias("id"), normalised(F.col(f"row.`{text_col}`")).alias("content"))
    rows = keyed(rows, digest)
    found = _resolved(rows, salts)
    kept = found.filter(F.col("group_size").isNull() | F.col("id").eqNullSafe(F.col("keep_id")))
    repeated = rows.groupBy("digest", "id").count().filter("count > 1")
    if not repeated.isEmpty():  # of rows that differ elsewhere, the first by all columns
        kept = kept.groupBy("sha", "id").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return kept.select("row.*")
