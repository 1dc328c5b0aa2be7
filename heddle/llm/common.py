"""Shared pieces of the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.functions.storage import discard, freed, persisted, shared_folder, stored

__all__ = ["discard", "freed", "hash60", "limited_batches", "persisted", "read", "shared_folder", "small_batches", "stored", "whole_text"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Bounds the rows of a batch that goes to a Python worker, for the rest of the session: a batch of documents
    is held several times over, as Arrow, as strings and as results."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, rows)


@contextmanager
def limited_batches(spark: SparkSession, rows: int = 500) -> Iterator[None]:
    """Bounds the rows of a batch that goes to a Python worker for the jobs that run within, and restores the setting."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows if int(before) <= 0 else min(rows, int(before)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def whole_text(column: str | Column) -> Column:
    """The text, with null as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def hash60(*parts: Column) -> Column:
    """A non-negative 60-bit hash: differences of two never overflow a long."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 4)
