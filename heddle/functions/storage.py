"""Steps written to the folder that driver and executors share."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders that `stored` has written, by application.
_WRITTEN: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which spark.checkpoint.dir names.

    A session on one machine without that setting, as in tests, gets a temporary folder; on a cluster,
    where executors wouldn't see it, its absence is an error.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = context.getConf().get("spark.checkpoint.dir", None)
        if not named and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir isn't set; it names the folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="heddle-checkpoint-"))
    return context.getCheckpointDir()


def persisted(df: DataFrame) -> DataFrame:
    """`df`, written to the shared folder, with its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """`df`, written as Parquet to the shared folder and read again: the lineage is cut and later reads take only the columns they need."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/heddle-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(folder)
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(folder)
    made = spark.read.schema(df.schema).parquet(folder)
    made.heddle_folder = folder
    return made


def discard(df: DataFrame) -> None:
    """Removes what `stored` has written for `df`, which isn't read any more, and lets Spark drop shuffle files."""
    spark = df.sparkSession
    _WRITTEN.get(spark.sparkContext.applicationId, []).remove(df.heddle_folder)
    _delete(spark, df.heddle_folder)
    freed(spark)


def freed(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of finished steps: it does so when the driver's objects for them are collected,
    which takes two rounds, since what the first one finds only then lets go of the rest."""
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.4)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> int:
    """Removes what `stored` has written in this application, and returns the number of folders.

    For a caller who is done with all results that were built on it; it can't be read afterwards.
    """
    folders = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for folder in folders:
        _delete(spark, folder)
    return len(folders)
