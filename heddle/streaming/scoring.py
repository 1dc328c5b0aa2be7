"""Incremental scoring: arriving patches are scored against a fixed bank and calibration, and images are decided.

Patches of an image may come in any order and number of files. Keyed state holds an image's patches until all of
its layers are there; then the image goes through the same steps as in a batch: nearest neighbours, calibration,
fusion, map, image score, and prediction. An image that isn't complete in time gives a row that says so.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from heddle.functions.storage import stored
from heddle.operators import maps
from heddle.operators.calibration import calibrated, fused, threshold_predictions
from heddle.operators.features import FEATURES, with_coordinates
from heddle.operators.nearest import nearest


def score_arrivals(spark: SparkSession, arrivals: str, bank: DataFrame, weights: DataFrame | float, calibration: DataFrame, out: str, checkpoint: str, patch_count: int, clamp: bool = False, files_per_batch: int = 100) -> StreamingQuery:
    """A query that scores the feature files in `arrivals` and stops when all are done; each file counts once.

    A batch's results go to a folder of its own that a repeated batch overwrites, so a restart neither
    loses nor doubles rows. Scoring keeps no state.
    """

    def score(batch: DataFrame, batch_id: int) -> None:
        found = nearest(with_coordinates(batch, patch_count), bank, weights)
        calibrated(found, calibration, clamp).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    stream = spark.readStream.schema(FEATURES).option("maxFilesPerTrigger", files_per_batch).parquet(arrivals)
    return stream.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


HELD = "layer array<int>, patch array<int>, v array<double>, done boolean"
GATHERED = "category string, image_id long, layer int, patch_id int, v array<double>, complete boolean"


def gathered(arrivals: DataFrame, layers: list[int], patch_count: int, timeout_ms: int) -> DataFrame:
    """(category, image_id, layer, patch_id, v, complete) of the images whose patches are all there, or that have waited too long.

    A patch counts once. A decided image is remembered until the timeout, so that late copies of its patches don't begin it anew.
    """
    wanted = {(layer, p) for layer in layers for p in range(patch_count)}

    def rows(key: tuple, held: dict, complete: bool) -> pd.DataFrame:
        places = sorted(held)
        return pd.DataFrame({"category": key[0], "image_id": key[1], "layer": [p[0] for p in places], "patch_id": [p[1] for p in places], "v": [held[p] for p in places], "complete": complete})

    def gather(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, done = {}, False
        if state.exists:
            layer, patch, v, done = state.get
            width = len(v) // max(1, len(layer))
            held = {(a, b): list(v[i * width : (i + 1) * width]) for i, (a, b) in enumerate(zip(layer, patch, strict=True))}
        if state.hasTimedOut:
            state.remove()
            if not done:
                yield rows(key, held, False)
            return
        for frame in frames:
            for place, v in zip(zip(frame["layer"].tolist(), frame["patch_id"].tolist(), strict=True), frame["v"], strict=True):
                if not done and place in wanted:
                    held.setdefault(place, [float(x) for x in v])
        if not done and len(held) == len(wanted):
            yield rows(key, held, True)
            held, done = {}, True
        places = list(held)
        state.update(([p[0] for p in places], [p[1] for p in places], [x for p in places for x in held[p]], done))
        state.setTimeoutDuration(timeout_ms)

    keyed = arrivals.select("category", "image_id", "layer", "patch_id", "v").groupBy("category", "image_id")
    return keyed.applyInPandasWithState(gather, GATHERED, HELD, "append", GroupStateTimeout.ProcessingTimeTimeout)


def image_decisions(patches: DataFrame, bank: DataFrame, weights: DataFrame | float, calibration: DataFrame, thresholds: DataFrame, patch_count: int, map_size: int = 224, sigma: float = 0.0, method: str = "topk_mean", topk_fraction: float = 0.01) -> DataFrame:
    """(category, image_id, image_score, predicted) of whole images, given as patches; `thresholds` has (category, image_threshold)."""
    scores = calibrated(nearest(with_coordinates(patches, patch_count), bank, weights), calibration)
    made = maps.upsampled(maps.patch_grids(fused(scores)), map_size, sigma)
    return threshold_predictions(maps.image_scores(made, method, topk_fraction), thresholds, "image_score", "image_threshold")


def decide_arrivals(spark: SparkSession, arrivals: str, layers: list[int], patch_count: int, decide: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, timeout_ms: int = 3_600_000, files_per_batch: int = 100) -> StreamingQuery:
    """A query that decides the images whose patches are in the files of `arrivals`, and stops when all files are read.

    `decide` makes decisions from the patches of whole images; `out` gets them with `complete`, and a row without a decision for
    each image whose time was up. State and results belong to a batch, whose folder a repeated batch overwrites: a restart
    neither loses nor doubles an image.
    """

    def finish(batch: DataFrame, batch_id: int) -> None:
        held = stored(batch)  # read several times, while the state is updated once
        found = decide(held.filter("complete").drop("complete")).withColumn("complete", F.lit(True))
        late = held.filter("NOT complete").select("category", "image_id", F.lit(False).alias("complete")).distinct()
        found.unionByName(late, allowMissingColumns=True).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    stream = spark.readStream.schema(FEATURES).option("maxFilesPerTrigger", files_per_batch).parquet(arrivals)
    ready = gathered(stream, layers, patch_count, timeout_ms)
    # With timeouts, batches without data would go on for ever; timeouts are looked at when files arrive.
    name = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        return ready.writeStream.foreachBatch(finish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(name, before)
