"""Image folders: listing, labels and masks; decoding; resizing and normalising to tensors.

A category's folder has train/good, test/<defect> and ground_truth/<defect>/<stem>_mask.png.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = r"(?i)\.(png|jpg|jpeg|bmp|tif|tiff)$"
#: Channel means and deviations that image encoders of the CLIP family expect.
CHANNEL_MEAN = (0.48145466, 0.4578275, 0.40821073)
CHANNEL_STD = (0.26862954, 0.26130258, 0.27577711)


def list_images(spark: SparkSession, root: str) -> DataFrame:
    """(path) of the images below `root`; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    return files.filter(F.col("path").rlike(SUFFIXES))


def image_records(spark: SparkSession, root: str) -> DataFrame:
    """(category, image_id, path, is_train, label, defect_type, mask_path) of all categories below `root`.

    An anomalous image without a mask, and a category without training or test images, are errors.
    """
    part = r"([^/]+)/(train|test|ground_truth)/([^/]+)/(?:.*/)?([^/]+)\.[^./]+$"
    at = lambda i: F.regexp_extract("path", part, i)
    files = list_images(spark, root).select("path", at(1).alias("category"), at(2).alias("part"), at(3).alias("defect_type"), at(4).alias("stem")).filter("part != ''")
    masks = files.filter("part = 'ground_truth'").select("category", "defect_type", F.regexp_replace("stem", "_mask$", "").alias("stem"), F.col("path").alias("mask_path"))
    images = files.filter("part != 'ground_truth'").withColumn("label", (F.col("defect_type") != "good").cast("int"))
    rows = images.join(masks, ["category", "defect_type", "stem"], "left").select("category", F.xxhash64("path").alias("image_id"), "path", (F.col("part") == "train").alias("is_train"), "label", "defect_type", F.when(F.col("label") == 1, F.col("mask_path")).alias("mask_path"))
    lacking = rows.filter("label = 1 AND mask_path IS NULL AND NOT is_train").select("path").take(5)
    if lacking:
        raise FileNotFoundError(f"no mask for {[r.path for r in lacking]}")
    counts = rows.groupBy("category").agg(F.sum(F.col("is_train").cast("int")).alias("train"), F.sum((~F.col("is_train")).cast("int")).alias("test")).filter("train = 0 OR test = 0").take(5)
    if counts or rows.isEmpty():
        raise ValueError(f"categories without training or test images: {[r.category for r in counts]}")
    return rows


def decode_images(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(path, height, width, channels, data): decoded pixels, row by row, in the order RGB."""
    rows = spark.read.format("image").option("recursiveFileLookup", "true").load(paths)
    # The two readers write local paths differently.
    path = F.regexp_replace("image.origin", "^file:/+", "file:/")
    return rows.select(path.alias("path"), F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("bgr"))


def as_array(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """RGB (height, width, 3) of stored BGR, BGRA or gray bytes."""
    pixels = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.repeat(pixels, 3, axis=2) if channels == 1 else pixels[:, :, 2::-1]


def _cubic(x: np.ndarray, a: float = -0.5) -> np.ndarray:
    x = np.abs(x)
    return np.where(x < 1, (a + 2) * x**3 - (a + 3) * x**2 + 1, np.where(x < 2, a * x**3 - 5 * a * x**2 + 8 * a * x - 4 * a, 0.0))


def bicubic_weights(source: int, target: int) -> np.ndarray:
    """(target, source): cubic weights whose support widens when shrinking; rows add up to 1."""
    scale = source / target
    wide = max(1.0, scale)
    centers = (np.arange(target) + 0.5) * scale
    weights = _cubic((np.arange(source)[None, :] + 0.5 - centers[:, None]) / wide)
    return weights / weights.sum(axis=1, keepdims=True)


def resized(image: np.ndarray, height: int, width: int, mask: bool = False) -> np.ndarray:
    """Nearest pixels for masks, antialiased cubic interpolation for images."""
    if mask:
        rows = np.minimum(((np.arange(height) + 0.5) * image.shape[0] / height).astype(int), image.shape[0] - 1)
        columns = np.minimum(((np.arange(width) + 0.5) * image.shape[1] / width).astype(int), image.shape[1] - 1)
        return image[rows][:, columns]
    across = np.einsum("tw,hwc->htc", bicubic_weights(image.shape[1], width), image.astype(np.float64))
    down = np.einsum("th,hwc->twc", bicubic_weights(image.shape[0], height), across)
    return np.clip(np.rint(down), 0, 255).astype(np.uint8)


def fitted(image: np.ndarray, size: int, mode: str = "resize", mask: bool = False) -> np.ndarray:
    """A square of `size`: stretched, or with its proportions kept on a black ground."""
    if mode == "resize":
        return resized(image, size, size, mask)
    if mode != "pad_resize":
        raise ValueError(f"no such resize mode: {mode}")
    scale = size / max(image.shape[:2])
    height, width = (max(1, round(n * scale)) for n in image.shape[:2])
    out = np.zeros((size, size, image.shape[2]), np.uint8)
    top, left = (size - height) // 2, (size - width) // 2
    out[top : top + height, left : left + width] = resized(image, height, width, mask)
    return out


def to_tensor(image: np.ndarray) -> np.ndarray:
    """Normalised channels first."""
    return ((image / 255.0 - CHANNEL_MEAN) / CHANNEL_STD).transpose(2, 0, 1)


def tensors(images: DataFrame, size: int, mode: str = "resize") -> DataFrame:
    """(path, tensor) of decoded images, the tensor flat in the order channel, row, column."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = [to_tensor(fitted(as_array(r.bgr, r.height, r.width, r.channels), size, mode)).ravel() for r in frame.itertuples()]
            yield pd.DataFrame({"path": frame["path"], "tensor": made})

    return images.mapInPandas(batches, "path string, tensor array<double>")


def masks(images: DataFrame, size: int, mode: str = "resize") -> DataFrame:
    """(path, mask) of decoded masks: 1 where any channel is above 0."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = [(fitted(as_array(r.bgr, r.height, r.width, r.channels), size, mode, mask=True).max(axis=2) > 0).astype(np.int32).ravel() for r in frame.itertuples()]
            yield pd.DataFrame({"path": frame["path"], "mask": made})

    return images.mapInPandas(batches, "path string, mask array<int>")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of files."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.sha2("content", 256).alias("sha256"))
