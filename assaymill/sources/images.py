"""Photographs and masks read with Spark's image source.

The image source decodes on the JVM and hands over one row per file. The only
Python is the unpacking of a decoded buffer, which returns colour counts or four
measures per image, never pixels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaymill.functions.colour import GREY, GREY_SHIFT

MASK_THRESHOLD = 127
COUNTS = "image_id string, r int, g int, b int, in_roi boolean, n long"
MEASURES = (
    "image_id string, luma double, clipped double, sharpness double, roi_area double, width int, height int"
)


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Site, folder, name, path and size of every file; contents are not read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    parts = F.split("path", "/")
    named = raw.withColumns({"name": parts[F.size(parts) - 1], "folder": parts[F.size(parts) - 2], "site": parts[F.size(parts) - 3]})
    return named.select("site", "folder", "name", "path", "length")


def read_images(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, height, width, channels, data); height is -1 for an unreadable file.

    The buffer is stored blue first, as decoded.
    """
    raw = spark.read.format("image").option("recursiveFileLookup", True).load(paths)
    return raw.select(
        F.col("image.origin").alias("path"),
        F.col("image.height").alias("height"),
        F.col("image.width").alias("width"),
        F.col("image.nChannels").alias("channels"),
        F.col("image.data").alias("data"),
    )


def _array(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    return np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels)


def rgb_array(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    a = _array(data, height, width, channels)
    return np.repeat(a, 3, axis=2) if channels == 1 else a[:, :, 2::-1]


def grey_array(rgb: np.ndarray) -> np.ndarray:
    return (rgb.astype(np.int32) @ np.array(GREY, dtype=np.int32) + (1 << (GREY_SHIFT - 1))) >> GREY_SHIFT


def mask_array(data: bytes, height: int, width: int, channels: int, threshold: int = MASK_THRESHOLD) -> np.ndarray:
    """Four channels are read from the first, three are made grey."""
    a = _array(data, height, width, channels)
    level = grey_array(a[:, :, 2::-1]) if channels == 3 else a[:, :, 0]
    return level > threshold


def at_size(mask: np.ndarray, height: int, width: int) -> np.ndarray:
    """Nearest neighbour and nothing else: a mask has no fractions."""
    ys = np.minimum((np.arange(height) * mask.shape[0]) // height, mask.shape[0] - 1)
    xs = np.minimum((np.arange(width) * mask.shape[1]) // width, mask.shape[1] - 1)
    return mask[np.ix_(ys, xs)]


def with_mask(frames: DataFrame, masks: DataFrame, frame_key: Column, mask_key: Column) -> DataFrame:
    """Frames beside the mask of the same key; frames without one stay."""
    m = masks.where("height > 0").select(
        mask_key.alias("image_id"),
        F.struct("height", "width", "channels", "data").alias("mask"),
    )
    f = frames.select(frame_key.alias("image_id"), "height", "width", "channels", "data")
    return f.join(m, "image_id", "left")


def _mask_of(row: object, height: int, width: int) -> np.ndarray | None:
    if row is None or not len(row):  # type: ignore[arg-type]
        return None
    m = row if isinstance(row, dict) else row.asDict()  # type: ignore[attr-defined]
    return at_size(mask_array(m["data"], m["height"], m["width"], m["channels"]), height, width)


def _count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in parts:
        for row in pdf.itertuples(index=False):
            if row.height < 1:
                continue
            rgb = rgb_array(row.data, row.height, row.width, row.channels).reshape(-1, 3).astype(np.int64)
            mask = _mask_of(row.mask, row.height, row.width)
            packed = (rgb[:, 0] << 16) | (rgb[:, 1] << 8) | rgb[:, 2]
            if mask is not None:
                packed = packed | (mask.reshape(-1).astype(np.int64) << 24)
            code, n = np.unique(packed, return_counts=True)
            yield pd.DataFrame(
                {
                    "image_id": row.image_id,
                    "r": (code >> 16) & 255,
                    "g": (code >> 8) & 255,
                    "b": code & 255,
                    "in_roi": None if mask is None else (code >> 24).astype(bool),
                    "n": n,
                }
            )


def colour_counts(paired: DataFrame) -> DataFrame:
    """Counts per image, region and colour: what all colour features need."""
    return paired.mapInPandas(_count, COUNTS)


def _stencil(grey: np.ndarray) -> np.ndarray:
    side = np.pad(grey, 1, mode="reflect") if min(grey.shape) > 1 else np.pad(grey, 1, mode="edge")
    return side[:-2, 1:-1] + side[2:, 1:-1] + side[1:-1, :-2] + side[1:-1, 2:] - 4 * grey


def _measure(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in parts:
        rows = []
        for row in pdf.itertuples(index=False):
            if row.height < 1:
                rows.append((row.image_id, None, None, None, None, row.width, row.height))
                continue
            grey = grey_array(rgb_array(row.data, row.height, row.width, row.channels))
            mask = _mask_of(row.mask, row.height, row.width)
            rows.append(
                (
                    row.image_id, float(grey.mean()), float((grey >= 255).mean()), float(_stencil(grey).var()),
                    None if mask is None else float(mask.mean()), row.width, row.height,
                )
            )
        yield pd.DataFrame(rows, columns=["image_id", "luma", "clipped", "sharpness", "roi_area", "width", "height"])


def quality_measures(paired: DataFrame) -> DataFrame:
    """Focus and exposure straight from the buffers, one row per image."""
    return paired.mapInPandas(_measure, MEASURES)


def _mask_size(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in parts:
        rows = [
            (r.path, float(mask_array(r.data, r.height, r.width, r.channels).mean()) if r.height > 0 else None, r.height, r.width)
            for r in pdf.itertuples(index=False)
        ]
        yield pd.DataFrame(rows, columns=["path", "area", "height", "width"])


def mask_areas(masks: DataFrame) -> DataFrame:
    """Share of set pixels and size of every mask file."""
    return masks.mapInPandas(_mask_size, "path string, area double, height int, width int")
