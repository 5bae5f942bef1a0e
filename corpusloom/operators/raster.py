"""Pictures of layouts of any size: points are counted by pixel, and only pixels reach the driver."""

from __future__ import annotations

import struct
import zlib
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.coords import palette
from corpusloom.functions.text import label_encode

Bounds = tuple[float, float, float, float]


def bounds_of(df: DataFrame) -> Bounds:
    """Least and largest x, least and largest y."""
    return tuple(df.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first())


def pixels(df: DataFrame, width: int, height: int, bounds: Bounds, label: str) -> DataFrame:
    """(px, py, n, label): points of each pixel, from the top left, and the most frequent label of them, on ties the least."""
    low_x, high_x, low_y, high_y = bounds
    place = lambda c, low, high, size: F.least(F.lit(size - 1), F.floor((F.col(c) - low) / ((high - low) or 1.0) * size)).cast("int")
    at = df.select(place("x", low_x, high_x, width).alias("px"), (height - 1 - place("y", low_y, high_y, height)).cast("int").alias("py"), F.col(label).alias("label"))
    each = at.groupBy("px", "py", "label").agg(F.count("*").alias("n"))
    return each.groupBy("px", "py").agg(F.sum("n").alias("total"), F.min(F.struct((-F.col("n")).alias("m"), "label")).alias("most")).select("px", "py", F.col("total").alias("n"), F.col("most.label").alias("label"))


def picture(df: DataFrame, label: str, width: int = 600, height: int = 600) -> np.ndarray:
    """A (height, width, 3) image of (x, y, label) in the labels' colours, brighter where more points lie, on black."""
    out = np.zeros((height, width, 3), np.uint8)
    coded = label_encode(df.select("row_id", "x", "y", label), label, "code")
    found = pixels(coded, width, height, bounds_of(df), "code")
    rows = found.select("px", "py", "n", *palette(F.col("label"))).collect()  # a row for each pixel at most
    most = np.log1p(max((r["n"] for r in rows), default=1))
    for r in rows:
        out[r["py"], r["px"]] = np.array([r["r"], r["g"], r["b"]]) * (0.4 + 0.6 * np.log1p(r["n"]) / most)
    return out


def png(image: np.ndarray) -> bytes:
    """An RGB image in the PNG format, eight bits a channel, without filters."""
    height, width, _ = image.shape

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    lines = np.c_[np.zeros((height, 1), np.uint8), image.reshape(height, width * 3)]
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 9)) + chunk(b"IEND", b"")


def write_gate(path: str | Path, layout: DataFrame, shuffled: DataFrame, label: str, size: int = 600) -> None:
    """The layout and that of shuffled columns side by side."""
    gap = np.full((size, 8, 3), 255, np.uint8)
    Path(path).write_bytes(png(np.concatenate([picture(layout, label, size, size), gap, picture(shuffled, label, size, size)], axis=1)))
