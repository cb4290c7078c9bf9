"""Diagnostic pictures of a run: sampled frames as display planes, the first frame laid over the middle one, thumbnails."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import LUMA
from ..operators import slabs
from ..operators.bands import Rows
from ..sources import sinks

#: The longest side of a picture.
LIMIT = 1400
THUMB_WIDTH, THUMB_ROWS = 128, 4


def shrunk(r: Rows, frames: list[int], factor: int, rows: int | None = None) -> dict[int, np.ndarray]:
    """Means over blocks of ``factor`` of the given frames (over a block's first ``rows`` lines); they come to the driver."""
    w, h, width, c = max(r.w // factor, 1), max(r.h // factor, 1), r.w, r.c
    asked = r.df.where(F.col("frame_idx").isin(frames) & (F.col("y") < h * factor) & (F.col("y") % factor < (rows or factor)))

    def across(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                data = [np.asarray(d, dtype=np.float64).reshape(width, c)[: w * factor].reshape(w, -1, c).mean(axis=1).ravel() for d in b.data]
                yield pd.DataFrame({"frame_idx": b.frame_idx, "y": b.y // factor, "data": data})

    def down(lines: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"frame_idx": lines.frame_idx.iloc[:1], "y": lines.y.iloc[:1], "data": [np.stack(lines.data.to_numpy()).mean(axis=0)]})

    schema = "frame_idx int, y int, data array<double>"
    small = asked.select("frame_idx", "y", "data").mapInPandas(across, schema).groupBy("frame_idx", "y").applyInPandas(down, schema)
    out = {k: np.zeros((h, w, r.c)) for k in frames}
    for line in small.toLocalIterator():
        out[line.frame_idx][line.y] = np.asarray(line.data).reshape(w, r.c)
    return out


def display(plane: np.ndarray) -> np.ndarray:
    """ln(1 + v) of what is above 0, stretched to 0..255."""
    t = np.log1p(np.maximum(np.nan_to_num(plane), 0))
    span = t.max() - t.min()
    return np.round((t - t.min()) / span * 255 if span > 1e-12 else np.zeros(t.shape)).astype(np.uint8)


def write_debug(r: Rows, transforms: DataFrame, n: int, folder: str, limit: int = LIMIT) -> list[str]:
    """PNGs of the first, middle and last frame's brightness, and the first frame, aligned, over the middle one.

    A power of two shrinks them until no side exceeds ``limit``; a shift shrinks with them. At most three pictures
    come to the driver.
    """
    level = 0
    while max(r.w, r.h) >> level > limit:
        level += 1
    middle = n // 2
    small = {k: p @ np.array(LUMA) if r.c == 3 else p[..., 0] for k, p in shrunk(r, sorted({0, middle, n - 1}), 1 << level).items()}
    os.makedirs(folder, exist_ok=True)
    paths = []
    for k, plane in small.items():
        paths.append(os.path.join(folder, f"luma_{k:05d}.png"))
        sinks.write_png(paths[-1], display(plane))
    found = transforms.where("frame_idx = 0").first()
    t = (found.scale, found.dx / 2**level, found.dy / 2**level) if found else (1.0, 0.0, 0.0)
    h = len(small[0])
    aligned = slabs.warp(slabs.Slab(small[0][..., None], 0, h), t, 0, h).a[..., 0]
    paths.append(os.path.join(folder, "overlay.png"))
    sinks.write_png(paths[-1], sinks.overlay(small[middle], aligned))
    return paths


def thumbnail(r: Rows, frame: int, width: int = THUMB_WIDTH, rows: int = THUMB_ROWS) -> np.ndarray:
    """A frame about ``width`` pixels wide in 8-bit sRGB, from the first ``rows`` lines of each block only."""
    v = np.clip(np.nan_to_num(shrunk(r, [frame], max(r.w // max(width, 1), 1), rows)[frame]), 0, 1)
    return np.floor(np.where(v <= 0.0031308, v * 12.92, 1.055 * v ** (1 / 2.4) - 0.055) * 255 + 0.5).astype(np.uint8)
