"""The row layout for large frames: a row of pixels is an array, bands of rows with a halo are NumPy arrays.

Results equal the pixel layout's. A task holds one band of a frame, never the frame.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.rasters import Raster

BAND_ROWS = 256


def to_rows(r: Raster, col: str) -> DataFrame:
    """keys, y, data: a row a line of pixels."""
    cells = F.sort_array(F.collect_list(F.struct("x", F.col(col).cast("double").alias("v"))))
    return r.df.groupBy(*r.keys, "y").agg(F.transform(cells, lambda c: c.v).alias("data"))


def to_pixels(rows: DataFrame, keys: tuple[str, ...], w: int, h: int, col: str = "v") -> Raster:
    df = rows.select(*keys, "y", F.posexplode("data").alias("x", col))
    return Raster(df, keys, w, h, (col,))


def banded(rows: DataFrame, keys: tuple[str, ...], h: int, halo: int, kernel: Callable[[np.ndarray], np.ndarray], band: int = BAND_ROWS) -> DataFrame:
    """``kernel`` over bands of rows with ``halo`` rows of their neighbours; frame edges are replicated.

    ``kernel`` gets rows + 2 halo lines and returns as many; the halo's lines are dropped.
    """
    first = F.floor(F.greatest(F.col("y") - halo, F.lit(0)) / band).cast("int")
    last = F.floor(F.least(F.col("y") + halo, F.lit(h - 1)) / band).cast("int")
    spread = rows.select(*keys, "y", "data", F.explode(F.sequence(first, last)).alias("_band"))

    def run(key: tuple, lines: pd.DataFrame) -> pd.DataFrame:
        top = key[-1] * band
        bottom = min(top + band, h)
        lines = lines.sort_values("y")
        have = np.stack(lines.data.to_numpy())
        begin = int(lines.y.iat[0])
        index = np.clip(np.arange(top - halo, bottom + halo), 0, h - 1) - begin
        out = kernel(have[index])[halo : halo + bottom - top]
        got = pd.DataFrame({"y": np.arange(top, bottom, dtype=np.int32), "data": list(out)})
        for name, value in zip(keys, key):
            got[name] = value
        return got[[*keys, "y", "data"]]

    types = dict(rows.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", y int, data array<double>"
    return spread.groupBy(*keys, "_band").applyInPandas(run, schema)


def box_kernel(radius: int) -> Callable[[np.ndarray], np.ndarray]:
    def run(a: np.ndarray) -> np.ndarray:
        for axis in (0, 1):
            pad = [(0, 0), (0, 0)]
            pad[axis] = (radius + 1, radius)
            s = np.cumsum(np.pad(a, pad, mode="edge"), axis=axis)
            n = a.shape[axis]
            a = np.take(s, np.arange(2 * radius + 1, n + 2 * radius + 1), axis=axis) - np.take(s, np.arange(n), axis=axis)
        return a

    return run


def laplacian_kernel(a: np.ndarray) -> np.ndarray:
    p = np.pad(a, 1, mode="edge")
    return (p[1:-1, :-2] + p[1:-1, 2:] + p[:-2, 1:-1] + p[2:, 1:-1] - 4 * a) ** 2


def focus_rows(rows: DataFrame, keys: tuple[str, ...], h: int, radius: int, band: int = BAND_ROWS) -> DataFrame:
    """Windowed Laplacian energy; the Laplacian outside the frame is that of the replicated edge line."""
    energy = banded(rows, keys, h, 1, laplacian_kernel, band)
    return banded(energy, keys, h, radius, box_kernel(radius), band)
