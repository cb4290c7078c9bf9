"""Rectangles of anchor pixels that a transformed frame can fill: half-open x0, y0, x1, y1, a row a frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pixels trimmed from each side that falls short of the frame.
TRIM = 2


def _side(n: int, shift: Column, scale: Column) -> tuple[Column, Column]:
    half = n / 2

    def held(c: Column) -> Column:
        return F.least(F.greatest(c, F.lit(0.0)), F.lit(float(n))).cast("int")

    lo = held(F.ceil(half + F.try_divide(-shift - half, scale)).cast("double"))
    hi = held((F.floor(half + F.try_divide(n - 1 - shift - half, scale)) + 1).cast("double"))
    hi = F.greatest(hi, lo)
    lo2 = F.when(lo > 0, lo + TRIM).otherwise(lo)
    hi2 = F.when(hi < n, F.greatest(hi - TRIM, F.lit(0))).otherwise(hi)
    return lo2.cast("int"), F.greatest(hi2, lo2).cast("int")


def coverage(transforms: DataFrame, w: int, h: int) -> DataFrame:
    """frame_idx, x0, y0, x1, y1."""
    x0, x1 = _side(w, F.col("dx"), F.col("scale"))
    y0, y1 = _side(h, F.col("dy"), F.col("scale"))
    return transforms.select("frame_idx", x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def reduced(rects: DataFrame, w: int, h: int) -> DataFrame:
    """The rectangles one pyramid level up, never reaching further inward than the pixels they cover."""

    def lo(c: str) -> Column:
        return F.ceil(F.col(c) / 2).cast("int").alias(c)

    def hi(c: str, n: int) -> Column:
        return F.when(F.col(c) >= n, -(-n // 2)).otherwise(F.floor(F.col(c) / 2)).cast("int").alias(c)

    return rects.select("frame_idx", lo("x0"), lo("y0"), hi("x1", w), hi("y1", h))


def every_frame(rects: DataFrame) -> DataFrame:
    """The intersection, one row; disjoint rectangles give an empty one."""
    one = rects.agg(F.max("x0").alias("x0"), F.max("y0").alias("y0"), F.min("x1").alias("x1"), F.min("y1").alias("y1"))
    return one.select("x0", "y0", F.greatest("x0", "x1").alias("x1"), F.greatest("y0", "y1").alias("y1"))


def contains(x: Column, y: Column, prefix: str = "") -> Column:
    return (x >= F.col(f"{prefix}x0")) & (x < F.col(f"{prefix}x1")) & (y >= F.col(f"{prefix}y0")) & (y < F.col(f"{prefix}y1"))
