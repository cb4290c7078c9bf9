"""Fusing a stack: per-level arg-max of salience or weighted means, then reconstruction."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import level_count, sizes
from ..sources.rasters import Raster, materialised
from . import coverage as cov
from .stencil import _combined, box_sum, gaussian_pyramid, laplacian_pyramid, reconstruct, reduce, warp


@dataclass(frozen=True)
class Select:
    """At band levels the most salient frame's samples; means at the coarsest level."""

    salience_radius: int = 2
    token = "select"
    label = "Select"
    summary = "the sharpest frame at each pixel and scale"


@dataclass(frozen=True)
class Blend:
    """Weighted means at every level."""

    token = "blend"
    label = "Blend"
    summary = "a weighted mean at each scale"


RULES = {Select.token: Select, Blend.token: Blend}


def rule(token: str, salience_radius: int | None = None) -> Select | Blend:
    """The rule of that name; a salience radius means nothing to ``blend``."""
    kind = RULES[token]
    return kind(salience_radius) if kind is Select and salience_radius is not None else kind()


def energy(r: Raster) -> Column:
    return sum((F.col(c) * F.col(c) for c in r.cols), F.lit(0.0))


def salience(r: Raster, radius: int) -> Raster:
    """Windowed energy over all channels together."""
    return box_sum(r.map(s=energy(r)), radius)


def _covered(r: Raster, rects: DataFrame | None) -> DataFrame:
    if rects is None:
        return r.df
    return r.df.join(F.broadcast(rects), "frame_idx").where(cov.contains(F.col("x"), F.col("y"))).select(*r.df.columns)  # a row a frame


def _on_grid(r: Raster, found: DataFrame, cols: tuple[str, ...]) -> Raster:
    """``found`` on the full grid, 0 where no frame covers."""
    rest = tuple(k for k in r.keys if k != "frame_idx")
    spark = r.df.sparkSession
    # The rest's keys, without a pass over pixels where there are none, times the grid.
    lines = r.df.select(*rest).distinct() if rest else spark.range(1).select()
    lines = lines.select("*", F.explode(F.sequence(F.lit(0), F.lit(r.h - 1))).alias("y"))
    grid = lines.select("*", F.explode(F.sequence(F.lit(0), F.lit(r.w - 1))).alias("x"))
    full = grid.join(found, [*rest, "y", "x"], "left")
    return Raster(full.select(*rest, "y", "x", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in cols]), rest, r.w, r.h, cols)


def select_level(r: Raster, radius: int, rects: DataFrame | None = None) -> Raster:
    """Per pixel the samples of the covering frame of the greatest salience; ties to the earliest frame."""
    s = salience(r, radius)
    both = r.df.join(s.df, r.at)
    inside = _covered(r.having(both, (*r.cols, "s")), rects).where(~F.isnan(F.col("s").cast("double")))  # NaN never wins
    rest = [k for k in r.keys if k != "frame_idx"]
    key = F.struct(F.col("s").alias("s"), (-F.col("frame_idx")).alias("f"), *[F.col(c).cast("double").alias(c) for c in r.cols])
    best = inside.groupBy(*rest, "y", "x").agg(F.max(key).alias("m")).where("m.s > -1")
    return _on_grid(r, best.select(*rest, "y", "x", *[F.col(f"m.{c}").alias(c) for c in r.cols]), r.cols)


def require_same_frames(r: Raster, weights: Raster, frame: str = "frame_idx") -> None:
    """Every frame must have a weight plane and every plane a frame; counts rows a frame, one job."""
    both = r.df.groupBy(frame).count().join(weights.df.groupBy(frame).agg(F.count(F.lit(1)).alias("planes")), frame, "full")
    odd = both.where(F.col("count").isNull() | F.col("planes").isNull() | (F.col("count") != F.col("planes"))).first()
    if odd:
        raise ValueError(f"frame {odd[frame]}: {odd['count'] or 0} pixels, {odd['planes'] or 0} weights")


def accumulate(r: Raster, weights: Raster, rects: DataFrame | None = None) -> Raster:
    """Sums of weight times sample and of weights over the covering frames; a partial aggregate, so it streams."""
    both = r.df.join(weights.df.select(*weights.at, F.col(weights.cols[0]).alias("_w")), r.at)
    inside = _covered(r.having(both, (*r.cols, "_w")), rects)
    rest = [k for k in r.keys if k != "frame_idx"]
    sums = inside.groupBy(*rest, "y", "x").agg(*[F.sum(F.col("_w") * F.col(c)).alias(c) for c in r.cols], F.sum("_w").alias("tally"))
    return _on_grid(r, sums, (*r.cols, "tally"))


def normalise_uncovered(acc: Raster, every: DataFrame | None) -> Raster:
    """Sums over their tally, only outside the rectangle that every frame covers and where there is a tally."""
    cols = tuple(c for c in acc.cols if c != "tally")
    if every is None:
        return acc.having(acc.df.drop("tally"), cols)
    one = acc.df.crossJoin(F.broadcast(every))  # one row
    keep = cov.contains(F.col("x"), F.col("y")) | (F.col("tally") <= 0)
    return acc.having(one.select(*acc.at, *[F.when(keep, F.col(c)).otherwise(F.try_divide(F.col(c), F.col("tally"))).alias(c) for c in cols]), cols)


def fuse(r: Raster, weights: Raster, transforms: DataFrame, how: Select | Blend, floor: int = 32) -> Raster:
    """The fused raster (without the frame key). Under ``select`` no weight pyramid is kept, only its last level."""
    levels = level_count(r.w, r.h, floor)
    bands = laplacian_pyramid(warp(r, transforms), levels, step=materialised)
    weights = materialised(weights)
    all_sizes = sizes(r.w, r.h, levels)
    rects = [cov.coverage(transforms, r.w, r.h)]
    for w, h in all_sizes[:-1]:
        rects.append(cov.reduced(rects[-1], w, h))
    every = [cov.every_frame(rects[0])]
    for w, h in all_sizes[:-1]:
        every.append(cov.reduced(every[-1].withColumn("frame_idx", F.lit(0)), w, h).drop("frame_idx"))
    if isinstance(how, Blend):
        planes = gaussian_pyramid(weights, levels)
        fused = [normalise_uncovered(accumulate(b, w, q), e) for b, w, q, e in zip(bands, planes, rects, every)]
    else:
        coarse = weights
        for _ in range(levels - 1):
            coarse = reduce(coarse)
        fused = [select_level(b, how.salience_radius, q) for b, q in zip(bands[:-1], rects)]
        fused.append(normalise_uncovered(accumulate(bands[-1], coarse, rects[-1]), every[-1]))
    return reconstruct(fused)


__all__ = ["Select", "Blend", "rule", "salience", "select_level", "accumulate", "normalise_uncovered", "fuse", "_combined"]
