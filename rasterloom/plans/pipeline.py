"""The whole run: register, measure focus, weigh, fuse; each stage can be replaced."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import fusion, registration, stencil, weights
from ..sources.rasters import Raster
from .params import Params


class Registration(Protocol):
    def __call__(self, frames: Raster, n: int) -> DataFrame: ...


class FocusMetric(Protocol):
    def __call__(self, frames: Raster, transforms: DataFrame) -> Raster: ...


class WeightEstimator(Protocol):
    def __call__(self, focus: Raster, guides: Raster, n: int) -> Raster: ...


class ImageFusion(Protocol):
    def __call__(self, frames: Raster, weights: Raster, transforms: DataFrame) -> Raster: ...


def small_params() -> Params:
    return Params(registration_level=0, focus_radius=1, guide_radius=1, pyramid_floor=4)


def luminance(r: Raster) -> Raster:
    return r.map(l=scalar.luma(*[F.col(c) for c in r.cols]))


def register_stack(level: int) -> Registration:
    """Neighbouring frames' luma at a level, a frame in a row, correlated pair by pair, then chained."""

    def run(frames: Raster, n: int) -> DataFrame:
        small = stencil.block_mean(luminance(frames), level)
        cells = F.sort_array(F.collect_list(F.struct("y", "x", "l")))
        arrays = small.df.groupBy("frame_idx").agg(F.transform(cells, lambda c: c.l).alias("a"))
        wanted = registration.pairs(arrays.select("frame_idx"), n)
        paired = wanted.join(arrays.withColumnRenamed("a", "b"), "frame_idx").join(arrays.withColumnRenamed("frame_idx", "reference"), "reference")
        steps = registration.register(paired.select(F.col("frame_idx").alias("pair"), F.lit(small.w).alias("w"), "a", "b"), level)
        middle = frames.df.sparkSession.range(1).select(F.lit(n // 2).alias("frame_idx"), F.lit(1.0).alias("scale"), F.lit(0.0).alias("dx"), F.lit(0.0).alias("dy"))
        return registration.chained(steps.select(F.col("pair").alias("frame_idx"), "scale", "dx", "dy").unionByName(middle), n)

    return run


def windowed_laplacian(radius: int) -> FocusMetric:
    """Measured in the frame, then warped: never the other way round."""

    def run(frames: Raster, transforms: DataFrame) -> Raster:
        return stencil.warp(stencil.focus_measure(luminance(frames), radius), transforms)

    return run


def guided_weights(radius: int, epsilon: float, perceptual: bool) -> WeightEstimator:
    def run(focus: Raster, guides: Raster, n: int) -> Raster:
        hot = weights.one_hot(focus, weights.argmax_labels(focus, focus.cols[0]))
        guide = guides.map(i=scalar.guide_value(F.col(guides.cols[0]), perceptual))
        both = guide.having(guide.df.join(hot.df, guide.at).withColumnRenamed("w", "p"), ("i", "p"))
        return weights.normalised(weights.refine(both, "i", "p", radius, epsilon), n)

    return run


def fuse_stack(frames: Raster, params: Params, n: int, register: Registration | None = None) -> DataFrame:
    """The fused samples of a stack of ``n`` frames of linear light."""
    transforms = (register or register_stack(params.registration_level))(frames, n)
    focus = windowed_laplacian(params.focus_radius)(frames, transforms)
    guides = stencil.warp(luminance(frames), transforms)
    w = guided_weights(params.guide_radius, params.guide_epsilon, params.guide_perceptual)(focus, guides, n)
    return fusion.fuse(frames, w, transforms, params.fusion, params.pyramid_floor).df


def display_plane(r: Raster, col: str) -> Raster:
    """ln(1 + v) of what is above 0, stretched to 0..1 within each key."""
    logs = r.df.select(*r.at, F.log1p(F.greatest(F.col(col), F.lit(0)).cast("double")).alias("t"))
    ends = logs.groupBy(*r.keys).agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    span = F.col("hi") - F.col("lo")
    both = logs.join(ends, list(r.keys))
    return r.having(both.select(*r.at, F.when(span > 1e-12, (F.col("t") - F.col("lo")) / span).otherwise(0.0).alias("t")), ("t",))


def sampled(frames: DataFrame, n: int) -> DataFrame:
    """The first, middle and last frame."""
    return frames.where(F.col("frame_idx").isin(sorted({0, n // 2, n - 1})))


def sampled_of_each(frames: DataFrame, stack: str) -> DataFrame:
    """The first, middle and last frame of each stack, by the stack's own number of frames."""
    n = frames.groupBy(stack).agg((F.max("frame_idx") + 1).alias("_n"))  # a row a stack
    k = F.col("frame_idx")
    return frames.join(n, stack).where((k == 0) | (k == F.expr("_n div 2")) | (k == F.col("_n") - 1)).drop("_n")
