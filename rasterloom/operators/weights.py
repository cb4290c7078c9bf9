"""Labels and weights: arg-max over frames, guided filter, normalisation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..sources.rasters import Raster
from .stencil import box_mean


def argmax_labels(r: Raster, col: str, frame: str = "frame_idx") -> Raster:
    """Per pixel the frame of the greatest value; ties to the lowest frame, NaN never wins, all NaN gives 0."""
    rest = tuple(k for k in r.keys if k != frame)
    value = F.when(~F.isnan(F.col(col).cast("double")), F.struct(F.col(col).alias("v"), (-F.col(frame)).alias("f")))
    best = r.df.groupBy(*rest, "y", "x").agg(F.max(value).alias("m"))
    out = best.select(*rest, "y", "x", F.coalesce(-F.col("m.f"), F.lit(0)).cast("int").alias("label"), F.col("m.v").alias(col))
    return Raster(out, rest, r.w, r.h, ("label", col))


def one_hot(r: Raster, labels: Raster, frame: str = "frame_idx") -> Raster:
    """1 where the frame is the pixel's label, else 0, for every pixel of every frame."""
    joined = r.df.select(*r.at).join(labels.df.select(*labels.at, "label"), labels.at)
    return r.having(joined.select(*r.at, (F.col("label") == F.col(frame)).cast("double").alias("w")), ("w",))


def guided_filter(r: Raster, guide: str, mask: str, radius: int, epsilon: float) -> Raster:
    """Edge-preserving smoothing of ``mask`` along ``guide``; the four inner means share their windows."""
    i, p = F.col(guide).cast("double"), F.col(mask).cast("double")
    moments = box_mean(r.map(i=i, p=p, ip=i * p, ii=i * i), radius)
    a = F.try_divide(F.col("ip") - F.col("i") * F.col("p"), F.col("ii") - F.col("i") * F.col("i") + epsilon)
    slopes = moments.having(moments.df.select("*", a.alias("a")).select(*r.at, F.coalesce("a", F.lit(0.0)).alias("a"), (F.col("p") - F.coalesce("a", F.lit(0.0)) * F.col("i")).alias("b")), ("a", "b"))
    means = box_mean(slopes, radius)
    both = means.df.join(r.df.select(*r.at, i.alias("_i")), r.at)
    return r.having(both.select(*r.at, (F.col("a") * F.col("_i") + F.col("b")).alias("q")), ("q",))


def refine(r: Raster, guide: str, mask: str, radius: int, epsilon: float) -> Raster:
    q = guided_filter(r, guide, mask, radius, epsilon)
    return q.map(w=F.greatest("q", F.lit(0.0)))


def normalised(r: Raster, frames: int, col: str = "w", frame: str = "frame_idx") -> Raster:
    """Weights over their sum, or equal shares where the sum is nothing."""
    over = Window.partitionBy(*[k for k in r.keys if k != frame], "y", "x")
    total = F.sum(col).over(over)
    return r.map(**{col: F.when(total > 1e-8, F.try_divide(F.col(col), total)).otherwise(1.0 / frames)})
