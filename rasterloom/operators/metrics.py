"""Measures of a fused result: quantiles by rank, masks, errors, envelopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.rasters import Raster


def gradient(r: Raster, col: str) -> Raster:
    """Squared central-difference gradient, 0 on the border."""
    row, column = Window.partitionBy(*r.keys, "y").orderBy("x"), Window.partitionBy(*r.keys, "x").orderBy("y")
    gx = F.lead(col).over(row) - F.lag(col).over(row)
    gy = F.lead(col).over(column) - F.lag(col).over(column)
    two = r.df.select(*r.at, col, gx.alias("gx")).select(*r.at, col, "gx", gy.alias("gy"))
    return r.having(two.select(*r.at, col, F.coalesce(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy"), F.lit(0)).alias("grad")), (col, "grad"))


def at_rank(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """For each key the elements at ``floor(share * n)`` of the sorted values: no interpolation.

    Counts of different values are summed first, so that a rank is looked up among values, not rows.
    """
    counts = df.groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*keys)
    ranked = counts.withColumn("_end", F.sum("_n").over(whole.orderBy("_v"))).withColumn("_all", F.sum("_n").over(whole))

    def found(share: float) -> Column:
        rank = F.least(F.floor(F.col("_all") * share), F.col("_all") - 1)
        return F.max(F.when((rank >= F.col("_end") - F.col("_n")) & (rank < F.col("_end")), F.col("_v")))

    return ranked.groupBy(*keys).agg(*[found(s).alias(n) for n, s in shares.items()])


def gradient_masks(r: Raster, col: str, edge_share: float = 0.02, flat_share: float = 0.5) -> DataFrame:
    """The pixels with whether they are among the strongest edges and among the flattest."""
    g = gradient(r, col)
    cuts = at_rank(g.df, list(r.keys), "grad", {"hi": 1 - edge_share, "lo": flat_share})
    return g.df.join(cuts, list(r.keys)).select(*r.at, col, "grad", (F.col("grad") >= F.col("hi")).alias("edge"), (F.col("grad") <= F.col("lo")).alias("flat"))


def masked_energy(masks: DataFrame, energy: DataFrame, at: list[str], keys: list[str], value: str) -> DataFrame:
    both = masks.select(*at, "edge", "flat").join(energy, at)
    return both.groupBy(*keys).agg(F.avg(F.when(F.col("edge"), F.col(value))).alias("detail"), F.avg(F.when(F.col("flat"), F.col(value))).alias("bokeh"))


def oracle_ceiling(energy: Raster, col: str, frame: str = "frame_idx") -> DataFrame:
    """Mean of the per-pixel best, and the best frame's mean."""
    rest = [k for k in energy.keys if k != frame]
    best = energy.df.groupBy(*rest, "y", "x").agg(F.max(col).alias("m")).groupBy(*rest).agg(F.avg("m").alias("per_pixel"))
    frames = energy.df.groupBy(*rest, frame).agg(F.avg(col).alias("m")).groupBy(*rest).agg(F.max("m").alias("single"))
    return best.join(frames, rest)


def rmse(a: Raster, b: Raster, col: str, masks: DataFrame | None = None) -> DataFrame:
    both = a.df.select(*a.at, F.col(col).alias("_a")).join(b.df.select(*b.at, F.col(col).alias("_b")), a.at)
    e = (F.col("_a") - F.col("_b")).cast("double")
    aggs = [F.sqrt(F.avg(e * e)).alias("rmse")]
    if masks is not None:
        both = both.join(masks.select(*a.at, "edge"), a.at)
        aggs.append(F.sqrt(F.avg(F.when(F.col("edge"), e * e))).alias("rmse_edges"))
    return both.groupBy(*a.keys).agg(*aggs)


def row_errors(a: Raster, b: Raster, col: str) -> DataFrame:
    both = a.df.select(*a.at, F.col(col).alias("_a")).join(b.df.select(*b.at, F.col(col).alias("_b")), a.at)
    return both.groupBy(*a.keys, "y").agg(F.avg(F.abs(F.col("_a") - F.col("_b")).cast("double")).alias("mae"))


def row_error_summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, upper median and worst of row errors (y, mae), and the worst over the median."""
    middle = at_rank(rows, keys, "mae", {"median": 0.5})
    ends = rows.groupBy(*keys).agg(F.avg("mae").alias("mean"), F.max("mae").alias("worst"))
    return ends.join(middle, keys).withColumn("ratio", F.try_divide("worst", "median"))


def weighted_mean(r: Raster, weights: Raster, col: str, weight: str = "w", frame: str = "frame_idx") -> DataFrame:
    """Per pixel the sum over frames of weight times value: fusing without a pyramid, as a control."""
    rest = [k for k in r.keys if k != frame]
    both = r.df.select(*r.at, col).join(weights.df.select(*weights.at, F.col(weight).alias("_w")), r.at)
    return both.groupBy(*rest, "y", "x").agg(F.sum(F.col("_w") * F.col(col)).alias(col))


def chroma(r: Raster) -> DataFrame:
    """A frame's population deviation of Cb and Cr and its mean brightness (fixed BT.601 weights)."""
    y = 0.299 * F.col("r") + 0.587 * F.col("g") + 0.114 * F.col("b")
    cb, cr = 0.564 * (F.col("b") - y), 0.713 * (F.col("r") - y)
    return r.df.groupBy(*r.keys).agg(F.stddev_pop(cb).alias("sd_cb"), F.stddev_pop(cr).alias("sd_cr"), F.avg(y).alias("mean_y"))


def nearest_frame(frames: DataFrame, value: str, frame: str = "frame_idx") -> DataFrame:
    """For each frame the other of the nearest value, ties to the lower frame; none for a null value or a lone frame.

    Only the lowest frames of the same value and of the values beside it can be nearest, so no pairs are made.
    """
    own = frames.select(frame, F.col(value).alias("_v")).where("_v is not null")
    line = Window.orderBy("_v")  # a row a different value of a stack's frames
    lowest = own.groupBy("_v").agg(F.min(frame).alias("_low"))
    beside = lowest.select("_v", "_low", *[f(F.struct("_v", "_low")).over(line).alias(n) for n, f in (("_below", F.lag), ("_above", F.lead))])
    both = own.join(beside, "_v")
    second = both.where(F.col(frame) != F.col("_low")).groupBy("_v").agg(F.min(frame).alias("_second"))
    both = both.join(second, "_v", "left")

    def candidate(v: Column, other: Column) -> Column:
        return F.when(other.isNotNull(), F.struct(F.abs(F.col("_v") - v).alias("d"), other.alias("other")))

    same = F.when(F.col(frame) == F.col("_low"), F.col("_second")).otherwise(F.col("_low"))
    found = [candidate(F.col("_v"), same), *[candidate(F.col(f"{n}._v"), F.col(f"{n}._low")) for n in ("_below", "_above")]]
    return both.select(frame, F.array_min(F.array(*found)).getField("other").alias("nearest")).where("nearest is not null")


def envelope(frames: Raster, result: Raster, col: str) -> DataFrame:
    """How many result pixels lie above and below what any frame has at their place."""
    rest = list(result.keys)
    range_ = frames.df.groupBy(*rest, "y", "x").agg(F.min(col).alias("lo"), F.max(col).alias("hi"))
    both = result.df.select(*result.at, F.col(col).alias("_v")).join(range_, result.at)
    return both.groupBy(*rest).agg(F.sum((F.col("_v") > F.col("hi")).cast("long")).alias("above"), F.sum((F.col("_v") < F.col("lo")).cast("long")).alias("below"))


def effective_frames(noise: Column, fused: Column) -> Column:
    return F.pow(F.try_divide(noise, fused), 2)


def checksum(r: Raster) -> DataFrame:
    """A digest of all samples that does not depend on row order."""
    h = F.conv(F.substring(F.md5(F.concat_ws(",", *[F.col(c).cast("string") for c in (*r.at, *r.cols)])), 1, 15), 16, 10).cast("long")
    return r.df.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("x"), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))).alias("s"))
