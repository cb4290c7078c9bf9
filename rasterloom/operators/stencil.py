"""Windowed sums, stencils, resampling and pyramids over dense pixel tables.

Neighbours are read with windows along rows and columns, or by joins on a computed, clamped key; both partition
by frame and line, so that no frame has to fit in one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import sizes
from ..sources.rasters import Raster


def _axis_sum(r: Raster, axis: str, radius: int) -> Raster:
    n, other = (r.w, "y") if axis == "x" else (r.h, "x")
    line = Window.partitionBy(*r.keys, other).orderBy(axis)
    near, whole = line.rowsBetween(-radius, radius), line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before, after = F.greatest(radius - F.col(axis), F.lit(0)), F.greatest(F.col(axis) + radius - (n - 1), F.lit(0))
    return r.map(**{c: F.sum(c).over(near) + before * F.first(c).over(whole) + after * F.last(c).over(whole) for c in r.cols})


def box_sum(r: Raster, radius: int) -> Raster:
    """Sum over (2 radius + 1) squared pixels, edges replicated."""
    return _axis_sum(_axis_sum(r, "x", radius), "y", radius)


def box_mean(r: Raster, radius: int) -> Raster:
    s = box_sum(r, radius)
    return s.map(**{c: F.col(c) / float((2 * radius + 1) ** 2) for c in s.cols})


def laplacian_energy(r: Raster) -> Raster:
    """Squared four-neighbour Laplacian, edges replicated."""
    row, column = Window.partitionBy(*r.keys, "y").orderBy("x"), Window.partitionBy(*r.keys, "x").orderBy("y")

    def part(c: str, w) -> Column:
        return F.coalesce(F.lag(c).over(w), F.col(c)) + F.coalesce(F.lead(c).over(w), F.col(c))

    across = r.df.select(*r.at, *r.cols, *[part(c, row).alias(f"_{c}") for c in r.cols])
    both = across.select(*r.at, *[(F.col(f"_{c}") + part(c, column) - 4 * F.col(c)).alias(c) for c in r.cols])
    return r.having(both.select(*r.at, *[(F.col(c) * F.col(c)).alias(c) for c in r.cols]))


def focus_measure(r: Raster, radius: int) -> Raster:
    """Windowed Laplacian energy."""
    return box_sum(laplacian_energy(r), radius)


def crop(r: Raster, x0: int, y0: int, w: int, h: int) -> Raster:
    if x0 < 0 or y0 < 0 or x0 + w > r.w or y0 + h > r.h:
        raise ValueError("crop reaches outside the raster")
    inside = r.df.where(F.col("x").between(x0, x0 + w - 1) & F.col("y").between(y0, y0 + h - 1))
    return r.having(inside.withColumn("x", F.col("x") - x0).withColumn("y", F.col("y") - y0), w=w, h=h)


def block_mean(r: Raster, level: int) -> Raster:
    """Area mean over blocks of 2 ** level; what does not fill a block is dropped."""
    f = 1 << level
    w, h = r.w // f, r.h // f
    if not w or not h:
        raise ValueError("the raster is smaller than a block")
    inside = r.df.where((F.col("x") < w * f) & (F.col("y") < h * f))
    blocks = inside.groupBy(*r.keys, F.expr(f"cast(y div {f} as int)").alias("y"), F.expr(f"cast(x div {f} as int)").alias("x"))
    return r.having(blocks.agg(*[F.avg(c).alias(c) for c in r.cols]), w=w, h=h)


def region_mean(r: Raster, x0: int, y0: int, w: int, h: int, target_w: int, max_rows: int) -> Raster:
    """A clamped region at about ``target_w`` pixels a row: means over the first rows of each block."""
    x0, y0 = min(x0, r.w - 1), min(y0, r.h - 1)
    w, h = min(max(w, 1), r.w - x0), min(max(h, 1), r.h - y0)
    f = max(w // max(target_w, 1), 1)
    out_w, out_h = max(w // f, 1), max(h // f, 1)
    rows = min(f, max(max_rows, 1))
    x, y = F.col("x") - x0, F.col("y") - y0
    inside = r.df.where(F.col("x").between(x0, x0 + out_w * f - 1) & F.col("y").between(y0, y0 + out_h * f - 1) & (y % f < rows))
    blocks = inside.groupBy(*r.keys, F.floor(y / f).cast("int").alias("y"), F.floor(x / f).cast("int").alias("x"))
    return r.having(blocks.agg(*[F.avg(c).alias(c) for c in r.cols]), w=out_w, h=out_h)


def warp(r: Raster, transforms: DataFrame, clamp: bool = True) -> Raster:
    """Bilinear gather: pixel p reads its frame at T(p - c) + c. Outside: the edge, or 0 without ``clamp``.

    ``transforms``: frame_idx, scale, dx, dy, a row a frame (few, so broadcast); a frame without one stays put.
    """
    few = F.broadcast(transforms.select("frame_idx", "scale", "dx", "dy"))
    at = r.df.select(*r.at).join(few, "frame_idx", "left")
    s, dx, dy = F.coalesce("scale", F.lit(1.0)), F.coalesce("dx", F.lit(0.0)), F.coalesce("dy", F.lit(0.0))
    at = at.select(*r.at, (s * (F.col("x") - r.w / 2) + dx + r.w / 2).alias("_sx"), (s * (F.col("y") - r.h / 2) + dy + r.h / 2).alias("_sy"))
    fx, fy = F.col("_sx") - F.floor("_sx"), F.col("_sy") - F.floor("_sy")
    taps = F.array(*[
        F.struct(
            (F.floor("_sx") + i).cast("int").alias("x"), (F.floor("_sy") + j).cast("int").alias("y"),
            ((fx if i else 1 - fx) * (fy if j else 1 - fy)).alias("w"),
        )
        for j in (0, 1) for i in (0, 1)
    ])
    taken = at.select(*r.at, F.explode(taps).alias("t"))

    def held(c: Column, n: int) -> Column:
        return F.least(F.greatest(c, F.lit(0)), F.lit(n - 1)) if clamp else c

    taken = taken.select(*r.keys, F.col("y").alias("_y"), F.col("x").alias("_x"), held(F.col("t.y"), r.h).alias("y"), held(F.col("t.x"), r.w).alias("x"), F.col("t.w").alias("_w"))
    joined = taken.join(r.df, r.at, "inner" if clamp else "left")
    sums = joined.groupBy(*r.keys, F.col("_y").alias("y"), F.col("_x").alias("x"))
    return r.having(sums.agg(*[F.coalesce(F.sum(F.col("_w") * F.col(c)), F.lit(0.0)).alias(c) for c in r.cols]))


def _reduce_axis(r: Raster, axis: str) -> Raster:
    """Binomial taps 1 4 6 4 1 at even places. An even place lacks its far right tap only if the near one is the last."""
    n, other = (r.w, "y") if axis == "x" else (r.h, "x")
    line = Window.partitionBy(*r.keys, other).orderBy(axis)

    def blurred(c: str) -> Column:
        v, near = F.col(c), F.coalesce(F.lead(c).over(line), F.col(c))
        left, far = F.coalesce(F.lag(c).over(line), v), F.coalesce(F.lag(c, 2).over(line), v)
        return (far + F.coalesce(F.lead(c, 2).over(line), near) + 4 * (left + near) + 6 * v) / 16.0

    even = r.df.select(*r.at, *[blurred(c).alias(c) for c in r.cols]).where(F.col(axis) % 2 == 0)
    m = -(-n // 2)
    return r.having(even.withColumn(axis, F.floor(F.col(axis) / 2).cast("int")), w=m if axis == "x" else None, h=m if axis == "y" else None)


def reduce(r: Raster) -> Raster:
    """Binomial blur evaluated at even pixels only, edges replicated; sizes are halved, rounded up."""
    return _reduce_axis(_reduce_axis(r, "x"), "y")


def _expand_axis(r: Raster, axis: str, size: int) -> Raster:
    n, other = (r.w, "y") if axis == "x" else (r.h, "x")
    line = Window.partitionBy(*r.keys, other).orderBy(axis)

    def near(c: str) -> tuple[Column, Column]:
        return F.coalesce(F.lag(c).over(line), F.col(c)), F.coalesce(F.lead(c).over(line), F.col(c))

    sides = {c: near(c) for c in r.cols}
    wide = r.df.select(*r.at, *[e.alias(f"_{k}{c}") for c in r.cols for k, e in zip("eo", ((sides[c][0] + 6 * F.col(c) + sides[c][1]) / 8.0, (F.col(c) + sides[c][1]) / 2.0))])
    two = F.array(*[F.struct((2 * F.col(axis) + o).cast("int").alias("p"), *[F.col(f"_{'eo'[o]}{c}").alias(c) for c in r.cols]) for o in (0, 1)])
    rest = [c for c in r.at if c != axis]
    out = wide.select(*rest, F.explode(two).alias("t")).where(F.col("t.p") < size)
    df = out.select(*[F.col("t.p").alias(c) if c == axis else c for c in r.at], *[F.col(f"t.{c}").alias(c) for c in r.cols])
    return r.having(df, w=size if axis == "x" else None, h=size if axis == "y" else None)


def expand(r: Raster, w: int, h: int) -> Raster:
    """The inverse step: rows first, then columns, indices clamped to the coarse level."""
    return _expand_axis(_expand_axis(r, "x", w), "y", h)


def _combined(a: Raster, b: Raster, sign: int) -> Raster:
    right = b.df.select(*b.at, *[F.col(c).alias(f"_{c}") for c in b.cols])
    return a.having(a.df.join(right, a.at).select(*a.at, *[(F.col(c) + sign * F.col(f"_{c}")).alias(c) for c in a.cols]))


def gaussian_pyramid(r: Raster, levels: int, step: Callable[[Raster], Raster] = lambda level: level) -> list[Raster]:
    """``step`` is done to each level before the next is made of it (to cut the lineage, say)."""
    out = [step(r)]
    while len(out) < levels:
        out.append(step(reduce(out[-1])))
    return out


def laplacian_pyramid(r: Raster, levels: int, step: Callable[[Raster], Raster] = lambda level: level) -> list[Raster]:
    """Bands, finest first; the last level is the Gaussian residual."""
    g = gaussian_pyramid(r, levels, step)
    return [_combined(a, expand(b, a.w, a.h), -1) for a, b in zip(g, g[1:])] + g[-1:]


def reconstruct(pyramid: list[Raster]) -> Raster:
    out = pyramid[-1]
    for band in reversed(pyramid[:-1]):
        out = _combined(band, expand(out, band.w, band.h), 1)
    return out


def stacked(pyramid: list[Raster]) -> DataFrame:
    """All levels in one table, with the level as a column."""
    rows = [p.df.select(*p.keys, F.lit(i).alias("level"), "y", "x", *[F.col(c).cast("double").alias(c) for c in p.cols]) for i, p in enumerate(pyramid)]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out


def level_sizes(r: Raster, levels: int) -> list[tuple[int, int]]:
    return sizes(r.w, r.h, levels)
