"""Registration to fusion on rows of pixels as arrays, for large frames: each task holds bands, never a frame.

A table of rows is (frame_idx, y, data): a line of a frame, its pixels interleaved. A stage joins the lines with a
small table of the lines that each band of its result needs (a row a frame and band, broadcast up to a bound), and works on bands
with the kernels of :mod:`slabs`. What runs over frames (arg-max, sums, selection) streams a line's frames in order
through one running line, so that memory does not grow with the number of frames. Results are the pixel layout's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import LUMA, level_count, sizes
from . import coverage as cov
from . import registration, slabs
from .fusion import Blend, Select
from .slabs import Slab

BAND = 256
#: Ranges of lines, some 20 bytes each, that are broadcast; more are joined.
BROADCAST_RANGES = 1 << 18
Transform = tuple[float, float, float]
STILL: Transform = (1.0, 0.0, 0.0)


@dataclass(frozen=True)
class Rows:
    """Lines of frames of ``h`` lines of ``w`` pixels of ``c`` samples in linear light."""

    df: DataFrame
    w: int
    h: int
    c: int = 3


def from_pixels(df: DataFrame, cols: tuple[str, ...], w: int, h: int) -> Rows:
    """Of a pixel table (frame_idx, y, x, samples)."""
    cells = F.sort_array(F.collect_list(F.struct("x", F.array(*[F.col(c).cast("double") for c in cols]).alias("v"))))
    return Rows(df.groupBy("frame_idx", "y").agg(F.flatten(F.transform(cells, lambda p: p.v)).alias("data")), w, h, len(cols))


def to_pixels(df: DataFrame, cols: tuple[str, ...], key: str = "data") -> DataFrame:
    """y, x and samples of lines (y, data)."""
    c = len(cols)
    x = F.posexplode(F.expr(f"transform(sequence(0, cast(size({key}) / {c} as int) - 1), i -> slice({key}, i * {c} + 1, {c}))")).alias("x", "v")
    return df.select("y", x).select("y", "x", *[F.element_at("v", i + 1).alias(n) for i, n in enumerate(cols)])


def banded(lines: DataFrame, ranges: list[tuple], on: list[str], kernel: Callable, schema: str) -> DataFrame:
    """``kernel`` for each band over the lines it needs; ``ranges``: (*on, band, lo, hi), a row a frame (or level) and band."""
    spark = lines.sparkSession
    keys = ", ".join(f"{k} int" for k in on)
    table = spark.createDataFrame(ranges, f"{keys}{', ' if keys else ''}band int, lo int, hi int")
    if len(ranges) <= BROADCAST_RANGES:
        table = F.broadcast(table)
    wanted = (F.col("y") >= F.col("lo")) & (F.col("y") < F.col("hi"))
    dealt = (lines.join(table, on) if on else lines.crossJoin(table)).where(wanted).drop("lo", "hi")
    group = [k for k in ("frame_idx", "band") if k in dealt.columns]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(parts, *group).groupBy(*group).applyInPandas(kernel, schema)


def _slab(rows: pd.DataFrame, h: int, c: int, column: str = "data") -> Slab:
    rows = rows.sort_values("y")
    return Slab(np.stack(rows[column].to_numpy()).reshape(len(rows), -1, c), int(rows.y.iat[0]), h)


def _ends(h: int, band: int) -> list[tuple[int, int]]:
    return [(y, min(y + band, h)) for y in range(0, h, band)]


def streamed(lines: DataFrame, keys: list[str], start: Callable, add: Callable, end: Callable, schema: str) -> DataFrame:
    """One running state for each key over its frames in order: ``start()``, ``add(state, row)``, ``end(key, state)``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, None
        for b in batches:
            out = []
            for row in b.to_dict("records"):
                key = tuple(row[k] for k in keys)
                if key != at:
                    if at is not None:
                        out.append(end(at, state))
                    at, state = key, start()
                state = add(state, row)
            if out:
                yield pd.DataFrame(out)
        if at is not None:
            yield pd.DataFrame([end(at, state)])

    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return lines.repartition(parts, *keys).sortWithinPartitions(*keys, "frame_idx").mapInPandas(run, schema)


def luma(r: Rows) -> Rows:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(data=[np.asarray(d).reshape(-1, 3) @ np.array(LUMA) for d in b.data])

    return replace(r, df=r.df.select("frame_idx", "y", "data").mapInPandas(run, "frame_idx int, y int, data array<double>"), c=1)


def block_means(r: Rows, level: int) -> Rows:
    """One channel's area means over blocks of 2 ** level; what does not fill a block is dropped."""
    f = 1 << level
    w, h = r.w // f, r.h // f
    if not w or not h:
        raise ValueError("the raster is smaller than a block")

    def across(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(data=[np.asarray(d)[: w * f].reshape(w, f).mean(axis=1) for d in b.data])

    thin = r.df.where(F.col("y") < h * f).mapInPandas(across, "frame_idx int, y int, data array<double>").withColumn("block", F.expr(f"cast(y div {f} as int)"))

    def end(key: tuple, s: list) -> dict:
        return {"frame_idx": key[0], "y": key[1], "data": s[0] / f}

    means = streamed(thin, ["frame_idx", "block"], lambda: [0.0], lambda s, row: [s[0] + np.asarray(row["data"])], end, "frame_idx int, y int, data array<double>")
    return Rows(means, w, h, 1)


def registered(r: Rows, n: int, level: int) -> DataFrame:
    """frame_idx, scale, dx, dy of every frame: neighbours correlated pair by pair at a level, then chained."""
    small = block_means(luma(r), level)
    arrays = small.df.groupBy("frame_idx").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("y", "data"))), lambda s: s.data)).alias("a"))
    wanted = registration.pairs(arrays.select("frame_idx"), n)
    paired = wanted.join(arrays.withColumnRenamed("a", "b"), "frame_idx").join(arrays.withColumnRenamed("frame_idx", "reference"), "reference")
    steps = registration.register(paired.select(F.col("frame_idx").alias("pair"), F.lit(small.w).alias("w"), "a", "b"), level)
    middle = r.df.sparkSession.range(1).select(F.lit(n // 2).alias("frame_idx"), F.lit(1.0).alias("scale"), F.lit(0.0).alias("dx"), F.lit(0.0).alias("dy"))
    return registration.chained(steps.select(F.col("pair").alias("frame_idx"), "scale", "dx", "dy").unionByName(middle), n)


def of_frames(transforms: DataFrame, n: int) -> dict[int, Transform]:
    """A transform for each of ``n`` frames; one that has none stays put. A row a frame."""
    own = {q.frame_idx: (q.scale, q.dx, q.dy) for q in transforms.select("frame_idx", "scale", "dx", "dy").collect()}
    return {k: own.get(k, STILL) for k in range(n)}


def focus_and_guide(r: Rows, ts: dict[int, Transform], radius: int, perceptual: bool, band: int = BAND) -> DataFrame:
    """frame_idx, y, data (focus, measured in the frame and then warped), guide (warped luma)."""
    h = r.h
    ends = _ends(h, band)
    ranges = [(k, i, *slabs.held((e := slabs.warp_range(*y, h, t))[0] - radius - 1, e[1] + radius + 1, h)) for k, t in ts.items() for i, y in enumerate(ends)]

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        t, (lo, hi) = ts[key[0]], ends[key[1]]
        s = _slab(rows, h, 1)
        a, b = slabs.warp_range(lo, hi, h, t)
        wide = slabs.held(a - radius, b + radius, h)
        focus = slabs.warp(slabs.box(slabs.laplacian(s, *wide), a, b, radius), t, lo, hi).a[:, :, 0]
        guide = slabs.warp(s, t, lo, hi).a[:, :, 0]
        if perceptual:
            v = np.maximum(guide, 0)
            guide = np.where(v <= 0.0031308, v * 12.92, 1.055 * v ** (1 / 2.4) - 0.055)
        return pd.DataFrame({"frame_idx": key[0], "y": np.arange(lo, hi), "data": list(focus), "guide": list(guide)})

    return banded(luma(r).df, ranges, ["frame_idx"], run, "frame_idx int, y int, data array<double>, guide array<double>")


def labels(focus: DataFrame) -> DataFrame:
    """y, label: per pixel the frame of the greatest value; ties to the lowest frame, NaN never wins, all NaN gives 0."""

    def add(state, row):
        v = np.asarray(row["data"])
        best, label = state or (np.full(len(v), -np.inf), np.zeros(len(v)))
        more = v > best
        return np.where(more, v, best), np.where(more, row["frame_idx"], label)

    return streamed(focus, ["y"], lambda: None, add, lambda key, s: {"y": key[0], "label": s[1]}, "y int, label array<double>")


def weights(focus: DataFrame, n: int, h: int, radius: int, epsilon: float, band: int = BAND) -> DataFrame:
    """frame_idx, y, data: guided one-hot weights over their sum, or equal shares where the sum is nothing."""
    ends = _ends(h, band)
    ranges = [(i, *slabs.held(lo - 2 * radius, hi + 2 * radius, h)) for i, (lo, hi) in enumerate(ends)]

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        lo, hi = ends[key[1]]
        guide, label = _slab(rows, h, 1, "guide"), _slab(rows, h, 1, "label")
        q = slabs.guided(guide, replace(label, a=(label.a == key[0]).astype(float)), lo, hi, radius, epsilon)
        return pd.DataFrame({"frame_idx": key[0], "y": np.arange(lo, hi), "data": list(np.maximum(q.a[:, :, 0], 0))})

    raw = banded(focus.select("frame_idx", "y", "guide").join(labels(focus), "y"), ranges, [], run, "frame_idx int, y int, data array<double>")
    total = streamed(raw, ["y"], lambda: 0.0, lambda s, row: s + np.asarray(row["data"]), lambda key, s: {"y": key[0], "total": s}, "y int, total array<double>")

    def share(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            data = [np.where(t > 1e-8, np.asarray(d) / np.maximum(t, 1e-8), 1 / n) for d, t in zip(b.data, map(np.asarray, b.total))]
            yield b[["frame_idx", "y"]].assign(data=data)

    return raw.join(total, "y").select("frame_idx", "y", "data", "total").mapInPandas(share, "frame_idx int, y int, data array<double>")


LEVELS = "frame_idx int, level int, y int, data array<double>, s array<double>"


def pyramid(r: Rows, ts: dict[int, Transform], levels: int, radius: int | None, residual: bool = True, band: int = BAND) -> DataFrame:
    """frame_idx, level, y, data, s: Laplacian bands (or, without ``residual``, Gaussian levels) of warped frames.

    ``radius``: of the salience ``s`` of a band's line; None for none. A band's lines at all levels are one task's.
    """
    all_sizes = sizes(r.w, r.h, levels)
    tall = -(-band >> (levels - 1)) << (levels - 1) if levels > 1 else band
    tall = max(tall, 1 << (levels - 1))
    ends = _ends(r.h, tall)
    halo = radius or 0
    own, wide = [], []
    for i, (lo, hi) in enumerate(ends):
        mine = [(lo >> k, hk if i == len(ends) - 1 else hi >> k) for k, (_, hk) in enumerate(all_sizes)]
        need = [slabs.held(a - halo, b + halo, hk) if k < levels - 1 else (a, b) for k, ((a, b), (_, hk)) in enumerate(zip(mine, all_sizes))]
        for k in range(levels - 1):
            if residual:
                a, b = slabs.expand_range(*(slabs.held(mine[k][0] - halo, mine[k][1] + halo, all_sizes[k][1])), all_sizes[k + 1][1])
                need[k + 1] = min(need[k + 1][0], a), max(need[k + 1][1], b)
        for k in range(levels - 2, -1, -1):
            a, b = slabs.reduce_range(*need[k + 1], all_sizes[k][1])
            need[k] = min(need[k][0], a), max(need[k][1], b)
        own.append(mine)
        wide.append(need)
    ranges = [(k, i, *slabs.warp_range(*wide[i][0], r.h, t)) for k, t in ts.items() for i in range(len(ends))]

    full_h, c = r.h, r.c

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        frame, i = key
        t = ts[frame]
        s = _slab(rows, full_h, c)
        g = [slabs.warp(s, t, *wide[i][0]) if t != STILL else Slab(s.lines(*wide[i][0]), wide[i][0][0], full_h)]
        for k in range(1, levels):
            g.append(slabs.reduce(g[-1], *wide[i][k]))
        out = []
        for k, (a, b) in enumerate(own[i]):
            w, h = all_sizes[k]
            last = k == levels - 1 or not residual
            lo, hi = (a, b) if last else slabs.held(a - halo, b + halo, h)
            part = Slab(g[k].lines(lo, hi) - (0 if last else slabs.expand(g[k + 1], lo, hi, w, h).a), lo, h)
            sal = None if last or radius is None else slabs.box(replace(part, a=(part.a**2).sum(axis=2, keepdims=True)), a, b, radius).a[:, :, 0]
            lines = part.lines(a, b).reshape(b - a, -1)
            out.append(pd.DataFrame({"frame_idx": frame, "level": k, "y": np.arange(a, b), "data": list(lines), "s": list(sal) if sal is not None else None}))
        return pd.concat(out)

    return banded(r.df.select("frame_idx", "y", "data"), ranges, ["frame_idx"], run, LEVELS)


def fuse(r: Rows, planes: DataFrame, transforms: DataFrame, n: int, how: Select | Blend, floor: int = 32, band: int = BAND, step: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """y, data: the fused lines. ``planes``: weights (frame_idx, y, data); under ``select`` only their last level is used."""
    levels = level_count(r.w, r.h, floor)
    ts, all_sizes = of_frames(transforms, n), sizes(r.w, r.h, levels)
    select = isinstance(how, Select)
    full = r.df.sparkSession.createDataFrame([(k, *t) for k, t in ts.items()], "frame_idx int, scale double, dx double, dy double")
    rects = [{q.frame_idx: (q.x0, q.y0, q.x1, q.y1) for q in cov.coverage(full, r.w, r.h).collect()}]  # a row a frame

    def halved(rect: tuple, w: int, h: int) -> tuple:
        x0, y0, x1, y1 = rect
        return -(-x0 // 2), -(-y0 // 2), -(-w // 2) if x1 >= w else x1 // 2, -(-h // 2) if y1 >= h else y1 // 2

    x0, y0, x1, y1 = (f(v) for f, v in zip((max, max, min, min), zip(*rects[0].values())))
    every = [(x0, y0, max(x0, x1), max(y0, y1))]
    for w, h in all_sizes[:-1]:
        rects.append({k: halved(q, w, h) for k, q in rects[-1].items()})
        every.append(halved(every[-1], w, h))
    bands = step(pyramid(r, ts, levels, how.salience_radius if select else None, band=band))
    flat = pyramid(Rows(planes, r.w, r.h, 1), dict.fromkeys(range(n), STILL), levels, None, residual=False, band=band)
    flat = flat.where(F.col("level") == levels - 1) if select else flat
    both = bands.join(flat.select("frame_idx", "level", "y", F.col("data").alias("weight")), ["frame_idx", "level", "y"], "left")

    c, full_h = r.c, r.h

    def inside(rect: tuple, y: int, w: int) -> np.ndarray:
        out = np.zeros(w, dtype=bool)
        if rect[1] <= y < rect[3]:
            out[rect[0] : rect[2]] = True
        return out

    def add(state, row):
        k, y = row["level"], row["y"]
        w, v = all_sizes[k][0], np.asarray(row["data"]).reshape(-1, c)
        on = inside(rects[k][row["frame_idx"]], y, w)
        if select and k < levels - 1:
            best, out = state or (np.full(w, -1.0), np.zeros((w, c)))
            s = np.asarray(row["s"])
            more = on & (s > best)
            return np.where(more, s, best), np.where(more[:, None], v, out)
        tally, out = state or (np.zeros(w), np.zeros((w, c)))
        weight = np.where(on, np.asarray(row["weight"]), 0.0)
        return tally + weight, out + weight[:, None] * v

    def end(key: tuple, state) -> dict:
        k, y = key
        tally, out = state
        if not (select and k < levels - 1):
            keep = inside(every[k], y, all_sizes[k][0]) | (tally <= 0)
            out = np.where(keep[:, None], out, out / np.where(keep, 1.0, tally)[:, None])
        return {"level": k, "y": y, "data": out.ravel()}

    fused = step(streamed(both, ["level", "y"], lambda: None, add, end, "level int, y int, data array<double>"))
    ends, ranges = _ends(full_h, band), []
    for i, (lo, hi) in enumerate(ends):
        for k in range(levels):
            ranges.append((k, i, lo, hi))
            if k < levels - 1:
                lo, hi = slabs.expand_range(lo, hi, all_sizes[k + 1][1])
    wanted = {(k, i): (lo, hi) for k, i, lo, hi in ranges}

    def rebuild(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        i = int(key[0])
        out = None
        for k in range(levels - 1, -1, -1):
            (w, h), (lo, hi) = all_sizes[k], wanted[k, i]
            own = _slab(rows[rows.level == k], h, c)
            a = own.lines(lo, hi)
            out = Slab(a if out is None else a + slabs.expand(out, lo, hi, w, h).a, lo, h)
        return pd.DataFrame({"y": np.arange(*ends[i]), "data": list(out.a.reshape(len(out.a), -1))})

    return banded(fused, ranges, ["level"], rebuild, "y int, data array<double>")
