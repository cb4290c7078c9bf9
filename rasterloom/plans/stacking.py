"""Folder in, image out: discover, check headers, admit, register, measure, weigh, fuse, write."""

from __future__ import annotations

import os
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bands
from ..sources import discovery, sinks, tiff
from ..sources.rasters import stored
from . import pictures
from .control import RunControl, Workload, enough_scratch, memory_limit
from .params import BufferSize, Params, RasterError

#: Strips that a task reads.
STRIPS = 8


def local(path: str) -> str:
    """A listed path as the workers open it: frames lie in a folder that all of them mount."""
    return unquote(path.removeprefix("file://").removeprefix("file:"))


def headers(frames: DataFrame) -> DataFrame:
    """stack, path, frame_idx, width, height, samples, bits, strip_rows, strips, strip_bytes; headers are read in tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [tiff.probe(local(p)) for p in b.path]
            yield b.assign(
                width=[h.width for h in got], height=[h.height for h in got], samples=[h.samples for h in got], bits=[h.bits for h in got],
                strip_rows=[h.rows for h in got], strips=[len(h.offsets) for h in got], strip_bytes=[h.rows * h.width * 6 for h in got],
            )

    parts = int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    few = frames.select("stack", "path", "frame_idx").repartition(parts, "path")
    return few.mapInPandas(run, "stack string, path string, frame_idx int, width int, height int, samples int, bits int, strip_rows int, strips int, strip_bytes long")


def linear_table() -> np.ndarray:
    """Linear light of every 16-bit code."""
    v = np.arange(65_536) / 65_535
    return np.where(v <= 0.04045, v / 12.92, ((v + 0.055) / 1.055) ** 2.4)


def linear_lines(heads: DataFrame, w: int, h: int) -> bands.Rows:
    """The frames' lines in linear light; a task reads runs of ``STRIPS`` strips."""
    runs = heads.select("frame_idx", "path", F.explode(F.sequence(F.lit(0), F.expr(f"(strips - 1) div {STRIPS}"))).alias("run"))
    parts = 4 * int(heads.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = linear_table()
        for b in batches:
            for frame, path, k in zip(b.frame_idx, b.path, b.run):
                head = tiff.probe(local(path))
                with open(local(path), "rb") as f:
                    for s in range(k * STRIPS, min((k + 1) * STRIPS, len(head.offsets))):
                        rows = table[tiff.read_strip(f, head, s)]
                        y = s * head.rows + np.arange(len(rows), dtype=np.int32)
                        yield pd.DataFrame({"frame_idx": np.int32(frame), "y": y, "data": list(rows.reshape(len(rows), -1))})

    lines = runs.repartition(parts, "frame_idx", "run").mapInPandas(run, "frame_idx int, y int, data array<double>")
    return bands.Rows(lines, w, h, 3)


def fuse_lines(r: bands.Rows, n: int, params: Params, control: RunControl, transforms: DataFrame | None = None, debug: str | None = None) -> DataFrame:
    """y, data: the fused lines of ``n`` frames; every stage is a table, polls ``control`` and counts its seconds.

    Diagnostic pictures go to the folder ``debug``. Each frame needs one transform, else BufferSize is raised.
    """
    with control.stage("register"):
        transforms = stored(transforms if transforms is not None else bands.registered(r, n, params.registration_level))
        held = transforms.agg(F.count("frame_idx").alias("rows"), F.count_distinct(F.when(F.col("frame_idx").between(0, n - 1), F.col("frame_idx"))).alias("frames")).first()
        if (held.rows, held.frames) != (n, n):
            raise BufferSize(f"{held.rows} transforms of {held.frames} frames, {n} are needed")
        ts = bands.of_frames(transforms, n)
    if debug:
        with control.stage("debug"):
            pictures.write_debug(r, transforms, n, debug)
    with control.stage("focus"):
        focus = stored(bands.focus_and_guide(r, ts, params.focus_radius, params.guide_perceptual))
    with control.stage("weights"):
        planes = stored(bands.weights(focus, n, r.h, params.guide_radius, params.guide_epsilon))
    with control.stage("fuse"):
        return stored(bands.fuse(r, planes, transforms, n, params.fusion, params.pyramid_floor, step=stored))


def stack_folder(
    spark: SparkSession, folder: str, output: str, params: Params = Params(), control: RunControl | None = None, excluded: list[int] | None = None, ram: int | None = None, debug: str | None = None
) -> str:
    """Fuse the frames of ``folder`` into the 16-bit TIFF ``output``; raises the errors of :mod:`params`."""
    control = control or RunControl(spark)
    discovery.ensure_outside(output, folder)
    with control.stage("discover"):
        frames = discovery.included(discovery.discover(spark, folder), excluded or [])
        heads = discovery.check_geometry(stored(headers(frames)))
        first, n = heads.where("frame_idx = 0").first(), heads.count()
    work = Workload(n, first.width, first.height, first.strip_bytes * STRIPS, params.guide_radius, params.registration_level)
    limit = memory_limit(ram or os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES"))
    readers, peak = work.admitted(spark.sparkContext.defaultParallelism, limit)
    if peak > limit:
        raise RasterError(f"{peak} bytes are needed with {readers} reader, {limit} are allowed")
    if not enough_scratch(work, os.path.dirname(os.path.abspath(output))):
        raise RasterError(f"{work.scratch_bytes()} bytes of scratch space are needed")
    lines = fuse_lines(linear_lines(heads, first.width, first.height), n, params, control, debug=debug)
    with control.stage("write"):
        sinks.write_lines(lines, first.width, first.height, output)
    return output
