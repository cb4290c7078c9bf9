"""Admission and lifecycle: memory model, cancellation, progress, scratch folders."""

from __future__ import annotations

import os
import re
import shutil
import time
from contextlib import contextmanager
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import SparkSession

from .params import Cancelled

#: Fixed values of the memory model.
GIB = 1 << 30
LIMIT_FLOOR, LIMIT_SHARE, LIMIT_CEILING = 16 * GIB, 0.25, 0.9
FUSION_PLANES, WEIGHT_BANDS, REGISTRATION_GRIDS = 3, 28, 39
RESIDUE_PER_FRAME, MARGIN, BAND_ROWS = 15 << 20, 1.15, 256


def memory_limit(ram: int) -> int:
    return min(max(int(ram * LIMIT_SHARE), LIMIT_FLOOR), int(ram * LIMIT_CEILING))


@dataclass(frozen=True)
class Workload:
    frames: int
    width: int
    height: int
    cache_bytes: int
    guide_radius: int = 4
    registration_level: int = 3

    def peak(self, readers: int, threads: int) -> int:
        """Modelled peak bytes with so many frames read at once."""
        plane = self.width * self.height * 4
        band = (BAND_ROWS + 4 * self.guide_radius) * self.width * 4
        grid = max(self.width >> self.registration_level, 1) * max(self.height >> self.registration_level, 1) * 4
        stages = (
            2 * readers * self.cache_bytes + threads * REGISTRATION_GRIDS * grid,
            readers * self.cache_bytes + 4 * threads * band,
            threads * WEIGHT_BANDS * band,
            3 * FUSION_PLANES * plane + self.cache_bytes,
        )
        return int((self.frames * RESIDUE_PER_FRAME + max(stages)) * MARGIN)

    def admitted(self, threads: int, limit: int) -> tuple[int, int]:
        """The most readers whose peak is within the limit (1 if none), and that peak."""
        fitting = (c for c in range(threads, 0, -1) if self.peak(c, threads) <= limit)
        c = next(fitting, 1)
        return c, self.peak(c, threads)

    def scratch_bytes(self) -> int:
        return 2 * self.frames * self.width * self.height * 4


def readers_for(per_task: int, limit: int, threads: int) -> int:
    return min(max(limit // max(per_task, 1), 1), threads)


def enough_scratch(workload: Workload, folder: str) -> bool:
    return shutil.disk_usage(folder).free >= workload.scratch_bytes()


@dataclass
class RunControl:
    """Cancellation by job tag, progress and durations by stage."""

    spark: SparkSession
    tag: str = field(default_factory=lambda: f"run-{os.getpid()}-{time.monotonic_ns()}")
    cancelled: bool = False
    seconds: dict[str, float] = field(default_factory=dict)

    def cancel(self) -> None:
        self.cancelled = True
        self.spark.sparkContext.cancelJobsWithTag(self.tag)

    @contextmanager
    def stage(self, name: str):
        """Jobs inside carry the tag and the stage's name; no stage begins after a cancellation."""
        if self.cancelled:
            raise Cancelled(name)
        context = self.spark.sparkContext
        context.addJobTag(self.tag)
        context.setJobDescription(name)
        began = time.monotonic()
        try:
            yield self
        finally:
            self.seconds[name] = self.seconds.get(name, 0.0) + time.monotonic() - began
            context.removeJobTag(self.tag)
            context.setJobDescription(None)


    def progress(self) -> tuple[int, int]:
        """Tasks done and tasks in all of the stages that run now."""
        tracker = self.spark.sparkContext.statusTracker()
        found = [tracker.getStageInfo(s) for s in tracker.getActiveStageIds()]
        return sum(s.numCompletedTasks for s in found if s), sum(s.numTasks for s in found if s)


def clock(seconds: float) -> str:
    return f"{int(seconds) // 60:02d}:{int(seconds) % 60:02d}"


SCRATCH_PREFIX = "rasterloom-scratch-"


@contextmanager
def scratch(parent: str):
    """A folder named after this process: deleted after success or cancellation, kept after a failure."""
    folder = Path(parent) / f"{SCRATCH_PREFIX}{os.getpid()}-{time.monotonic_ns()}"
    folder.mkdir(parents=True)
    try:
        yield str(folder)
    except Cancelled:
        shutil.rmtree(folder)
        raise
    else:
        shutil.rmtree(folder)


def reap(parent: str) -> list[str]:
    """Delete scratch folders whose process is gone; what is not clearly ours stays."""
    gone = []
    for p in Path(parent).glob(f"{SCRATCH_PREFIX}*"):
        m = re.fullmatch(rf"{SCRATCH_PREFIX}(\d+)-\d+", p.name)
        if m and p.is_dir() and not _alive(int(m[1])):
            shutil.rmtree(p)
            gone.append(p.name)
    return gone


def _alive(pid: int) -> bool:
    try:
        os.kill(pid, 0)
    except ProcessLookupError:
        return False
    except PermissionError:
        return True
    return True
