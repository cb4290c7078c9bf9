"""16-bit RGB TIFF files: header probe, strip reader and writer, and a Spark data source of rows.

A file's strips are the unit of reading; the data source makes a partition of each run of strips, so a frame is
never whole in one task unless it is one strip.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..plans.params import Bounds, UnsupportedFormat

#: Tags, compressions and limits of the format.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, OFFSETS, SAMPLES, ROWS, COUNTS, PLANAR, PREDICTOR, FORMAT, ICC = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317, 339, 34675
NONE, DEFLATE, OLD_DEFLATE = 1, 8, 32946
MAX_STRIP = 2 << 30
SIZES = {1: "B", 3: "H", 4: "I", 16: "Q"}
ROWS_PER_STRIP = 64


@dataclass(frozen=True)
class Header:
    width: int
    height: int
    samples: int
    bits: int
    rows: int
    compression: int
    order: str
    offsets: tuple[int, ...]
    counts: tuple[int, ...]

    def strips(self, y0: int, count: int) -> range:
        if y0 < 0 or count < 0 or y0 + count > self.height:
            raise Bounds(f"rows {y0}..{y0 + count} of {self.height}")
        return range(y0 // self.rows, -(-(y0 + count) // self.rows))


def probe(path: str) -> Header:
    """The header alone; refuses what is not chunky 16-bit RGB in strips of at least one row."""
    with open(path, "rb") as f:
        start = f.read(8)
        if start[:2] not in (b"II", b"MM") or len(start) < 8:
            raise UnsupportedFormat(f"{path}: not a TIFF file")
        order = "<" if start[:2] == b"II" else ">"
        magic, at = struct.unpack(order + "HI", start[2:])
        if magic != 42:
            raise UnsupportedFormat(f"{path}: not a classic TIFF file")
        f.seek(at)
        (n,) = struct.unpack(order + "H", f.read(2))
        raw = f.read(12 * n)
        tags: dict[int, tuple[int, ...]] = {}
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", raw, 12 * i)
            if kind not in SIZES:
                continue
            form = f"{order}{count}{SIZES[kind]}"
            size = struct.calcsize(form)
            if size <= 4:
                tags[tag] = struct.unpack_from(form, raw, 12 * i + 8)
            elif size <= MAX_STRIP:
                f.seek(struct.unpack_from(order + "I", raw, 12 * i + 8)[0])
                tags[tag] = struct.unpack(form, f.read(size))
    one = lambda tag, default=None: tags.get(tag, (default,))[0]
    if set(tags.get(BITS, ())) != {16} or one(SAMPLES) != 3 or one(PHOTOMETRIC) != 2 or one(PLANAR, 1) != 1 or one(FORMAT, 1) != 1 or one(PREDICTOR, 1) != 1:
        raise UnsupportedFormat(f"{path}: not 16-bit RGB")
    if one(COMPRESSION, 1) not in (NONE, DEFLATE, OLD_DEFLATE) or OFFSETS not in tags:
        raise UnsupportedFormat(f"{path}: unreadable compression or layout")
    rows = min(one(ROWS, one(HEIGHT)), one(HEIGHT))
    if not rows or rows * one(WIDTH) * 6 > MAX_STRIP:
        raise UnsupportedFormat(f"{path}: strips of no rows or over 2 GiB")
    return Header(one(WIDTH), one(HEIGHT), 3, 16, rows, one(COMPRESSION, 1), order, tags[OFFSETS], tags[COUNTS])


def read_strip(f, h: Header, strip: int) -> np.ndarray:
    """Rows x width x 3 encoded samples."""
    f.seek(h.offsets[strip])
    raw = f.read(h.counts[strip])
    if h.compression != NONE:
        raw = zlib.decompress(raw)
    rows = min(h.rows, h.height - strip * h.rows)
    return np.frombuffer(raw, dtype=h.order + "u2", count=rows * h.width * 3).reshape(rows, h.width, 3)


def read_rows(path: str, y0: int, count: int) -> np.ndarray:
    h = probe(path)
    with open(path, "rb") as f:
        parts = [read_strip(f, h, s) for s in h.strips(y0, count)]
    first = y0 // h.rows * h.rows
    return np.concatenate(parts)[y0 - first : y0 - first + count] if parts else np.zeros((0, h.width, 3), dtype=np.uint16)


def write(path: str, width: int, height: int, rows: Iterator[np.ndarray], profile: bytes = b"", compress: bool = False, rows_per_strip: int = ROWS_PER_STRIP) -> None:
    """``rows``: height arrays of width x 3 encoded 16-bit samples, pulled one at a time."""
    strips = -(-height // rows_per_strip)
    with open(path, "wb") as f:
        f.write(b"II*\0\0\0\0\0")
        offsets, counts = [], []
        for s in range(strips):
            band = np.stack([np.asarray(next(rows), dtype="<u2") for _ in range(min(rows_per_strip, height - s * rows_per_strip))])
            if band.shape[1:] != (width, 3):
                raise UnsupportedFormat("rows must hold three samples a pixel")
            raw = zlib.compress(band.tobytes()) if compress else band.tobytes()
            offsets.append(f.tell())
            counts.append(len(raw))
            f.write(raw)

        def put(form: str, *values: int) -> int:
            at = f.tell()
            f.write(struct.pack("<" + form, *values))
            return at

        bits = put("3H", 16, 16, 16)
        where = put(f"{strips}I", *offsets) if strips > 1 else offsets[0]
        sizes = put(f"{strips}I", *counts) if strips > 1 else counts[0]
        tags = [(WIDTH, 4, 1, width), (HEIGHT, 4, 1, height), (BITS, 3, 3, bits), (COMPRESSION, 3, 1, DEFLATE if compress else NONE), (PHOTOMETRIC, 3, 1, 2), (OFFSETS, 4, strips, where)]
        tags += [(SAMPLES, 3, 1, 3), (ROWS, 4, 1, rows_per_strip), (COUNTS, 4, strips, sizes), (PLANAR, 3, 1, 1)]
        if profile:
            at = f.tell()
            f.write(profile + b"\0" * (len(profile) & 1))
            tags.append((ICC, 7, len(profile), at))
        f.write(b"\0" * (f.tell() & 1))
        start = f.tell()
        f.write(struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags) + b"\0\0\0\0")
        f.seek(4)
        f.write(struct.pack("<I", start))


@dataclass
class StripRun(InputPartition):
    path: str
    frame_idx: int
    first: int
    end: int


class TiffStack(DataSource):
    """``format("tiffstack")``; options: ``paths`` (frames in order, one a line), ``strips`` a partition (default 4)."""

    @classmethod
    def name(cls) -> str:
        return "tiffstack"

    def schema(self) -> str:
        return "frame_idx int, path string, y int, width int, data array<int>"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.paths = [p for p in options["paths"].split("\n") if p]
        self.strips = int(options.get("strips", 4))

    def partitions(self) -> list[StripRun]:
        out = []
        for k, path in enumerate(self.paths):
            n = len(probe(path).offsets)
            out += [StripRun(path, k, s, min(s + self.strips, n)) for s in range(0, n, self.strips)]
        return out

    def read(self, partition: StripRun):
        h = probe(partition.path)
        with open(partition.path, "rb") as f:
            for s in range(partition.first, partition.end):
                for i, row in enumerate(read_strip(f, h, s)):
                    yield (partition.frame_idx, partition.path, s * h.rows + i, h.width, row.ravel().astype(int).tolist())
