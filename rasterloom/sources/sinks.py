"""Writers: colour profile, diagnostic pictures, the fused image, export."""

from __future__ import annotations

import os
import shutil
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import quantize16
from . import tiff
from .rasters import Raster

CURVE = 1024
#: sRGB primaries adapted to the profile's white, and that white.
PRIMARIES = {b"rXYZ": (0.4360747, 0.2225045, 0.0139322), b"gXYZ": (0.3850649, 0.7168786, 0.0971045), b"bXYZ": (0.1430804, 0.0606169, 0.7141733)}
WHITE = (0.9642, 1.0, 0.8249)


def srgb_profile() -> bytes:
    """A version 2.4 display profile; the same bytes every time."""

    def fixed(v: float) -> bytes:
        return struct.pack(">i", round(v * 65536))

    def xyz(v: tuple[float, float, float]) -> bytes:
        return b"XYZ \0\0\0\0" + b"".join(map(fixed, v))

    x = np.arange(CURVE) / (CURVE - 1)
    linear = np.where(x <= 0.04045, x / 12.92, ((x + 0.055) / 1.055) ** 2.4)
    curve = b"curv\0\0\0\0" + struct.pack(">I", CURVE) + np.round(linear * 65535).astype(">u2").tobytes()
    text = b"sRGB\0"
    tags = {b"desc": b"desc\0\0\0\0" + struct.pack(">I", len(text)) + text + bytes(78), b"cprt": b"text\0\0\0\0none\0", b"wtpt": xyz(WHITE)}
    tags |= {k: xyz(v) for k, v in PRIMARIES.items()}
    blobs, table, at = b"", b"", 128 + 4 + 12 * (len(tags) + 3)
    for name, blob in tags.items():
        table += name + struct.pack(">II", at + len(blobs), len(blob))
        blobs += blob + bytes(-len(blob) % 4)
    for name in (b"rTRC", b"gTRC", b"bTRC"):
        table += name + struct.pack(">II", at + len(blobs), len(curve))
    blobs += curve + bytes(-len(curve) % 4)
    head = struct.pack(">I4sI4s4s4s6H4s4sI4s4sQI", at + len(blobs), b"\0" * 4, 0x02400000, b"mntr", b"RGB ", b"XYZ ", 2020, 1, 1, 0, 0, 0, b"acsp", b"\0" * 4, 0, b"\0" * 4, b"\0" * 4, 0, 0)
    head += b"".join(map(fixed, WHITE))
    return head.ljust(128, b"\0") + struct.pack(">I", len(tags) + 3) + table + blobs


def write_png(path: str, gray_or_rgb: np.ndarray) -> None:
    """8-bit samples, height x width or height x width x 3."""
    a = np.asarray(gray_or_rgb, dtype=np.uint8)
    h, w = a.shape[:2]
    rows = np.concatenate([np.zeros((h, 1), dtype=np.uint8), a.reshape(h, -1)], axis=1)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", w, h, 8, 2 if a.ndim == 3 else 0, 0, 0, 0)
    with open(path, "wb") as f:
        f.write(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b""))


def overlay(reference: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The reference in red, the aligned target in green, each stretched to 0..255."""

    def stretched(a: np.ndarray) -> np.ndarray:
        span = a.max() - a.min()
        return np.round((a - a.min()) / span * 255 if span > 1e-12 else np.zeros(a.shape)).astype(np.uint8)

    return np.stack([stretched(reference), stretched(target), np.zeros(reference.shape, np.uint8)], axis=2)


def write_fused(r: Raster, path: str) -> None:
    """A raster of linear light as a 16-bit TIFF; a row at a time comes to the driver, in order."""
    pixels = F.sort_array(F.collect_list(F.struct("x", *[quantize16(F.col(c)).alias(c) for c in r.cols])))
    rows = r.df.groupBy("y").agg(pixels.alias("p")).orderBy("y")
    arrays = (np.array([list(p)[1:] for p in row.p]) for row in rows.toLocalIterator())
    half = f"{path}.part"
    tiff.write(half, r.w, r.h, arrays, srgb_profile())
    os.replace(half, path)


def write_lines(lines: DataFrame, w: int, h: int, path: str) -> None:
    """Lines (y, data) of linear light as a 16-bit TIFF; encoded in tasks, a line at a time comes to the driver, in order."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for d in b.data:
                v = np.clip(np.nan_to_num(np.asarray(d, dtype=np.float64), nan=0.0), 0, 1)
                v = np.where(v <= 0.0031308, v * 12.92, 1.055 * v ** (1 / 2.4) - 0.055)
                out.append(np.floor(np.clip(v, 0, 1) * 65535 + 0.5).astype("<u2").tobytes())
            yield pd.DataFrame({"y": b.y, "data": out})

    rows = lines.select("y", "data").mapInPandas(encode, "y int, data binary").orderBy("y")
    half = f"{path}.part"
    tiff.write(half, w, h, (np.frombuffer(row.data, dtype="<u2").reshape(w, 3) for row in rows.toLocalIterator()), srgb_profile())
    os.replace(half, path)


def export(result: str, target: str) -> None:
    """Rename, or copy and delete where that is another volume."""
    try:
        os.replace(result, target)
    except OSError:
        shutil.copyfile(result, target)
        os.remove(result)
