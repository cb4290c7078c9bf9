"""NumPy kernels on slabs: some lines of a plane, with the line that the first of them is.

Every kernel gives lines ``lo .. hi`` of its result from a slab that has the lines it needs; lines outside the frame
are its edge lines. So a band of a frame gives what the whole frame would.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Slab:
    """Lines ``at ..`` of a plane of ``h`` lines: an array of lines x width x channels."""

    a: np.ndarray
    at: int
    h: int

    def lines(self, lo: int, hi: int) -> np.ndarray:
        return self.a[np.clip(np.arange(lo, hi), 0, self.h - 1) - self.at]


Range = tuple[int, int]


def held(lo: int, hi: int, h: int) -> Range:
    """The lines of the frame that stand for ``lo .. hi``."""
    return min(max(lo, 0), h - 1), min(max(hi, 1), h)


def box(s: Slab, lo: int, hi: int, radius: int) -> Slab:
    a = s.lines(lo - radius, hi + radius)
    a = np.pad(a, [(0, 0), (radius, radius), (0, 0)], mode="edge")
    for axis in (0, 1):
        n = a.shape[axis] - 2 * radius
        total = np.cumsum(a, axis=axis)
        head = np.take(total, np.arange(2 * radius, n + 2 * radius), axis=axis)
        tail = np.concatenate([np.zeros_like(np.take(total, [0], axis=axis)), np.take(total, np.arange(n - 1), axis=axis)], axis=axis)
        a = head - tail
    return Slab(a, lo, s.h)


def laplacian(s: Slab, lo: int, hi: int) -> Slab:
    """Squared four-neighbour Laplacian."""
    a = np.pad(s.lines(lo - 1, hi + 1), [(0, 0), (1, 1), (0, 0)], mode="edge")
    c = a[1:-1, 1:-1]
    return Slab((a[:-2, 1:-1] + a[2:, 1:-1] + a[1:-1, :-2] + a[1:-1, 2:] - 4 * c) ** 2, lo, s.h)


def reduce(s: Slab, lo: int, hi: int) -> Slab:
    """Lines of the next coarser level; they need ``reduce_range``."""
    a = s.lines(2 * lo - 2, 2 * hi + 1)
    rows = sum(k * a[j : j + 2 * (hi - lo) - 1 : 2] for j, k in enumerate((1, 4, 6, 4, 1))) / 16
    w = a.shape[1]
    p = np.pad(rows, [(0, 0), (2, 2), (0, 0)], mode="edge")
    out = sum(k * p[:, j : j + w : 2] for j, k in enumerate((1, 4, 6, 4, 1))) / 16
    return Slab(out, lo, -(-s.h // 2))


def reduce_range(lo: int, hi: int, h: int) -> Range:
    return held(2 * lo - 2, 2 * hi + 1, h)


def expand(s: Slab, lo: int, hi: int, w: int, h: int) -> Slab:
    """Lines of the next finer level, of ``h`` lines of ``w``; they need ``expand_range``."""

    def finer(left: np.ndarray, middle: np.ndarray, right: np.ndarray, odd: np.ndarray) -> np.ndarray:
        return np.where(odd, (middle + right) / 2, (left + 6 * middle + right) / 8)

    y = np.arange(lo, hi)
    i = y // 2
    near = [s.a[np.clip(i + d, 0, s.h - 1) - s.at] if d else s.a[i - s.at] for d in (-1, 0, 1)]
    rows = finer(*near, (y % 2 == 1)[:, None, None])
    x = np.arange(w)
    j = x // 2
    near = [rows[:, np.clip(j + d, 0, rows.shape[1] - 1)] for d in (-1, 0, 1)]
    return Slab(finer(*near, (x % 2 == 1)[None, :, None]), lo, h)


def expand_range(lo: int, hi: int, h: int) -> Range:
    return held(lo // 2 - 1, (hi - 1) // 2 + 2, h)


def warp(s: Slab, t: tuple[float, float, float], lo: int, hi: int) -> Slab:
    """Bilinear, edges held; (scale, dx, dy) about the centre; lines need ``warp_range``."""
    scale, dx, dy = t
    w = s.a.shape[1]
    sx = scale * (np.arange(w) - w / 2) + dx + w / 2
    sy = scale * (np.arange(lo, hi) - s.h / 2) + dy + s.h / 2
    x0, y0 = np.floor(sx).astype(int), np.floor(sy).astype(int)
    fx, fy = (sx - x0)[None, :, None], (sy - y0)[:, None, None]

    def line(y: np.ndarray) -> np.ndarray:
        rows = s.a[np.clip(y, 0, s.h - 1) - s.at]
        return rows[:, np.clip(x0, 0, w - 1)] * (1 - fx) + rows[:, np.clip(x0 + 1, 0, w - 1)] * fx

    return Slab(line(y0) * (1 - fy) + line(y0 + 1) * fy, lo, s.h)


def warp_range(lo: int, hi: int, h: int, t: tuple[float, float, float]) -> Range:
    ends = [t[0] * (y - h / 2) + t[2] + h / 2 for y in (lo, hi - 1)]
    return held(int(np.floor(min(ends))), int(np.floor(max(ends))) + 2, h)


def guided(guide: Slab, mask: Slab, lo: int, hi: int, radius: int, epsilon: float) -> Slab:
    """Lines of the guided filter; both slabs need ``2 * radius`` lines more on either side."""
    n = float((2 * radius + 1) ** 2)
    a, b = held(lo - radius, hi + radius, guide.h)
    first, last = held(lo - 2 * radius, hi + 2 * radius, guide.h)
    i, p = guide.lines(first, last), mask.lines(first, last)
    mi, mp, mip, mii = np.split(box(Slab(np.concatenate([i, p, i * p, i * i], axis=2), first, guide.h), a, b, radius).a / n, 4, axis=2)
    slope = (mip - mi * mp) / (mii - mi * mi + epsilon)
    both = box(Slab(np.concatenate([slope, mp - slope * mi], axis=2), a, guide.h), lo, hi, radius).a / n
    return Slab(both[:, :, :1] * guide.lines(lo, hi) + both[:, :, 1:], lo, guide.h)
