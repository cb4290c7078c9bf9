"""Scalar functions of samples, transforms and sizes, as column expressions (or plain Python at plan time)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rec.709 luma weights.
LUMA = (0.2126, 0.7152, 0.0722)


def linear_to_srgb(v: Column) -> Column:
    return F.when(v <= 0.0031308, v * 12.92).otherwise(1.055 * F.pow(v, F.lit(1 / 2.4)) - 0.055)


def srgb_to_linear(v: Column) -> Column:
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def luma(r: Column, g: Column, b: Column) -> Column:
    return r * LUMA[0] + g * LUMA[1] + b * LUMA[2]


def guide_value(luminance: Column, perceptual: bool = True) -> Column:
    return linear_to_srgb(F.greatest(luminance, F.lit(0.0))) if perceptual else luminance


def clamped(v: Column) -> Column:
    """To 0..1; a NaN becomes 0."""
    return F.least(F.greatest(F.nanvl(v, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))


def quantize16(v: Column) -> Column:
    """Encoded linear light as a whole number up to 65535, halves away from zero."""
    return F.round(clamped(linear_to_srgb(F.greatest(F.nanvl(v, F.lit(0.0)), F.lit(0.0)))) * 65535).cast("int")


def encode8(v: Column) -> Column:
    return F.floor(clamped(linear_to_srgb(F.greatest(F.nanvl(v, F.lit(0.0)), F.lit(0.0)))) * 255 + 0.5).cast("int")


def then(first: Column, second: Column) -> Column:
    """The similarity that applies ``first``, then ``second`` (structs of scale, dx, dy)."""
    return F.struct(
        (first["scale"] * second["scale"]).alias("scale"),
        (second["scale"] * first["dx"] + second["dx"]).alias("dx"),
        (second["scale"] * first["dy"] + second["dy"]).alias("dy"),
    )


def inverse(t: Column) -> Column:
    """None where the scale is 0."""
    return F.struct(
        F.try_divide(F.lit(1.0), t["scale"]).alias("scale"), F.try_divide(-t["dx"], t["scale"]).alias("dx"), F.try_divide(-t["dy"], t["scale"]).alias("dy")
    )


def applied(t: Column, x: Column, y: Column) -> tuple[Column, Column]:
    return t["scale"] * x + t["dx"], t["scale"] * y + t["dy"]


def scaled_up(t: Column, level: int) -> Column:
    return F.struct(t["scale"].alias("scale"), (t["dx"] * 2.0**level).alias("dx"), (t["dy"] * 2.0**level).alias("dy"))


def parabolic(left: Column, middle: Column, right: Column) -> Column:
    bend = left - 2 * middle + right
    return F.when(F.abs(bend) < 1e-20, 0.0).otherwise(F.try_divide((left - right) / 2, bend))


def wrapped(v: Column, n: Column | int) -> Column:
    """Signed shift of a circular index; exactly half stays positive."""
    return F.when(v > F.lit(n) / 2 if isinstance(n, int) else v > n / 2, v - n).otherwise(v)


def hann(i: Column, n: int) -> Column:
    return F.lit(1.0) if n <= 1 else 0.5 - 0.5 * F.cos(i * (2 * 3.141592653589793 / (n - 1)))


def level_count(w: int, h: int, floor: int) -> int:
    """Pyramid levels while the half of the shorter side, rounded down, is at least the floor."""
    n = 1
    while min(w, h) // 2 >= max(floor, 1):
        w, h, n = -(-w // 2), -(-h // 2), n + 1
    return n


def sizes(w: int, h: int, levels: int) -> list[tuple[int, int]]:
    out = [(w, h)]
    while len(out) < levels:
        w, h = -(-w // 2), -(-h // 2)
        out.append((w, h))
    return out
