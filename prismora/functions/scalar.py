"""Column functions of the pixel pipeline. Order of operations and rounding are part of their meaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of the two lumas, the contrast pivot, the encoding gamma.
LUMA_709, LUMA_256 = (0.2126, 0.7152, 0.0722), (54, 183, 19)
PIVOT, GAMMA = 0.18, 1 / 2.2


def clamp(v: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), v))


def rounded(v: Column, scale: float = 1e6) -> Column:
    """Ties to even on the scaled binary value, the form that other engines share."""
    return F.rint(v * scale) / scale


def normalize(dn: Column, black: Column | float, white: Column | float) -> Column:
    return clamp((dn - black) / (white - black))


def luma709(r: Column, g: Column, b: Column) -> Column:
    return r * LUMA_709[0] + g * LUMA_709[1] + b * LUMA_709[2]


def weighted256(r: Column, g: Column, b: Column) -> Column:
    return r * LUMA_256[0] + g * LUMA_256[1] + b * LUMA_256[2]


def qc_luma(r: Column, g: Column, b: Column) -> Column:
    return F.shiftright(weighted256(r, g, b), 8)


def guide(r: Column, g: Column, b: Column) -> Column:
    """The rounded 8-bit luma that noise filters compare."""
    return F.shiftright(weighted256(r, g, b) + 128, 8)


def contrast(v: Column, amount: float) -> Column:
    return (v - PIVOT) * (1 + 0.75 * amount) + PIVOT


def tonal(v: Column, highlights: float, shadows: float) -> Column:
    """Lifts shadows and bends highlights; pulled highlights above 1 follow a rational shoulder."""
    p = clamp(v)
    curve = v + 1.2 * shadows * p * (1 - p) * (1 - p) + 0.3 * highlights * p * p
    if highlights >= 0:
        return curve
    a = -0.3 * highlights
    return F.when(v > 1, 1 - a * a / (a + (1 - 2 * a) * (v - 1))).otherwise(curve)


def encode(v: Column, maximum: int = 255) -> Column:
    return F.rint(F.pow(clamp(v), F.lit(GAMMA)) * maximum)


def balance(warmth: Column | float, tint: Column | float) -> tuple[Column, Column, Column]:
    """Scales of red, green and blue."""
    w, t = (x if isinstance(x, Column) else F.lit(float(x)) for x in (warmth, tint))
    return (1 + 0.12 * w) * (1 + 0.08 * t), (1 + 0.03 * w) * (1 - 0.12 * t), (1 - 0.12 * w) * (1 + 0.08 * t)


def matrix(m: list[list[float]] | list[list[Column]], rgb: tuple[Column, Column, Column]) -> tuple[Column, Column, Column]:
    return tuple(row[0] * rgb[0] + row[1] * rgb[1] + row[2] * rgb[2] for row in m)  # type: ignore[return-value]


def cfa(y: Column, x: Column) -> Column:
    """0 red, 1 green, 2 blue, of an RGGB mosaic."""
    return (F.pmod(y, F.lit(2)) + F.pmod(x, F.lit(2))).cast("int")


def saturation(r: Column, g: Column, b: Column) -> Column:
    high = F.greatest(r, g, b)
    return F.when(high > 0, (high - F.least(r, g, b)) / high).otherwise(0.0)


def log_ratios(r: Column, g: Column, b: Column, floor: float = 1.0) -> tuple[Column, Column]:
    low = F.lit(float(floor))
    return F.log(F.greatest(r, low) / F.greatest(g, low)), F.log(F.greatest(b, low) / F.greatest(g, low))
