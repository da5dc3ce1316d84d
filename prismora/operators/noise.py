"""Noise filters: 5 x 5 bilateral filters on strips of rows, edges repeated.

The order of a combined filter is luminance, then chroma; a strength of zero leaves a stage out of the plan.
"""

from __future__ import annotations

from math import exp

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import stencil

#: Widths of the spatial, light and colour weights of both filters.
SPATIAL, LIGHT, CHROMA_LIGHT, CHROMA = 1.2, 12.0, 32.0, 48.0
OFFSETS = [(dy, dx) for dy in range(-2, 3) for dx in range(-2, 3)]
CODES = {"r": "int", "g": "int", "b": "int"}


def rows_of(rgb: DataFrame) -> DataFrame:
    """(photo, y, r, g, b): pixels as arrays, a row each."""
    rows = rgb.groupBy("photo", "y").agg(F.sort_array(F.collect_list(F.struct("x", "r", "g", "b"))).alias("px"))
    return rows.select("photo", "y", *(F.col(f"px.{c}").alias(c) for c in "rgb"))


def _planes(planes: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
    r, g, b = (planes[c].astype(np.int64) for c in "rgb")
    w = 54 * r + 183 * g + 19 * b
    return r, g, b, w, (w + 128) >> 8


def luminance(rgb: DataFrame, strength: float, height: int = 32) -> DataFrame:
    """Shifts a pixel's channels together towards the mean luma of its like neighbours; whole numbers throughout, ties to even."""
    if strength == 0:
        return rgb
    amount = round(strength * 65536)

    def kernel(planes: dict[str, np.ndarray], first: int, n: int) -> dict[str, np.ndarray]:
        r, g, b, w, q = _planes(planes)
        at = lambda p, dy=0, dx=0: stencil._tap(p, 2, dy, dx)
        light = np.exp(-(np.arange(256.0) ** 2) / (2 * LIGHT**2))
        total, moved = np.zeros(at(w).shape, np.int64), np.zeros(at(w).shape, np.int64)
        for dy, dx in OFFSETS:
            k = np.rint(65536 * exp(-(dy * dy + dx * dx) / (2 * SPATIAL**2)) * light)[np.abs(at(q, dy, dx) - at(q))].astype(np.int64)
            total += k
            moved += k * (at(w, dy, dx) - at(w))
        whole, rest = np.divmod(np.abs(moved * amount), den := total * (256 * 65536))
        whole += (2 * rest > den) | ((2 * rest == den) & (whole % 2 == 1))
        own = np.stack([at(r), at(g), at(b)])
        delta = np.clip(np.sign(moved) * whole, -own.min(axis=0), 255 - own.max(axis=0))
        return dict(zip("rgb", own + delta))

    return stencil.pixels(stencil.per_strip(rows_of(rgb), ("r", "g", "b"), 2, stencil.REPLICATE, kernel, CODES, height))


def chroma(rgb: DataFrame, strength: float, height: int = 32) -> DataFrame:
    """Moves R-G and B-G towards their mean over like neighbours; luma stays, and colours shrink towards it by one factor to stay in range."""
    if strength == 0:
        return rgb

    def kernel(planes: dict[str, np.ndarray], first: int, n: int) -> dict[str, np.ndarray]:
        r, g, b, w, q = _planes(planes)
        at = lambda p, dy=0, dx=0: stencil._tap(p, 2, dy, dx)
        u, v = r - g, b - g
        light = np.exp(-(np.arange(256.0) ** 2) / (2 * CHROMA_LIGHT**2))
        colour = np.exp(-(np.arange(1021.0) ** 2) / (2 * CHROMA**2))
        sw, su, sv = (np.zeros(at(w).shape) for _ in range(3))
        for dy, dx in OFFSETS:
            nu, nv = at(u, dy, dx), at(v, dy, dx)
            k = exp(-(dy * dy + dx * dx) / (2 * SPATIAL**2)) * light[np.abs(at(q, dy, dx) - at(q))] * colour[np.abs(nu - at(u)) + np.abs(nv - at(v))]
            sw, su, sv = sw + k, su + k * nu, sv + k * nv
        mean_u, mean_v = at(u) + strength * (su / sw - at(u)), at(v) + strength * (sv / sw - at(v))
        off = (54 * mean_u + 19 * mean_v) / 256
        parts, luma = np.stack([mean_u - off, -off, mean_v - off]), at(w) / 256
        with np.errstate(divide="ignore", invalid="ignore"):
            room = np.where(parts > 0, (255 - luma) / parts, np.where(parts < 0, -luma / parts, np.inf))
        return dict(zip("rgb", np.rint(np.clip(luma + parts * np.minimum(1, room.min(axis=0)), 0, 255)).astype(np.int32)))

    return stencil.pixels(stencil.per_strip(rows_of(rgb), ("r", "g", "b"), 2, stencil.REPLICATE, kernel, CODES, height))


def combined(rgb: DataFrame, luminance_strength: float, chroma_strength: float, height: int = 32) -> DataFrame:
    return chroma(luminance(rgb, luminance_strength, height), chroma_strength, height)
