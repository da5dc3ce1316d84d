"""Arithmetic of sensor codecs: bit packing, wavelet synthesis, prediction and reconstruction."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.frames import BLACK, WHITE


def pack(column: str, bits: int) -> Column:
    """Rows of samples as bytes, high bits first, each row padded to whole bytes. A sample out of range is an error."""

    @F.pandas_udf("binary")
    def run(rows: pd.Series) -> pd.Series:
        out = []
        for row in rows:
            v = np.asarray(row, np.uint32)
            if (v >> bits).any():
                raise ValueError("sample out of range")
            out.append(np.packbits((v[:, None] >> np.arange(bits - 1, -1, -1, dtype=np.uint32)) & 1).tobytes())
        return pd.Series(out)

    return run(column)


def unpack(column: str, width: str, bits: int) -> Column:
    """The inverse of pack."""

    @F.pandas_udf("array<int>")
    def run(rows: pd.Series, widths: pd.Series) -> pd.Series:
        out = []
        for data, n in zip(rows, widths):
            if len(data) != -(-n * bits // 8):
                raise ValueError(f"{len(data)} bytes for {n} samples of {bits} bits")
            b = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits).reshape(n, bits).astype(np.int32)
            out.append(b @ (1 << np.arange(bits - 1, -1, -1, dtype=np.int32)))
        return pd.Series(out)

    return run(column, width)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once: a projection of its own would be folded into each use."""
    return F.get(F.transform(F.array(value), body), 0)


def inverse_53(bands: DataFrame) -> DataFrame:
    """Adds out: the integer 5/3 synthesis of arrays low and high of equal length, ends repeated."""
    n = F.size("low")
    even = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.get("low", k) - F.shiftright(F.get("high", F.greatest(k - 1, F.lit(0))) + F.get("high", k) + 2, 2))
    odd = lambda e: F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.get("high", k) + F.shiftright(F.get(e, k) + F.get(e, F.least(k + 1, n - 1)), 1))
    return bands.withColumn("out", let(even, lambda e: F.flatten(F.zip_with(e, odd(e), lambda a, b: F.array(a, b)))))


def linear_level(i: Column) -> Column:
    """The two quadratics around the black level that turn 16-bit codes into sensor levels."""
    pivot = 65535 * (BLACK / WHITE) ** 0.5
    d = i - F.lit(pivot)
    below, above = d / pivot, d / (65535 - pivot)
    curve = F.when(d < 0, BLACK * (1 - below * below)).otherwise(BLACK + (WHITE - BLACK) * (above * above))
    return F.greatest(F.lit(0), F.least(F.lit(WHITE), F.floor(curve + 0.5))).cast("int")


def predict_gcli(threshold: Column, previous: Column, residual: Column) -> Column:
    """Zig-zag around the previous value while there is room below it, then straight up."""
    base = F.greatest(threshold, previous)
    zig = F.when(residual % 2 == 0, base + F.floor(residual / 2)).otherwise(base - F.floor((residual + 1) / 2))
    return F.when(residual <= 2 * (base - threshold), zig).otherwise(threshold + residual)


def dequantize(coefficient: Column, gcli: Column, threshold: Column) -> Column:
    """sign * 16 * (m + (m >> s) + (m >> 2s) + ...), s = max(1, gcli - threshold + 1)."""
    s = F.greatest(F.lit(1), gcli - threshold + 1).cast("int")
    m = F.abs(coefficient)
    terms = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: F.when(s * k < 62, F.call_function("shiftright", m, (s * k).cast("int"))).otherwise(F.lit(0).cast("long")))
    return F.signum(coefficient).cast("long") * F.aggregate(terms, F.lit(0).cast("long"), lambda a, t: a + t) * 16


def color_lift(planes: DataFrame) -> DataFrame:
    """(photo, y, x, red, green1, green2, blue): the inverse of a lifted colour transform, of whole numbers, from (photo, y, x, luma, rd, delta, bd).

    Each step takes a rounded-down mean of neighbours from a plane; at the edges a place stands in for its missing neighbour, but below the
    last row, where the first luma is made anew from that row alone. Neighbours are lag and lead along rows and columns.
    """
    along, down = (Window.partitionBy("photo", a).orderBy(b) for a, b in (("y", "x"), ("x", "y")))
    right, left = (lambda c, f=f: F.coalesce(f(c).over(along), F.col(c)) for f in (F.lead, F.lag))
    below, above = (lambda c, f=f: F.coalesce(f(c).over(down), F.col(c)) for f in (F.lead, F.lag))
    shift = F.shiftright
    p = planes.withColumn("pair", F.col("delta") + right("delta"))
    p = p.withColumn("y1", F.col("luma") - shift(F.col("pair") + above("pair"), 3))
    p = p.withColumn("next", F.coalesce(F.lead("y1").over(down), F.col("luma") - shift(F.col("pair"), 2)))
    p = p.withColumn("y2", F.col("delta") + shift(F.col("y1") + left("y1") + F.col("next") + left("next"), 2))
    p = p.withColumn("green1", F.col("y1") - shift(F.col("rd") + right("rd") + F.col("bd") + above("bd"), 3)).withColumn("green2", F.col("y2") - shift(F.col("rd") + below("rd") + F.col("bd") + left("bd"), 3))
    red = F.col("rd") + shift(F.col("green1") + left("green1") + F.col("green2") + above("green2"), 2)
    blue = F.col("bd") + shift(F.col("green1") + below("green1") + F.col("green2") + right("green2"), 2)
    return p.select("photo", "y", "x", red.alias("red"), "green1", "green2", blue.alias("blue"))
