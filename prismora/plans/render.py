"""From sensor frames to rendered pixels: a plan of projections around one stencil."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import stencil
from . import frames


def balanced_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sensor rows with v: normalised samples times their site's gain, limited to the least gain, which is 1 here."""
    rows = frames.sensor_rows(spark, sf_dir).join(frames.frames(spark, sf_dir), "photo")
    site = lambda i: F.pmod(F.col("y"), F.lit(2)) + F.pmod(i, F.lit(2))
    gain = lambda i: F.when(site(i) == 0, F.col("wb_r")).when(site(i) == 2, F.col("wb_b")).otherwise(1.0)
    return rows.withColumn("v", F.transform("px", lambda d, i: F.least(F.lit(1.0), scalar.normalize(d, frames.BLACK, frames.WHITE) * gain(i))))


def linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(photo, y, x, r, g, b): demosaiced camera colour in linear sRGB, not clamped."""
    headers = frames.frames(spark, sf_dir).select("photo", "model").join(F.broadcast(frames.render_profiles(spark)), "model")
    demosaiced = stencil.bilinear(balanced_rows(spark, sf_dir), "v")
    px = stencil.pixels(demosaiced).join(headers, "photo")
    m = [[F.col(f"c{i}{j}") for j in range(3)] for i in range(3)]
    r, g, b = scalar.matrix(m, (F.col("r"), F.col("g"), F.col("b")))
    return px.select("photo", "y", "x", r.alias("r"), g.alias("g"), b.alias("b"))


def rgb8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(photo, y, x, r, g, b): 8-bit codes at default settings."""
    return linear(spark, sf_dir).select("photo", "y", "x", *(scalar.encode(F.col(c)).cast("int").alias(c) for c in "rgb"))


LINEAR = (
    frames.sensor_sql() + "," + frames.frames_sql() + "," + frames.render_profiles_sql() + """,
bal AS (SELECT s.photo, y, x, y % 2 + x % 2 AS ch, least(1::DOUBLE, greatest(0::DOUBLE, least(1::DOUBLE, (dn - 1008)::DOUBLE / 15375::DOUBLE)) * CASE y % 2 + x % 2 WHEN 0 THEN wb_r WHEN 2 THEN wb_b ELSE 1::DOUBLE END) AS v
  FROM sensor s JOIN frames f USING (photo)),
taps AS (SELECT dy, dx FROM (VALUES (-1), (0), (1)) a(dy), (VALUES (-1), (0), (1)) b(dx)),
spread AS (SELECT photo, y + dy AS y, x + dx AS x, ch, v, (CASE WHEN ch = 1 THEN CASE abs(dy) + abs(dx) WHEN 0 THEN 4 WHEN 1 THEN 1 ELSE 0 END ELSE (2 - abs(dy)) * (2 - abs(dx)) END)::DOUBLE AS k FROM bal, taps),
dem AS (SELECT photo, y, x, sum(v * k) FILTER (ch = 0) / sum(k) FILTER (ch = 0) AS r, sum(v * k) FILTER (ch = 1) / sum(k) FILTER (ch = 1) AS g, sum(v * k) FILTER (ch = 2) / sum(k) FILTER (ch = 2) AS b
  FROM spread WHERE y BETWEEN 0 AND 31 AND x BETWEEN 0 AND 31 GROUP BY ALL),
lin AS (SELECT d.photo, d.y, d.x, c00 * r + c01 * g + c02 * b AS r, c10 * r + c11 * g + c12 * b AS g, c20 * r + c21 * g + c22 * b AS b FROM dem d JOIN frames f USING (photo) JOIN cams c USING (model))"""
)


def encode_sql(v: str, maximum: int = 255) -> str:
    return f"round_even(pow(greatest(0::DOUBLE, least(1::DOUBLE, {v})), 1::DOUBLE / 2.2::DOUBLE) * {maximum}, 0)"


RGB8 = LINEAR + ",\nrgb8 AS (SELECT photo, y, x, " + ", ".join(f"{encode_sql(c)}::INTEGER AS {c}" for c in "rgb") + " FROM lin)"
