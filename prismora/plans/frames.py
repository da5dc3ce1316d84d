"""Sensor frames and other inputs of the operators, read from the tables at hand.

A frame's row is one array; a row of the long form is one pixel. Stencils work on rows: neighbours across are array
elements, neighbours up and down are lag and lead, so a 5 x 5 window costs no join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLACK, WHITE = 1008, 16383
#: D65 XYZ-to-camera matrices by model, and linear sRGB to XYZ.
MATRICES = {
    "NIKON D500": [[0.8813, -0.3210, -0.1036], [-0.4703, 1.2868, 0.2021], [-0.1054, 0.1940, 0.6129]],
    "NIKON 1 J5": [[0.7520, -0.2518, -0.0645], [-0.3844, 1.2102, 0.1945], [-0.0913, 0.2249, 0.6835]],
    "NIKON Z F": [[1.1607, -0.4491, -0.0977], [-0.4522, 1.2460, 0.2304], [-0.0458, 0.1519, 0.7616]],
    "NIKON Z 5": [[0.8695, -0.2559, -0.0648], [-0.5015, 1.2710, 0.2575], [-0.1280, 0.2215, 0.7514]],
}
SRGB_TO_XYZ = [[0.4124564, 0.3575761, 0.1804375], [0.2126729, 0.7151522, 0.0721750], [0.0193339, 0.1191920, 0.9503041]]
MAKE = "NIKON CORPORATION"
MODELS = [*MATRICES, "UNKNOWN X"]


def inverse3(m: list[list[float]]) -> list[list[float]]:
    """By cofactors; a singular matrix is an error."""
    c = [[m[(i + 1) % 3][(j + 1) % 3] * m[(i + 2) % 3][(j + 2) % 3] - m[(i + 1) % 3][(j + 2) % 3] * m[(i + 2) % 3][(j + 1) % 3] for j in range(3)] for i in range(3)]
    det = sum(m[0][j] * c[0][j] for j in range(3))
    if abs(det) < 1e-12:
        raise ValueError("singular matrix")
    return [[c[j][i] / det for j in range(3)] for i in range(3)]


def camera_to_srgb(xyz_to_camera: list[list[float]]) -> list[list[float]]:
    """Neutral stays neutral: the rows of camera-from-sRGB sum to 1 before they are inverted."""
    m = [[sum(row[k] * SRGB_TO_XYZ[k][j] for k in range(3)) for j in range(3)] for row in xyz_to_camera]
    return inverse3([[v / sum(row) for v in row] for row in m])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sensor_rows(spark: SparkSession, sf_dir: str, side: int = 32) -> DataFrame:
    """(photo, y, px): one row of samples. A frame is made of side * side / 64 vectors, each an 8 x 8 tile; broken frames are left out."""
    across = side // 8
    n = across * across
    dn = lambda v: F.greatest(F.lit(0), F.least(F.lit(WHITE), F.rint(BLACK + (v.cast("double") + 0.30) / 0.60 * (WHITE - BLACK)).cast("int")))
    tiles = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / n).cast("long").alias("photo"), (F.col("vec_id") % n).cast("int").alias("t"), F.transform("embedding", dn).alias("px"))
    whole = tiles.groupBy("photo").agg(F.sum(F.size("px")).alias("n")).where(F.col("n") == side * side)
    strips = tiles.join(whole, "photo", "left_semi").select("photo", "t", F.posexplode(F.expr("transform(sequence(0, 7), k -> slice(px, 8 * k + 1, 8))")).alias("k", "part"))
    rows = strips.groupBy("photo", (F.floor(F.col("t") / across).cast("int") * 8 + F.col("k")).alias("y")).agg(F.sort_array(F.collect_list(F.struct((F.col("t") % across).alias("c"), "part"))).alias("parts"))
    return rows.select("photo", "y", F.flatten(F.transform("parts", lambda p: p["part"])).alias("px"))


def pixels(rows: DataFrame, name: str = "dn", column: str = "px") -> DataFrame:
    """The long form: (photo, y, x, value)."""
    return rows.select("photo", "y", F.posexplode(column).alias("x", name))


def frames(spark: SparkSession, sf_dir: str, side: int = 32) -> DataFrame:
    """(photo, make, model, orientation, iso, wb_r, wb_b): headers by rule."""
    photo = F.col("photo")
    n = side * side // 64
    found = table(spark, sf_dir, "embeddings").groupBy(F.floor(F.col("vec_id") / n).cast("long").alias("photo")).agg(F.count("*").alias("n")).where(F.col("n") == n)
    return found.select(
        "photo", F.when(photo % 5 < 4, MAKE).otherwise("Nobody").alias("make"), F.element_at(F.array(*map(F.lit, MODELS)), (photo % 5 + 1).cast("int")).alias("model"),
        (1 + photo % 8).cast("int").alias("orientation"), (100 * F.pow(F.lit(2), photo % 8)).cast("int").alias("iso"), (1.5 + 0.1 * (photo % 7)).alias("wb_r"), (1.2 + 0.1 * (photo % 7)).alias("wb_b"),
    )


def profiles(spark: SparkSession) -> DataFrame:
    """(make, model, m00 .. m22): a row for each camera that has a profile; four in all."""
    rows = [(MAKE, model, *[v for row in m for v in row]) for model, m in MATRICES.items()]
    return spark.createDataFrame(rows, "make string, model string, " + ", ".join(f"m{i}{j} double" for i in range(3) for j in range(3)))


def render_profiles(spark: SparkSession) -> DataFrame:
    """(model, c00 .. c22): camera to linear sRGB; identity for a model without a profile."""
    rows = [(model, *[v for row in camera_to_srgb(m) for v in row]) for model, m in MATRICES.items()]
    rows.append((MODELS[-1], 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0))
    return spark.createDataFrame(rows, "model string, " + ", ".join(f"c{i}{j} double" for i in range(3) for j in range(3)))


#: The same inputs as common table expressions of the checking SQL engine.
SENSOR = """
sensor AS (SELECT photo, y, x, dn FROM (SELECT vec_id // {n} AS photo, ((vec_id % {n}) // {across}) * 8 + i // 8 AS y, ((vec_id % {n}) % {across}) * 8 + i % 8 AS x,
  least(greatest(round_even(1008::DOUBLE + (v + 0.30::DOUBLE) / 0.60::DOUBLE * 15375::DOUBLE, 0), 0), 16383)::INTEGER AS dn,
  count(*) OVER (PARTITION BY vec_id // {n}) AS n
  FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)) WHERE n = {n} * 64)"""


def sensor_sql(side: int = 32) -> str:
    return SENSOR.format(n=side * side // 64, across=side // 8)


def frames_sql() -> str:
    models = ", ".join(f"'{m}'" for m in MODELS)
    return f"""
frames AS (SELECT photo, CASE WHEN photo % 5 < 4 THEN '{MAKE}' ELSE 'Nobody' END AS make, [{models}][photo % 5 + 1] AS model, (1 + photo % 8)::INTEGER AS orientation,
  (100 * pow(2, photo % 8))::INTEGER AS iso, 1.5::DOUBLE + 0.1::DOUBLE * (photo % 7) AS wb_r, 1.2::DOUBLE + 0.1::DOUBLE * (photo % 7) AS wb_b
  FROM (SELECT vec_id // 16 AS photo FROM embeddings GROUP BY 1 HAVING count(*) = 16))"""


def render_profiles_sql() -> str:
    rows = [(model, *[v for row in camera_to_srgb(m) for v in row]) for model, m in MATRICES.items()] + [(MODELS[-1], 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)]
    values = ", ".join("('" + r[0] + "', " + ", ".join(f"{v!r}::DOUBLE" for v in r[1:]) + ")" for r in rows)
    return f"cams AS (SELECT * FROM (VALUES {values}) t(model, " + ", ".join(f"c{i}{j}" for i in range(3) for j in range(3)) + "))"
