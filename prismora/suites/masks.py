"""Noise filters, masks, selections and boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import masks, noise
from ..plans import frames, render
from .pixel import r6
from .registry import Suite

S = Suite()
RGB8 = render.RGB8
_TAPS = "taps5 AS (SELECT dy, dx FROM (VALUES (-2), (-1), (0), (1), (2)) a(dy), (VALUES (-2), (-1), (0), (1), (2)) b(dx))"
_NEAR = RGB8 + f""", {_TAPS}, px AS (SELECT *, 54 * r + 183 * g + 19 * b AS w, (54 * r + 183 * g + 19 * b + 128) >> 8 AS q FROM rgb8),
near AS (SELECT c.photo, c.y, c.x, c.r, c.g, c.b, c.w, c.q, dy, dx, n.r AS nr, n.g AS ng, n.b AS nb, n.w AS nw, n.q AS nq FROM px c, taps5, px n WHERE n.photo = c.photo AND n.y = greatest(0, least(31, c.y + dy)) AND n.x = greatest(0, least(31, c.x + dx)))"""


_LUMINANCE = f"""WITH {_NEAR}, k AS (SELECT *, round_even(65536 * exp(-((dy * dy + dx * dx) / 2.88::DOUBLE)) * exp(-((nq - q) * (nq - q))::DOUBLE / 288::DOUBLE), 0)::BIGINT AS k FROM near),
s AS (SELECT photo, y, x, r, g, b, sum(k)::BIGINT AS sw, sum(k * (nw - w))::BIGINT AS sy FROM k GROUP BY ALL), d AS (SELECT *, sy * 32768 AS num, sw * 16777216 AS den FROM s),
e AS (SELECT *, abs(num) // den + CASE WHEN 2 * (abs(num) % den) > den OR (2 * (abs(num) % den) = den AND (abs(num) // den) % 2 = 1) THEN 1 ELSE 0 END AS whole FROM d),
f AS (SELECT *, greatest(-least(r, g, b), least(255 - greatest(r, g, b), sign(num) * whole)) AS delta FROM e)"""
_SHIFTED = "SELECT photo, y, x, (r + delta)::INTEGER AS r, (g + delta)::INTEGER AS g, (b + delta)::INTEGER AS b FROM f"


@S.add(f"{_LUMINANCE} {_SHIFTED}")
def denoise_luminance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return noise.luminance(render.rgb8(spark, sf_dir), 0.5)


def _chroma_sql(near: str, n: str = "") -> str:
    """The filter and its checksums over the neighbours `near`; n sets its names apart."""
    return f"""k{n} AS (SELECT *, exp(-((dy * dy + dx * dx) / 2.88::DOUBLE)) * exp(-((nq - q) * (nq - q))::DOUBLE / 2048::DOUBLE) * exp(-((abs(nr - ng - r + g) + abs(nb - ng - b + g)) * (abs(nr - ng - r + g) + abs(nb - ng - b + g)))::DOUBLE / 4608::DOUBLE) AS k FROM {near}),
s{n} AS (SELECT photo, y, x, r, g, b, w / 256::DOUBLE AS luma, sum(k) AS sw, sum(k * (nr - ng)) AS su, sum(k * (nb - ng)) AS sv FROM k{n} GROUP BY ALL),
m{n} AS (SELECT *, (r - g) + 0.6::DOUBLE * (su / sw - (r - g)) AS u, (b - g) + 0.6::DOUBLE * (sv / sw - (b - g)) AS v FROM s{n}),
o{n} AS (SELECT *, u - (54 * u + 19 * v) / 256 AS cr, -((54 * u + 19 * v) / 256) AS cg, v - (54 * u + 19 * v) / 256 AS cb FROM m{n}),
l{n} AS (SELECT *, least(1::DOUBLE, {', '.join(f'CASE WHEN {c} > 0 THEN (255 - luma) / {c} WHEN {c} < 0 THEN -luma / {c} ELSE 1 END' for c in ('cr', 'cg', 'cb'))}) AS k FROM o{n}),
z{n} AS (SELECT photo, y, x, {', '.join(f'round_even(greatest(0::DOUBLE, least(255::DOUBLE, luma + c{c} * k)), 0) AS {c}' for c in 'rgb')} FROM l{n})
SELECT photo, count(*) AS n, sum(r)::BIGINT AS r, sum(g)::BIGINT AS g, sum(b)::BIGINT AS b, sum(r * y + g * x + b)::BIGINT AS mixed FROM z{n} GROUP BY photo"""


def _checksums(rgb: DataFrame) -> DataFrame:
    return rgb.groupBy("photo").agg(F.count("*").alias("n"), *(F.sum(F.col(c).cast("long")).alias(c) for c in "rgb"), F.sum((F.col("r") * F.col("y") + F.col("g") * F.col("x") + F.col("b")).cast("long")).alias("mixed"))


_CHROMA = f"WITH {_NEAR}, {_chroma_sql('near')}"


@S.add(_CHROMA)
def denoise_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checksums of a photo's filtered pixels."""
    return _checksums(noise.chroma(render.rgb8(spark, sf_dir), 0.6))


@S.add(f"""{_LUMINANCE}, one AS ({_SHIFTED}), px2 AS (SELECT *, 54 * r + 183 * g + 19 * b AS w, (54 * r + 183 * g + 19 * b + 128) >> 8 AS q FROM one),
near2 AS (SELECT c.photo, c.y, c.x, c.r, c.g, c.b, c.w, c.q, dy, dx, n.r AS nr, n.g AS ng, n.b AS nb, n.w AS nw, n.q AS nq FROM px2 c, taps5, px2 n WHERE n.photo = c.photo AND n.y = greatest(0, least(31, c.y + dy)) AND n.x = greatest(0, least(31, c.x + dx))), {_chroma_sql('near2', '2')}""")
def denoise_combined_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both filters, luminance first. Checksums of a photo's pixels."""
    return _checksums(noise.combined(render.rgb8(spark, sf_dir), 0.5, 0.6))


def _mask(spark: SparkSession, sf_dir: str, side: int) -> DataFrame:
    """(photo, y, x, w): a radial weight 0..255 whose centre moves with the photo."""
    cell = F.explode(F.sequence(F.lit(0), F.lit(side * side - 1))).alias("k")
    m = frames.frames(spark, sf_dir).select("photo", cell).select("photo", F.floor(F.col("k") / side).cast("int").alias("y"), (F.col("k") % side).alias("x"))
    d = (F.col("y") - F.col("photo") % side) * (F.col("y") - F.col("photo") % side) + (F.col("x") - side / 2) * (F.col("x") - side / 2)
    return m.withColumn("w", F.greatest(F.lit(0), 255 - F.floor(d * 4000 / (side * side))).cast("int"))


def _mask_sql(side: int) -> str:
    return f"mask AS (SELECT photo, y::INTEGER AS y, x::INTEGER AS x, greatest(0, 255 - floor(((y - photo % {side}) * (y - photo % {side}) + (x - {side / 2!r}::DOUBLE) * (x - {side / 2!r}::DOUBLE)) * 4000 / {side * side}))::INTEGER AS w FROM frames, range({side}) a(y), range({side}) b(x))"


def _weights_sql(side: int) -> str:
    p = f"greatest(0::DOUBLE, least({side - 1}::DOUBLE, ({{0}} + 0.5::DOUBLE) * {side} / 32 - 0.5::DOUBLE))"
    return f"""{_mask_sql(side)}, pt AS (SELECT photo, y, x, {p.format('y')} AS v, {p.format('x')} AS u FROM frames, range(32) a(y), range(32) b(x)),
weights AS (SELECT pt.photo, pt.y, pt.x, ((a.w * (1 - (u - floor(u))) + b.w * (u - floor(u))) * (1 - (v - floor(v))) + (c.w * (1 - (u - floor(u))) + d.w * (u - floor(u))) * (v - floor(v))) / 255 AS weight
  FROM pt JOIN mask a ON a.photo = pt.photo AND a.y = floor(v)::INTEGER AND a.x = floor(u)::INTEGER JOIN mask b ON b.photo = pt.photo AND b.y = floor(v)::INTEGER AND b.x = least(floor(u)::INTEGER + 1, {side - 1})
  JOIN mask c ON c.photo = pt.photo AND c.y = least(floor(v)::INTEGER + 1, {side - 1}) AND c.x = floor(u)::INTEGER JOIN mask d ON d.photo = pt.photo AND d.y = least(floor(v)::INTEGER + 1, {side - 1}) AND d.x = least(floor(u)::INTEGER + 1, {side - 1}))"""


def _weights(spark: SparkSession, sf_dir: str, pixels: DataFrame | None = None) -> DataFrame:
    grid = frames.pixels(frames.sensor_rows(spark, sf_dir)).select("photo", "y", "x") if pixels is None else pixels
    return masks.subject_weights(grid, _mask(spark, sf_dir, 12), 32, 12)


@S.add(f"WITH {frames.frames_sql()}, {_weights_sql(12)} SELECT photo, y::INTEGER AS y, x::INTEGER AS x, {r6('weight')} AS weight FROM weights")
def subject_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weights(spark, sf_dir).select("photo", "y", "x", scalar.rounded(F.col("weight")).alias("weight"))


@S.add(f"""WITH {RGB8}, {_weights_sql(12)}, g AS (SELECT p.*, weight, pow(pow(2::DOUBLE, 0.7::DOUBLE) / (1 + (pow(2::DOUBLE, 0.7::DOUBLE) - 1) * pow(greatest(r, g, b) / 255::DOUBLE, 2.2::DOUBLE)), 1 / 2.2::DOUBLE) AS f FROM rgb8 p JOIN weights w ON w.photo = p.photo AND w.y = p.y AND w.x = p.x)
SELECT photo, y, x, {', '.join(f'greatest(0, least(255, round_even({c} * (1 + weight * (f - 1)), 0)))::INTEGER AS {c}' for c in 'rgb')} FROM g""")
def subject_exposure_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = render.rgb8(spark, sf_dir)
    joined = px.join(_weights(spark, sf_dir), ["photo", "y", "x"])
    out = masks.expose(F.col("r"), F.col("g"), F.col("b"), F.col("weight"), 0.7)
    return joined.select("photo", "y", "x", *(v.alias(c) for v, c in zip(out, "rgb")))


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(photo, k, x0, y0, x1, y1, score): a box of each vector, from its first five components."""
    e = frames.table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 16).cast("long").alias("photo"), (F.col("vec_id") % 16).cast("int").alias("k"), F.transform("embedding", lambda v: F.rint(scalar.clamp(v.cast("double") + 0.5) * 64) / 64).alias("e"))
    half = lambda i: 0.0625 + F.get("e", i) / 4
    return e.select("photo", "k", (F.get("e", 0) - half(2)).alias("x0"), (F.get("e", 1) - half(3)).alias("y0"), (F.get("e", 0) + half(2)).alias("x1"), (F.get("e", 1) + half(3)).alias("y1"), F.get("e", 4).alias("score"))


_BOXES = """e AS (SELECT vec_id // 16 AS photo, (vec_id % 16)::INTEGER AS k, list_transform(embedding, lambda v: round_even(greatest(0::DOUBLE, least(1::DOUBLE, v::DOUBLE + 0.5::DOUBLE)) * 64, 0) / 64) AS e FROM embeddings),
boxes AS (SELECT photo, k, e[1] - (0.0625::DOUBLE + e[3] / 4) AS x0, e[2] - (0.0625::DOUBLE + e[4] / 4) AS y0, e[1] + (0.0625::DOUBLE + e[3] / 4) AS x1, e[2] + (0.0625::DOUBLE + e[4] / 4) AS y1, e[5] AS score FROM e)"""


@S.add(f"""WITH RECURSIVE {_BOXES}, o AS (SELECT *, row_number() OVER (PARTITION BY photo ORDER BY score DESC, k) AS n FROM boxes),
w AS (SELECT photo, 0 AS n, []::STRUCT(x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE, k INTEGER)[] AS kept FROM (SELECT DISTINCT photo FROM o)
UNION ALL SELECT w.photo, o.n::INTEGER, CASE WHEN len(list_filter(w.kept, lambda b: greatest(0, least(b.x1, o.x1) - greatest(b.x0, o.x0)) * greatest(0, least(b.y1, o.y1) - greatest(b.y0, o.y0)) >
  0.3::DOUBLE * ((b.x1 - b.x0) * (b.y1 - b.y0) + (o.x1 - o.x0) * (o.y1 - o.y0) - greatest(0, least(b.x1, o.x1) - greatest(b.x0, o.x0)) * greatest(0, least(b.y1, o.y1) - greatest(b.y0, o.y0))))) = 0
  THEN list_append(w.kept, {{'x0': o.x0, 'y0': o.y0, 'x1': o.x1, 'y1': o.y1, 'k': o.k}}) ELSE w.kept END FROM w JOIN o ON o.photo = w.photo AND o.n = w.n + 1)
SELECT photo, unnest(kept).k AS k FROM w WHERE n = (SELECT max(n) FROM o WHERE o.photo = w.photo)""")
def face_nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.suppress(_boxes(spark, sf_dir))


@S.add(f"""WITH {_BOXES}, {frames.frames_sql()}, i AS (SELECT b.photo, k, count(*) AS n FROM boxes b JOIN frames f ON f.photo = b.photo, range(32) p(y), range(32) q(x)
WHERE ((x + 0.5::DOUBLE) / 32 - (x0 + x1) / 2) * ((x + 0.5::DOUBLE) / 32 - (x0 + x1) / 2) / ((0.32::DOUBLE * (x1 - x0)) * (0.32::DOUBLE * (x1 - x0))) + ((y + 0.5::DOUBLE) / 32 - (y0 + y1) / 2) * ((y + 0.5::DOUBLE) / 32 - (y0 + y1) / 2) / ((0.35::DOUBLE * (y1 - y0)) * (0.35::DOUBLE * (y1 - y0))) <= 1 GROUP BY ALL)
SELECT photo, k, n FROM i WHERE n >= 24""")
def face_ellipses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels within each box's inner ellipse, those of 24 or more. Only the pixels of an ellipse's bounding box are made."""
    b = _boxes(spark, sf_dir).join(frames.frames(spark, sf_dir).select("photo"), "photo")
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    b = b.select("photo", "k", cx.alias("cx"), cy.alias("cy"), (0.32 * (F.col("x1") - F.col("x0"))).alias("rx"), (0.35 * (F.col("y1") - F.col("y0"))).alias("ry"))
    span = lambda c, r: F.sequence(F.greatest(F.lit(0), F.floor((F.col(c) - F.col(r)) * 32) - 1).cast("int"), F.least(F.lit(31), F.ceil((F.col(c) + F.col(r)) * 32)).cast("int"))
    inside = b.where("cx - rx < 1.1 and cx + rx > -0.1 and cy - ry < 1.1 and cy + ry > -0.1").withColumn("y", F.explode(span("cy", "ry"))).withColumn("x", F.explode(span("cx", "rx")))
    h, v = (F.col("x") + 0.5) / 32 - F.col("cx"), (F.col("y") + 0.5) / 32 - F.col("cy")
    hit = inside.where(h * h / (F.col("rx") * F.col("rx")) + v * v / (F.col("ry") * F.col("ry")) <= 1)
    return hit.groupBy("photo", "k").agg(F.count("*").alias("n")).where("n >= 24")


@S.add(f"""WITH RECURSIVE {frames.sensor_sql()}, core AS (SELECT photo, y * 32 + x AS c FROM sensor WHERE dn > 8700 ), walk AS (SELECT photo, c, c AS root FROM core UNION SELECT w.photo, n.c, w.root FROM walk w JOIN core n ON n.photo = w.photo AND (n.c = w.c + 32 OR n.c = w.c - 32 OR (n.c = w.c + 1 AND n.c % 32 > 0) OR (n.c = w.c - 1 AND w.c % 32 > 0)) WHERE n.c > w.root),
l AS (SELECT photo, c, min(root) AS label FROM walk GROUP BY ALL), s AS (SELECT photo, label, count(*) AS n FROM l GROUP BY ALL HAVING count(*) * 100 >= 1024) SELECT photo, label, n FROM s QUALIFY row_number() OVER (PARTITION BY photo ORDER BY n DESC, label) <= 3""")
def mask_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    core = frames.pixels(frames.sensor_rows(spark, sf_dir)).where("dn > 8700")
    return masks.components(core.select("photo", "y", "x"), 32)
