"""Pixel projections, stencils and codecs' arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import codec, stencil
from ..plans import frames, render
from .registry import Suite

S = Suite()
SENSOR, FRAMES = frames.sensor_sql(), frames.frames_sql()


def r6(v: str) -> str:
    return f"round_even(({v}) * 1000000::DOUBLE, 0) / 1000000::DOUBLE"


@S.add(f"WITH {SENSOR} SELECT photo, y, x, {r6('greatest(0::DOUBLE, least(1::DOUBLE, (dn - 1008)::DOUBLE / 15375::DOUBLE))')} AS v FROM sensor")
def normalize_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = frames.pixels(frames.sensor_rows(spark, sf_dir))
    return px.select("photo", "y", "x", scalar.rounded(scalar.normalize(F.col("dn"), frames.BLACK, frames.WHITE)).alias("v"))


@S.add(f"""WITH {SENSOR},{FRAMES} SELECT s.photo, y, x, {r6("greatest(0::DOUBLE, least(1::DOUBLE, greatest(0::DOUBLE, least(1::DOUBLE, (dn - 1008)::DOUBLE / 15375::DOUBLE)) * CASE y % 2 + x % 2 WHEN 0 THEN wb_r WHEN 2 THEN wb_b ELSE 1::DOUBLE END))")} AS v FROM sensor s JOIN frames f ON s.photo = f.photo""")
def as_shot_neutral(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = frames.pixels(frames.sensor_rows(spark, sf_dir)).join(frames.frames(spark, sf_dir), "photo")
    site = scalar.cfa(F.col("y"), F.col("x"))
    gain = F.when(site == 0, F.col("wb_r")).when(site == 2, F.col("wb_b")).otherwise(1.0)
    return px.select("photo", "y", "x", scalar.rounded(scalar.clamp(scalar.normalize(F.col("dn"), frames.BLACK, frames.WHITE) * gain)).alias("v"))


_PROFILE_VALUES = ", ".join(f"('{frames.MAKE}', '{model}', " + ", ".join(f"{v}::DOUBLE" for row in m for v in row) + ")" for model, m in frames.MATRICES.items())
_PROFILES = f"profiles AS (SELECT * FROM (VALUES {_PROFILE_VALUES}) t(make, model, m00, m01, m02, m10, m11, m12, m20, m21, m22))"


@S.add(f"WITH {FRAMES}, {_PROFILES} SELECT f.photo, f.make, f.model, p.m00, p.m11, p.m22, p.make IS NOT NULL AS known FROM frames f LEFT JOIN profiles p ON upper(trim(f.make)) = p.make AND upper(trim(f.model)) = p.model")
def camera_profile_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, p = frames.frames(spark, sf_dir), frames.profiles(spark).withColumnsRenamed({"make": "p_make", "model": "p_model"})
    joined = f.join(F.broadcast(p), (F.upper(F.trim("make")) == F.col("p_make")) & (F.upper(F.trim("model")) == F.col("p_model")), "left")
    return joined.select("photo", "make", "model", "m00", "m11", "m22", F.col("p_make").isNotNull().alias("known"))


@S.add(f"WITH {render.LINEAR} SELECT photo, y, x, {r6('r')} AS r, {r6('g')} AS g, {r6('b')} AS b FROM lin")
def camera_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.linear(spark, sf_dir).select("photo", "y", "x", *(scalar.rounded(F.col(c)).alias(c) for c in "rgb"))


@S.add(f"""WITH {FRAMES}, p AS (SELECT photo, wb_r, wb_b, (photo % 5 - 2) / 4.0::DOUBLE AS w, (photo % 3 - 1) / 2.0::DOUBLE AS t FROM frames)
SELECT photo, {r6('wb_r * ((1 + 0.12::DOUBLE * w) * (1 + 0.08::DOUBLE * t))')} AS red, {r6('(1 + 0.03::DOUBLE * w) * (1 - 0.12::DOUBLE * t)')} AS green, {r6('wb_b * ((1 - 0.12::DOUBLE * w) * (1 + 0.08::DOUBLE * t))')} AS blue FROM p""")
def white_balance_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames.frames(spark, sf_dir).withColumn("w", (F.col("photo") % 5 - 2) / 4).withColumn("t", (F.col("photo") % 3 - 1) / 2)
    r, g, b = scalar.balance(F.col("w"), F.col("t"))
    return f.select("photo", scalar.rounded(F.col("wb_r") * r).alias("red"), scalar.rounded(g).alias("green"), scalar.rounded(F.col("wb_b") * b).alias("blue"))


#: Settings of the tone queries.
EV, CONTRAST, HIGHLIGHTS, SHADOWS, SATURATION = 0.3, 0.2, -0.4, 0.3, 0.25


def _toned(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = lambda c: scalar.tonal(scalar.contrast(F.col(c) * 2**EV, CONTRAST), HIGHLIGHTS, SHADOWS)
    return render.linear(spark, sf_dir).select("photo", "y", "x", *(v(c).alias(c) for c in "rgb"))


def _tone_sql(c: str) -> str:
    v = f"(({c} * {2**EV!r}::DOUBLE - 0.18::DOUBLE) * {1 + 0.75 * CONTRAST!r}::DOUBLE + 0.18::DOUBLE)"
    p = f"greatest(0::DOUBLE, least(1::DOUBLE, {v}))"
    a = -0.3 * HIGHLIGHTS
    return f"CASE WHEN {v} > 1 THEN 1 - {a * a!r}::DOUBLE / ({a!r}::DOUBLE + {1 - 2 * a!r}::DOUBLE * ({v} - 1)) ELSE {v} + {1.2 * SHADOWS!r}::DOUBLE * {p} * (1 - {p}) * (1 - {p}) + {0.3 * HIGHLIGHTS!r}::DOUBLE * {p} * {p} END"


_TONED = render.LINEAR + f", toned AS (SELECT photo, y, x, {', '.join(f'{_tone_sql(c)} AS {c}' for c in 'rgb')} FROM lin)"
_F = 1 + 0.75 * SATURATION


@S.add(f"WITH {_TONED}, l AS (SELECT *, 0.2126::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * b AS l FROM toned) SELECT photo, y, x, " + ", ".join(f"{render.encode_sql(f'l + ({c} - l) * {_F!r}::DOUBLE')}::INTEGER AS {c}" for c in "rgb") + " FROM l")
def tone_linear_sat(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _toned(spark, sf_dir).withColumn("l", scalar.luma709(F.col("r"), F.col("g"), F.col("b")))
    return df.select("photo", "y", "x", *(scalar.encode(F.col("l") + (F.col(c) - F.col("l")) * _F).cast("int").alias(c) for c in "rgb"))


_P = ", ".join(f"pow(greatest(0::DOUBLE, least(1::DOUBLE, {c})), 1::DOUBLE / 2.2::DOUBLE) AS {c}" for c in "rgb")


@S.add(f"WITH {_TONED}, e AS (SELECT photo, y, x, {_P} FROM toned), l AS (SELECT *, (54 * r + 183 * g + 19 * b) / 256::DOUBLE AS l FROM e) SELECT photo, y, x, " + ", ".join(f"round_even(greatest(0::DOUBLE, least(1::DOUBLE, l + ({c} - l) * {_F!r}::DOUBLE)) * 255, 0)::INTEGER AS {c}" for c in "rgb") + " FROM l")
def tone_encoded_sat(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _toned(spark, sf_dir).select("photo", "y", "x", *(F.pow(scalar.clamp(F.col(c)), F.lit(scalar.GAMMA)).alias(c) for c in "rgb"))
    df = df.withColumn("l", scalar.weighted256(F.col("r"), F.col("g"), F.col("b")) / 256)
    return df.select("photo", "y", "x", *(F.rint(scalar.clamp(F.col("l") + (F.col(c) - F.col("l")) * _F) * 255).cast("int").alias(c) for c in "rgb"))


@S.add(f"WITH g AS (SELECT k, k / 1000::DOUBLE AS c FROM range(-200, 2200) t(k)), v AS (SELECT k, (c / {2**EV!r}::DOUBLE) AS r FROM (SELECT k, (c - 0.18::DOUBLE) / {1 + 0.75 * CONTRAST!r}::DOUBLE + 0.18::DOUBLE AS c FROM g)) SELECT k, {r6(_tone_sql('r'))} AS v FROM v")
def tonal_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("k") / 1000
    back = ((c - 0.18) / (1 + 0.75 * CONTRAST) + 0.18) / 2**EV
    again = scalar.contrast(back * 2**EV, CONTRAST)
    return spark.range(-200, 2200).withColumnRenamed("id", "k").select("k", scalar.rounded(scalar.tonal(again, HIGHLIGHTS, SHADOWS)).alias("v"))


@S.add(f"""WITH {SENSOR}, b AS (SELECT photo, y // 2 AS y, x // 2 AS x, max(dn) FILTER (y % 2 = 0 AND x % 2 = 0) AS r, sum(dn) FILTER ((y + x) % 2 = 1) // 2 AS g, max(dn) FILTER (y % 2 = 1 AND x % 2 = 1) AS b FROM sensor GROUP BY ALL)
SELECT photo, y::INTEGER AS y, x::INTEGER AS x, {', '.join(f"round_even(pow(greatest(0, least(1, round_even(greatest(0::DOUBLE, least(1::DOUBLE, ({c} - 1008)::DOUBLE / 15375::DOUBLE)) * 65535, 0) / 65535::DOUBLE)), 1::DOUBLE / 2.2::DOUBLE) * 255, 0)::INTEGER AS {c}" for c in 'rgb')} FROM b""")
def lut_fast_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pixel for each 2 x 2 block; levels go through a table of 65535ths before the gamma, as an integer table would have them."""
    px = frames.pixels(frames.sensor_rows(spark, sf_dir))
    site = scalar.cfa(F.col("y"), F.col("x"))
    blocks = px.groupBy("photo", F.floor(F.col("y") / 2).cast("int").alias("y"), F.floor(F.col("x") / 2).cast("int").alias("x")).agg(
        F.max(F.when(site == 0, F.col("dn"))).alias("r"), F.shiftright(F.sum(F.when(site == 1, F.col("dn"))), 1).alias("g"), F.max(F.when(site == 2, F.col("dn"))).alias("b")
    )
    level = lambda c: F.rint(scalar.normalize(F.col(c), frames.BLACK, frames.WHITE) * 65535) / 65535
    return blocks.select("photo", "y", "x", *(scalar.encode(level(c)).cast("int").alias(c) for c in "rgb"))


_SHIFTED = "taps AS (SELECT dy, dx FROM (VALUES {v}) a(dy), (VALUES {v}) b(dx))"
_TAPS1, _TAPS2 = _SHIFTED.format(v="(-1), (0), (1)"), _SHIFTED.format(v="(-2), (-1), (0), (1), (2)")


def _rgb(df: DataFrame) -> DataFrame:
    return stencil.pixels(df).select("photo", "y", "x", *(scalar.rounded(F.col(c)).alias(c) for c in "rgb"))


@S.add(f"""WITH {SENSOR}, {_TAPS1}, n AS (SELECT photo, y + dy AS y, x + dx AS x, y % 2 + x % 2 AS ch, dn, dy = 0 AND dx = 0 AS own FROM sensor, taps),
m AS (SELECT photo, y, x, {', '.join(f"coalesce(max(dn) FILTER (ch = {k} AND own)::DOUBLE, sum(dn) FILTER (ch = {k})::DOUBLE / count(*) FILTER (ch = {k})) AS {c}" for k, c in enumerate('rgb'))} FROM n WHERE y BETWEEN 0 AND 31 AND x BETWEEN 0 AND 31 GROUP BY ALL)
SELECT photo, y, x, {', '.join(f'{r6(c)} AS {c}' for c in 'rgb')} FROM m""")
def demosaic_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rgb(stencil.simple(frames.sensor_rows(spark, sf_dir)))


@S.add(f"WITH {render.LINEAR} SELECT photo, y, x, {', '.join(f'{r6(c)} AS {c}' for c in 'rgb')} FROM dem")
def demosaic_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rgb(stencil.bilinear(render.balanced_rows(spark, sf_dir), "v"))


_MIRROR = "CASE WHEN abs({e}) > 31 THEN 62 - abs({e}) ELSE abs({e}) END"
_MALVAR = f"""WITH {SENSOR}, {_TAPS2},
n AS (SELECT c.photo, c.y, c.x, dy, dx, s.dn FROM sensor c, taps, sensor s WHERE abs(dy) + abs(dx) <= 2 AND s.photo = c.photo AND s.y = {_MIRROR.format(e='(c.y + dy)')} AND s.x = {_MIRROR.format(e='(c.x + dx)')}),
t AS (SELECT photo, y, x, sum(dn) FILTER (dy = 0 AND dx = 0) AS c, sum(dn) FILTER (dy = 0 AND abs(dx) = 1) AS h, sum(dn) FILTER (dx = 0 AND abs(dy) = 1) AS v, sum(dn) FILTER (abs(dx) = 2) AS hh, sum(dn) FILTER (abs(dy) = 2) AS vv, sum(dn) FILTER (abs(dx) = 1 AND abs(dy) = 1) AS d FROM n GROUP BY ALL),
k AS (SELECT photo, y, x, c::DOUBLE AS c, y % 2 AS oy, x % 2 AS ox, (4 * c + 2 * (h + v) - hh - vv)::DOUBLE / 8 AS cross_, (6 * c + 2 * d - 1.5::DOUBLE * (hh + vv)) / 8 AS other, (5 * c + 4 * h - d - hh + 0.5::DOUBLE * vv) / 8 AS across, (5 * c + 4 * v - d - vv + 0.5::DOUBLE * hh) / 8 AS along FROM t)
SELECT photo, y, x, {r6('CASE WHEN oy = 0 AND ox = 0 THEN c WHEN oy = 1 AND ox = 1 THEN other WHEN oy = 1 THEN along ELSE across END')} AS r, {r6('CASE WHEN oy = ox THEN cross_ ELSE c END')} AS g, {r6('CASE WHEN oy = 1 AND ox = 1 THEN c WHEN oy = 0 AND ox = 0 THEN other WHEN oy = 1 THEN across ELSE along END')} AS b FROM k"""


@S.add(_MALVAR)
def demosaic_malvar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rgb(stencil.malvar(frames.sensor_rows(spark, sf_dir)))


@S.add(_MALVAR + " WHERE y BETWEEN 9 AND 20 AND x BETWEEN 5 AND 26")
def detail_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A viewport of a render: only its rows and a halo of two are read into the stencil; equal to the crop of the whole."""
    top, bottom, left, right = 9, 20, 5, 26
    rows = frames.sensor_rows(spark, sf_dir).where(F.col("y").between(top - 2, bottom + 2))
    core = stencil.malvar(rows, height=32).where(F.col("y").between(top, bottom))
    return _rgb(core).where(F.col("x").between(left, right))


@S.add(f"WITH {render.RGB8} SELECT photo, (y // 2)::INTEGER AS y, (x // 2)::INTEGER AS x, r, g, b FROM rgb8 WHERE y % 2 = 0 AND x % 2 = 0")
def resize_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = (F.col("y") % 2 == 0) & (F.col("x") % 2 == 0)
    return render.rgb8(spark, sf_dir).where(half).select("photo", F.floor(F.col("y") / 2).cast("int").alias("y"), F.floor(F.col("x") / 2).cast("int").alias("x"), "r", "g", "b")


@S.add(f"WITH {render.LINEAR} SELECT photo, (y // 4)::INTEGER AS y, (x // 4)::INTEGER AS x, {', '.join(f'round_even(avg({c}) * 10000000000::DOUBLE, 0) / 10000000000::DOUBLE AS {c}' for c in 'rgb')} FROM lin GROUP BY ALL")
def resize_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.linear(spark, sf_dir).groupBy("photo", F.floor(F.col("y") / 4).cast("int").alias("y"), F.floor(F.col("x") / 4).cast("int").alias("x")).agg(*(scalar.rounded(F.avg(c), 1e10).alias(c) for c in "rgb"))


#: For each EXIF orientation the place (y, x) a pixel goes to, of a frame of side n: as text for both engines.
ORIENT = {1: ("y", "x"), 2: ("y", "n - 1 - x"), 3: ("n - 1 - y", "n - 1 - x"), 4: ("n - 1 - y", "x"), 5: ("x", "y"), 6: ("x", "n - 1 - y"), 7: ("n - 1 - x", "n - 1 - y"), 8: ("n - 1 - x", "y")}


def _orient(k: int, n: str) -> str:
    return "CASE orientation " + " ".join(f"WHEN {o} THEN {p[k].replace('n', n)}" for o, p in ORIENT.items()) + " END"


@S.add(f"WITH {SENSOR},{FRAMES} SELECT photo, {_orient(0, '32')} AS y, {_orient(1, '32')} AS x, dn FROM sensor JOIN frames USING (photo)")
def exif_orient(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = frames.pixels(frames.sensor_rows(spark, sf_dir)).join(frames.frames(spark, sf_dir).select("photo", "orientation"), "photo")
    n, y, x, o = 32, F.col("y"), F.col("x"), F.col("orientation")
    up = lambda v: n - 1 - v
    turned = o >= 5
    a = F.when(turned, x).otherwise(y)
    b = F.when(turned, y).otherwise(x)
    return px.select("photo", F.when(o.isin(3, 4, 7, 8), up(a)).otherwise(a).alias("y"), F.when(o.isin(2, 3, 6, 7), up(b)).otherwise(b).alias("x"), "dn")


_REGION = "SELECT photo, orientation, 48 AS sw, 32 AS sh, 3 + photo % 5 AS x, 2 + photo % 3 AS y, 7 + photo % 4 AS w, 5 + photo % 6 AS h FROM frames"
_MAP = {2: ("sw - x - w", "y", "w", "h"), 3: ("sw - x - w", "sh - y - h", "w", "h"), 4: ("x", "sh - y - h", "w", "h"), 5: ("y", "x", "h", "w"), 6: ("y", "sh - x - w", "h", "w"), 7: ("sw - y - h", "sh - x - w", "h", "w"), 8: ("sw - y - h", "x", "h", "w")}


@S.add(f"WITH {FRAMES}, q AS ({_REGION}) SELECT photo, orientation, " + ", ".join(f"(CASE orientation {' '.join(f'WHEN {o} THEN {m[k]}' for o, m in _MAP.items())} ELSE {d} END)::BIGINT AS {name}" for k, (d, name) in enumerate([("x", "left_"), ("y", "top_"), ("w", "width"), ("h", "height")])) + " FROM q")
def sensor_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An oriented rectangle back in sensor coordinates of a 48 x 32 frame."""
    p, o = F.col("photo"), F.col("orientation")
    x, y, w, h, sw, sh = 3 + p % 5, 2 + p % 3, 7 + p % 4, 5 + p % 6, 48, 32
    flip_x = F.when(o.isin(2, 3), sw - x - w).when(o.isin(5, 6), y).when(o.isin(7, 8), sw - y - h).otherwise(x)
    flip_y = F.when(o.isin(3, 4), sh - y - h).when(o.isin(6, 7), sh - x - w).when(o.isin(5, 8), x).otherwise(y)
    return frames.frames(spark, sf_dir).select("photo", "orientation", *(c.cast("long").alias(n) for c, n in ((flip_x, "left_"), (flip_y, "top_"), (F.when(o >= 5, h).otherwise(w), "width"), (F.when(o >= 5, w).otherwise(h), "height"))))


@S.add(f"""WITH {FRAMES}, q AS (SELECT photo, photo % 40 AS x, photo % 25 AS y, 8 AS w, 7 AS h, 2 + photo % 3 AS r FROM frames)
SELECT photo, (4 + greatest(0, x - r))::BIGINT AS left_, (6 + greatest(0, y - r))::BIGINT AS top_, (least(48, x + w + r) - greatest(0, x - r))::BIGINT AS width, (least(32, y + h + r) - greatest(0, y - r))::BIGINT AS height, (x - greatest(0, x - r))::BIGINT AS core_x, (y - greatest(0, y - r))::BIGINT AS core_y FROM q""")
def region_halo(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("photo")
    x, y, w, h, r = p % 40, p % 25, 8, 7, 2 + p % 3
    x0, y0 = F.greatest(F.lit(0), x - r), F.greatest(F.lit(0), y - r)
    x1, y1 = F.least(F.lit(48), x + w + r), F.least(F.lit(32), y + h + r)
    return frames.frames(spark, sf_dir).select("photo", *(c.cast("long").alias(n) for c, n in ((4 + x0, "left_"), (6 + y0, "top_"), (x1 - x0, "width"), (y1 - y0, "height"), (x - x0, "core_x"), (y - y0, "core_y"))))


@S.add(f"""WITH {FRAMES}, q AS (SELECT photo, photo % 7 AS l, photo % 5 AS t, least(50 + photo % 9, 64 - photo % 7) AS w, least(40 + photo % 11, 48 - photo % 5) AS h FROM frames)
SELECT photo, (l + l % 2)::BIGINT AS left_, (t + t % 2)::BIGINT AS top_, (w - l % 2 - (w - l % 2) % 2)::BIGINT AS width, (h - t % 2 - (h - t % 2) % 2)::BIGINT AS height FROM q""")
def active_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An active area within a 64 x 48 frame, moved to the mosaic's phase and to even sizes."""
    p = F.col("photo")
    left, top = p % 7, p % 5
    w, h = F.least(50 + p % 9, 64 - left) - left % 2, F.least(40 + p % 11, 48 - top) - top % 2
    return frames.frames(spark, sf_dir).select("photo", *(c.cast("long").alias(n) for c, n in ((left + left % 2, "left_"), (top + top % 2, "top_"), (w - w % 2, "width"), (h - h % 2, "height"))))


@S.add("SELECT vec_id // 16 AS photo, (((vec_id % 16) // 4) * 8 + (i - 1) // 8)::INTEGER AS y, (((vec_id % 16) % 4) * 8 + (i - 1) % 8)::INTEGER AS x, v FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) WHERE ((vec_id % 16) // 4) * 8 + (i - 1) // 8 < 30 AND ((vec_id % 16) % 4) * 8 + (i - 1) % 8 < 27")
def tile_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of 8 x 8 in a mosaic of 4 across, cropped to 27 x 30: places by arithmetic, no join."""
    tiles = frames.table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    t, i = F.col("vec_id") % 16, F.col("i")
    placed = tiles.select(F.floor(F.col("vec_id") / 16).cast("long").alias("photo"), (F.floor(t / 4) * 8 + F.floor(i / 8)).cast("int").alias("y"), (t % 4 * 8 + i % 8).cast("int").alias("x"), F.col("v").cast("double").alias("v"))
    return placed.where("y < 30 and x < 27")


def _packed(bits: int):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = frames.sensor_rows(spark, sf_dir).select("photo", "y", F.transform("px", lambda d: F.shiftright(d, 14 - bits)).alias("px"))
        packed = rows.select("photo", "y", codec.pack("px", bits).alias("packed"), F.size("px").alias("width"))
        return frames.pixels(packed.select("photo", "y", codec.unpack("packed", "width", bits).alias("px")))

    return query


for _bits in (12, 14):
    S.add(f"WITH {SENSOR} SELECT photo, y, x, (dn >> {14 - _bits})::INTEGER AS dn FROM sensor", f"bit_unpack_{_bits}")(_packed(_bits))


_DIFFS = """d AS (SELECT vec_id // 16 AS photo, ((vec_id % 16) // 4) * 8 + (i - 1) // 8 AS y, ((vec_id % 16) % 4) * 8 + (i - 1) % 8 AS x, round_even(v::DOUBLE * 64, 0)::BIGINT AS d FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings))"""


@S.add(f"""WITH {_DIFFS}, h AS (SELECT *, sum(d) OVER (PARTITION BY photo, y, x % 2 ORDER BY x)::BIGINT AS run FROM d),
v AS (SELECT photo, y, x AS lane, coalesce(sum(d) OVER (PARTITION BY photo, y % 2, x ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS seed FROM d WHERE x < 2)
SELECT h.photo, h.y::INTEGER AS y, h.x::INTEGER AS x, least(16383, greatest(0, 2048 + seed + run))::BIGINT AS dn FROM h JOIN v ON h.photo = v.photo AND h.y = v.y AND h.x % 2 = v.lane""")
def huffman_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction by lanes: a running sum along each row's even and odd columns, on a seed that runs down the rows of equal parity. Only the output is clamped."""
    tiles = frames.table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    t, i = F.col("vec_id") % 16, F.col("i")
    d = tiles.select(F.floor(F.col("vec_id") / 16).cast("long").alias("photo"), (F.floor(t / 4) * 8 + F.floor(i / 8)).cast("int").alias("y"), (t % 4 * 8 + i % 8).cast("int").alias("x"), F.rint(F.col("v").cast("double") * 64).cast("long").alias("d"))
    run = d.withColumn("run", F.sum("d").over(Window.partitionBy("photo", "y", F.col("x") % 2).orderBy("x")))
    above = Window.partitionBy("photo", F.col("y") % 2, "x").orderBy("y").rowsBetween(Window.unboundedPreceding, -1)
    seeds = d.where("x < 2").select("photo", "y", F.col("x").alias("lane"), F.coalesce(F.sum("d").over(above), F.lit(0)).alias("seed"))
    joined = run.withColumn("lane", F.col("x") % 2).join(seeds, ["photo", "y", "lane"])
    return joined.select("photo", "y", "x", F.least(F.lit(16383), F.greatest(F.lit(0), 2048 + F.col("seed") + F.col("run"))).cast("long").alias("dn"))


@S.add("""WITH b AS (SELECT vec_id AS id, unnest(range(32)) AS k, embedding AS e FROM embeddings), c AS (SELECT id, k, round_even(e[k + 1]::DOUBLE * 256, 0)::BIGINT AS low, round_even(e[k + 33]::DOUBLE * 256, 0)::BIGINT AS high FROM b),
e AS (SELECT *, low - ((coalesce(lag(high) OVER w, high) + high + 2) >> 2) AS even FROM c WINDOW w AS (PARTITION BY id ORDER BY k)),
o AS (SELECT *, high + ((even + coalesce(lead(even) OVER w, even)) >> 1) AS odd FROM e WINDOW w AS (PARTITION BY id ORDER BY k))
SELECT id, (2 * k)::INTEGER AS pos, even AS v FROM o UNION ALL SELECT id, (2 * k + 1)::INTEGER, odd FROM o""")
def wavelet_53(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = frames.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda v: F.rint(v.cast("double") * 256).cast("long")).alias("e"))
    return codec.inverse_53(bands.select("id", F.slice("e", 1, 32).alias("low"), F.slice("e", 33, 32).alias("high"))).select("id", F.posexplode("out").alias("pos", "v"))


_ROW, _COL = "OVER (PARTITION BY photo, y ORDER BY x)", "OVER (PARTITION BY photo, x ORDER BY y)"


@S.add(f"""WITH {SENSOR}, c AS (SELECT photo, y // 2 AS y, x // 2 AS x, sum(dn) FILTER (y % 2 = 0 AND x % 2 = 0)::BIGINT AS luma, (sum(dn) FILTER (y % 2 = 0 AND x % 2 = 1) - 8192)::BIGINT AS rd, (sum(dn) FILTER (y % 2 = 1 AND x % 2 = 0) - 8192)::BIGINT AS delta, (sum(dn) FILTER (y % 2 = 1 AND x % 2 = 1) - 8192)::BIGINT AS bd FROM sensor GROUP BY ALL),
p1 AS (SELECT *, delta + coalesce(lead(delta) {_ROW}, delta) AS pair FROM c), p2 AS (SELECT *, luma - ((pair + coalesce(lag(pair) {_COL}, pair)) >> 3) AS y1 FROM p1), p3 AS (SELECT *, coalesce(lead(y1) {_COL}, luma - (pair >> 2)) AS nx FROM p2),
p4 AS (SELECT *, delta + ((y1 + coalesce(lag(y1) {_ROW}, y1) + nx + coalesce(lag(nx) {_ROW}, nx)) >> 2) AS y2 FROM p3),
p5 AS (SELECT *, y1 - ((rd + coalesce(lead(rd) {_ROW}, rd) + bd + coalesce(lag(bd) {_COL}, bd)) >> 3) AS green1, y2 - ((rd + coalesce(lead(rd) {_COL}, rd) + bd + coalesce(lag(bd) {_ROW}, bd)) >> 3) AS green2 FROM p4)
SELECT photo, y::INTEGER AS y, x::INTEGER AS x, rd + ((green1 + coalesce(lag(green1) {_ROW}, green1) + green2 + coalesce(lag(green2) {_COL}, green2)) >> 2) AS red, green1, green2, bd + ((green1 + coalesce(lead(green1) {_COL}, green1) + green2 + coalesce(lead(green2) {_ROW}, green2)) >> 2) AS blue FROM p5""")
def color_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mosaic samples as lifted planes, turned back into four colours."""
    px = frames.pixels(frames.sensor_rows(spark, sf_dir))
    site = lambda a, b, less=0: (F.sum(F.when((F.col("y") % 2 == a) & (F.col("x") % 2 == b), F.col("dn"))) - less).cast("long")
    planes = px.groupBy("photo", F.floor(F.col("y") / 2).cast("int").alias("cy"), F.floor(F.col("x") / 2).cast("int").alias("cx")).agg(site(0, 0).alias("luma"), site(0, 1, 8192).alias("rd"), site(1, 0, 8192).alias("delta"), site(1, 1, 8192).alias("bd"))
    return codec.color_lift(planes.withColumnsRenamed({"cy": "y", "cx": "x"}))


@S.add("""WITH g AS (SELECT i, i - 65535::DOUBLE * sqrt(1008::DOUBLE / 16383::DOUBLE) AS d, 65535::DOUBLE * sqrt(1008::DOUBLE / 16383::DOUBLE) AS p FROM range(65536) t(i))
SELECT i, greatest(0, least(16383, floor(CASE WHEN d < 0 THEN 1008::DOUBLE * (1 - (d / p) * (d / p)) ELSE 1008::DOUBLE + 15375::DOUBLE * ((d / (65535 - p)) * (d / (65535 - p))) END + 0.5::DOUBLE)))::INTEGER AS dn FROM g""")
def he_linearize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(65536).select(F.col("id").alias("i"), codec.linear_level(F.col("id")).alias("dn"))


@S.add("""SELECT t, p, r, (CASE WHEN r <= 2 * (greatest(t, p) - t) THEN CASE WHEN r % 2 = 0 THEN greatest(t, p) + r // 2 ELSE greatest(t, p) - (r + 1) // 2 END ELSE t + r END)::BIGINT AS v FROM range(16) a(t), range(16) b(p), range(32) c(r)""")
def gcli_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = spark.range(16 * 16 * 32).select(F.floor(F.col("id") / 512).cast("long").alias("t"), (F.floor(F.col("id") / 32) % 16).cast("long").alias("p"), (F.col("id") % 32).alias("r"))
    return grid.select("t", "p", "r", codec.predict_gcli(F.col("t"), F.col("p"), F.col("r")).cast("long").alias("v"))


@S.add("""WITH g AS (SELECT c, n, greatest(1, n - 1 + 1) AS s FROM range(-300, 301) a(c), range(12) b(n)), t AS (SELECT c, n, (SELECT sum(abs(c) >> (s * k)) FROM range(0, 12) z(k) WHERE s * k < 62) AS m FROM g)
SELECT c, n, (sign(c) * m * 16)::BIGINT AS v FROM t""")
def dequantize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Magnitudes with a geometric series of their shifts, for a threshold of 1."""
    grid = spark.range(601 * 12).select((F.floor(F.col("id") / 12) - 300).cast("long").alias("c"), (F.col("id") % 12).cast("long").alias("n"))
    return grid.select("c", "n", codec.dequantize(F.col("c"), F.col("n"), F.lit(1)).cast("long").alias("v"))


@S.add(f"""WITH {SENSOR}, b AS (SELECT photo, dn, row_number() OVER (PARTITION BY photo ORDER BY dn) - 1 AS k, count(*) OVER (PARTITION BY photo) AS n FROM sensor WHERE y < 2 OR y >= 30 OR x < 3 OR x >= 28)
SELECT photo, least(greatest(dn, 0), 16383 // 8)::INTEGER AS black FROM b WHERE k = n * 5 // 100""")
def black_level_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest rank at 5 % of the samples outside the active area, up to an eighth of white."""
    px = frames.pixels(frames.sensor_rows(spark, sf_dir)).where("y < 2 or y >= 30 or x < 3 or x >= 28")
    ranked = px.groupBy("photo").agg(F.sort_array(F.collect_list("dn")).alias("d"))
    return ranked.select("photo", F.least(F.greatest(F.element_at("d", F.floor(F.size("d") * 5 / 100).cast("int") + 1), F.lit(0)), F.lit(frames.WHITE // 8)).alias("black"))


#: Knots of the linearisation query: every 64th level, rising faster and faster.
@S.add("""SELECT i, (y0 + ((y1 - y0) * (i - 64 * k)) // 64)::BIGINT AS v FROM (SELECT i, i // 64 AS k, (i // 64) * (i // 64) + 3 * (i // 64) AS y0, (i // 64 + 1) * (i // 64 + 1) + 3 * (i // 64 + 1) AS y1 FROM range(4096) t(i))""")
def linearization_knots(spark: SparkSession, sf_dir: str) -> DataFrame:
    knots = F.transform(F.sequence(F.lit(0), F.lit(64)), lambda k: k * k + 3 * k)
    k = F.floor(F.col("id") / 64).cast("int")
    a, b = F.get("knots", k), F.get("knots", k + 1)
    return spark.range(4096).withColumn("knots", knots).select(F.col("id").alias("i"), (a + F.floor((b - a) * (F.col("id") - 64 * k) / 64)).cast("long").alias("v"))


@S.add(f"""WITH {render.RGB8}, a AS (SELECT photo, y, x, avg(r) OVER (PARTITION BY photo, y ORDER BY x ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m FROM rgb8)
SELECT photo, y, x, {r6('avg(m) OVER (PARTITION BY photo, x ORDER BY y ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)')} AS mean FROM a""")
def box_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stencil.box_mean(render.rgb8(spark, sf_dir), "r", 2).select("photo", "y", "x", scalar.rounded(F.col("mean")).alias("mean"))
