"""Candidate searches and solvers, as rows and folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar
from ..plans import frames, render
from .masks import _weights, _weights_sql
from .pixel import r6
from .registry import Suite

S = Suite()
RGB8 = render.RGB8
#: Bounds of warmth and tint.
WARMTH, TINT = 0.35, 0.25

_SYSTEM = "s AS (SELECT k, 1 + (k % 7) / 4::DOUBLE AS a, (k % 5 - 2) / 4::DOUBLE AS b, (k % 3 - 1) / 4::DOUBLE AS c, 1 + (k % 11) / 8::DOUBLE AS d, (k % 13 - 6) / 4::DOUBLE AS p, (k % 17 - 8) / 4::DOUBLE AS q FROM range(400) t(k))"
_EDGE_X = "greatest(-0.25::DOUBLE, least(0.25::DOUBLE, ((p - a * {v}) * b + (q - c * {v}) * d) / (b * b + d * d)))"
_EDGE_Y = "greatest(-0.35::DOUBLE, least(0.35::DOUBLE, ((p - b * {v}) * a + (q - d * {v}) * c) / (a * a + c * c)))"


@S.add(f"""WITH {_SYSTEM}, e AS (SELECT *, 0 AS o, (p * d - b * q) / (a * d - b * c) AS x, (a * q - c * p) / (a * d - b * c) AS y FROM s
UNION ALL SELECT *, 1, -0.35::DOUBLE, {_EDGE_X.format(v='(-0.35::DOUBLE)')} FROM s UNION ALL SELECT *, 2, 0.35::DOUBLE, {_EDGE_X.format(v='0.35::DOUBLE')} FROM s
UNION ALL SELECT *, 3, {_EDGE_Y.format(v='(-0.25::DOUBLE)')}, -0.25::DOUBLE FROM s UNION ALL SELECT *, 4, {_EDGE_Y.format(v='0.25::DOUBLE')}, 0.25::DOUBLE FROM s),
r AS (SELECT *, round_even(((a * x + b * y - p) * (a * x + b * y - p) + (c * x + d * y - q) * (c * x + d * y - q)) * 1e9::DOUBLE, 0) AS res FROM e WHERE abs(x) <= 0.35::DOUBLE AND abs(y) <= 0.25::DOUBLE)
SELECT k, {r6('x')} AS warmth, {r6('y')} AS tint FROM r QUALIFY row_number() OVER (PARTITION BY k ORDER BY res, o) = 1""")
def wb_bounded_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least squares of two controls in a box: the inner solution, if it is inside, and the best of each edge; the least residual wins."""
    k = F.col("id")
    s = spark.range(400).select(k.alias("k"), (1 + k % 7 / 4).alias("a"), ((k % 5 - 2) / 4).alias("b"), ((k % 3 - 1) / 4).alias("c"), (1 + k % 11 / 8).alias("d"), ((k % 13 - 6) / 4).alias("p"), ((k % 17 - 8) / 4).alias("q"))
    a, b, c, d, p, q = (F.col(n) for n in "abcdpq")
    det = a * d - b * c
    edge_x = lambda v: scalar.clamp(((p - a * v) * b + (q - c * v) * d) / (b * b + d * d), -TINT, TINT)
    edge_y = lambda v: scalar.clamp(((p - b * v) * a + (q - d * v) * c) / (a * a + c * c), -WARMTH, WARMTH)
    options = [((p * d - b * q) / det, (a * q - c * p) / det), *((F.lit(v), edge_x(v)) for v in (-WARMTH, WARMTH)), *((edge_y(v), F.lit(v)) for v in (-TINT, TINT))]

    def option(o: int, x: Column, y: Column) -> Column:
        res = (a * x + b * y - p) * (a * x + b * y - p) + (c * x + d * y - q) * (c * x + d * y - q)
        return F.when((F.abs(x) <= WARMTH) & (F.abs(y) <= TINT), F.struct(F.rint(res * 1e9).alias("res"), F.lit(o).alias("o"), x.alias("x"), y.alias("y")))

    best = F.array_min(F.array_compact(F.array(*(option(o, x, y) for o, (x, y) in enumerate(options)))))
    return s.select("k", best.alias("best")).select("k", scalar.rounded(F.col("best.x")).alias("warmth"), scalar.rounded(F.col("best.y")).alias("tint"))


_STEPS = "\n".join(f", s{k} AS (SELECT photo, ok, CASE WHEN ok[(lo + hi) // 2] THEN (lo + hi) // 2 ELSE lo END AS lo, CASE WHEN ok[(lo + hi) // 2] THEN hi ELSE (lo + hi) // 2 END AS hi FROM s{k - 1})" for k in range(1, 6))


@S.add(f"""WITH {RGB8}, c AS (SELECT photo, y, x, k, greatest({', '.join(render.encode_sql(f'(({v} - 0.18::DOUBLE) * (1 + 0.75::DOUBLE * k / 32) + 0.18::DOUBLE)') for v in 'rgb')}) AS hi FROM lin, range(1, 33) t(k)),
j AS (SELECT c.photo, k, count(*) AS n, count(*) FILTER (c.hi >= 254) AS clipped, count(*) FILTER (greatest(b.r, b.g, b.b) >= 254) AS base, count(*) FILTER (c.hi >= 254 AND greatest(b.r, b.g, b.b) <= 250) AS fresh FROM c JOIN rgb8 b ON b.photo = c.photo AND b.y = c.y AND b.x = c.x GROUP BY ALL),
g AS (SELECT photo, list(clipped <= base + 0.05 * n AND fresh <= 0.05 * n ORDER BY k) AS ok FROM j GROUP BY photo), s0 AS (SELECT photo, ok, 0 AS lo, 32 AS hi FROM g){_STEPS}
SELECT photo, CASE WHEN ok[32] THEN 32 ELSE lo END::INTEGER AS steps FROM s5""")
def contrast_bisection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checked bisection on contrast: all 32 settings it may ask for are measured at once, then its path is replayed on their verdicts."""
    lin = render.linear(spark, sf_dir)
    codes = lambda f: F.greatest(*(scalar.encode(f(F.col(c))) for c in "rgb"))
    px = lin.select("photo", codes(lambda v: v).alias("base"), *(codes(lambda v, k=k: (v - 0.18) * (1 + F.lit(0.75) * k / 32) + 0.18).alias(f"k{k}") for k in range(1, 33)))
    top = F.count_if(F.col("base") >= 254)
    ok = lambda k: (F.count_if(F.col(f"k{k}") >= 254) <= top + 0.05 * F.count("*")) & (F.count_if((F.col(f"k{k}") >= 254) & (F.col("base") <= 250)) <= 0.05 * F.count("*"))
    verdicts = px.groupBy("photo").agg(F.array(*(ok(k) for k in range(1, 33))).alias("ok"))

    def step(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        yes = F.element_at("ok", mid)
        return F.struct(F.when(yes, mid).otherwise(s["lo"]).alias("lo"), F.when(yes, s["hi"]).otherwise(mid).alias("hi"))

    path = F.aggregate(F.sequence(F.lit(1), F.lit(5)), F.struct(F.lit(0).alias("lo"), F.lit(32).alias("hi")), step)
    return verdicts.select("photo", F.when(F.element_at("ok", 32), 32).otherwise(path["lo"]).alias("steps"))


@S.add(f"""WITH {RGB8}, {_weights_sql(12)}, j AS (SELECT p.*, weight, (r * 0.2126::DOUBLE + g * 0.7152::DOUBLE + b * 0.0722::DOUBLE) AS l, r * exp(0.05::DOUBLE) AS r1, g * exp(-0.03::DOUBLE) AS g1, b * exp(-0.05::DOUBLE + 0.06::DOUBLE) AS b1 FROM rgb8 p JOIN weights w ON w.photo = p.photo AND w.y = p.y AND w.x = p.x),
k AS (SELECT *, CASE WHEN l > 0 THEN l / (r1 * 0.2126::DOUBLE + g1 * 0.7152::DOUBLE + b1 * 0.0722::DOUBLE) ELSE 0 END AS f FROM j), m AS (SELECT *, greatest(r1, g1, b1) * f AS peak FROM k),
z AS (SELECT *, CASE WHEN peak > greatest(r, g, b) AND peak > 254 THEN greatest(0::DOUBLE, least(1::DOUBLE, (254 - l) / greatest(peak - l, 0.000001::DOUBLE))) ELSE 1 END AS back FROM m)
SELECT photo, count(*) AS n, {', '.join(f"sum(round_even(greatest(0::DOUBLE, least(255::DOUBLE, {c} + weight * back * ({c}1 * f - {c}))), 0))::BIGINT AS {c}" for c in 'rgb')} FROM z GROUP BY photo""")
def subject_color_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warmth .5 and tint 0 with a little green, at constant luma; one factor takes all channels back where the brightest would leave the range. Checksums of a photo."""
    joined = render.rgb8(spark, sf_dir).join(_weights(spark, sf_dir), ["photo", "y", "x"])
    gains = dict(zip("rgb", (F.exp(F.lit(0.05)), F.exp(F.lit(-0.03)), F.exp(F.lit(-0.05 + 0.06)))))
    df = joined.withColumns({f"{c}1": F.col(c) * gains[c] for c in "rgb"}).withColumn("l", scalar.luma709(F.col("r"), F.col("g"), F.col("b")))
    df = df.withColumn("f", F.when(F.col("l") > 0, F.col("l") / scalar.luma709(F.col("r1"), F.col("g1"), F.col("b1"))).otherwise(0.0)).withColumn("peak", F.greatest("r1", "g1", "b1") * F.col("f"))
    over = (F.col("peak") > F.greatest("r", "g", "b")) & (F.col("peak") > 254)
    df = df.withColumn("back", F.when(over, scalar.clamp((254 - F.col("l")) / F.greatest(F.col("peak") - F.col("l"), F.lit(0.000001)))).otherwise(1.0))
    out = lambda c: F.rint(scalar.clamp(F.col(c) + F.col("weight") * F.col("back") * (F.col(f"{c}1") * F.col("f") - F.col(c)), 0.0, 255.0)).cast("long")
    return df.groupBy("photo").agg(F.count("*").alias("n"), *(F.sum(out(c)).alias(c) for c in "rgb"))


@S.add(f"""WITH {frames.sensor_sql()}, b AS (SELECT *, (y % 2) * 2 + x % 2 AS plane, y // 8 AS by_, x // 8 AS bx FROM sensor), m AS (SELECT photo, y, x FROM b QUALIFY row_number() OVER (PARTITION BY photo, plane, by_, bx ORDER BY dn DESC, y, x) = 1),
g AS (SELECT photo, 4 * i AS y, 4 * j AS x FROM (SELECT DISTINCT photo FROM sensor), range(8) a(i), range(8) c(j)), u AS (SELECT photo, (y // 4) * 4 AS y, (x // 4) * 4 AS x, 1 AS kind FROM m UNION ALL SELECT photo, y, x, 0 FROM g)
SELECT photo, y::INTEGER AS y, x::INTEGER AS x, min(kind)::INTEGER AS kind, count(*) AS votes FROM u GROUP BY ALL""")
def bright_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample tiles: a grid, and those of each mosaic plane's brightest site in each block, each place once. The first of equals wins by (y, x)."""
    px = frames.pixels(frames.sensor_rows(spark, sf_dir))
    plane = F.col("y") % 2 * 2 + F.col("x") % 2
    best = px.groupBy("photo", plane, F.floor(F.col("y") / 8), F.floor(F.col("x") / 8)).agg(F.max_by(F.struct("y", "x"), F.struct("dn", -F.col("y"), -F.col("x"))).alias("p"))
    tile = lambda c: (F.floor(F.col(c) / 4) * 4).cast("int")
    bright = best.select("photo", tile("p.y").alias("y"), tile("p.x").alias("x"), F.lit(1).alias("kind"))
    grid = px.where("y % 4 = 0 and x % 4 = 0").select("photo", "y", "x", F.lit(0).alias("kind"))
    return grid.union(bright).groupBy("photo", "y", "x").agg(F.min("kind").alias("kind"), F.count("*").alias("votes"))


@S.add(f"""WITH {frames.sensor_sql(64)}, t AS (SELECT photo, max(m) - min(m) AS range_, quantile_cont(m, 0.95) - quantile_cont(m, 0.05) AS span FROM (SELECT photo, y // 16 AS ty, x // 16 AS tx, avg(dn / 64::DOUBLE) AS m FROM sensor GROUP BY ALL) GROUP BY photo),
m AS (SELECT *, dn / 64::DOUBLE - avg(dn / 64::DOUBLE) OVER (PARTITION BY photo) AS d FROM sensor), l AS (SELECT *, {', '.join(f'lead(d, {k}) OVER (PARTITION BY photo, y ORDER BY x) AS d{k}' for k in (1, 2, 4))} FROM m),
a AS (SELECT photo, {', '.join(f'sum(d * d{k}) / sum(d * d) FILTER (d{k} IS NOT NULL) AS c{k}' for k in (1, 2, 4))} FROM l GROUP BY photo)
SELECT photo, {r6('range_')} AS range_, {r6('span')} AS span, {', '.join(f'{r6(f"c{k}")} AS c{k}' for k in (1, 2, 4))} FROM t JOIN a USING (photo)""")
def dark_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What tells noise from detail in the dark: tile means' spread, and how neighbours at 1, 2 and 4 places correlate."""
    px = frames.pixels(frames.sensor_rows(spark, sf_dir, 64), "dn").withColumn("v", F.col("dn") / 64.0)
    tiles = px.groupBy("photo", F.floor(F.col("y") / 16), F.floor(F.col("x") / 16)).agg(F.avg("v").alias("m")).groupBy("photo").agg((F.max("m") - F.min("m")).alias("range_"), (F.percentile("m", 0.95) - F.percentile("m", 0.05)).alias("span"))
    d = px.withColumn("d", F.col("v") - F.avg("v").over(Window.partitionBy("photo")))
    row = Window.partitionBy("photo", "y").orderBy("x")
    d = d.withColumns({f"d{k}": F.lead("d", k).over(row) for k in (1, 2, 4)})
    c = d.groupBy("photo").agg(*((F.sum(F.col("d") * F.col(f"d{k}")) / F.sum(F.when(F.col(f"d{k}").isNotNull(), F.col("d") * F.col("d")))).alias(f"c{k}") for k in (1, 2, 4)))
    return tiles.join(c, "photo").select("photo", *(scalar.rounded(F.col(n)).alias(n) for n in ("range_", "span", "c1", "c2", "c4")))
