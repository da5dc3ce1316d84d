"""Aggregations and decisions on rendered frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import measure
from ..plans import frames, render
from .pixel import r6
from .registry import Suite

S = Suite()


def r10(v: str) -> str:
    """For means: of these, many are ties of the sixth decimal, and sums in another order fall to either side."""
    return f"round_even(({v}) * 10000000000::DOUBLE, 0) / 10000000000::DOUBLE"


RGB8 = render.RGB8


@S.add(f"""WITH {RGB8}, c AS (SELECT photo, unnest(['red', 'green', 'blue', 'luma']) AS channel, unnest([r, g, b, (54 * r + 183 * g + 19 * b) >> 8]) AS v FROM rgb8),
n AS (SELECT photo, channel, ((v * 64) >> 8)::INTEGER AS bin, count(*) AS n FROM c GROUP BY ALL), g AS (SELECT DISTINCT photo, channel FROM c)
SELECT g.photo, g.channel, k::INTEGER AS bin, coalesce(n, 0)::BIGINT AS n FROM g CROSS JOIN range(64) t(k) LEFT JOIN n ON n.photo = g.photo AND n.channel = g.channel AND n.bin = k""")
def qc_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.histogram(render.rgb8(spark, sf_dir), 64)


@S.add(f"""WITH {RGB8} SELECT photo, count(*) AS n, count(*) FILTER (greatest(r, g, b) <= 2) AS shadows, count(*) FILTER (greatest(r, g, b) >= 253) AS highlights,
count(*) FILTER (greatest(r, g, b) <= 2) >= 0.01 * count(*) OR count(*) FILTER (greatest(r, g, b) >= 253) >= 0.01 * count(*) AS significant FROM rgb8 GROUP BY photo""")
def qc_clip_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = measure.clip_counts(render.rgb8(spark, sf_dir))
    return c.withColumn("significant", F.greatest("shadows", "highlights") >= 0.01 * F.col("n"))


@S.add(f"""WITH {RGB8}, c AS (SELECT photo, count(*) AS n, count(*) FILTER (greatest(r, g, b) <= 2) AS s, count(*) FILTER (greatest(r, g, b) >= 253) AS h FROM rgb8 WHERE y % 2 = 0 AND x % 2 = 0 GROUP BY photo)
SELECT photo, concat_ws(',', CASE WHEN h >= 0.01 * n THEN 'highlight_clipping' END, CASE WHEN s >= 0.01 * n THEN 'shadow_clipping' END) AS warnings FROM c""")
def qc_report_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warnings of a thumbnail, those of highlights first."""
    c = measure.clip_counts(render.rgb8(spark, sf_dir).where("y % 2 = 0 and x % 2 = 0"))
    said = F.array_compact(F.array(F.when(F.col("highlights") >= 0.01 * F.col("n"), "highlight_clipping"), F.when(F.col("shadows") >= 0.01 * F.col("n"), "shadow_clipping")))
    return c.select("photo", F.concat_ws(",", said).alias("warnings"))


@S.add(f"""WITH {RGB8}, n AS (SELECT photo, (r * 32) >> 8 AS bin, count(*) AS n FROM rgb8 GROUP BY ALL), g AS (SELECT p.photo, k::INTEGER AS bin, coalesce(n.n, 0) AS n FROM (SELECT DISTINCT photo FROM rgb8) p CROSS JOIN range(32) t(k) LEFT JOIN n ON n.photo = p.photo AND n.bin = k)
SELECT photo, bin, {r6('bin * 255 / 31::DOUBLE')} AS px, {r6('95 - 95 * (ln(1::DOUBLE + n) / ln(1::DOUBLE + max(n) OVER (PARTITION BY photo)))')} AS py FROM g""")
def histogram_polyline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of a log-scaled histogram line in a 256 x 96 canvas."""
    red = measure.histogram(render.rgb8(spark, sf_dir), 32).where("channel = 'red'")
    peak = F.max("n").over(Window.partitionBy("photo"))
    return red.select("photo", "bin", scalar.rounded(F.col("bin") * 255 / 31).alias("px"), scalar.rounded(95 - 95 * (F.log(1.0 + F.col("n")) / F.log(1.0 + peak))).alias("py"))


_STATS = RGB8 + """, u AS (SELECT photo, r / 255::DOUBLE AS r, g / 255::DOUBLE AS g, b / 255::DOUBLE AS b FROM rgb8),
lit AS (SELECT *, r * 0.2126::DOUBLE + g * 0.7152::DOUBLE + b * 0.0722::DOUBLE AS luma, greatest(r, g, b) - least(r, g, b) AS chroma FROM u),
q AS (SELECT photo, quantile_cont(luma, 0.05) AS p05, quantile_cont(luma, 0.1) AS p10, median(luma) AS median, quantile_cont(luma, 0.9) AS p90, quantile_cont(luma, 0.95) AS p95, quantile_cont(luma, 0.99) AS p99,
  avg((luma < 0.12::DOUBLE)::INTEGER) AS dark, avg((luma > 0.25::DOUBLE)::INTEGER) AS lit, avg((greatest(r, g, b) >= 254 / 255::DOUBLE)::INTEGER) AS clipped, avg(chroma) AS chroma FROM lit GROUP BY photo),
stats AS (SELECT q.*, t.trimmed FROM q JOIN (SELECT photo, avg(luma) AS trimmed FROM lit JOIN q USING (photo) WHERE luma >= p10 AND luma <= p90 GROUP BY photo) t USING (photo))"""
_NAMES = ("p05", "p10", "median", "p90", "p95", "p99", "trimmed", "dark", "lit", "clipped", "chroma")


@S.add(f"WITH {_STATS} SELECT photo, {', '.join(f'{r10(n)} AS {n}' for n in _NAMES)} FROM stats")
def auto_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.statistics(render.rgb8(spark, sf_dir)).select("photo", *(scalar.rounded(F.col(n), 1e10).alias(n) for n in _NAMES))


@S.add(f"""WITH {_STATS}, k AS (SELECT *, (dark > 0.55 AND p95 > 0.5) OR (dark > 0.9 AND lit > 0.001) AS low, p10 > 0.62 AND median > 0.72 AS high, p10 < 0.10 AND p99 > 0.84 AND median < 0.4 AS back, 0.65::DOUBLE * median + 0.35::DOUBLE * trimmed AS mid FROM stats),
t AS (SELECT *, low OR back AS held, CASE WHEN low THEN 0.30 WHEN high THEN 0.69 ELSE 0.44 END::DOUBLE AS target FROM k),
e AS (SELECT *, CASE WHEN abs(mid - target) < 0.035 THEN 0::DOUBLE ELSE greatest(-0.8::DOUBLE, least(1.2::DOUBLE, 2.2::DOUBLE * log2(target / greatest(mid, 0.025::DOUBLE)))) END AS e0 FROM t),
f AS (SELECT *, CASE WHEN held THEN least(e0, 0.35::DOUBLE) ELSE e0 END AS e1 FROM e),
g AS (SELECT *, CASE WHEN e1 > 0 AND p99 > 0.8 THEN least(e1, greatest(0::DOUBLE, 2.2::DOUBLE * log2(0.96::DOUBLE / p99))) ELSE e1 END AS ev,
  CASE WHEN p95 - p05 < 0.30 THEN 0.18 WHEN p95 - p05 < 0.48 THEN 0.10 WHEN p95 - p05 > 0.78 THEN -0.08 ELSE 0.03 END::DOUBLE AS c0,
  CASE WHEN p05 < 0.06 THEN 0.24 WHEN p05 < 0.15 THEN 0.14 WHEN p05 < 0.25 THEN 0.08 ELSE 0 END::DOUBLE AS s0 FROM f)
SELECT photo, CASE WHEN low THEN 'low_key' WHEN high THEN 'high_key' WHEN back THEN 'backlit' ELSE 'normal' END AS scene, {r6('ev')} AS exposure,
  CASE WHEN held THEN 0::DOUBLE WHEN high THEN least(c0, 0.05::DOUBLE) ELSE c0 END AS contrast, CASE WHEN p95 > 0.92 OR clipped > 0.01 THEN -0.30 WHEN p95 > 0.82 THEN -0.16 ELSE 0 END::DOUBLE AS highlights,
  (CASE WHEN low THEN least(s0, 0.10::DOUBLE) ELSE s0 END) / CASE WHEN ev > 0.5 THEN 2 ELSE 1 END AS shadows FROM g""")
def auto_proposal(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = measure.proposal(measure.statistics(render.rgb8(spark, sf_dir)))
    return p.withColumn("exposure", scalar.rounded(F.col("exposure")))


#: Exposures of the guard queries, in stops; the candidate's number is its rank.
LADDER = (0.8, 0.4, 0.2, 0.1, 0.0)


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rung's codes beside the baseline's: five rows a pixel, made in place from its linear colour."""
    rungs = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(2.0**e).alias("gain")) for k, e in enumerate(LADDER)))
    lin = render.linear(spark, sf_dir).select("photo", *"rgb", *(scalar.encode(F.col(c)).cast("int").alias(f"{c}0") for c in "rgb"), F.explode(rungs).alias("rung"))
    return lin.select("photo", F.col("rung.k").cast("int").alias("candidate"), *(scalar.encode(F.col(c) * F.col("rung.gain")).cast("int").alias(c) for c in "rgb"), *(f"{c}0" for c in "rgb"))


_CAND = RGB8 + ", rungs AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, {2.0**e!r}::DOUBLE)" for k, e in enumerate(LADDER)) + ") t(candidate, gain)), cand AS (SELECT photo, y, x, candidate, " + ", ".join(f"{render.encode_sql(f'{c} * gain')}::INTEGER AS {c}" for c in "rgb") + """ FROM lin, rungs),
both_ AS (SELECT c.*, b.r AS r0, b.g AS g0, b.b AS b0, (b.r * 0.2126::DOUBLE + b.g * 0.7152::DOUBLE + b.b * 0.0722::DOUBLE) / 255 AS luma0, (c.r * 0.2126::DOUBLE + c.g * 0.7152::DOUBLE + c.b * 0.0722::DOUBLE) / 255 AS luma FROM cand c JOIN rgb8 b ON c.photo = b.photo AND c.y = b.y AND c.x = b.x),
m AS (SELECT *, luma0 > 8 / 255::DOUBLE AND luma0 < 0.25::DOUBLE AS usable, luma0 >= 0.08::DOUBLE AND luma0 < 0.35::DOUBLE AS mid, greatest(r, g, b) >= 254 AS clip FROM both_),
guards AS (SELECT photo, candidate, count(*) AS n, count(*) FILTER (clip) AS clipped, count(*) FILTER (usable AND luma <= 2 / 255::DOUBLE) AS crushed,
  coalesce(sum(greatest(0::DOUBLE, least(1::DOUBLE, (4 / 255::DOUBLE - luma) * 127.5::DOUBLE))) FILTER (usable), 0) AS risk, count(*) FILTER (clip AND greatest(r0, g0, b0) <= 250) AS fresh,
  sum((r0 BETWEEN 153 AND 250 AND r >= 254)::INTEGER + (g0 BETWEEN 153 AND 250 AND g >= 254)::INTEGER + (b0 BETWEEN 153 AND 250 AND b >= 254)::INTEGER)::BIGINT AS lost,
  sum((r0 BETWEEN 153 AND 250)::INTEGER + (g0 BETWEEN 153 AND 250)::INTEGER + (b0 BETWEEN 153 AND 250)::INTEGER)::BIGINT AS detail,
  median(luma) AS median, avg(luma) FILTER (mid) AS shadow_mean, count(*) FILTER (mid) AS midtones FROM m GROUP BY photo, candidate)"""


def _guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.guard_counts(_candidates(spark, sf_dir))


@S.add(f"WITH {_CAND} SELECT photo, candidate::INTEGER AS candidate, n, clipped, crushed, {r6('risk')} AS risk, fresh, lost, detail, {r6('median')} AS median, {r10('shadow_mean')} AS shadow_mean, midtones FROM guards")
def guard_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _guards(spark, sf_dir)
    return g.withColumns({"risk": scalar.rounded(F.col("risk")), "median": scalar.rounded(F.col("median")), "shadow_mean": scalar.rounded(F.col("shadow_mean"), 1e10)})


_ACCEPT = """ok AS (SELECT g.photo, g.candidate, g.risk / g.n <= 0.005 AND NOT (z.median < 0.5 AND z.median - g.median > 0.01) AND NOT (g.midtones >= 0.10 * g.n AND z.shadow_mean - g.shadow_mean > 0.01) AS tones,
  g.clipped <= z.clipped + 0.005 * g.n AND g.fresh <= 0.005 * g.n AND g.lost <= greatest(2, 0.02 * g.detail) AS highlights FROM guards g JOIN guards z ON g.photo = z.photo AND z.candidate = 4)"""


def _accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rung = Window.partitionBy("photo")  # five rows
    of_base = lambda name: F.max(F.when(F.col("candidate") == len(LADDER) - 1, F.col(name))).over(rung)
    g = _guards(spark, sf_dir).withColumns({"m0": of_base("median"), "s0": of_base("shadow_mean"), "c0": of_base("clipped")})
    c = F.col
    tones = (c("risk") / c("n") <= 0.005) & ~((c("m0") < 0.5) & (c("m0") - c("median") > 0.01)) & ~((c("midtones") >= 0.10 * c("n")) & (c("s0") - c("shadow_mean") > 0.01))
    highlights = (c("clipped") <= c("c0") + 0.005 * c("n")) & (c("fresh") <= 0.005 * c("n")) & (c("lost") <= F.greatest(F.lit(2.0), 0.02 * c("detail")))
    return g.select("photo", "candidate", tones.alias("tones"), highlights.alias("highlights"))


@S.add(f"WITH {_CAND}, {_ACCEPT} SELECT photo, candidate::INTEGER AS candidate, tones, highlights FROM ok")
def guard_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _accepted(spark, sf_dir)


@S.add(f"WITH {_CAND}, {_ACCEPT} SELECT photo, min(candidate)::INTEGER AS rung FROM ok WHERE tones AND highlights GROUP BY photo")
def exposure_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rung whose render the guards accept: all are measured at once, as guards have no side effects."""
    return _accepted(spark, sf_dir).where("tones and highlights").groupBy("photo").agg(F.min("candidate").alias("rung"))


_LOGS = RGB8 + """, u AS (SELECT photo, y, x, r, g, b, greatest(r, g, b) AS hi, least(r, g, b) AS lo, (r * 0.2126::DOUBLE + g * 0.7152::DOUBLE + b * 0.0722::DOUBLE) / 255 AS luma FROM rgb8),
neutral AS (SELECT *, y // 8 * 4 + x // 8 AS region, ln(greatest(r, 1)::DOUBLE / greatest(g, 1)) AS rg, ln(greatest(b, 1)::DOUBLE / greatest(g, 1)) AS bg FROM u WHERE hi > 0 AND (hi - lo)::DOUBLE / hi < 0.22::DOUBLE AND luma > 0.15::DOUBLE AND luma < 0.8::DOUBLE)"""


def _neutral(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = render.rgb8(spark, sf_dir)
    kept = px.where(measure.neutral(F.col("r"), F.col("g"), F.col("b")))
    rg, bg = scalar.log_ratios(F.col("r"), F.col("g"), F.col("b"))
    return kept.select("photo", "y", "x", measure.region(F.col("y"), F.col("x"), 32, 32).alias("region"), rg.alias("rg"), bg.alias("bg"))


@S.add(f"""WITH {_LOGS}, whole AS (SELECT photo, count(*) AS n, median(rg) AS rg, median(bg) AS bg FROM neutral GROUP BY photo),
all_ AS (SELECT photo, count(*) AS size, median(luma) AS median, greatest(avg((r >= g AND r >= b)::INTEGER), avg((b > r AND b > g)::INTEGER)) AS side, avg((g > r AND g >= b)::INTEGER) AS green FROM u GROUP BY photo),
votes AS (SELECT n.photo, n.region, median(n.rg) AS rg, median(n.bg) AS bg, count(*) AS n FROM neutral n GROUP BY n.photo, n.region HAVING count(*) >= 16 AND count(*) >= 0.12 * 64),
agree AS (SELECT w.photo, v.region, (v.region // 8) * 2 + (v.region % 4) // 2 AS quadrant, sqrt(v.rg * v.rg + v.bg * v.bg) > 0.015::DOUBLE AND v.rg * w.rg + v.bg * w.bg > 0.6::DOUBLE * sqrt(v.rg * v.rg + v.bg * v.bg) * sqrt(w.rg * w.rg + w.bg * w.bg) AS yes FROM votes v JOIN whole w USING (photo)),
t AS (SELECT a.photo, coalesce(w.n, 0) AS n, coalesce(w.n, 0) / a.size::DOUBLE AS fraction, a.median, w.rg, w.bg, count(g.region) AS votes, count(*) FILTER (g.yes) AS agreeing, count(DISTINCT g.quadrant) FILTER (g.yes) AS quadrants,
  NOT (coalesce(w.n, 0) < 0.12 * a.size OR a.median < 0.18 OR (a.median < 0.35 AND a.side > 0.85) OR (greatest(a.side, a.green) > 0.85 AND coalesce(w.n, 0) < 0.5 * a.size)) AND coalesce(sqrt(w.rg * w.rg + w.bg * w.bg) >= 0.025, false) AS usable FROM all_ a LEFT JOIN whole w USING (photo) LEFT JOIN agree g USING (photo) GROUP BY ALL)
SELECT photo, n, {r10('fraction')} AS fraction, {r10('median')} AS median, {r6('rg')} AS rg, {r6('bg')} AS bg, usable, votes, agreeing, quadrants, usable AND votes >= 6 AND agreeing >= 0.8 * votes AND quadrants >= 3 AS accepted FROM t""")
def neutral_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A photo's neutral bias, and how its regions vote on it."""
    out = measure.neutral_evidence(render.rgb8(spark, sf_dir), 32, 32)
    return out.withColumns({c: scalar.rounded(F.col(c), 1e10 if c in ("fraction", "median") else 1e6) for c in ("fraction", "median", "rg", "bg")})


@S.add(f"""WITH {_LOGS}, v AS (SELECT photo, region, median(rg) AS rg, median(bg) AS bg FROM neutral GROUP BY photo, region), m AS (SELECT photo, median(rg) AS rg, median(bg) AS bg FROM v GROUP BY photo),
s AS (SELECT m.photo, sqrt(m.rg * m.rg + m.bg * m.bg) AS signal, quantile_cont(sqrt((v.rg - m.rg) * (v.rg - m.rg) + (v.bg - m.bg) * (v.bg - m.bg)), 0.75) AS spread FROM v JOIN m USING (photo) GROUP BY ALL)
SELECT photo, {r6('greatest(0.25::DOUBLE, least(0.75::DOUBLE, 0.75::DOUBLE / (1 + (spread / greatest(signal, 0.025::DOUBLE)) * (spread / greatest(signal, 0.025::DOUBLE)))))')} AS strength FROM s""")
def wb_regional_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _neutral(spark, sf_dir).groupBy("photo", "region").agg(F.median("rg").alias("rg"), F.median("bg").alias("bg"))
    m = v.groupBy("photo").agg(F.median("rg").alias("r0"), F.median("bg").alias("b0"))
    apart = F.sqrt((F.col("rg") - F.col("r0")) * (F.col("rg") - F.col("r0")) + (F.col("bg") - F.col("b0")) * (F.col("bg") - F.col("b0")))
    s = v.join(m, "photo").groupBy("photo", F.sqrt(F.col("r0") * F.col("r0") + F.col("b0") * F.col("b0")).alias("signal")).agg(F.percentile(apart, 0.75).alias("spread"))
    ratio = F.col("spread") / F.greatest(F.col("signal"), F.lit(0.025))
    return s.select("photo", scalar.rounded(scalar.clamp(0.75 / (1 + ratio * ratio), 0.25, 0.75)).alias("strength"))


@S.add(f"""WITH {_STATS}, q2 AS (SELECT photo, median(luma) AS m, quantile_cont(luma, 0.75) - quantile_cont(luma, 0.25) AS iqr FROM lit GROUP BY photo), w AS (SELECT *, 0.8::DOUBLE * greatest(0::DOUBLE, least(1::DOUBLE, (0.45::DOUBLE - m) / 0.20::DOUBLE)) AS weight FROM q2)
SELECT photo, {r6('weight')} AS weight, {r6('CASE WHEN weight > 0 THEN greatest(3 / 255::DOUBLE, 0.15::DOUBLE * m, 0.10::DOUBLE * iqr) / weight END')} AS lift, {r6('CASE WHEN weight > 0 THEN m + greatest(3 / 255::DOUBLE, 0.15::DOUBLE * m, 0.10::DOUBLE * iqr) / weight END')} AS ceiling FROM w""")
def dark_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far a dark scene may be lifted, for scene evidence of weight 0.8."""
    luma = scalar.luma709(F.col("r"), F.col("g"), F.col("b"))
    lit = render.rgb8(spark, sf_dir).select("photo", *((F.col(c) / 255).alias(c) for c in "rgb")).select("photo", luma.alias("luma"))
    q = lit.groupBy("photo").agg(F.percentile("luma", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    q = q.select("photo", F.col("q")[1].alias("m"), (F.col("q")[2] - F.col("q")[0]).alias("iqr")).withColumn("weight", 0.8 * scalar.clamp((0.45 - F.col("m")) / 0.20))
    lift = F.when(F.col("weight") > 0, F.greatest(F.lit(3 / 255), 0.15 * F.col("m"), 0.10 * F.col("iqr")) / F.col("weight"))
    return q.select("photo", scalar.rounded(F.col("weight")).alias("weight"), scalar.rounded(lift).alias("lift"), scalar.rounded(F.col("m") + lift).alias("ceiling"))


@S.add(f"""WITH {_STATS}, t AS (SELECT photo, max(m) - min(m) AS range_ FROM (SELECT photo, y // 4 AS ty, x // 4 AS tx, avg(least(8 / 255::DOUBLE, (r * 0.2126::DOUBLE + g * 0.7152::DOUBLE + b * 0.0722::DOUBLE) / 255)) AS m FROM rgb8 GROUP BY ALL) GROUP BY photo),
k AS (SELECT photo, avg((greatest(r, g, b) > 16)::INTEGER) AS bright, quantile_cont((r * 0.2126::DOUBLE + g * 0.7152::DOUBLE + b * 0.0722::DOUBLE) / 255, 0.99) AS p99, quantile_cont((r * 0.2126::DOUBLE + g * 0.7152::DOUBLE + b * 0.0722::DOUBLE) / 255, 0.05) AS p05, avg(((r * 0.2126::DOUBLE + g * 0.7152::DOUBLE + b * 0.0722::DOUBLE) / 255 > 8 / 255::DOUBLE)::INTEGER) AS seen FROM rgb8 GROUP BY photo)
SELECT photo, bright < 0.0001 AND p99 < 8 / 255::DOUBLE AND p99 - p05 < 4 / 255::DOUBLE AND seen < 0.0001 AND range_ < 1 / 255::DOUBLE AS little, {r10('range_')} AS range_ FROM k JOIN t USING (photo)""")
def little_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure.little_detail(render.rgb8(spark, sf_dir), 32, 32).withColumn("range_", scalar.rounded(F.col("range_"), 1e10))


@S.add(f"""WITH {RGB8}, s AS (SELECT photo, (y // 16 * 1000 + x // 16)::INTEGER AS block, y % 16 - 7.5::DOUBLE AS v, x % 16 - 7.5::DOUBLE AS h, (r - g)::DOUBLE AS u, (b - g)::DOUBLE AS w, (54 * r + 183 * g + 19 * b) / 256::DOUBLE AS l FROM rgb8),
f AS (SELECT photo, block, {', '.join(f'avg({c}) AS {c}m, sum({c} * v) / 5440::DOUBLE AS {c}v, sum({c} * h) / 5440::DOUBLE AS {c}h' for c in 'uwl')} FROM s GROUP BY ALL),
e AS (SELECT s.photo, s.block, {', '.join(f'{c} - {c}m - {c}v * v - {c}h * h AS {c}' for c in 'uwl')} FROM s JOIN f ON s.photo = f.photo AND s.block = f.block),
d AS (SELECT photo, block, {', '.join(f'mad({c}) * 1.4826::DOUBLE AS {c}' for c in 'uwl')} FROM e GROUP BY ALL)
SELECT photo, block, {r6('sqrt((u * u + w * w) / 2)')} AS dispersion, {r6('l')} AS luma_sigma FROM d""")
def chroma_dispersion(spark: SparkSession, sf_dir: str) -> DataFrame:
    noise = measure.block_noise(render.rgb8(spark, sf_dir), 16)
    return noise.select("photo", "block", scalar.rounded(F.col("dispersion")).alias("dispersion"), scalar.rounded(F.col("luma_sigma")).alias("luma_sigma"))


_BLOCKS = RGB8 + f""", s AS (SELECT photo, (y // 16 * 1000 + x // 16)::INTEGER AS block, y % 16 - 7.5::DOUBLE AS v, x % 16 - 7.5::DOUBLE AS h, (r - g)::DOUBLE AS u, (b - g)::DOUBLE AS w, (54 * r + 183 * g + 19 * b) / 256::DOUBLE AS l, least(r, g, b) AS low, greatest(r, g, b) AS high FROM rgb8),
f AS (SELECT photo, block, {', '.join(f'avg({c}) AS {c}m, sum({c} * v) / 5440::DOUBLE AS {c}v, sum({c} * h) / 5440::DOUBLE AS {c}h' for c in 'uwl')} FROM s GROUP BY ALL),
e AS (SELECT s.photo, s.block, v, h, l AS luma, low, high, {', '.join(f'{c} - {c}m - {c}v * v - {c}h * h AS {c}_' for c in 'uwl')} FROM s JOIN f ON s.photo = f.photo AND s.block = f.block),
d AS (SELECT photo, block, sqrt((mad(u_) * mad(u_) + mad(w_) * mad(w_)) / 2) * 1.4826::DOUBLE AS dispersion, mad(l_) * 1.4826::DOUBLE AS sigma, avg((low > 3 AND high < 252 AND luma > 20 AND luma < 220)::INTEGER) AS usable FROM e GROUP BY ALL),
c AS (SELECT photo, block, sqrt(avg(u * u + w * w) / 2) AS chroma, sqrt(avg(l * l)) AS luma FROM (SELECT photo, block, avg(u_) AS u, avg(w_) AS w, avg(l_) AS l FROM e GROUP BY photo, block, floor((v + 7.5) / 4), floor((h + 7.5) / 4)) GROUP BY ALL),
p AS (SELECT a.photo, a.block, b.h = a.h AS down, abs(sum(a.u_ * b.u_ + a.w_ * b.w_)) / greatest(1::DOUBLE, sqrt(sum(a.u_ * a.u_ + a.w_ * a.w_) * sum(b.u_ * b.u_ + b.w_ * b.w_))) AS r FROM e a JOIN e b ON a.photo = b.photo AND a.block = b.block AND ((b.v = a.v + 4 AND b.h = a.h) OR (b.v = a.v AND b.h = a.h + 4)) GROUP BY ALL)"""


@S.add(f"""WITH {_BLOCKS} SELECT d.photo, d.block, {r10('usable')} AS usable, {r6('chroma')} AS chroma, {r6('c.luma')} AS luma, {r6('max(r)')} AS periodic,
usable >= 0.95 AND chroma <= greatest(1::DOUBLE, dispersion * 0.45::DOUBLE) AND c.luma <= greatest(2::DOUBLE, sigma * 0.45::DOUBLE) AND max(r) < 0.45::DOUBLE AS flat FROM d JOIN c USING (photo, block) JOIN p USING (photo, block) GROUP BY d.photo, d.block, usable, chroma, c.luma, dispersion, sigma""")
def noise_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which blocks show noise alone."""
    out = measure.noise_blocks(render.rgb8(spark, sf_dir))
    return out.withColumns({"usable": scalar.rounded(F.col("usable"), 1e10), **{c: scalar.rounded(F.col(c)) for c in ("chroma", "luma", "periodic")}})


#: A sunset of this share, and reliability 1/2 or more: the weight of the scene's label.
_SUNSET = (0.7 - 0.35) / 0.55


@S.add(f"""WITH {RGB8}, u AS (SELECT photo, y // 8 * 4 + x // 8 AS region, greatest(r, g, b) AS hi, (greatest(r, g, b) - least(r, g, b))::DOUBLE / greatest(1, greatest(r, g, b)) AS sat, (r * 0.2126::DOUBLE + g * 0.7152::DOUBLE + b * 0.0722::DOUBLE) / 255 AS luma, 100 * r > 103 * g AND 100 * g > 103 * b AS warm, ln(greatest(r, 1)::DOUBLE / greatest(g, 1)) AS rg, ln(greatest(b, 1)::DOUBLE / greatest(g, 1)) AS bg FROM rgb8),
c AS (SELECT * REPLACE (warm AND luma > 0.08::DOUBLE AND luma < 0.85::DOUBLE AND hi <= 247 AND sat > 0.08::DOUBLE AND sat < 0.85::DOUBLE AS warm) FROM u),
w AS (SELECT photo, count(*) FILTER (warm) AS n, count(*) AS size, median(rg) FILTER (warm) AS rg, median(bg) FILTER (warm) AS bg FROM c GROUP BY photo),
t AS (SELECT photo, region, median(rg) FILTER (warm) AS rg, median(bg) FILTER (warm) AS bg FROM c GROUP BY ALL HAVING count(*) FILTER (warm) >= 16 AND count(*) FILTER (warm) >= 0.12 * count(*)),
a AS (SELECT photo, region // 8 * 2 + region % 4 // 2 AS quadrant, (rg - bg) / sqrt(2::DOUBLE) > 0.5::DOUBLE * sqrt(rg * rg + bg * bg) AS yes FROM t),
v AS (SELECT w.*, count(a.quadrant) AS tiles, count(*) FILTER (a.yes) AS agreeing, count(DISTINCT a.quadrant) FILTER (a.yes) AS quadrants FROM w LEFT JOIN a USING (photo) GROUP BY ALL)
SELECT photo, n, {r6('rg')} AS rg, {r6('bg')} AS bg, tiles, agreeing, quadrants, {r6(f"CASE WHEN n >= 128 AND n >= 0.12 * size AND sqrt(rg * rg + bg * bg) >= 0.08 AND tiles >= 4 AND quadrants >= 2 AND agreeing >= 0.75 * tiles THEN {_SUNSET!r}::DOUBLE * greatest(0::DOUBLE, least(1::DOUBLE, (agreeing / tiles::DOUBLE - 0.6::DOUBLE) / 0.35::DOUBLE)) END")} AS weight FROM v""")
def ambient_color(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warm light worth keeping, where the picture bears out the label sunset."""
    out = measure.ambient_color(render.rgb8(spark, sf_dir), 32, 32, _SUNSET)
    return out.withColumns({c: scalar.rounded(F.col(c)) for c in ("rg", "bg", "weight")})


_AIMS = {"greens": 0.56, "blues": 0.32}


@S.add(f"""WITH {RGB8}, b AS (SELECT photo, {', '.join(f"{render.encode_sql(c)}::INTEGER AS {c}0, {render.encode_sql(f'{c} * {2**0.2!r}::DOUBLE')}::INTEGER AS {c}" for c in 'rgb')} FROM lin),
u AS (SELECT *, (r0 * 0.2126::DOUBLE + g0 * 0.7152::DOUBLE + b0 * 0.0722::DOUBLE) / 255 AS luma, (greatest(r, g, b) - least(r, g, b))::DOUBLE / greatest(1, greatest(r, g, b)) AS sat FROM b),
k AS (SELECT *, luma > 0.08::DOUBLE AND luma < 0.85::DOUBLE AND greatest(r0, g0, b0) <= 247 AS ok FROM u),
p AS ({' UNION ALL '.join(f"SELECT photo, '{part}' AS part, {w!r}::DOUBLE AS w, count(*) AS size, count(*) FILTER (ok AND {cond}) AS n, median(sat) FILTER (ok AND {cond}) AS s FROM k GROUP BY photo" for (part, w), cond in zip(_AIMS.items(), ("100 * g0 > 106 * r0 AND 100 * g0 > 104 * b0", "100 * b0 > 108 * r0 AND 100 * b0 > 98 * g0")))}),
l AS (SELECT *, least(0.04::DOUBLE, greatest(0::DOUBLE, 0.55::DOUBLE - s) * 0.12::DOUBLE) * w AS lift FROM p)
SELECT photo, part, n, {r6('s')} AS saturation, {r6('CASE WHEN n >= greatest(32, 0.025 * size) AND lift > 0.002 THEN s + lift END')} AS target FROM l""")
def scene_saturation_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What green and blue materials aim at in a render a fifth of a stop up, for a landscape's evidence."""
    lin = render.linear(spark, sf_dir)
    both = lin.select("photo", *(scalar.encode(F.col(c) * F.lit(g)).cast("int").alias(f"{c}{n}") for g, n in ((1.0, "0"), (2**0.2, "")) for c in "rgb"))
    out = measure.saturation_targets(both, _AIMS)
    return out.withColumns({c: scalar.rounded(F.col(c)) for c in ("saturation", "target")})


_SCORES = "sc AS (SELECT vec_id, i, v FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) WHERE i < 21)"


@S.add(f"""WITH {_SCORES}, w AS (SELECT *, i < 15 AS scene, exp(100 * (v - max(v) OVER (PARTITION BY vec_id, i < 15))) AS e FROM sc), p AS (SELECT *, e / sum(e) OVER (PARTITION BY vec_id, scene ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS p FROM w),
g AS (SELECT vec_id, max(v) FILTER (scene) AS top_, max(p) FILTER (scene) AS best, min(i) FILTER (scene AND v = m) AS scene_, max(p) FILTER (NOT scene) AS lp, min(i) FILTER (NOT scene AND v = m) AS light FROM (SELECT *, max(v) OVER (PARTITION BY vec_id, scene) AS m FROM p) GROUP BY vec_id)
SELECT vec_id, scene_::INTEGER AS scene, CASE WHEN lp >= 0.45 THEN (light - 15)::INTEGER ELSE -1 END AS light, {r6('greatest(0::DOUBLE, least(1::DOUBLE, (top_ - 0.20::DOUBLE) / 0.10::DOUBLE)) * greatest(0::DOUBLE, least(1::DOUBLE, (best - 0.12::DOUBLE) / 0.35::DOUBLE))')} AS reliability FROM g""")
def scene_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """15 scene and 6 light scores to a label each (-1: mixed light) and a reliability. The first of equal scores wins."""
    e = frames.table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("e"))
    e = e.select("vec_id", F.slice("e", 1, 15).alias("s"), F.slice("e", 16, 6).alias("l"))
    share = lambda a: 1 / F.aggregate(a, F.lit(0.0), lambda t, v: t + F.exp(100 * (v - F.array_max(a))))  # noqa: E731  of the greatest
    place = lambda a: F.array_position(a, F.array_max(a)).cast("int") - 1
    sure = scalar.clamp((F.array_max("s") - 0.20) / 0.10) * scalar.clamp((share(F.col("s")) - 0.12) / 0.35)
    return e.select("vec_id", place(F.col("s")).alias("scene"), F.when(share(F.col("l")) >= 0.45, place(F.col("l"))).otherwise(-1).alias("light"), scalar.rounded(sure).alias("reliability"))


@S.add(f"""WITH s AS (SELECT vec_id, embedding[1:14] AS e FROM embeddings) SELECT vec_id, (list_position(e, list_max(e)) - 1)::INTEGER AS material, {r6('greatest(e[1], e[2])::DOUBLE - list_max(e[3:14])::DOUBLE')} AS neutral_margin FROM s""")
def material_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = frames.table(spark, sf_dir, "embeddings").select("vec_id", F.slice("embedding", 1, 14).alias("e"))
    margin = F.array_max(F.slice("e", 1, 2)).cast("double") - F.array_max(F.slice("e", 3, 12)).cast("double")
    return e.select("vec_id", (F.array_position("e", F.array_max("e")).cast("int") - 1).alias("material"), scalar.rounded(margin).alias("neutral_margin"))
