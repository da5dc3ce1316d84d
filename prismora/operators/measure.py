"""Measurements: histograms, guards, regional medians, noise statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar

#: Codes at and beyond which quality control counts a pixel as clipped.
DARK, BRIGHT = 2, 253


def histogram(rgb: DataFrame, bins: int) -> DataFrame:
    """(photo, channel, bin, n): every bin of four channels, empty ones with 0. Counting is partial in each task; the grid of bins has 4 * bins rows a photo."""
    channels = F.map_from_arrays(F.array(*map(F.lit, ("red", "green", "blue", "luma"))), F.array(F.col("r"), F.col("g"), F.col("b"), scalar.qc_luma(F.col("r"), F.col("g"), F.col("b"))))
    counted = rgb.select("photo", F.explode(channels).alias("channel", "v")).groupBy("photo", "channel", F.shiftright(F.col("v") * bins, 8).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    dense = counted.groupBy("photo", "channel").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("found"))
    return dense.select("photo", "channel", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "found").select("photo", "channel", "bin", F.coalesce(F.try_element_at("found", F.col("bin")), F.lit(0)).cast("long").alias("n"))


def clip_counts(rgb: DataFrame) -> DataFrame:
    """(photo, n, shadows, highlights)."""
    return rgb.groupBy("photo").agg(F.count("*").alias("n"), F.count_if(F.greatest("r", "g", "b") <= DARK).alias("shadows"), F.count_if(F.greatest("r", "g", "b") >= BRIGHT).alias("highlights"))


def neutral(r: Column, g: Column, b: Column) -> Column:
    """Low chroma at middle brightness, of 8-bit codes; whole numbers, so no threshold depends on how 255ths are rounded."""
    high = F.greatest(r, g, b)
    luma = scalar.luma709(r, g, b) / 255
    return (high > 0) & ((high - F.least(r, g, b)) / high < 0.22) & (luma > 0.15) & (luma < 0.8)


def statistics(rgb: DataFrame) -> DataFrame:
    """(photo, quantiles of luma, mean within p10..p90, shares): what an automatic proposal starts from."""
    unit = rgb.select("photo", *((F.col(c) / 255).alias(c) for c in "rgb"))
    lit = unit.withColumn("luma", scalar.luma709(F.col("r"), F.col("g"), F.col("b"))).withColumn("chroma", F.greatest("r", "g", "b") - F.least("r", "g", "b"))
    q = lit.groupBy("photo").agg(F.percentile("luma", F.array(*map(F.lit, (0.05, 0.1, 0.5, 0.9, 0.95, 0.99)))).alias("q"), F.avg(F.when(F.col("luma") < 0.12, 1.0).otherwise(0.0)).alias("dark"), F.avg(F.when(F.col("luma") > 0.25, 1.0).otherwise(0.0)).alias("lit"), F.avg(F.when(F.greatest("r", "g", "b") >= 254 / 255, 1.0).otherwise(0.0)).alias("clipped"), F.avg("chroma").alias("chroma"))
    trimmed = lit.select("photo", "luma").join(q.select("photo", "q"), "photo").where((F.col("luma") >= F.col("q")[1]) & (F.col("luma") <= F.col("q")[3])).groupBy("photo").agg(F.avg("luma").alias("trimmed"))
    return q.join(trimmed, "photo").select("photo", *(F.col("q")[k].alias(n) for k, n in enumerate(("p05", "p10", "median", "p90", "p95", "p99"))), "trimmed", "dark", "lit", "clipped", "chroma")


def proposal(stats: DataFrame) -> DataFrame:
    """(photo, scene, exposure, contrast, highlights, shadows): unguarded settings from statistics."""
    c = F.col
    low = ((c("dark") > 0.55) & (c("p95") > 0.5)) | ((c("dark") > 0.9) & (c("lit") > 0.001))
    high = (c("p10") > 0.62) & (c("median") > 0.72)
    back = (c("p10") < 0.10) & (c("p99") > 0.84) & (c("median") < 0.4)
    df = stats.withColumn("scene", F.when(low, "low_key").when(high, "high_key").when(back, "backlit").otherwise("normal")).withColumn("mid", 0.65 * c("median") + 0.35 * c("trimmed"))
    df = df.withColumn("low", low).withColumn("high", high).withColumn("held", low | back)
    target = F.when(c("low"), 0.30).when(c("high"), 0.69).otherwise(0.44)
    ev = scalar.clamp(2.2 * F.log2(target / F.greatest(c("mid"), F.lit(0.025))), -0.8, 1.2)
    ev = F.when(F.abs(c("mid") - target) < 0.035, 0.0).otherwise(ev)
    ev = F.when(c("held"), F.least(ev, F.lit(0.35))).otherwise(ev)
    ev = F.when((ev > 0) & (c("p99") > 0.8), F.least(ev, F.greatest(F.lit(0.0), 2.2 * F.log2(0.96 / c("p99"))))).otherwise(ev)
    spread = c("p95") - c("p05")
    contrast = F.when(spread < 0.30, 0.18).when(spread < 0.48, 0.10).when(spread > 0.78, -0.08).otherwise(0.03)
    contrast = F.when(c("held"), 0.0).when(c("high"), F.least(contrast, F.lit(0.05))).otherwise(contrast)
    highlights = F.when((c("p95") > 0.92) | (c("clipped") > 0.01), -0.30).when(c("p95") > 0.82, -0.16).otherwise(0.0)
    shadows = F.when(c("p05") < 0.06, 0.24).when(c("p05") < 0.15, 0.14).when(c("p05") < 0.25, 0.08).otherwise(0.0)
    shadows = F.when(c("low"), F.least(shadows, F.lit(0.10))).otherwise(shadows)
    df = df.withColumn("exposure", ev)
    return df.select("photo", "scene", "exposure", contrast.alias("contrast"), highlights.alias("highlights"), F.when(c("exposure") > 0.5, shadows / 2).otherwise(shadows).alias("shadows"))


def guard_counts(both: DataFrame) -> DataFrame:
    """(photo, candidate, n, clipped, crushed, risk, fresh, lost, detail, median, shadow_mean, midtones): each candidate's pixels beside the baseline's.

    both: (photo, candidate, r, g, b, r0, g0, b0), a candidate's codes and the baseline's of one pixel, which one projection of the linear pixel
    gives, so no pixels are joined. Masks are the baseline's.
    """
    luma0 = scalar.luma709(F.col("r0"), F.col("g0"), F.col("b0")) / 255
    luma = scalar.luma709(F.col("r"), F.col("g"), F.col("b")) / 255
    both = both.withColumn("luma0", luma0).withColumn("luma", luma).withColumn("usable", (F.col("luma0") > 8 / 255) & (F.col("luma0") < 0.25)).withColumn("mid", (F.col("luma0") >= 0.08) & (F.col("luma0") < 0.35))
    number = lambda cond: F.count_if(cond)
    room = [F.col(f"{c}0") <= 250 for c in "rgb"]
    detail = [room[k] & (F.col(f"{c}0") >= 153) for k, c in enumerate("rgb")]
    top = [F.col(c) >= 254 for c in "rgb"]
    clipped = F.greatest("r", "g", "b") >= 254
    total = lambda parts: sum((F.when(p, 1).otherwise(0) for p in parts[1:]), F.when(parts[0], 1).otherwise(0))
    return both.groupBy("photo", "candidate").agg(
        F.count("*").alias("n"), number(clipped).alias("clipped"), number(F.col("usable") & (F.col("luma") <= 2 / 255)).alias("crushed"),
        F.sum(F.when(F.col("usable"), scalar.clamp((4 / 255 - F.col("luma")) * 127.5)).otherwise(0.0)).alias("risk"),
        number(clipped & (F.greatest("r0", "g0", "b0") <= 250)).alias("fresh"), F.sum(total([d & t for d, t in zip(detail, top)])).alias("lost"), F.sum(total(detail)).alias("detail"),
        F.median("luma").alias("median"), F.avg(F.when(F.col("mid"), F.col("luma"))).alias("shadow_mean"), number(F.col("mid")).alias("midtones"),
    )


def region(y: Column, x: Column, h: int, w: int, n: int = 4) -> Column:
    """The cell of an n x n grid with bounds k * h // n: the number of bounds at or below, as cells may be uneven."""
    place = lambda v, size: sum((F.when(v >= k * size // n, 1).otherwise(0) for k in range(2, n)), F.when(v >= size // n, 1).otherwise(0))
    return place(y, h) * n + place(x, w)


def part_of(v: Column, size: int, n: int) -> Column:
    """Which of n nearly equal parts of size places v is in: the first ones are one longer where size isn't a multiple."""
    short, more = divmod(size, n)
    edge = more * (short + 1)
    long_part = F.floor(v / (short + 1))
    return (long_part if not short else F.when(v < edge, long_part).otherwise(more + F.floor((v - edge) / short))).cast("int")


#: Of a preview without visible detail, the brightest code, the share of pixels beyond, the luma's upper bound and span, and the span of the tiles' means.
LITTLE_CODE, LITTLE_SHARE, LITTLE_LUMA, LITTLE_SPAN, LITTLE_RANGE = 16, 0.0001, 8 / 255, 4 / 255, 1 / 255


def little_detail(rgb: DataFrame, height: int, width: int) -> DataFrame:
    """(photo, little, range_): whether a frame is so dark and even that nothing in it is worth a lift; range_ is that of the means of 8 x 8 tiles, whatever their size. Frames of fewer than 16 places a side never are."""
    px = rgb.withColumn("luma", scalar.luma709(F.col("r"), F.col("g"), F.col("b")) / 255)
    tiles = px.groupBy("photo", part_of(F.col("y"), height, 8), part_of(F.col("x"), width, 8)).agg(F.avg(F.least("luma", F.lit(LITTLE_LUMA))).alias("m")).groupBy("photo").agg((F.max("m") - F.min("m")).alias("range_"))
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    k = px.groupBy("photo").agg(share(F.greatest("r", "g", "b") > LITTLE_CODE).alias("bright"), F.percentile("luma", 0.99).alias("p99"), F.percentile("luma", 0.05).alias("p05"), share(F.col("luma") > LITTLE_LUMA).alias("seen"))
    little = (F.col("bright") < LITTLE_SHARE) & (F.col("p99") < LITTLE_LUMA) & (F.col("p99") - F.col("p05") < LITTLE_SPAN) & (F.col("seen") < LITTLE_SHARE) & (F.col("range_") < LITTLE_RANGE) & F.lit(min(height, width) >= 16)
    return k.join(tiles, "photo").select("photo", little.alias("little"), "range_")


#: The least neutral share, median luma and bias; dim red or blue light; the share of one strongest channel and the neutral share that makes up for it.
NEUTRAL_SHARE, NEUTRAL_LUMA, NEUTRAL_BIAS, DIM_LUMA, ONE_CHANNEL, MUCH_NEUTRAL = 0.12, 0.18, 0.025, 0.35, 0.85, 0.5
#: Of a region, the least neutral pixels and their share, the least bias and its cosine with the frame's; the votes, their consensus and quadrants that a verdict asks for.
VOTE_PIXELS, VOTE_SHARE, VOTE_BIAS, VOTE_COSINE, VOTES, CONSENSUS, QUADRANTS = 16, 0.12, 0.015, 0.6, 6, 0.8, 3


def neutral_evidence(rgb: DataFrame, height: int, width: int) -> DataFrame:
    """(photo, n, fraction, median, rg, bg, usable, votes, agreeing, quadrants, accepted): the neutral pixels' log ratios, and whether the frame's regions bear them out.

    usable says whether the frame as a whole may be asked; accepted whether its regions agree, too. The first of equal channels is the strongest.
    """
    r, g, b = (F.col(c) for c in "rgb")
    rg, bg = scalar.log_ratios(r, g, b)
    strongest = F.when((r >= g) & (r >= b), 0).when(g >= b, 1).otherwise(2)
    px = rgb.select("photo", region(F.col("y"), F.col("x"), height, width).alias("region"), neutral(r, g, b).alias("neutral"), (scalar.luma709(r, g, b) / 255).alias("luma"), strongest.alias("strongest"), rg.alias("rg"), bg.alias("bg"))
    of = lambda c: F.when(F.col("neutral"), F.col(c))
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    whole = px.groupBy("photo").agg(F.count_if("neutral").alias("n"), share(F.col("neutral")).alias("fraction"), F.median("luma").alias("median"), *(share(F.col("strongest") == k).alias(f"s{k}") for k in range(3)), F.median(of("rg")).alias("rg"), F.median(of("bg")).alias("bg"))
    dim = (F.col("median") < DIM_LUMA) & (F.greatest("s0", "s2") > ONE_CHANNEL)
    one = (F.greatest("s0", "s1", "s2") > ONE_CHANNEL) & (F.col("fraction") < MUCH_NEUTRAL)
    length = lambda x, y: F.sqrt(F.col(x) * F.col(x) + F.col(y) * F.col(y))
    usable = ~((F.col("fraction") < NEUTRAL_SHARE) | (F.col("median") < NEUTRAL_LUMA) | dim | one) & F.coalesce(length("rg", "bg") >= NEUTRAL_BIAS, F.lit(False)) & F.lit(min(height, width) >= 16)
    votes = px.groupBy("photo", "region").agg(F.median(of("rg")).alias("vr"), F.median(of("bg")).alias("vb"), F.count_if("neutral").alias("many"), F.count("*").alias("size")).where((F.col("many") >= VOTE_PIXELS) & (F.col("many") >= VOTE_SHARE * F.col("size")))
    yes = (length("vr", "vb") > VOTE_BIAS) & (F.col("vr") * F.col("rg") + F.col("vb") * F.col("bg") > VOTE_COSINE * length("vr", "vb") * length("rg", "bg"))
    quadrant = F.floor(F.col("region") / 8) * 2 + F.floor(F.col("region") % 4 / 2)
    told = whole.withColumn("usable", usable).join(votes, "photo", "left").groupBy("photo", "n", "fraction", "median", "rg", "bg", "usable").agg(F.count("region").alias("votes"), F.count_if(yes).alias("agreeing"), F.countDistinct(F.when(yes, quadrant)).alias("quadrants"))
    return told.withColumn("accepted", F.col("usable") & (F.col("votes") >= VOTES) & (F.col("agreeing") >= CONSENSUS * F.col("votes")) & (F.col("quadrants") >= QUADRANTS))


def block_residuals(rgb: DataFrame, side: int) -> DataFrame:
    """(photo, block, v, h, u, w, l, low, high, luma): what is left of R-G, B-G and luma after a block's mean and its linear trends; v and h are centred places, low and high a pixel's extreme codes."""
    at = F.floor(F.col("y") / side) * 1000 + F.floor(F.col("x") / side)
    s = rgb.select("photo", at.cast("int").alias("block"), (F.col("y") % side - (side - 1) / 2).alias("v"), (F.col("x") % side - (side - 1) / 2).alias("h"), (F.col("r") - F.col("g")).cast("double").alias("u"), (F.col("b") - F.col("g")).cast("double").alias("w"), (scalar.weighted256(F.col("r"), F.col("g"), F.col("b")) / 256).alias("l"), F.least("r", "g", "b").alias("low"), F.greatest("r", "g", "b").alias("high"))
    norm = side * side * (side * side - 1) / 12  # of a side's centred places over the block
    fit = s.groupBy("photo", "block").agg(*(e for c in "uwl" for e in (F.avg(c).alias(f"{c}m"), (F.sum(F.col(c) * F.col("v")) / norm).alias(f"{c}v"), (F.sum(F.col(c) * F.col("h")) / norm).alias(f"{c}h"))))
    return s.join(fit, ["photo", "block"]).select("photo", "block", "v", "h", *((F.col(c) - F.col(f"{c}m") - F.col(f"{c}v") * F.col("v") - F.col(f"{c}h") * F.col("h")).alias(c) for c in "uwl"), "low", "high", F.col("l").alias("luma"))


def block_noise(rgb: DataFrame, side: int) -> DataFrame:
    """(photo, block, dispersion, luma_sigma): MAD * 1.4826 of a block's residuals, the two chroma ones as a root mean square."""
    return dispersion(block_residuals(rgb, side))


def dispersion(res: DataFrame) -> DataFrame:
    mid = res.groupBy("photo", "block").agg(*(F.median(c).alias(f"{c}0") for c in "uwl"))
    mad = res.join(mid, ["photo", "block"]).groupBy("photo", "block").agg(*((F.median(F.abs(F.col(c) - F.col(f"{c}0"))) * 1.4826).alias(c) for c in "uwl"))
    return mad.select("photo", "block", F.sqrt((F.col("u") * F.col("u") + F.col("w") * F.col("w")) / 2).alias("dispersion"), F.col("l").alias("luma_sigma"))


#: Codes and lumas of pixels that say something about noise, and their least share; structure's share of the dispersion, with its floors for colour and luma; the correlation of places 4 apart.
USABLE_CODES, USABLE_LUMA, USABLE_SHARE, STRUCTURE, STRUCTURE_CHROMA, STRUCTURE_LUMA, PERIODIC = (3, 252), (20, 220), 0.95, 0.45, 1.0, 2.0, 0.45


def noise_blocks(rgb: DataFrame, side: int = 16) -> DataFrame:
    """(photo, block, usable, chroma, luma, periodic, flat): whether a block shows noise alone: well exposed, without structure in its 4 x 4 cells' means, and without repeats 4 places apart."""
    res = block_residuals(rgb, side)
    good = (F.col("low") > USABLE_CODES[0]) & (F.col("high") < USABLE_CODES[1]) & (F.col("luma") > USABLE_LUMA[0]) & (F.col("luma") < USABLE_LUMA[1])
    shown = res.groupBy("photo", "block").agg(F.avg(F.when(good, 1.0).otherwise(0.0)).alias("usable"))
    cell = lambda c: F.floor((F.col(c) + (side - 1) / 2) / 4).cast("int")
    cells = res.groupBy("photo", "block", cell("v"), cell("h")).agg(*(F.avg(c).alias(c) for c in "uwl"))
    coarse = cells.groupBy("photo", "block").agg(F.sqrt(F.avg(F.col("u") * F.col("u") + F.col("w") * F.col("w")) / 2).alias("chroma"), F.sqrt(F.avg(F.col("l") * F.col("l"))).alias("luma"))
    ahead = [Window.partitionBy("photo", "block", a).orderBy(b) for a, b in (("h", "v"), ("v", "h"))]
    moved = res.select("photo", "block", "u", "w", *(F.lead(c, 4).over(win).alias(f"{c}{k}") for k, win in enumerate(ahead) for c in "uw"), *(F.lag(c, 4).over(win).alias(f"{c}b{k}") for k, win in enumerate(ahead) for c in "uw"))
    power = lambda there: F.sum(F.when(there.isNotNull(), F.col("u") * F.col("u") + F.col("w") * F.col("w")))
    like = [F.abs(F.sum(F.col("u") * F.col(f"u{k}") + F.col("w") * F.col(f"w{k}"))) / F.greatest(F.lit(1.0), F.sqrt(power(F.col(f"u{k}")) * power(F.col(f"ub{k}")))) for k in (0, 1)]
    repeats = moved.groupBy("photo", "block").agg(F.greatest(*like).alias("periodic"))
    out = shown.join(coarse, ["photo", "block"]).join(repeats, ["photo", "block"]).join(dispersion(res), ["photo", "block"])
    flat = (F.col("usable") >= USABLE_SHARE) & (F.col("chroma") <= F.greatest(F.lit(STRUCTURE_CHROMA), F.col("dispersion") * STRUCTURE)) & (F.col("luma") <= F.greatest(F.lit(STRUCTURE_LUMA), F.col("luma_sigma") * STRUCTURE)) & (F.col("periodic") < PERIODIC)
    return out.select("photo", "block", "usable", "chroma", "luma", "periodic", flat.alias("flat"))


#: Luma and codes of pixels that may show coloured light, their saturation and warmth; the least count, share and bias; the region's share, agreement, votes, quadrants and consensus.
AMBIENT = {"luma": (0.08, 0.85), "code": 247, "saturation": (0.08, 0.85), "count": 128, "share": 0.12, "bias": 0.08, "cosine": 0.5, "votes": 4, "quadrants": 2, "consensus": 0.75}


def ambient_color(rgb: DataFrame, height: int, width: int, semantic: float) -> DataFrame:
    """(photo, n, rg, bg, tiles, agreeing, quadrants, weight): warm light that a scene's label, of weight semantic, and the picture's regions both tell of; weight is null where they don't."""
    r, g, b = (F.col(c) for c in "rgb")
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    luma, full = scalar.luma709(r, g, b) / 255, (high - low) / F.greatest(high, F.lit(1))
    usable = (luma > AMBIENT["luma"][0]) & (luma < AMBIENT["luma"][1]) & (high <= AMBIENT["code"])
    warm = (100 * r > 103 * g) & (100 * g > 103 * b)
    rg, bg = scalar.log_ratios(r, g, b)
    px = rgb.select("photo", region(F.col("y"), F.col("x"), height, width).alias("region"), (usable & (full > AMBIENT["saturation"][0]) & (full < AMBIENT["saturation"][1]) & warm).alias("warm"), rg.alias("rg"), bg.alias("bg"))
    of = lambda c: F.median(F.when(F.col("warm"), F.col(c)))
    whole = px.groupBy("photo").agg(F.count_if("warm").alias("n"), F.count("*").alias("size"), of("rg").alias("rg"), of("bg").alias("bg"))
    told = px.groupBy("photo", "region").agg(F.count_if("warm").alias("many"), F.count("*").alias("all"), of("rg").alias("vr"), of("bg").alias("vb")).where((F.col("many") >= 16) & (F.col("many") >= AMBIENT["share"] * F.col("all")))
    agrees = (F.col("vr") - F.col("vb")) / F.sqrt(F.lit(2.0)) > AMBIENT["cosine"] * F.sqrt(F.col("vr") * F.col("vr") + F.col("vb") * F.col("vb"))
    quadrant = F.floor(F.col("region") / 8) * 2 + F.floor(F.col("region") % 4 / 2)
    votes = told.groupBy("photo").agg(F.count("*").alias("tiles"), F.count_if(agrees).alias("agreeing"), F.countDistinct(F.when(agrees, quadrant)).alias("quadrants"))
    out = whole.join(votes, "photo", "left").fillna(0, ["tiles", "agreeing", "quadrants"])
    consensus = F.col("agreeing") / F.greatest(F.col("tiles"), F.lit(1))
    strong = (F.col("n") >= AMBIENT["count"]) & (F.col("n") >= AMBIENT["share"] * F.col("size")) & (F.sqrt(F.col("rg") * F.col("rg") + F.col("bg") * F.col("bg")) >= AMBIENT["bias"])
    yes = strong & (F.col("tiles") >= AMBIENT["votes"]) & (F.col("quadrants") >= AMBIENT["quadrants"]) & (consensus >= AMBIENT["consensus"])
    return out.select("photo", "n", "rg", "bg", "tiles", "agreeing", "quadrants", F.when(yes, semantic * scalar.clamp((consensus - 0.6) / 0.35)).alias("weight"))


def saturation_targets(both: DataFrame, influences: dict[str, float]) -> DataFrame:
    """(photo, part, n, saturation, target): for green and blue materials the median saturation of a render (r, g, b), and what to aim at, from the pixels that the original (r0, g0, b0) shows so; muted ones get more, and null stands for no aim."""
    r, g, b = (F.col(f"{c}0") for c in "rgb")
    luma = scalar.luma709(r, g, b) / 255
    usable = (luma > AMBIENT["luma"][0]) & (luma < AMBIENT["luma"][1]) & (F.greatest(r, g, b) <= AMBIENT["code"])
    masks = {"greens": (100 * g > 106 * r) & (100 * g > 104 * b), "blues": (100 * b > 108 * r) & (100 * b > 98 * g)}
    full = (F.greatest("r", "g", "b") - F.least("r", "g", "b")) / F.greatest(F.greatest("r", "g", "b"), F.lit(1))
    agg = both.groupBy("photo").agg(F.count("*").alias("size"), *(e for k, m in masks.items() for e in (F.count_if(usable & m).alias(f"{k}_n"), F.median(F.when(usable & m, full)).alias(f"{k}_s"))))
    parts = F.array(*(F.struct(F.lit(k).alias("part"), F.col(f"{k}_n").alias("n"), F.col(f"{k}_s").alias("saturation"), F.lit(float(w)).alias("influence")) for k, w in influences.items()))
    out = agg.select("photo", "size", F.explode(parts).alias("p")).select("photo", "size", "p.*")
    lift = F.least(F.lit(0.04), F.greatest(F.lit(0.0), F.lit(0.55) - F.col("saturation")) * 0.12) * F.col("influence")
    enough = (F.col("influence") >= 0.12) & (F.col("n") >= F.greatest(F.lit(32.0), 0.025 * F.col("size"))) & (lift > 0.002)
    return out.select("photo", "part", "n", "saturation", F.when(enough, F.col("saturation") + lift).alias("target"))
