"""Colors of regions: what stands behind a text, how even it is, and whether ink is dark or light."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.operators.spatial import gridded

# Width of a bin of colors, least difference of ink in luminance (of 255), parts of luminance in 10,000ths.
BIN, INK = 12, 14
RED, GREEN, BLUE = 2126, 7152, 722
CHANNELS = ("r", "g", "b")


def luminance(r: str, g: str, b: str) -> Column:
    """10,000 times the luminance, a whole number for whole colors."""
    return F.col(r) * RED + F.col(g) * GREEN + F.col(b) * BLUE


def region_pixels(pixels: DataFrame, regions: DataFrame, cell: float = 32.0) -> DataFrame:
    """(page, region, part, r, g, b, n) of pixels (page, x, y, r, g, b) and regions (page, region, x0, y0, x1, y1 as whole
    numbers, x1 and y1 not included): `crop` within a region, `border` around it, at most six wide and at least two, half
    the region's height in between. n counts equal colors, so that what follows sees at most a row for each color.

    They meet in grid cells; a pixel belongs to every region that it lies in or near. Regions without area have no pixels.
    """
    high = F.col("y1") - F.col("y0")
    margin = F.greatest(F.lit(2), F.least(F.lit(6), F.when(F.floor(high / 2) == 0, 2).otherwise(F.floor(high / 2))))
    grown = regions.where("x1 > x0 and y1 > y0").withColumn("m", margin)
    cells = gridded(grown.select("page", "region", "m", "x0", "y0", (F.col("x1") - 1).alias("x1"), (F.col("y1") - 1).alias("y1")), cell, 6.0)
    spots = pixels.select("page", "x", "y", *CHANNELS, F.floor(F.col("x") / cell).alias("gx"), F.floor(F.col("y") / cell).alias("gy"))
    inside = lambda by: F.col("x").between(F.col("x0") - by, F.col("x1") + by) & F.col("y").between(F.col("y0") - by, F.col("y1") + by)
    part = F.when(inside(F.lit(0)), "crop").otherwise("border").alias("part")
    met = spots.join(cells, ["page", "gx", "gy"]).where(inside(F.col("m")))
    return met.groupBy("page", "region", part, *CHANNELS).agg(F.count("*").alias("n"))


def _median(c: str) -> Column:
    return F.percentile(F.col(c), F.lit(0.5), F.col("n"))


def _spread(c: str) -> Column:
    """The standard deviation of all values of counted ones."""
    n = F.sum("n")
    mean = F.sum(F.col(c) * F.col("n")) / n
    return F.sqrt(F.greatest(F.sum(F.col(c) * F.col(c) * F.col("n")) / n - mean * mean, F.lit(0.0)))


def dominant_background(counted: DataFrame) -> DataFrame:
    """(page, region, r, g, b, ratio): the fullest bin of colors (ties: the smaller r, g, b), its share of all pixels, and
    the medians, cut to whole numbers, of all pixels whose bins lie within one of it in each channel."""
    bins = [F.floor(F.col(c) / BIN).alias(f"q{c}") for c in CHANNELS]
    own = counted.withColumns({f"q{c}": b for c, b in zip(CHANNELS, bins)})
    filled = own.groupBy("page", "region", "qr", "qg", "qb").agg(F.sum("n").alias("k"))
    first = F.struct("k", -F.col("qr"), -F.col("qg"), -F.col("qb"))
    best = filled.groupBy("page", "region").agg(F.max_by(F.struct("qr", "qg", "qb"), first).alias("best"), F.max("k").alias("k"), F.sum("k").alias("total"))
    near = own.join(best, ["page", "region"])
    for c in CHANNELS:
        near = near.where(F.abs(F.col(f"q{c}") - F.col(f"best.q{c}")) <= 1)
    ratio = F.round(F.first(F.col("k") / F.col("total")), 6)
    return near.groupBy("page", "region").agg(*[F.floor(_median(c)).alias(c) for c in CHANNELS], ratio.alias("ratio"))


def robust_background(counted: DataFrame) -> DataFrame:
    """(page, region, r, g, b, spread): of pixels around a region the lighter ones, from the 45th hundredth of luminance on,
    if the median is light (120 or more), else the darker ones up to the 55th; the channels' medians over them and the mean
    of their standard deviations."""
    lit = counted.withColumn("l", luminance(*CHANNELS))
    level = lambda p: F.percentile(F.col("l"), F.lit(p), F.col("n"))
    cuts = lit.groupBy("page", "region").agg(level(0.5).alias("median"), level(0.45).alias("low"), level(0.55).alias("high"))
    light = F.col("median") >= 120 * 10_000
    kept = lit.join(cuts, ["page", "region"]).where(F.when(light, F.col("l") >= F.col("low")).otherwise(F.col("l") <= F.col("high")))
    spread = F.round((_spread("r") + _spread("g") + _spread("b")) / 3, 4)
    return kept.groupBy("page", "region").agg(*[_median(c).alias(c) for c in CHANNELS], spread.alias("spread"))


def ink(counted: DataFrame, regions: DataFrame) -> DataFrame:
    """(page, region, dark, light, spread, polarity) of every region (page, region): how much its pixels are darker or lighter
    than what is around it, beyond 14 of 255; light ink must outweigh dark by .08. Without pixels around, white is assumed;
    a region without pixels has no ink, and is dark."""
    around = robust_background(counted.where("part = 'border'")).withColumn("around", luminance(*CHANNELS)).select("page", "region", "around", "spread")
    own = regions.select("page", "region").join(around, ["page", "region"], "left").fillna({"around": 255.0 * 10_000, "spread": 0.0})
    crop = counted.where("part = 'crop'").withColumn("l", luminance(*CHANNELS)).select("page", "region", "l", "n")
    far = lambda a, b: F.coalesce(F.sum(F.greatest(a - b - INK * 10_000, F.lit(0.0)) * F.col("n")), F.lit(0.0)) / 10_000
    sums = own.join(crop, ["page", "region"], "left").groupBy("page", "region", "spread")
    out = sums.agg(far(F.col("around"), F.col("l")).alias("dark"), far(F.col("l"), F.col("around")).alias("light"))
    return out.withColumn("polarity", F.when(F.col("light") > F.col("dark") * 1.08, "light").otherwise("dark"))


def text_polarity(inks: DataFrame, lines: DataFrame, most: int = 20) -> DataFrame:
    """(page, text, dark, light, polarity) of texts whose lines (page, text, line_no, region) are regions: the ink of the first
    `most` lines together. A line without a region adds nothing."""
    own = lines.where(F.col("line_no") < most).join(inks.select("page", "region", "dark", "light"), ["page", "region"], "left")
    sums = own.groupBy("page", "text").agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("dark", "light")])
    return sums.withColumn("polarity", F.when(F.col("light") > F.col("dark") * 1.08, "light").otherwise("dark"))
