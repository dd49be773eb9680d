"""Pixel-layout kernels: one row a pixel (tile_id, t, y, x, channels).

Rectangular structuring elements are separable, so erosion and dilation are a
sliding minimum or maximum along x and then along y; cells outside the chip are
left out. ``by_tile`` puts a tile's pixels into one part; every window and group
below is then satisfied by that exchange and only sorts within parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

CHIP = ("tile_id", "t")

# Thresholds of the change and quality operators.
WATER, VEGETATION, VEGETATION_DROP = 0.10, 0.25, 0.12
SSIM_LIMIT, SEASONAL_LIMIT, MIN_AREA, EDGE = 0.55, 0.09, 400, 15
CLOUD_LIMIT, BORDER_LIMIT = 15.0, 25.0


def by_tile(df: DataFrame) -> DataFrame:
    """All pixels of a tile in one part, for all operators that follow."""
    return df.repartition("tile_id")


def normalised_difference(a: Column, b: Column) -> Column:
    """(a - b) / (a + b), 0 where both are 0."""
    return F.when(a + b == 0, F.lit(0.0)).otherwise((a - b).cast("double") / (a + b))


def ndvi() -> Column:
    return normalised_difference(F.col("nir"), F.col("r"))


def ndwi() -> Column:
    return normalised_difference(F.col("g"), F.col("nir"))


def grey() -> Column:
    return F.round(F.lit(0.299) * F.col("r") + F.lit(0.587) * F.col("g") + F.lit(0.114) * F.col("b"))


def value() -> Column:
    return F.greatest("r", "g", "b")


def saturation() -> Column:
    v = value()
    return F.when(v == 0, F.lit(0.0)).otherwise(F.round((v - F.least("r", "g", "b")) * F.lit(255.0) / v))


def _slide(df: DataFrame, column: str, size: int, pick) -> DataFrame:
    half = size // 2
    across = W.partitionBy(*CHIP, "y").orderBy("x").rowsBetween(-half, half)
    down = W.partitionBy(*CHIP, "x").orderBy("y").rowsBetween(-half, half)
    return df.withColumn(column, pick(column).over(across)).withColumn(column, pick(column).over(down))


def erode(df: DataFrame, column: str, size: int) -> DataFrame:
    return _slide(df, column, size, F.min)


def dilate(df: DataFrame, column: str, size: int) -> DataFrame:
    return _slide(df, column, size, F.max)


def opened(df: DataFrame, column: str, size: int) -> DataFrame:
    return dilate(erode(df, column, size), column, size)


def closed(df: DataFrame, column: str, size: int) -> DataFrame:
    return erode(dilate(df, column, size), column, size)


def nodata(df: DataFrame) -> DataFrame:
    return dilate(df.withColumn("nodata", F.when(grey() <= 5, 1).otherwise(0)), "nodata", 9)


def clouds(df: DataFrame) -> DataFrame:
    bright = F.when((value() > 160) & (saturation() <= 50), 1).otherwise(0)
    return dilate(opened(df.withColumn("cloud", bright), "cloud", 7), "cloud", 35)


def shadows(df: DataFrame) -> DataFrame:
    return dilate(opened(df.withColumn("shadow", F.when(value() <= 35, 1).otherwise(0)), "shadow", 5), "shadow", 15)


def invalid(df: DataFrame) -> DataFrame:
    """Pixels of a place that no date may use: no data, cloud or shadow at either."""
    told = shadows(clouds(nodata(df)))
    return told.groupBy("tile_id", "y", "x").agg(F.max(F.greatest("nodata", "cloud", "shadow")).alias("invalid"))


def two_dates(df: DataFrame, *columns: tuple[str, Column]) -> DataFrame:
    """One row a place with each column at both dates, as name_1 and name_2, in one pass."""
    parts = [F.max(F.when(F.col("t") == t, c)).alias(f"{name}_{t + 1}") for name, c in columns for t in (0, 1)]
    return df.groupBy("tile_id", "y", "x").agg(*parts)


def water_change(df: DataFrame) -> DataFrame:
    both = two_dates(df, ("w", (ndwi() > WATER).cast("int")))
    return both.select("tile_id", "y", "x", ((F.col("w_2") == 1) & (F.col("w_1") == 0)).alias("flood"), ((F.col("w_1") == 1) & (F.col("w_2") == 0)).alias("recede"))


def _vegetation() -> tuple[Column, Column]:
    a, b, changed = F.col("v_1"), F.col("v_2"), F.col("changed") == 1
    return (a > VEGETATION) & (a - b > VEGETATION_DROP) & changed, (b > VEGETATION) & (b - a > VEGETATION_DROP) & changed


def vegetation_change(df: DataFrame) -> DataFrame:
    """Vegetation lost or grown where the structure changed too."""
    lost, grown = _vegetation()
    return _structural(df, ("v", ndvi())).select("tile_id", "y", "x", lost.alias("loss"), grown.alias("growth"))


def histogram(df: DataFrame, column: str, *keys: str) -> DataFrame:
    return df.groupBy(*keys, F.col(column).alias("v")).agg(F.count("*").alias("c"))


def cdf(df: DataFrame, column: str, *keys: str) -> DataFrame:
    """Share of a chip's pixels at or below each value."""
    h, all_ = histogram(df, column, *keys), W.partitionBy(*keys)
    run = F.sum("c").over(all_.orderBy("v").rowsBetween(W.unboundedPreceding, 0))
    return h.select(*keys, "v", (run.cast("double") / F.sum("c").over(all_)).alias("cdf"))


def otsu(hist: DataFrame, *keys: str) -> DataFrame:
    """The value whose split has the largest variance between classes, the least of equals."""
    all_ = W.partitionBy(*keys)
    run = all_.orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    c, v = F.col("c").cast("double"), F.col("v")
    h = hist.select(*keys, "v", F.sum(c).over(run).alias("w0"), F.sum(c * v).over(run).alias("s0"), F.sum(c).over(all_).alias("n"), F.sum(c * v).over(all_).alias("s")).where("w0 < n")
    gap = F.col("s0") * F.col("n") - F.col("s") * F.col("w0")
    between = gap * gap / (F.col("w0") * (F.col("n") - F.col("w0")))
    first = F.row_number().over(all_.orderBy(F.desc("between"), "v"))
    return h.withColumn("between", between).withColumn("rn", first).where("rn = 1").select(*keys, F.col("v").alias("threshold"))


def smooth(df: DataFrame, column: str, colour: float, space: float) -> DataFrame:
    """Bilateral mean over the 13 pixels within two of each, mirrored at the edges."""

    def at(source: Column, line, step: int) -> Column:
        if not step:
            return source
        move, back = (F.lag, F.lead) if step < 0 else (F.lead, F.lag)
        if abs(step) == 1:
            return F.coalesce(move(source, 1).over(line), back(source, 1).over(line))
        return F.coalesce(move(source, 2).over(line), F.when(move(source, 1).over(line).isNotNull(), source), back(source, 2).over(line))

    down, across = W.partitionBy(*CHIP, "x").orderBy("y"), W.partitionBy(*CHIP, "y").orderBy("x")
    c = F.col(column)
    tall = df.withColumns({f"_{dy}": at(c, down, dy).cast("double") for dy in range(-2, 3)})
    near = {(dy, dx): f"_{dy}_{dx}" for dy in range(-2, 3) for dx in range(-2, 3) if dy * dy + dx * dx <= 4}
    wide = tall.withColumns({name: at(F.col(f"_{dy}"), across, dx) for (dy, dx), name in near.items()})
    total = weight = F.lit(0.0)
    for (dy, dx), name in near.items():
        gap = F.col(name) - c
        k = F.exp(-(gap * gap) / F.lit(2.0 * colour * colour) - F.lit((dy * dy + dx * dx) / (2.0 * space * space)))
        total, weight = total + k * F.col(name), weight + k
    return wide.withColumn(column, F.rint(total / weight).cast("int")).select(*df.columns)


def built(df: DataFrame) -> DataFrame:
    """Smoothed gain of grey over 25 and over its tile's Otsu threshold, where structure changed and nothing was cleared."""
    lost, _ = _vegetation()
    both = _structural(df, ("v", ndvi())).withColumn("gain", F.greatest(F.col("p_2") - F.col("p_1"), F.lit(0.0)).cast("int"))
    gains = smooth(both, "gain", 50.0, 50.0).withColumn("gain", F.when(F.col("gain") > 25, F.col("gain")).otherwise(0))
    cut = otsu(histogram(gains, "gain", "tile_id"), "tile_id")
    bright = F.coalesce(F.col("gain") > F.col("threshold"), F.lit(False))
    return gains.join(cut, "tile_id", "left").select("tile_id", "y", "x", (bright & (F.col("changed") == 1) & ~lost).alias("built"))


def _similarity(both: DataFrame, size: int = 11) -> DataFrame:
    """Adds ``ssim`` of p_1 and p_2 to a row a place."""
    half, a, b = size // 2, F.col("p_1"), F.col("p_2")
    sums = {"_a": a, "_b": b, "_aa": a * a, "_bb": b * b, "_ab": a * b, "_n": F.lit(1.0)}
    across = W.partitionBy("tile_id", "y").orderBy("x").rowsBetween(-half, half)
    down = W.partitionBy("tile_id", "x").orderBy("y").rowsBetween(-half, half)
    s = both.withColumns({k: F.sum(c).over(across) for k, c in sums.items()})
    s = s.withColumns({k: F.sum(k).over(down) for k in sums})
    n = F.col("_n")
    ma, mb, fix = F.col("_a") / n, F.col("_b") / n, n / (n - 1)
    va, vb, cov = fix * (F.col("_aa") / n - ma * ma), fix * (F.col("_bb") / n - mb * mb), fix * (F.col("_ab") / n - ma * mb)
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    ssim = ((2 * ma * mb + c1) * (2 * cov + c2)) / ((ma * ma + mb * mb + c1) * (va + vb + c2))
    return s.select(*both.columns, ssim.alias("ssim"))


def ssim_map(df: DataFrame, size: int = 11) -> DataFrame:
    """Structural similarity of the two dates in box windows, cropped at the edges."""
    return _similarity(two_dates(df, ("p", grey())), size).select("tile_id", "y", "x", "ssim")


def _structural(df: DataFrame, *columns: tuple[str, Column]) -> DataFrame:
    """A row a place: grey and ``columns`` at both dates, and ``changed``."""
    low = _similarity(two_dates(df, ("p", grey()), *columns)).withColumn("t", F.lit(0))
    low = low.withColumn("changed", F.when(F.floor(F.greatest("ssim", F.lit(0.0)) * 255) < 255 - int((1 - SSIM_LIMIT) * 255), 1).otherwise(0))
    return closed(opened(low, "changed", 3), "changed", 5)


def structural(df: DataFrame) -> DataFrame:
    """Pixels whose structure changed: similarity, clamped at 0, below the limit; opened and closed."""
    return _structural(df).select("tile_id", "y", "x", "changed")


def seasonal(mask: DataFrame, column: str, limit: float = SEASONAL_LIMIT) -> DataFrame:
    """Share of a chip that a mask covers, and whether that is a global shift."""
    share = F.avg(F.col(column).cast("int").cast("double"))
    return mask.groupBy("tile_id").agg(share.alias("share")).withColumn("is_global", F.col("share") > limit)


def _lit(df: DataFrame, size: int) -> DataFrame:
    """Adds a_r, a_g, a_b: the mean colour of the thousandth of a chip's pixels with the brightest dark channel."""
    dark = erode(df.withColumn("dark", F.least("r", "g", "b")), "dark", size)
    chip = W.partitionBy(*CHIP)
    ranked = dark.withColumn("_rn", F.row_number().over(chip.orderBy(F.desc("dark"), "y", "x")))
    top = F.col("_rn") <= F.greatest(F.floor(F.count("*").over(chip) / 1000), F.lit(1))
    ranked = ranked.withColumn("_top", top)
    return ranked.withColumns({f"a_{c}": F.avg(F.when(F.col("_top"), F.col(c) / F.lit(255.0))).over(chip) for c in "rgb"}).drop("_rn", "_top", "dark")


def atmospheric_light(df: DataFrame, size: int = 15) -> DataFrame:
    return _lit(df, size).groupBy(*CHIP).agg(*(F.max(f"a_{c}").alias(f"a_{c}") for c in "rgb"))


def dehaze(df: DataFrame, omega: float = 0.82, size: int = 15) -> DataFrame:
    lit_ = _lit(df, size)
    least = F.least(*(F.col(c) / F.lit(255.0) / (F.col(f"a_{c}") + F.lit(1e-6)) for c in "rgb"))
    thin = erode(lit_.withColumn("dark", least), "dark", size)
    through = F.greatest(F.lit(1.0) - F.lit(omega) * F.col("dark"), F.lit(0.1))
    clear = {c: (F.col(c) / F.lit(255.0) - F.col(f"a_{c}")) / through + F.col(f"a_{c}") for c in "rgb"}
    return thin.select(*CHIP, "y", "x", *(F.floor(F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)) * 255).cast("int").alias(c) for c, v in clear.items()))


def enhance(df: DataFrame, colour: float = 1.15, contrast: float = 1.10) -> DataFrame:
    """Colour pulled away from luma, then contrast away from the chip's mean luma."""
    luma = lambda: F.floor((F.col("r") * 299 + F.col("g") * 587 + F.col("b") * 114) / 1000)
    clip = lambda c: F.floor(F.least(F.greatest(c, F.lit(0.0)), F.lit(255.0))).cast("int")
    one = df.withColumn("l", luma()).withColumns({c: clip(F.col("l") + F.lit(colour) * (F.col(c) - F.col("l"))) for c in "rgb"})
    mean = F.floor(F.avg(luma()).over(W.partitionBy(*CHIP)) + 0.5)
    two = one.withColumn("m", mean)
    return two.select(*CHIP, "y", "x", *(clip(F.col("m") + F.lit(contrast) * (F.col(c) - F.col("m"))).alias(c) for c in "rgb"))


def at_quantiles(rows: DataFrame, goal: DataFrame) -> DataFrame:
    """``rows`` (tile_id, q, ...) with ``matched``: the goal's value at quantile q, between neighbours by line.

    The goal's shares stand among the rows in the order of q, and the nearest on
    either side is carried along, so that each row costs a step and not a search.
    """
    marks = goal.select("tile_id", F.col("cdf").alias("q"), F.struct("cdf", "v").alias("_g"))
    both = rows.withColumns({"_own": F.lit(True), "_g": F.lit(None).cast(marks.schema["_g"].dataType)}).unionByName(marks.withColumn("_own", F.lit(False)), allowMissingColumns=True)
    line = W.partitionBy("tile_id")
    near = {"_low": line.orderBy("q"), "_high": line.orderBy(F.desc("q"))}
    both = both.withColumns({name: F.last("_g", ignorenulls=True).over(w.rangeBetween(W.unboundedPreceding, W.currentRow)) for name, w in near.items()}).where("_own")
    q, low, high = F.col("q"), F.col("_low"), F.col("_high")
    ends = F.when(low.isNull(), high["v"].cast("double")).when(high.isNull() | (high["cdf"] == low["cdf"]), low["v"].cast("double"))
    between = low["v"] + (q - low["cdf"]) * (high["v"] - low["v"]) / (high["cdf"] - low["cdf"])
    return both.select(*rows.columns, F.floor(F.coalesce(ends, between) + F.lit(1e-9)).cast("int").alias("matched"))


def match_histogram(df: DataFrame, column: str, source: int = 1, template: int = 0) -> DataFrame:
    """Each source value with the template's value at its quantile."""
    both = cdf(df, column, *CHIP)
    rows = both.where(F.col("t") == source).select("tile_id", "v", F.col("cdf").alias("q"))
    return at_quantiles(rows, both.where(F.col("t") == template)).drop("q")


def thumbnail(pixels: DataFrame, side: int = 8, height: int = 32, width: int = 32) -> DataFrame:
    """Chips made ``side`` pixels square by the means of boxes; boxes differ by a row where ``side`` does not divide an edge."""
    y, x = (F.floor(F.col(c) * side / n).cast("int").alias(c) for c, n in (("y", height), ("x", width)))
    return pixels.select(*CHIP, y, x, "r", "g", "b").groupBy(*CHIP, "y", "x").agg(*(F.avg(c).alias(c) for c in "rgb"))
