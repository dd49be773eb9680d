"""Gates and scores of a chip, from its pixels in one pass each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import raster


def _share(hit: Column, weight: Column) -> Column:
    return F.lit(100.0) * F.sum(F.when(hit, weight).otherwise(0)).cast("double") / F.sum(weight).cast("double")


def border_weight(height: int, width: int, part: float = 0.05) -> Column:
    """How many of the four edge strips hold a pixel; corners count twice."""
    up, side = int(height * part), int(width * part)
    y, x = F.col("y"), F.col("x")
    return sum((F.when(c, 1).otherwise(0) for c in (y >= height - up, x < side, x >= width - side)), F.when(y < up, 1).otherwise(0))


def gates(pixels: DataFrame, height: int = 32, width: int = 32) -> DataFrame:
    """cloud_pct and border_pct of each chip."""
    cloud = (raster.value() > 180) & (raster.saturation() < 45)
    return pixels.groupBy(*raster.CHIP).agg(_share(cloud, F.lit(1)).alias("cloud_pct"), _share(raster.grey() < 15, border_weight(height, width)).alias("border_pct"))


def verdict(gated: DataFrame) -> DataFrame:
    """Status, reason, message and confidence; the cloud gate speaks first.

    A frame without shares could not be read: it is rejected, at confidence 0.
    """
    cloud, border = F.col("cloud_pct"), F.col("border_pct")
    cases = {
        "unreadable": (cloud.isNull() | border.isNull(), F.lit("Error: Failed to read image file.")),
        "cloud": (cloud > raster.CLOUD_LIMIT, F.format_string("Rejected: Excessive cloud cover (%.1f%% > 15%%).", F.bround(cloud, 1))),
        "border": (border > raster.BORDER_LIMIT, F.format_string("Rejected: Excessive black borders (%.1f%% > 25%%).", F.bround(border, 1))),
    }
    reason, message = F.lit(None).cast("string"), F.lit("Passed quality gate.")
    for name, (holds, said) in reversed(cases.items()):
        reason, message = F.when(holds, name).otherwise(reason), F.when(holds, said).otherwise(message)
    confidence = F.coalesce(F.round(F.greatest(F.lit(0.0), F.lit(1.0) - F.least(F.lit(1.0), cloud / 100 + border / 200)), 3), F.lit(0.0))
    return gated.withColumns({"status": F.when(reason.isNull(), "passed").otherwise("rejected"), "reason": reason, "message": message, "confidence": confidence})


def sharpness(pixels: DataFrame) -> DataFrame:
    """Population variance of the four-neighbour Laplacian of grey, mirrored at the edges."""
    lines = W.partitionBy(*raster.CHIP, "y").orderBy("x"), W.partitionBy(*raster.CHIP, "x").orderBy("y")
    c = F.col("grey")
    near = [F.coalesce(one(c).over(w), other(c).over(w), c) for w in lines for one, other in ((F.lag, F.lead), (F.lead, F.lag))]
    lap = sum(near, F.lit(-4.0) * c)
    return pixels.withColumn("grey", raster.grey()).select(*raster.CHIP, lap.alias("lap")).groupBy(*raster.CHIP).agg(F.var_pop("lap").alias("sharpness"))


def clarity(sharp: Column, similarity: Column) -> Column:
    """Sharpness plus five times the likeness to a clear view, in percent."""
    return F.coalesce(sharp + F.lit(5.0) * (F.lit(100.0) * similarity), F.lit(0.0))


def master_reference(scored: DataFrame, band: str, score: str, order: str) -> DataFrame:
    """The clearest frame of each band, the first of equals."""
    first = F.row_number().over(W.partitionBy(band).orderBy(F.desc(score), order))
    return scored.withColumn("rn", first).where("rn = 1").drop("rn")


def standardise(pixels: DataFrame, template: int = 0) -> DataFrame:
    """Dehaze, colour and contrast, matching to the tile's raw chip of date ``template``, smoothing."""
    out = raster.enhance(raster.dehaze(pixels))
    chip = W.partitionBy(*raster.CHIP)
    for c in "rgb":
        goal = raster.cdf(pixels.where(F.col("t") == template), c, *raster.CHIP)
        share = F.count("*").over(chip.orderBy(c)).cast("double") / F.count("*").over(chip)
        told = raster.at_quantiles(out.withColumn("q", share), goal)
        out = told.select(*raster.CHIP, "y", "x", *(F.col("matched").alias(c) if d == c else d for d in "rgb"))
    for c in "rgb":
        out = raster.smooth(out, c, 30.0, 30.0)
    return out


def manifest(frames: DataFrame, key: str, *order: str) -> DataFrame:
    """One row a file name; a later band overwrites."""
    last = F.row_number().over(W.partitionBy(key).orderBy(*(F.desc(c) for c in order)))
    return frames.withColumn("rn", last).where("rn = 1").drop("rn")


def thumbnails(pixels: DataFrame, dark_limit: float, dead: int = 8, cloud_limit: float = 0.03) -> DataFrame:
    """Dark, dead-line and cloud tests of a thumbnail; ``ok`` if none rejects."""
    total = F.col("r") + F.col("g") + F.col("b")
    line = {axis: F.avg(total.cast("double") / 3).over(W.partitionBy(*raster.CHIP, axis)) for axis in ("y", "x")}
    told = pixels.select(*raster.CHIP, "r", "g", "b", "y", "x", *(F.when(mean < 35, F.col(axis)).alias(f"_{axis}") for axis, mean in line.items()))
    out = told.groupBy(*raster.CHIP).agg(
        F.avg((total < 35).cast("int").cast("double")).alias("dark"),
        F.avg(((F.col("r") > 200) & (F.col("g") > 200) & (F.col("b") > 200)).cast("int").cast("double")).alias("bright"),
        *(F.size(F.collect_set(f"_{axis}")).cast("long").alias(f"dead_{axis}") for axis in ("y", "x")),  # as many as a chip has lines
    )
    ok = (F.col("dark") <= dark_limit) & (F.col("dead_y") < dead) & (F.col("dead_x") < dead) & (F.col("bright") <= cloud_limit)
    return out.withColumn("ok", ok)
