"""Vector search, band fusion and clustering over unit vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import geo, vectors


def literal(values: list[float]) -> Column:
    """A vector that is part of the plan: one query, not a table."""
    return F.array(*(F.lit(float(v)) for v in values))


def artifact_shares(embedding: Column, prompts: list[list[float]], scale: float) -> Column:
    """Softmax over likeness to (clear, cloud, shadow) prompts."""
    return vectors.softmax(F.array(*(F.lit(float(scale)) * vectors.dot(embedding, literal(p)) for p in prompts)))


def execute(tiles: DataFrame, query: list[float], *, first: str | None = None, last: str | None = None, area=None, layers: list[str] | None = None, prompts: list[list[float]] | None = None, scale: float = 10.0, gate: float = 0.35, least: float = 0.0, k: int = 5, unknown: str | None = "Unknown") -> DataFrame:
    """Filters on metadata, scores by inner product, one row a path, gate, top k.

    Metadata filters come first and reach the scan; the score is an expression
    over a literal, so nothing is joined or shuffled before the dedupe.
    """
    box = (F.col("min_lon"), F.col("min_lat"), F.col("min_lon") + F.lit(0.045), F.col("min_lat") + F.lit(0.045))
    found = tiles.where(geo.in_dates(F.col("acq_date"), first, last) & geo.intersects(box, area))
    if layers:
        found = found.where(F.col("layer").isin(layers))
    found = found.withColumn("raw", F.lit(100.0) * vectors.dot(F.col("embedding"), literal(query))).where(F.col("raw") >= least)
    if prompts:
        shares = artifact_shares(F.col("embedding"), prompts, scale)
        found = found.withColumn("p", shares).withColumns({"cloud_conf": F.col("p")[1], "shadow_conf": F.col("p")[2]}).where((F.col("cloud_conf") <= gate) & (F.col("shadow_conf") <= gate))
    best = F.row_number().over(W.partitionBy("path").orderBy(F.desc("raw"), "tile_id"))
    found = found.withColumn("rn", best).where("rn = 1")
    day = F.col("acq_date").cast("string")
    return found.orderBy(F.desc("raw"), "path").limit(k).select("path", "placename", "layer", F.round("raw", 2).alias("score"), (F.coalesce(day, F.lit(unknown)) if unknown else day).alias("acq_day"), *(["cloud_conf", "shadow_conf"] if prompts else []))


def similar(tiles: DataFrame, seed: list[float], name: str, least: float = 55.0, k: int = 5, key: str = "base") -> DataFrame:
    """The k nearest by cosine at or above a score, the seed left out first."""
    score = F.lit(100.0) * vectors.dot(F.col("embedding"), literal(seed))
    return tiles.where(F.col(key) != name).withColumn("raw", score).where(F.col("raw") >= least).orderBy(F.desc("raw"), key).limit(k).select(key, F.round("raw", 6).alias("score"))


def fuse(tiles: DataFrame, key: str) -> DataFrame:
    """Mean of the unit vectors of a key's bands, at unit length again.

    One aggregate with a mean for each component: one row a key is shuffled, after partial sums.
    """
    some = tiles.where(F.col("embedding").isNotNull()).select(F.size("embedding").alias("n")).first()
    units = tiles.select(key, vectors.unit(F.col("embedding")).alias("u"))
    mean = units.groupBy(key).agg(*(F.avg(F.get("u", F.lit(i))).alias(f"_{i}") for i in range(some["n"] if some else 0)))
    return mean.select(key, vectors.unit(F.array(*(F.col(c) for c in mean.columns if c != key)).cast("array<double>")).alias("embedding"))


def ensemble(prompts: list[list[float]], positive: list[list[float]] = (), negative: list[list[float]] = (), weight: float = 0.15) -> Column:
    """Query vector from prompts and up to three confirmed and three rejected labels."""
    units = [vectors.unit(literal(p)) for p in [*prompts, *positive[:3]]]
    out = vectors.mean(units)
    if negative:
        out = vectors.add(out, vectors.mean([vectors.unit(literal(p)) for p in negative[:3]]), -weight)
    return vectors.unit(out)


def assign(tiles: DataFrame, centres: list[list[float]], key: str = "tile_id") -> DataFrame:
    """Each row's nearest of a few centres by inner product, the first of equals."""
    scores = F.array(*(vectors.dot(F.col("embedding"), literal(c)) for c in centres))
    return tiles.select(key, scores.alias("s")).select(key, (F.array_position("s", F.array_max("s")) - 1).cast("long").alias("cluster"))


def kmeans(tiles: DataFrame, k: int = 8, iterations: int = 25, seed: int = 42, key: str = "tile_id") -> DataFrame:
    """Spherical k-means; k is held to 1..rows, and no rows give no clusters."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    n = tiles.count()
    if not n:
        return tiles.select(key, F.lit(None).cast("int").alias("cluster"))
    data = tiles.select(key, array_to_vector(vectors.wide(F.col("embedding"))).alias("features"))
    if min(k, n) < 2:
        return tiles.select(key, F.lit(0).alias("cluster"))
    model = KMeans(k=min(k, n), distanceMeasure="cosine", seed=seed, maxIter=iterations).fit(data)
    return model.transform(data).select(key, F.col("prediction").alias("cluster"))


def mates(assigned: DataFrame, seed: int, key: str = "tile_id") -> DataFrame:
    """The other members of the seed's cluster."""
    own = assigned.where(F.col(key) == seed).select(F.col("cluster").alias("own")).limit(1)
    return assigned.join(F.broadcast(own), F.col("cluster") == F.col("own")).where(F.col(key) != seed).select(key, "cluster")


def preview(assigned: DataFrame, key: str = "tile_id", k: int = 8) -> DataFrame:
    """The first ``k`` members of each cluster by key, numbered from 1."""
    rn = F.row_number().over(W.partitionBy("cluster").orderBy(key))
    return assigned.withColumn("rn", rn).where(F.col("rn") <= k)
