"""A thin facade: the workflows of the engine over one catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text
from .functions.encoders import Encoder, HashedWords, encode
from .operators import catalog, change, kernels, quality, raster, review, search

# The wording of prompts, which the encoders' vectors depend on.
ASKED = ("{query}, {hints}, high-resolution satellite imagery", "satellite view of {query}")
LIKED, REFUSED = "satellite view of {label}, similar to confirmed sites", "satellite view of {label}"


class Engine:
    """``tiles``: path, tile_id, placename, layer, acq_date, min_lon, min_lat, embedding."""

    def __init__(self, spark: SparkSession, tiles: DataFrame, encoder: Encoder | None = None):
        self.spark, self.tiles, self.encoder = spark, tiles, encoder or HashedWords()

    def route(self, query: str, long: bool = False) -> tuple[list[str], str]:
        """Layers and prompt hints of a text query."""
        rules = (text.LONG_RULES, text.LONG_DEFAULT) if long else (text.SHORT_RULES, text.SHORT_DEFAULT)
        layers, hints = text.route(F.lit(query), *rules)
        row = self.spark.range(1).select(layers.alias("layers"), hints.alias("hints")).first()
        return row["layers"], row["hints"]

    def query_vector(self, query: str, hints: str, positive: list[str] = (), negative: list[str] = ()) -> list[float]:
        """Prompts of a query and of confirmed and rejected labels as one vector."""
        asked = [p.format(query=query, hints=hints) for p in ASKED]
        liked = [LIKED.format(label=p) for p in positive[:3]]
        refused = [REFUSED.format(label=n) for n in negative[:3]]
        vectors = [list(map(float, v)) for v in self.encoder([*asked, *liked, *refused])]
        a, b = len(asked), len(asked) + len(liked)
        return self.spark.range(1).select(search.ensemble(vectors[:a], vectors[a:b], vectors[b:]).alias("v")).first()["v"]

    def search_text(self, query: str, **options) -> DataFrame:
        layers, hints = self.route(query)
        return search.execute(self.tiles, self.query_vector(query, hints), layers=layers, **options)

    def search_image(self, name: str, k: int = 5, **options) -> DataFrame:
        """Tiles like a named one, in its layer, without itself."""
        seed = catalog.seed(self.tiles, name, "path").first()
        if seed is None:
            raise KeyError(name)
        found = search.execute(self.tiles, seed["embedding"], layers=[seed["layer"]], k=15, unknown=None, **options)
        return found.where(F.col("path") != seed["path"]).orderBy(F.desc("score"), "path").limit(k)

    def similar_sites(self, key: str, name, least: float = 55.0, k: int = 5) -> DataFrame:
        """Sites like a named one by the fused vectors of their bands."""
        fused = search.fuse(self.tiles, key)
        seed = fused.where(F.col(key) == name).first()
        if seed is None:
            raise KeyError(name)
        return search.similar(fused, seed["embedding"], name, least, k, key)

    def clusters(self, k: int = 8) -> DataFrame:
        return search.kmeans(self.tiles, k)

    def add(self, fresh: DataFrame, column: str) -> DataFrame:
        """The catalog with new paths encoded; known ones are not encoded again."""
        new = encode(catalog.missing(fresh, self.tiles, "path").dropDuplicates(["path"]), column, self.encoder)
        return self.tiles.unionByName(new, allowMissingColumns=True)


def quality_pipeline(pixels: DataFrame, height: int, width: int, likeness: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(manifest, cleaned chips): gates, the clearest frame of a date as reference, standardisation.

    Frames rank by clarity where ``likeness`` (tile_id, t, similarity to a clear
    view) is given, those missing in it last; else by sharpness.
    """
    pixels = raster.by_tile(pixels)
    gated = quality.verdict(quality.gates(pixels, height, width))
    sharp = quality.sharpness(pixels)
    passed = gated.where("status = 'passed'").join(sharp, ["tile_id", "t"])
    if likeness is not None:
        passed = passed.join(likeness.select("tile_id", "t", "similarity"), ["tile_id", "t"], "left")
        passed = passed.withColumn("score", quality.clarity(F.col("sharpness"), F.col("similarity")))
    best = quality.master_reference(passed, "t", "sharpness" if likeness is None else "score", "tile_id").select("tile_id", "t")
    references = kernels.to_chips(pixels.join(best, ["tile_id", "t"], "left_semi"))
    kept = pixels.join(passed.select("tile_id", "t"), ["tile_id", "t"], "left_semi")
    return gated, kernels.standardised_chips(kept, references)


def change_pipeline(pixels: DataFrame, strict: bool = True, width: int = 800, height: int = 800, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(events, legend, candidates) of all pairs of consecutive dates of every tile."""
    shapes = kernels.change_shapes(pixels, strict, **options)
    marks = shapes.where("is_global").withColumns({"type": F.col("category"), "confidence": F.lit(None).cast("double")})
    told = change.classify(change.keep(shapes.where("not is_global"), strict, width, height)).withColumn("confidence", change.confidence())
    events = told.unionByName(marks).withColumn("event_id", F.xxhash64("tile_id", "t_1", "category", "center_x", "center_y"))
    return events, change.legend(events), review.from_events(events.where("not is_global"))


__all__ = ["Engine", "change_pipeline", "quality_pipeline"]
