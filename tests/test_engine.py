"""The facade, and chip kernels against the pixel layout."""

import numpy as np
from pyspark.sql import functions as F

from lodestone.engine import Engine, change_pipeline, quality_pipeline
from lodestone.functions.encoders import ChipColours, HashedWords, encode
from lodestone.operators import kernels, raster
from lodestone.plans import queries
from lodestone.sources.views import view

SF = "/root/testdata/sf0.001"


def planes(rows, size):
    out = np.zeros((size, size, 3), np.uint8)
    for r in rows:
        out[r["y"], r["x"]] = r["r"], r["g"], r["b"]
    return out


def test_chips_equal_pixels(spark):
    pixels = view(spark, SF, "pixels").where("tile_id = 3 and t = 1")
    chip = planes(pixels.collect(), 32)
    assert np.array_equal(kernels.dehaze(chip), planes(raster.dehaze(pixels).collect(), 32))
    assert np.array_equal(kernels.enhance(chip), planes(raster.enhance(pixels).collect(), 32))


def test_matching_equals_pixels(spark):
    pixels = view(spark, SF, "pixels").where("tile_id = 3")
    one, two = (planes(pixels.where(F.col("t") == t).collect(), 32) for t in (0, 1))
    told = {r["v"]: r["matched"] for r in raster.match_histogram(pixels, "r").collect()}
    matched = kernels.match_histogram(two, one)[:, :, 0]
    assert all(abs(told[int(v)] - int(m)) <= 1 for v, m in zip(two[:, :, 0].ravel(), matched.ravel()))


def test_quality_pipeline(spark):
    manifest, clean = quality_pipeline(view(spark, SF, "pixels"), 32, 32)
    passed = {(r["tile_id"], r["t"]) for r in manifest.where("status = 'passed'").collect()}
    assert {(r["tile_id"], r["t"]) for r in clean.collect()} == passed and passed


def test_quality_pipeline_ranks_by_clarity(spark):
    pixels = view(spark, SF, "pixels").where("tile_id < 4")

    def cleaned(liked):
        likeness = spark.createDataFrame([(i, t, 1e6 if i == liked else 0.0) for i in range(4) for t in (0, 1)], "tile_id long, t int, similarity double")
        return {(r["tile_id"], r["t"]): tuple(r) for r in quality_pipeline(pixels, 32, 32, likeness)[1].collect()}

    one, other = cleaned(1), cleaned(2)
    assert set(one) == set(other) and (1, 0) in one and one != other


def test_change_pipeline(spark):
    events, legend, candidates = change_pipeline(view(spark, SF, "pixels"), strict=False, width=256, height=256, **queries.LARGE)
    rows = events.collect()
    assert sum(r["count"] for r in legend.collect()) == len(rows)
    assert candidates.count() == sum(not r["is_global"] for r in rows) > 0


def test_engine(spark):
    tiles = queries._tiles(spark, SF)
    e = Engine(spark, tiles, HashedWords(64))
    assert e.route("new urban road")[0] == ["false_color_nir", "true_color"]
    assert e.route("stadium")[0] == ["true_color"]
    vector = e.query_vector("urban road", "hint", ["dam"], ["cloud"])
    assert abs(sum(x * x for x in vector) - 1) < 1e-9
    assert e.search_text("urban road", k=3, least=-100.0).count() == 3
    first = tiles.where("tile_id = 9").first()["path"]
    assert first not in {r["path"] for r in e.search_image(first).collect()}
    fresh = spark.createDataFrame([("new/a", "text"), (first, "known"), ("new/a", "again")], "path string, caption string")
    assert e.add(fresh, "caption").count() == tiles.count() + 1


def test_encoders(spark):
    df = spark.createDataFrame([("a b",), (None,), ("",)], "s string")
    rows = encode(df, "s", HashedWords(8)).collect()
    assert abs(sum(x * x for x in rows[0]["embedding"]) - 1) < 1e-6 and not any(rows[1]["embedding"])
    assert ChipColours()([bytes(range(48))]).shape == (1, 64)


def test_all_consecutive_pairs(spark):
    pixels = view(spark, SF, "pixels").where("tile_id < 3")
    more = pixels.withColumn("t", F.col("t") + 5).unionByName(pixels)  # dates 0, 1, 5, 6
    found = kernels.change_shapes(more, strict=False, **queries.LARGE).collect()
    key = lambda t: sorted((r["tile_id"], r["category"], r["area"]) for r in found if (r["t_1"], r["t_2"]) == t)
    assert {(r["t_1"], r["t_2"]) for r in found} <= {(0, 1), (1, 5), (5, 6)} and key((0, 1)) == key((5, 6)) != []
    alone = kernels.change_shapes(pixels, strict=False, **queries.LARGE).collect()
    assert sorted((r["tile_id"], r["category"], r["area"]) for r in alone) == key((0, 1))


def test_first_dates(spark):
    rng = np.random.default_rng(2)
    old, new = rng.integers(0, 256, (2, 24, 24))
    rows = [(tile, t, y, x, int((new if t >= since else old)[y, x])) for tile, since, n in ((1, 2, 4), (2, 9, 3), (3, 1, 2), (4, 0, 1)) for t in range(n) for y in range(24) for x in range(24)]
    pixels = spark.createDataFrame(rows, "tile_id long, t int, y int, x int, r int").withColumns({"g": F.col("r"), "b": F.col("r")})
    events = spark.createDataFrame([(i, 12, 12, False) for i in (1, 2, 3, 4)] + [(1, 0, 0, True)], "tile_id long, center_x int, center_y int, is_global boolean")
    got = {r["tile_id"]: r["first_t"] for r in kernels.first_dates(pixels, events, around=10).collect()}
    assert got == {1: 1, 2: 1, 3: 0, 4: None}  # unlike up to date 1; never unlike; two dates; one
