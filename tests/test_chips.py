"""Chips come whole out of pixels in any order, and change queries exchange blocks of pixels, not single ones."""

import random

import numpy as np
import pytest

from lodestone.operators import kernels
from lodestone.plans import registry

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")


@pytest.mark.parametrize("channels", [1, 4, 7])
def test_chips_from_pixels_in_any_order(spark, channels):
    rng, names = np.random.default_rng(channels), [f"c{i}" for i in range(channels)]
    told = {(7, 0): (70, 130), (7, 1): (64, 64), (None, 1): (2, 3), (8, 5): (1, 65)}
    chips = {k: rng.integers(0, 256, (*size, channels)) for k, size in told.items()}
    rows = [(*k, y, x, *map(int, a[y, x])) for k, a in chips.items() for y in range(a.shape[0]) for x in range(a.shape[1])]
    # A missing pixel and a null are 0, a number over 255 wraps; the chip's last pixel stays.
    rows = [r if r[2:4] != (0, 1) else (*r[:4], None, *r[5:]) for r in rows if r[2:4] != (0, 0)]
    rows = [r if r[2:4] != (0, 2) else (*r[:4], r[4] + 512, *r[5:]) for r in rows]
    for a in chips.values():
        a[0, 0] = 0
        a[0, 1, 0] = 0
    random.Random(5).shuffle(rows)
    pixels = spark.createDataFrame(rows, "tile_id long, t int, y long, x long, " + ", ".join(f"{c} int" for c in names)).repartition(3)
    got = kernels.to_chips(pixels, tuple(names)).collect()
    assert len(got) == len(chips)
    for r in got:
        a = chips[r["tile_id"], r["t"]]
        assert (r["height"], r["width"]) == a.shape[:2] and bytes(r["data"]) == a.astype(np.uint8).tobytes()


def test_no_chips(spark):
    assert kernels.to_chips(spark.createDataFrame([], "tile_id long, t int, y int, x int, r int, g int, b int")).collect() == []


@pytest.mark.parametrize("name", ["change_events", "change_events_strict", "change_timeline"])
def test_pixels_are_gathered_before_an_exchange(spark, name):
    lines = plan(registry.QUERIES[name](spark, SF)).splitlines()
    made = max(i for i, line in enumerate(lines) if "BroadcastNestedLoopJoin BuildRight" in line and "BroadcastNestedLoopJoin" not in lines[i - 1])
    above = [line for line in lines[:made] if "Exchange" in line or "partial_collect_list" in line]
    assert "partial_collect_list" in above[-1]  # what pixels meet first
    assert any("REPARTITION_BY_NUM" in line for line in lines[made:])  # tiles are dealt out before they make pixels


def test_timeline_is_sorted_after_an_exchange(spark):
    lines = plan(registry.QUERIES["change_timeline"](spark, SF)).splitlines()
    sort, shapes = (next(i for i, line in enumerate(lines) if word in line) for word in ("Exchange rangepartitioning", "MapInArrow"))
    assert any("REPARTITION_BY_COL" in line for line in lines[sort:shapes])  # sampling for the sort reads that, shapes are measured once
