"""Pairs of chips that are equal are worked on once, and fast kernels give what plain loops give."""

import numpy as np
import pyarrow as pa
import pytest

from lodestone.operators import kernels as k


@pytest.mark.parametrize("strict", [False, True])
def test_equal_pairs_are_measured_once(monkeypatch, strict):
    rng = np.random.default_rng(8)
    one, two, three = (rng.integers(0, 256, (32, 32, 4)).astype(np.uint8).tobytes() for _ in range(3))
    rows = [{"tile_id": i, "t": 0, "t_2": 1, "height": 32, "width": 32, "data": one, "height_2": 32, "width_2": 32, "data_2": d} for i, d in enumerate([two, two, two, three, two])]
    calls, events = [], k.events
    monkeypatch.setattr(k, "events", lambda *a: calls.append(1) or events(*a))
    found = lambda rows: pa.Table.from_batches(k.pair_shapes([pa.RecordBatch.from_pylist(rows)], strict, 8, False)).to_pylist()
    together = found(rows)
    assert len(calls) == 3  # two, three and two again
    alone = [r for row in rows for r in found([row])]
    assert together == alone and {r["tile_id"] for r in alone} == {0, 1, 2, 3, 4}


@pytest.mark.parametrize("size", [1, 3, 7, 15])
def test_sliding_extremes_keep_to_the_type(size):
    a = np.random.default_rng(size).integers(0, 256, (19, 26)).astype(np.uint8)
    h = size // 2
    around = [[a[max(0, y - h) : y + h + 1, max(0, x - h) : x + h + 1] for x in range(26)] for y in range(19)]
    for largest in (False, True):
        got = k.box_extreme(a, size, largest)
        assert got.dtype == a.dtype and got.tolist() == [[int(p.max() if largest else p.min()) for p in row] for row in around]


def test_regions_join_arms_that_meet_late():
    m = np.array([[1, 0, 1, 0, 1], [1, 0, 1, 0, 0], [0, 1, 0, 0, 1]], np.uint8)
    assert sorted(len(r) for r in k.regions(m)) == [1, 1, 5]
