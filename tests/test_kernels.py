"""Shapes, masks and filters against values worked out by hand."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.operators import kernels as k


def filled(h, w, y, x, hh, ww):
    m = np.zeros((h, w), np.uint8)
    m[y : y + hh, x : x + ww] = 1
    return m


def test_rectangle():
    (s,) = k.shapes(filled(200, 200, 60, 50, 31, 41), "Flooding")
    assert (s.area, s.box, s.centre) == (1200.0, (50, 60, 41, 31), (70, 75))
    assert s.solidity == pytest.approx(1)
    assert s.aspect == pytest.approx(40 / 30, rel=1e-4)
    assert len(s.contour) == 4


def test_bar():
    (s,) = k.shapes(filled(200, 200, 90, 40, 7, 121), "Construction")
    assert s.area == 720
    assert s.aspect == pytest.approx(20, rel=1e-3)
    assert s.compactness == pytest.approx(4 * np.pi * 720 / 252**2, rel=1e-6)
    assert s.is_linear


def test_global_marker():
    (s,) = k.shapes(filled(100, 100, 0, 0, 50, 50), "Land Clearance", skip=True)
    assert s.is_global and s.contour is None


def test_diagonal_pixels_are_one_region():
    assert len(k.regions(np.eye(6, dtype=np.uint8))) == 1
    two = np.zeros((5, 9), np.uint8)
    two[1, 1] = two[3, 6] = 1
    assert len(k.regions(two)) == 2


def test_outline_of_single_pixel():
    assert len(k.outline(np.array([[3, 4]]))) == 1


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 2**32 - 1), st.sampled_from([3, 5, 9]))
def test_morphology(seed, size):
    m = (np.random.default_rng(seed).random((17, 23)) < 0.4).astype(np.uint8)
    low, high = k.box_extreme(m, size, False), k.box_extreme(m, size, True)
    assert (low <= m).all() and (m <= high).all()
    assert (k.opening(k.opening(m, size), size) == k.opening(m, size)).all()
    assert (k.closing(k.closing(m, size), size) == k.closing(m, size)).all()


def test_identical_pair_has_no_change():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 256, (64, 64)).astype(np.uint8)
    assert not k.structure_change(a, a).any()
    assert k.similarity(a, a) == pytest.approx(np.ones((64, 64)))


def test_water_masks_are_apart():
    rng = np.random.default_rng(4)
    chip = {f"{c}_{t}": rng.integers(0, 256, (48, 48)) for c in ("r", "g", "b", "nir") for t in (1, 2)}
    found = k.masks(chip, strict=False)
    assert not (found["Flooding"] & found["Water Receded"]).any()
    assert not (found["Land Clearance"] & found["Construction"]).any()


def test_align_finds_a_shift():
    a = np.random.default_rng(5).random((32, 32))
    back = k.align(a, np.roll(a, (3, -5), (0, 1)))
    assert np.array_equal(back[:29, 5:], a[:29, 5:]) and not back[29:].any() and not back[:, :5].any()


def test_otsu_splits_two_levels():
    v = np.array([[10] * 8, [200] * 8], np.uint8)
    assert k.otsu_cut(v) == 10


def test_resize_keeps_constants_and_ends():
    a = np.arange(12, dtype=np.uint8).reshape(3, 4) * 10
    assert np.array_equal(k.resize(a, 3, 4), a) and (k.resize(np.full((5, 7), 9, np.uint8), 3, 11) == 9).all()
    assert k.resize(a, 6, 8)[0, 0] == 0 and k.resize(a, 6, 8)[-1, -1] == 110


def test_small_patches_have_no_similarity():
    a = np.random.default_rng(1).integers(0, 256, (9, 9)).astype(float)
    assert k.patch_similarity(a, a) == pytest.approx(1) and k.patch_similarity(a[:5], a[:5]) is None
