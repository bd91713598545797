"""Planted shifts are found exactly, over many tiles and frames, and corrected layers are the moved images."""

import numpy as np
import pytest
from helpers import movie, raster

from fluoroframe.operators import drift
from fluoroframe.sources.tiles import tiles_from_voxels, voxels_from_tiles

SHIFTS = [(0, 0), (3, -2), (-4, 5), (1, 7)]


def moved(a, dy, dx):
    out = np.zeros_like(a)
    h, w = a.shape
    ys, xs = slice(max(0, dy), min(h, h + dy)), slice(max(0, dx), min(w, w + dx))
    out[ys, xs] = a[slice(max(0, -dy), min(h, h - dy)), slice(max(0, -dx), min(w, w - dx))]
    return out


@pytest.fixture(scope="module")
def tiles(spark):
    image = np.random.default_rng(3).random((70, 54)).astype(np.float32).astype(float)
    return image, tiles_from_voxels(movie(spark, [moved(image, *s) for s in SHIFTS]), 16, 16).persist()


@pytest.mark.parametrize("against, neighbours", [("reference", 8), ("reference", 2), ("previous", 2)])
def test_planted_shifts(tiles, monkeypatch, against, neighbours):
    monkeypatch.setattr(drift, "NEIGHBOURS", neighbours)
    got = {r.t: r for r in drift.estimate_drift(tiles[1], "g", 0, against).collect()}
    want = SHIFTS if against == "reference" else SHIFTS[:2]
    for t, (dy, dx) in enumerate(want):
        assert (got[t].dy, got[t].dx) == (-dy, -dx)
    assert got[0].score > 0.9 if against == "reference" else got[0].score == 0


def test_other_reference_frame(tiles):
    got = {r.t: (r.dy, r.dx) for r in drift.estimate_drift(tiles[1], "g", 1).collect()}
    assert got[0] == (3, -2) and got[1] == (0, 0) and got[3] == (2, -9 + 16 * (-9 < -8))


def test_corrected_layer(spark, tiles):
    image, table = tiles
    shifts = spark.createDataFrame([("a", t, -dy, -dx, "x") for t, (dy, dx) in enumerate(SHIFTS[:3])], "image_id string, t int, dy int, dx int, channel string")
    out = drift.apply_drift_correction(table, shifts, fill=-1)
    assert {r.channel for r in out.select("channel").distinct().collect()} == {"g_corrected"}
    back = voxels_from_tiles(out)
    for t, (dy, dx) in enumerate(SHIFTS):
        got = raster(back.where(f"t = {t}"), (1, 70, 54))[0]
        if t == 3:  # no shift given
            want = moved(image, dy, dx)
        else:
            want = np.full(image.shape, -1.0)
            ys, xs = slice(max(0, -dy), min(70, 70 - dy)), slice(max(0, -dx), min(54, 54 - dx))
            want[ys, xs] = moved(moved(image, dy, dx), -dy, -dx)[ys, xs]
        assert np.array_equal(got, want)


def test_blank_and_missing_frames(spark):
    blank = tiles_from_voxels(movie(spark, [np.ones((8, 8)), np.zeros((8, 8))]), 4, 4)
    assert {(r.t, r.dy, r.dx, r.score) for r in drift.estimate_drift(blank, "g").collect()} == {(0, 0, 0, 0.0), (1, 0, 0, 0.0)}
    assert {(r.dy, r.score) for r in drift.estimate_drift(blank, "g", 7).collect()} == {(0, 0.0)}
    assert drift.estimate_drift(blank, "none").count() == 0
