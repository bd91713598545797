"""Shape descriptors against plain loops over the pixels of each object."""

import numpy as np
import pytest
from helpers import images, labels

from fluoroframe.operators import morphology


def naive(lab, k):
    m = np.pad(lab == k, 3)
    inner = m & np.roll(m, 1, 0) & np.roll(m, -1, 0) & np.roll(m, 1, 1) & np.roll(m, -1, 1)
    edge = m & ~inner
    perimeter = 0.0
    for y, x in zip(*np.nonzero(edge)):
        code = 1 + sum((2 if dy * dx == 0 else 10) * edge[y + dy, x + dx] for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx)
        perimeter += 1 if code in (5, 7, 15, 17, 25, 27) else 2**0.5 if code in (21, 33) else (1 + 2**0.5) / 2 if code in (13, 23) else 0
    p = np.argwhere(lab == k).astype(float)
    c = np.cov(p.T, bias=True) if len(p) > 1 else np.zeros((2, 2))
    l2, l1 = np.maximum(np.linalg.eigvalsh(c), 0)
    sides = np.concatenate([p + d for d in ((0.5, 0), (-0.5, 0), (0, 0.5), (0, -0.5))])
    # a pixel is in the hull if no line through two of the points has all points on one side and the pixel on the other
    inside = np.ones(lab.shape, bool)
    yy, xx = np.indices(lab.shape)
    for i, a in enumerate(sides):
        d = sides - a
        cross = d[:, None, 0] * d[None, :, 1] - d[:, None, 1] * d[None, :, 0]
        for j in np.nonzero((cross >= -1e-9).all(1) & (np.abs(d).sum(1) > 0))[0]:
            inside &= d[j, 0] * (xx - a[1]) - d[j, 1] * (yy - a[0]) >= -1e-9
    box = (p.max(0) - p.min(0) + 1).prod()
    return dict(
        area=len(p), perimeter=perimeter, extent=len(p) / box, axis_major_length=4 * l1**0.5, axis_minor_length=4 * l2**0.5,
        eccentricity=(1 - l2 / l1) ** 0.5 if l1 > 0 else 0, convex_area=inside.sum(), solidity=len(p) / inside.sum(),
    )


def shapes(seed):
    rng = np.random.default_rng(seed)
    lab = np.zeros((30, 34), int)
    yy, xx = np.indices(lab.shape)
    lab[(yy - 8) ** 2 + (xx - 9) ** 2 <= 40] = 1
    lab[18:27, 3:20] = np.where(rng.random((9, 17)) < 0.6, 2, 0)
    lab[2, 30] = 3
    lab[10:16, 25:26] = 4
    lab[20:29, 22:33][np.tril(np.ones((9, 11), bool))] = 5
    lab[9, 8] = 6
    return lab


@pytest.mark.parametrize("box", [(1, 512, 512), (1, 4, 3), (1, 1, 1)])
def test_shapes_in_blocks_of_any_size(spark, monkeypatch, box):
    monkeypatch.setitem(morphology.BOX, 2, box)
    lab = shapes(1)
    got = morphology.measure_morphology(labels(spark, lab), images(spark, lab.shape, (1, 0.5, 0.5)))
    rows = {r.label: r for r in got.collect()}
    assert sorted(rows) == [1, 2, 3, 4, 5, 6]
    for k, r in rows.items():
        for name, value in naive(lab, k).items():
            assert r[name] == pytest.approx(value, abs=1e-9), (k, name)
        assert r.area_um2 == pytest.approx(r.area * 0.25) and r.perimeter_um == pytest.approx(r.perimeter * 0.5)
    assert rows[3].circularity is None and rows[3].eccentricity == 0 and rows[4].axis_minor_length == 0
    assert rows[4].faces_y == 2 and rows[4].faces_x == 12 and rows[4].boundary_um == pytest.approx(7.0)


def test_volumes(spark, monkeypatch):
    monkeypatch.setitem(morphology.BOX, 3, (2, 3, 4))
    lab = np.zeros((5, 8, 9), int)
    lab[1:4, 1:6, 2:9] = 1
    lab[0, 0, 0] = 2
    rows = {r.label: r for r in morphology.measure_morphology(labels(spark, lab), images(spark, lab.shape, (2, 1, 0.5), axes="ZYX"), 3).collect()}
    box = rows[1]
    assert (box.area, box.extent, box["bbox-0"], box["bbox-5"]) == (105, 1.0, 1, 9)
    assert (box.faces_z, box.faces_y, box.faces_x) == (70, 42, 30)
    assert box.surface_um2 == pytest.approx(70 * 0.5 + 42 * 1.0 + 30 * 2.0)
    c = np.cov(np.argwhere(lab == 1).T, bias=True)
    ev = np.linalg.eigvalsh(c)[::-1]
    assert box.axis_major_length == pytest.approx((10 * (ev[0] + ev[1] - ev[2])) ** 0.5)
    assert rows[2].axis_major_length == 0


def test_frames_and_planes_stay_apart_and_sums_are_exact(spark):
    far = 2_000_000
    rows = [("a", t, z, far + y, far + x, 7) for t in (0, 1) for z in (0, 3) for y in range(3) for x in range(2 + t)]
    table = spark.createDataFrame(rows + [("a", 0, 0, 1, 1, 0)], "image_id string, t int, z int, y int, x int, label int")
    got = sorted((r.t, r.z, r.area, r["centroid-1"], r.axis_minor_length) for r in morphology.measure_morphology(table).collect())
    assert [g[:3] for g in got] == [(0, 0, 6), (0, 3, 6), (1, 0, 9), (1, 3, 9)]
    assert got[0][3] == far + 0.5 and got[0][4] == pytest.approx(2.0)
    assert morphology.measure_morphology(table.limit(0)).count() == 0
