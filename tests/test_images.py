import numpy as np
import pytest
from helpers import flood_labels, frame, images, labels, movie, place_set, positions, raster, true_set, voxels

from fluoroframe.operators import coloc, components as co, filters as fi, projection as pr, segment as sg, threshold as th
from fluoroframe.sources import tiles as ti

RNG = np.random.default_rng(3)


def blank(n=40):
    return np.zeros((n, n))


def pair(spark, a, b):
    return voxels(spark, a, "a").unionByName(voxels(spark, b, "b"))


def test_manders_overlap_disjoint_and_mask(spark):
    a, b = blank(), blank()
    a[10:30, 10:30], b[10:30, 10:30] = 1000, 800
    r = coloc.manders(pair(spark, a, b), "a", "b", None, 10, 10).first()
    assert (r.M1, r.M2, r.n_pixels) == (1, 1, 1600)
    a, b = blank(), blank()
    a[5:15, 5:15], b[25:35, 25:35] = 1000, 800
    r = coloc.manders(pair(spark, a, b), "a", "b").first()
    assert (r.M1, r.M2) == (0, 0)
    dark = coloc.manders(pair(spark, blank(), blank()), "a", "b", None, "zero", "zero").first()
    assert (dark.M1, dark.M2) == (0, 0)
    with pytest.raises(ValueError):
        coloc.manders(pair(spark, a, b), "a", "b", None, "yen")


def test_pearson_ramp_constant_and_single_pixel(spark):
    ramp = np.tile(np.arange(64.0), (64, 1))
    m = np.zeros((64, 64), int)
    m[20:40, 20:40] = 1
    r = coloc.pearson(pair(spark, ramp, ramp), "a", "b", labels(spark, m)).first()
    assert r.r == pytest.approx(1) and r.n_pixels == 400
    assert coloc.pearson(pair(spark, ramp, blank(64)), "a", "b").first().r == 0
    one = np.zeros((64, 64), int)
    one[0, 0] = 1
    assert coloc.pearson(pair(spark, ramp, ramp), "a", "b", labels(spark, one)).first().r == 0


def test_channels_of_different_shape_fail(spark):
    vox = voxels(spark, blank(4), "a").unionByName(voxels(spark, blank(5), "b"))
    with pytest.raises(Exception, match="shape mismatch"):
        coloc.pearson(vox, "a", "b").collect()


def otsu_by_hand(v, n=256):
    h, e = np.histogram(v, n)
    c = (e[:-1] + e[1:]) / 2
    w1, w2 = np.cumsum(h), np.cumsum(h[::-1])[::-1]
    m1, m2 = np.cumsum(h * c) / w1, (np.cumsum((h * c)[::-1]) / w2[::-1])[::-1]
    return c[np.argmax(w1[:-1] * w2[1:] * (m1[:-1] - m2[1:]) ** 2)]


def test_thresholds(spark):
    v = np.concatenate([RNG.normal(10, 2, 700), RNG.normal(40, 3, 200)]).reshape(30, 30)
    got = th.otsu(voxels(spark, v)).first().threshold
    assert got == pytest.approx(otsu_by_hand(v.ravel()))
    flat = voxels(spark, np.full((5, 5), 7.0))
    for f in (th.otsu, th.yen, th.triangle):
        assert f(flat).first().threshold == 7.0
    assert th.otsu(voxels(spark, np.array([[0, 0, 0, 9, 9, 10]])), "integer").first().threshold == 0
    assert th.resolve_threshold(flat, "3.5").first().threshold == 3.5
    with pytest.raises(ValueError):
        th.resolve_threshold(flat, "median")


def test_percentiles_skip_what_is_not_finite(spark):
    v = RNG.normal(size=(12, 12))
    w = v.copy()
    w[0, 0] = np.inf
    r = th.percentiles(voxels(spark, w), {"lo": 0.01, "hi": 0.995}).first()
    assert np.allclose([r.lo, r.hi], np.percentile(w[np.isfinite(w)], [1, 99.5]))


def test_projections_equal_numpy(spark):
    v = RNG.integers(0, 1000, (8, 12, 10)).astype(float)
    vox = voxels(spark, v)
    top = frame(pr.max_projection(vox, "z"))
    assert all(v.max(0)[r.y, r.x] == r.v for r in top.itertuples()) and len(top) == 120
    side = frame(pr.orthogonal_views(vox))
    xz, yz = side[side["view"] == "XZ"], side[side["view"] == "YZ"]
    assert all(v.max(1)[r.z, r.u] == r.v for r in xz.itertuples()) and len(xz) == 80
    assert all(v.max(2)[r.z, r.u] == r.v for r in yz.itertuples()) and len(yz) == 96
    with pytest.raises(ValueError):
        pr.max_projection(vox, "c")


def test_tiles_round_trip_and_axis_names(spark):
    v = RNG.random((3, 11, 13)).astype(np.float32)
    back = ti.voxels_from_tiles(ti.tiles_from_voxels(voxels(spark, v), 4, 5))
    assert np.array_equal(raster(back, v.shape), v)
    assert ti.axis_column("z", "TZYX") == "z" and ti.axis_column(-1, "TCZYX") == "x"
    for bad in ("q", 7):
        with pytest.raises(ValueError):
            ti.axis_column(bad, "TZYX")


def test_layer_operators(spark):
    frames = [np.full((4, 5), float(i)) for i in range(3)]
    vox, img = movie(spark, frames), images(spark, (4, 5), frames=3)
    assert {r.v for r in ti.extract_timepoint(vox, 2, img).collect()} == {2.0}
    with pytest.raises(ValueError, match="out of range"):
        ti.extract_timepoint(vox, 3, img)
    spots = vox.withColumnRenamed("t", "position")
    assert ti.select_position(spots, 1).count() == 20 and ti.position_warnings(spots).first().n_positions == 3
    with pytest.raises(ValueError, match="out of range"):
        ti.select_position(spots, 3)
    cat = ti.layer_catalog(vox, img).first()
    assert (cat.n_t, cat.n_y, cat.n_x) == (3, 4, 5)
    s = ti.layer_summary(vox).first()
    assert (s.min, s.max, s.mean) == (0.0, 2.0, 1.0)
    assert ti.labels_summary(labels(spark, np.array([[1, 0], [0, 9]])), images(spark, (2, 2))).first().n_labels == 9


def test_binary_mask_guards_continuous_images(spark):
    assert ti.binary_mask(voxels(spark, np.array([[0, 1], [1, 0]]))).count() == 2
    assert ti.binary_mask(voxels(spark, np.array([[0.2, 0.9]])), 0.5).count() == 1
    with pytest.raises(Exception, match="binary"):
        ti.binary_mask(voxels(spark, np.array([[0.2, 0.9]]))).collect()


@pytest.mark.parametrize("box", [(16, 256, 256), (2, 8, 8)])
def test_components_in_plane_and_volume(spark, box):
    for m, ndim in ((RNG.random((30, 34)) < 0.55, 2), (RNG.random((4, 17, 15)) < 0.3, 3)):
        ref = volume_labels(m)
        got = co.label_components(positions(spark, m), ndim, box=box).collect()
        assert len(got) == m.sum() and all(ref[r.z, r.y, r.x] == r.label for r in got)


def volume_labels(m):
    out = flood_labels(m)
    return out[None] if out.ndim == 2 else out


def test_fill_remove_keep(spark):
    m = RNG.random((26, 24)) < 0.6
    img, box = images(spark, m.shape), (1, 9, 9)
    bg = flood_labels(~m)
    rim = set(bg[0]) | set(bg[-1]) | set(bg[:, 0]) | set(bg[:, -1])
    assert place_set(co.fill_holes(positions(spark, m), img, box=box)) == true_set(m | ((bg > 0) & ~np.isin(bg, list(rim))))
    lab = flood_labels(m)
    n = np.bincount(lab.ravel())
    assert place_set(co.remove_small(positions(spark, m), 5, box=box)) == true_set((lab > 0) & (n[lab] >= 5))
    n[0] = 0
    assert place_set(co.keep_largest(positions(spark, m), box=box)) == true_set(lab == n.argmax())


def test_outline_of_touching_and_lone_objects(spark):
    lab = np.zeros((7, 8), int)
    lab[2:5, 2:4], lab[2:5, 4:6] = 1, 2
    got = place_set(co.label_outline(labels(spark, lab), images(spark, lab.shape)))
    want = {(0, y, x) for y in range(2, 5) for x in (3, 4)}  # the border between the two objects
    want |= {(0, y, x) for y in (1, 5) for x in range(2, 6)} | {(0, y, x) for y in range(2, 5) for x in (1, 6)}
    assert got == want


def separable(a, g, axes, mode):
    r = len(g) // 2
    for ax in axes:
        p = np.pad(a, [(r, r) if i == ax else (0, 0) for i in range(3)], mode=mode)
        a = sum(g[k] * np.take(p, range(k, k + a.shape[ax]), ax) for k in range(2 * r + 1))
    return a


def test_filters_do_not_depend_on_tiles(spark):
    a = np.round(RNG.random((2, 30, 27)) * 100)
    img = images(spark, a.shape)
    small, large = (ti.tiles_from_voxels(voxels(spark, a), s, s).cache() for s in (11, 64))
    g = fi.gauss_weights(1.0)
    for t in (small, large):
        assert np.allclose(raster(ti.voxels_from_tiles(fi.gaussian(t, img)), a.shape), separable(a, g, (1, 2), "edge"), atol=1e-4)
    whole = images(spark, a.shape, dtype="uint16")
    assert np.allclose(raster(ti.voxels_from_tiles(fi.gaussian(small, whole)), a.shape), np.trunc(separable(a, g, (1, 2), "edge")))
    assert np.allclose(raster(ti.voxels_from_tiles(fi.gaussian(small, img, 1.0, 3)), a.shape), separable(a, g, (0, 1, 2), "edge"), atol=1e-4)
    r = 5
    p = np.pad(a, [(0, 0), (r, r), (r, r)], constant_values=np.inf)
    base = np.full(a.shape, np.inf)
    for dy in range(-r, r + 1):
        for dx in range(-r, r + 1):
            if dy * dy + dx * dx <= r * r:
                base = np.minimum(base, p[:, r + dy : r + dy + 30, r + dx : r + dx + 27] + r - (r * r - dy * dy - dx * dx) ** 0.5)
    for t in (small, large):
        assert np.allclose(raster(ti.voxels_from_tiles(fi.rolling_ball(t, img, r)), a.shape), a - base, atol=1e-4)
    want = true_set(a > separable(a, fi.gauss_weights(26 / 6), (1, 2), "symmetric"))
    assert place_set(fi.local_threshold(small, img)) == want == place_set(fi.local_threshold(large, img))
    for how in ("sato", "frangi", "gaussian"):
        one, two = (raster(ti.voxels_from_tiles(fi.enhance_processes(t, img, how, 1.0, None)), a.shape) for t in (small, large))
        assert np.allclose(one, two, atol=1e-6) and one.min() >= 0 and one.max() <= 1
    with pytest.raises(ValueError):
        fi.enhance_processes(small, img, "sobel")


def test_ridge_filters_prefer_the_line(spark):
    a = np.zeros((1, 25, 25))
    a[0, 12] = 10
    img, t = images(spark, a.shape), ti.tiles_from_voxels(voxels(spark, a))
    for how in ("sato", "frangi"):
        out = raster(ti.voxels_from_tiles(fi.enhance_processes(t, img, how, 1.0, None, False)), a.shape)[0]
        assert out[12, 12] == out.max() > out[8, 12] + 1e-3


def test_auto_contrast(spark):
    v = RNG.random((9, 9)) * 50
    lo, hi = np.percentile(v, (1, 99))
    got = raster(fi.auto_contrast(voxels(spark, v)), (1, 9, 9))[0]
    assert np.allclose(got, np.clip((v - lo) / (hi - lo), 0, 1), atol=1e-6)
    assert set(raster(fi.auto_contrast(voxels(spark, np.full((3, 3), 5.0))), (1, 3, 3)).ravel()) == {1.0}


def test_segmentation_chain_and_model(spark):
    v = np.zeros((20, 20))
    v[2:9, 2:9], v[12:14, 12:14], v[5, 5] = 9, 9, 0
    img = images(spark, v.shape)
    lab, qc = sg.segment_processes(voxels(spark, v), img, "otsu", 5, True, False)
    assert place_set(lab) == {(0, y, x) for y in range(2, 9) for x in range(2, 9)}
    row = qc.first()
    assert (row.status, row.component_count, row.foreground_fraction) == ("pass", 1, 49 / 400)
    none = sg.segment_processes(voxels(spark, v), img, 50)[1].first()
    assert none.status == "fail" and len(none.warnings) == 2
    tiles = ti.tiles_from_voxels(voxels(spark, v), 6, 6)
    got, rows = sg.segment_with_model(tiles, img, lambda a: flood_labels(a > 0))
    ref = flood_labels(v > 0)
    assert {(r.y, r.x): r.label for r in got.collect()} == {(int(y), int(x)): ref[y, x] for y, x in zip(*np.nonzero(ref))}
    assert rows.first().n_objects == 2
    with pytest.raises(Exception, match="time series refused"):
        sg.segment_with_model(tiles, images(spark, v.shape, frames=2), lambda a: a > 0)[0].collect()


def test_label_qc_counts_unused_ids(spark):
    lab = np.zeros((4, 4), int)
    lab[0], lab[1, :2] = 1, 4
    r = sg.label_qc(labels(spark, lab)).first()
    assert (r.n_objects, r.object_area_min, r.object_area_median, r.object_area_max) == (4, 0, 1.0, 4)
