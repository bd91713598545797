"""Integer thresholds, whole-number label tiles, position limits and shape checks."""

import numpy as np
import pytest
from helpers import images, labels, movie, voxels

from fluoroframe.operators import components, measure, segment, threshold
from fluoroframe.sources.tiles import apply_mask, label_tiles, tiles_from_voxels


def test_integer_images_have_grey_levels(spark):
    a = np.array([[0, 0, 0, 9, 9, 10]])
    vox = voxels(spark, a, image="i").unionByName(voxels(spark, a, image="f"))
    facts = images(spark, a.shape, image="i", dtype="uint16").unionByName(images(spark, a.shape, image="f"))
    got = {r.image_id: r.threshold for r in threshold.otsu(vox, images=facts).collect()}
    assert got["i"] == 0 and 0 < got["f"] < 1
    wide = np.array([[0, 0, 5, 2_000_000_000]])
    assert threshold.otsu(voxels(spark, wide), images=images(spark, wide.shape, dtype="int32")).first().threshold == 5


def test_triangle_on_sparse_levels(spark):
    a = np.array([[3] * 40 + [4] * 20 + [9] * 6 + [30] * 2 + [90]])
    levels, heights = np.arange(3, 91), np.bincount(a[0], minlength=91)[3:]
    run = 87 - 0  # the peak is the first level, so the tail is on its right
    norm = np.hypot(heights.max(), run)
    x = 90 - levels
    score = heights.max() / norm * x - run / norm * heights
    score[x >= run] = -np.inf
    best = levels[np.nonzero(score == score.max())[0][-1]]
    assert threshold.triangle(voxels(spark, a), "integer").first().threshold == best


def test_infinite_voxels_are_above_every_threshold(spark):
    vox = voxels(spark, np.array([[1.0, 5.0, np.inf, -np.inf, np.nan]]))
    mask, _ = segment.threshold_mask(vox, images(spark, (1, 5)), 2.0)
    assert sorted(r.x for r in mask.collect()) == [1, 2]


def test_labels_beyond_floats_stay_apart(spark):
    lab = np.zeros((5, 7), int)
    lab[0, 1], lab[4, 6], lab[2, 3] = 16777216, 16777217, 3
    facts = images(spark, lab.shape)
    tiles = tiles_from_voxels(voxels(spark, np.arange(35).reshape(5, 7)), 3, 4)
    marks = label_tiles(labels(spark, lab), facts, 3, 4)
    got = {r.label: (r.area, r.mean_intensity_g) for r in measure.measure_intensity_tiles(tiles, marks, None, ["g"]).collect()}
    assert got == {16777216: (1, 1.0), 16777217: (1, 34.0), 3: (1, 17.0)}
    for wrong in (labels(spark, np.ones((6, 7), int)), labels(spark, lab).unionByName(labels(spark, lab))):
        with pytest.raises(Exception, match="outside the image|two labels"):
            label_tiles(wrong, facts, 3, 4).collect()


def test_positions_that_do_not_fit_raise(spark):
    far = spark.createDataFrame([("a", 0, 0, 0, 2097152), ("a", 0, 0, 1, 0)], "image_id string, t int, z int, y int, x int")
    with pytest.raises(Exception, match="2097152"):
        components.components_of(far)[0].collect()
    near = far.withColumn("x", far.x % 2097152)
    assert components.components_of(near)[1].count() == 1


def test_regions_and_masks_outside_the_image_raise(spark):
    vox = movie(spark, [np.ones((2, 3)), np.zeros((2, 3))])
    region = labels(spark, np.ones((2, 4), int)).drop("t")
    with pytest.raises(Exception, match="shape mismatch"):
        measure.measure_intensity_over_time(vox, region, channel="g").collect()
    fits = measure.measure_intensity_over_time(vox, region.where("x < 3"), channel="g").collect()
    assert sorted((r.time, r.area, r.mean_intensity) for r in fits) == [(0, 6, 1.0), (1, 6, 0.0)]
    with pytest.raises(Exception, match="mask shape mismatch"):
        apply_mask(vox, labels(spark, np.ones((2, 4), int))).collect()
    assert apply_mask(vox, labels(spark, np.eye(2, 3, dtype=int))).count() == 2
