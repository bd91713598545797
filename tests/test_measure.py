import pytest
from pyspark.sql import functions as F
from helpers import frame, images, labels, movie, two_squares, voxels

from fluoroframe.operators import measure as me
from fluoroframe.plans.ranks import exact_percentiles  # noqa: F401
from fluoroframe.sources.tiles import tiles_from_voxels

import numpy as np


def test_two_squares_two_channels_and_scale(spark):
    lab, a, b = two_squares()
    vox = voxels(spark, a, "A").unionByName(voxels(spark, b, "B"))
    out = frame(me.measure_intensity(vox, labels(spark, lab), images(spark, lab.shape, (1, 0.5, 0.5)), ["A", "B"])).sort_values("label")
    assert out["mean_intensity_A"].tolist() == [100, 50] and out["mean_intensity_B"].tolist() == [10, 200]
    assert out["area"].tolist() == [36, 36] and (out["area_um2"] / out["area_px"] == 0.25).all()
    assert out["centroid-0"].tolist() == [4.5, 14.5] and out["centroid_y_um"].tolist() == [2.25, 7.25]


def test_tiles_and_voxels_agree(spark):
    lab, a, b = two_squares()
    vox = voxels(spark, a, "A").unionByName(voxels(spark, b, "B"))
    one = frame(me.measure_intensity(vox, labels(spark, lab), None, ["A", "B"])).sort_values("label")
    for side in (7, 64):
        tiles, lt = tiles_from_voxels(vox, side, side), tiles_from_voxels(voxels(spark, lab, "L"), side, side)
        two = frame(me.measure_intensity_tiles(tiles, lt, None, ["A", "B"])).sort_values("label")
        assert one.reset_index(drop=True).equals(two[one.columns].reset_index(drop=True))


def test_three_dimensional_volume(spark):
    lab = np.zeros((4, 8, 8), int)
    lab[1:3, 2:5, 2:5] = 1
    out = me.measure_intensity(voxels(spark, lab), labels(spark, lab), images(spark, lab.shape, (0.5, 0.2, 0.2)), ["g"], ndim=3).first()
    assert out.volume_voxels == 18 and out.volume_um3 == pytest.approx(18 * 0.02)
    assert out["centroid-0"] == 1.5 and out.centroid_z_um == 0.75


def test_unit_scale_has_no_physical_values(spark):
    lab, a, _ = two_squares()
    out = me.measure_intensity(voxels(spark, a), labels(spark, lab), images(spark, lab.shape), ["g"]).first()
    assert out.area_um2 is None and out.area_px == 36


def test_empty_property_list_means_default_and_unknown_fails(spark):
    lab, a, _ = two_squares()
    only = me.measure_intensity(voxels(spark, a), labels(spark, lab), None, ["g"], ["label"])
    assert set(only.columns) == {"image_id", "label", "area", "area_px"}
    with pytest.raises(ValueError):
        me.measure_intensity(voxels(spark, a), labels(spark, lab), None, ["g"], ["perimeter"])
    with pytest.raises(ValueError):
        me.measure_intensity(voxels(spark, a), labels(spark, lab), None, [])


def test_shape_mismatch_is_an_error(spark):
    lab, a, _ = two_squares()
    with pytest.raises(Exception, match="shape mismatch"):
        me.measure_intensity(voxels(spark, a[:10]), labels(spark, lab), None, ["g"]).collect()


def test_static_and_dynamic_time_courses(spark):
    lab, a, _ = two_squares()
    vox = movie(spark, [a, 2 * a, 3 * a])
    img = images(spark, lab.shape, frames=3, interval=1.5)
    out = frame(me.measure_intensity_over_time(vox, labels(spark, lab).drop("t"), img, "g")).sort_values(["label", "time_index"])
    assert out[out.label == 1].mean_intensity.tolist() == [100, 200, 300] and len(out) == 6
    assert out[out.label == 1].time_s.tolist() == [0, 1.5, 3]
    second = lab.copy()
    second[second == 2] = 0
    dyn = labels(spark, lab, t=0).unionByName(labels(spark, second, t=1)).unionByName(labels(spark, lab, t=2))
    got = frame(me.measure_intensity_over_time(vox, dyn, img, "g"))
    assert sorted(zip(got.time_index, got.label)) == [(0, 1), (0, 2), (1, 1), (2, 1), (2, 2)]
    totals = me.timecourse_totals(me.measure_intensity_over_time(vox, dyn, img, "g"), img).first()
    assert (totals.n_timepoints, totals.n_labels, totals.n_rows) == (3, 2, 5)


def test_interval_needs_a_positive_finite_number(spark):
    rows = [("a", "bad", 2.0), ("b", "-1", None), ("c", "0.5", None)]
    img = spark.createDataFrame(rows, "image_id string, time_interval_s string, frame_interval double")
    got = {r.image_id: r.interval_s for r in me.frame_interval(img).collect()}
    assert got == {"a": 2.0, "b": None, "c": 0.5}


def test_refresh_reports_the_difference(spark):
    lab, a, _ = two_squares()
    vox, spec = voxels(spark, a), {"tool": "measure_intensity", "channels": ["g"]}
    old = me.measure_intensity(vox, labels(spark, lab * (lab == 1)), None, ["g"])
    new, delta = me.refresh_measurement(spec, vox, labels(spark, lab), None, old)
    assert new.count() == 2 and tuple(delta.first()) == (2, 1)
    with pytest.raises(ValueError):
        me.refresh_measurement({"tool": "filter_table"}, vox, labels(spark, lab), None, old)


def test_filter_and_summarize(spark):
    df = spark.createDataFrame([("x", 1.0, 5), ("x", 3.0, 7), ("y", 10.0, None), (None, 4.0, 1)], "g string, a double, b int")
    assert me.filter_table(df, "a > 2 and b == 7").count() == 1
    with pytest.raises(ValueError):
        me.filter_table(df, "nope > 2")
    for op, want in {"mean": 2, "median": 2, "sum": 4, "count": 2, "min": 1, "max": 3, "std": 2**0.5}.items():
        got = {r.g: r.a for r in me.summarize_table(df, op, "g").collect()}
        assert got["x"] == pytest.approx(want) and set(got) == {"x", "y"}
    assert me.summarize_table(df, "max").first().a == 10.0
    with pytest.raises(ValueError):
        me.summarize_table(df, "mode")


def test_lookup_and_sample_columns(spark):
    obj = spark.createDataFrame([("a", 1, 2.0, 3.0), ("a", 1, 9.0, 9.0), ("a", 2, 4.0, 5.0)], "image_id string, label int, `centroid-0` double, `centroid-1` double")
    req = spark.createDataFrame([("a", 2)], "image_id string, label int")
    assert me.lookup_objects(obj, req, images(spark, (9, 9), (1, 0.5, 2))).first().center == [2.0, 10.0]
    with pytest.raises(Exception, match="label not found"):
        me.lookup_objects(obj, spark.createDataFrame([("a", 7)], "image_id string, label int")).collect()
    phys = spark.createDataFrame([("a", 1, 1.5, 2.5)], "image_id string, label int, y_um double, x_um double")
    assert me.lookup_objects(phys, spark.createDataFrame([("a", 1)], "image_id string, label int")).first().center == [1.5, 2.5]
    smp = spark.createDataFrame([("a", "s", "ctl")], "image_id string, sample_name string, `group` string")
    out = me.attach_sample_columns(obj.withColumnRenamed("label", "group"), smp)
    assert out.columns.count("group") == 1 and out.first().sample_name == "s"


def test_label_tile_needs_an_image_tile(spark):
    schema = "image_id string, t int, z int, ty int, tx int, y0 int, x0 int, h int, w int, data array<float>"
    tile = ("a", 0, 0, 0, 0, 0, 0, 1, 2)
    labels = spark.createDataFrame([(*tile, [5.0, 0.0])], schema)
    image = spark.createDataFrame([(*tile, [7.0, 1.0])], schema).withColumn("channel", F.lit("red"))
    assert me.measure_intensity_tiles(image, labels, channels=["red"]).first().mean_intensity_red == 7.0
    with pytest.raises(Exception, match="without image tile"):
        me.measure_intensity_tiles(image, labels, channels=["red", "green"]).collect()
