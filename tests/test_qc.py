import numpy as np
import pytest
from helpers import images, labels, voxels

from fluoroframe.operators import qc

QC = "source string, status string, warnings array<string>, metrics string, reviewed_by_user boolean, notes string, updated_at int"


def test_segmentation_qc_pass_border_empty(spark):
    clean = np.zeros((24, 24), int)
    clean[3:9, 3:9], clean[14:20, 14:20] = 1, 2
    img = images(spark, clean.shape, (1, 0.5, 0.5))
    r = qc.segmentation_qc(labels(spark, clean), img).first()
    assert (r.status, r.n_objects, r.object_size_median, r.border_touching_labels) == ("pass", 2, 36.0, [])
    edge = np.zeros((16, 16), int)
    edge[0:4, 5:9], edge[8:12, 8:12] = 1, 2
    r = qc.segmentation_qc(labels(spark, edge), images(spark, edge.shape)).first()
    assert r.status == "warning" and r.border_touching_labels == [1] and r.border_touching_fraction == 0.5
    assert len(r.warnings) == 2 and r.warnings[0].startswith("Layer scale is missing")
    none = qc.segmentation_qc(labels(spark, np.zeros((8, 8), int)), images(spark, (8, 8))).first()
    assert none.status == "fail" and none.warnings == ["No labeled objects were found."]


def test_volume_border_includes_first_and_last_plane(spark):
    lab = np.zeros((3, 8, 8), int)
    lab[0, 3, 3], lab[1, 5, 5] = 1, 2
    got = qc.border_labels(labels(spark, lab), images(spark, lab.shape), 3).collect()
    assert [r.label for r in got] == [1]


def test_tiny_and_large_objects(spark):
    lab = np.zeros((40, 40), int)
    for k in range(6):
        lab[2 + 6 * k : 6 + 6 * k, 2:6] = k + 1  # area 16
    lab[2:20, 20:38] = 7
    lab[30, 30], lab[30, 33], lab[33, 30] = 8, 9, 10
    r = qc.segmentation_qc(labels(spark, lab), images(spark, lab.shape, (1, 2, 2))).first()
    assert r.tiny_object_fraction == 0.3 and r.large_object_fraction == 0.1
    assert r.warnings == ["Many labeled objects are much smaller than the median object size."]


def test_saturation_rules(spark):
    a = np.full((10, 10), 5.0)
    a[0, 0] = 255
    cases = [("uint8", a, 0.01, True), ("float32", a, 0.01, False), ("float32", np.full((4, 4), 0.9995), 1.0, True), ("uint16", a, 0.0, True), ("int8", np.full((2, 2), 127.0), 1.0, True)]
    for dtype, v, share, known in cases:
        r = qc.saturation(voxels(spark, v), images(spark, v.shape, dtype=dtype)).first()
        assert (r.saturation_fraction, r.saturation_interpretable) == (pytest.approx(share), known)


def test_measurement_qc(spark):
    rows = [(1, 10.0, 0.0, 5.0), (2, 20.0, 0.0, None), (2, 1000.0, 0.0, 7.0)]
    r = qc.measurement_qc(spark.createDataFrame(rows, "label int, area double, mean_intensity_green double, mean_intensity_red double")).first()
    assert r.all_zero_intensity_columns == ["mean_intensity_green"] and r.duplicate_label_rows == 1
    assert r.null_fraction == 1 / 12 and r.broad_size_distribution_columns == ["area"] and r.status == "warning"
    bad = qc.measurement_qc(spark.createDataFrame([(1, -1.0, 2.0)], "label int, area double, mean_intensity double")).first()
    assert bad.status == "fail" and bad.negative_size_columns == ["area"]
    none = qc.measurement_qc(spark.createDataFrame([], "label int, area double, mean_intensity double")).first()
    assert none.status == "fail" and none.warnings == ["Measurement table is empty."]
    bare = qc.measurement_qc(spark.createDataFrame([("x",)], "name string")).first()
    assert len(bare.warnings) == 3 and bare.status == "warning"


def test_timecourse_qc(spark):
    flat = [(t, k, 5.0) for t in range(3) for k in (1, 2)]
    r = qc.timecourse_qc(spark.createDataFrame(flat, "time_index int, label int, mean_intensity double")).first()
    assert (r.n_rois, r.flat_trace_fraction, r.missing_roi_time_pairs, r.status) == (2, 1.0, 0, "warning")
    gap = [(0, 1, 1.0), (1, 1, 2.0), (0, 2, 3.0)]
    df = spark.createDataFrame(gap, "time_index int, label int, mean_intensity double")
    r = qc.timecourse_qc(df).first()
    assert (r.missing_roi_time_pairs, r.missing_roi_time_fraction, r.points_per_roi_min, r.points_per_roi_max) == (1, 0.25, 1, 2)
    keyed = df.selectExpr("'a' image_id", "*")
    assert [tuple(x) for x in qc.missing_pairs(keyed, ["image_id"], "time_index").collect()] == [("a", 2, 1)]
    lacks = qc.timecourse_qc(spark.createDataFrame([(1.0,)], "value double")).first()
    assert lacks.status == "fail" and len(lacks.warnings) == 3
    assert qc.timecourse_qc(df.limit(0)).first().status == "fail"


def test_review_state(spark):
    old = spark.createDataFrame([("a", "warning", ["w"], "m", False, None, 0)], QC)
    rev = spark.createDataFrame([("a", "fail", "x", 1), ("a", "pass", "ok", 2), ("b", "not_checked", None, 1)], "source string, status string, notes string, updated_at int")
    got = {r.source: r for r in qc.mark_status(old, rev).collect()}
    assert (got["a"].status, got["a"].notes, got["a"].warnings, got["a"].metrics, got["a"].reviewed_by_user) == ("pass", "ok", ["w"], "m", True)
    assert got["b"].warnings == [] and got["b"].reviewed_by_user
    with pytest.raises(Exception, match="status must be"):
        qc.mark_status(old, rev.selectExpr("source", "'good' status", "notes", "updated_at")).collect()
    new = spark.createDataFrame([("a", "pass", [], "n", False, None, 5), ("a", "fail", [], "n", False, None, 3)], QC)
    assert qc.upsert_qc(old, new).first().status == "pass"


def test_branch_review(spark):
    old = spark.createDataFrame([("s", 0, "accepted", "fine", 0)], "trace_id string, branch_id int, status string, reason string, updated_at int")
    ev = spark.createDataFrame([("s", [0, 1], "rejected", None, 1), ("s", [1], "accepted", "no", 2)], "trace_id string, branch_ids array<int>, status string, reason string, updated_at int")
    known = spark.createDataFrame([("s", i) for i in range(3)], "trace_id string, branch_id int")
    got = {r.branch_id: (r.status, r.reason) for r in qc.set_branch_qc(old, ev, known).collect()}
    assert got == {0: ("rejected", "fine"), 1: ("accepted", "no")}
    assert sorted(r.branch_id for r in qc.accepted_only(known, qc.set_branch_qc(old, ev, known)).collect()) == [1, 2]
    with pytest.raises(Exception, match="out of range"):
        qc.set_branch_qc(old, ev.selectExpr("trace_id", "array(9) branch_ids", "status", "reason", "updated_at"), known).collect()
