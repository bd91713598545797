import numpy as np
import pytest
from helpers import images, labels, place_set, positions, true_set

from fluoroframe.operators import skeleton as sk, tracking as tr
from fluoroframe.sources import project

SCHEMA = "image_id string, t int, label int, z double, y double, x double"


def cross():
    m = np.zeros((40, 44), bool)
    m[18:22, 4:40], m[4:36, 20:24], m[26:32, 26:34] = True, True, True
    return m


def test_thinning_is_the_same_in_any_blocks(spark):
    m = cross()
    want = true_set(sk.thin_plane(m, 100))
    assert place_set(sk.thin(positions(spark, m))) == want
    assert place_set(sk.thin(positions(spark, m), box=(1, 9, 11), halo=4)) == want
    v = np.zeros((12, 14, 14), bool)
    v[4:8, 2:12, 5:9], v[2:10, 5:9, 5:9] = True, True
    want = true_set(sk.thin_volume(v, 100, (0, 0, 0)))
    assert place_set(sk.thin(positions(spark, v), 3, box=(6, 7, 7), halo=9)) == want
    assert 0 < len(want) < v.sum() / 5


def y_shape():
    m = np.zeros((20, 20), bool)
    m[10, 2:11] = True
    for i in range(1, 7):
        m[10 - i, 10 + i] = m[10 + i, 10 + i] = True
    return m


@pytest.fixture(scope="module")
def graph(spark):
    m = y_shape()
    return sk.trace_graph(positions(spark, m), images(spark, m.shape, (1, 0.5, 0.5)))


def test_y_graph(spark, graph):
    n = graph.nodes.toPandas().sort_values("node_id")
    assert len(n) == y_shape().sum() and (n.degree == 1).sum() == 3 and n.component_id.nunique() == 1
    b = graph.branches.toPandas()
    assert (b.branch_type == "junction-endpoint").sum() == 3
    assert b.branch_length.sum() == pytest.approx(graph.edges.toPandas().edge_length_scaled.sum())
    assert (b.tortuosity.dropna() >= 1 - 1e-9).all() and b.branch_length_um.notna().all()
    c = graph.components.first()
    assert c.n_nodes == len(n) and c.n_edges == graph.edges.count()
    total = sk.morphology(graph.nodes, graph.branches, graph.components, images(spark, (20, 20), (1, 0.5, 0.5))).first()
    assert total.n_endpoints == 3 and total.length_unit == "um" and total.skeleton_volume_occupancy == len(n) / 400
    assert total.median_branch_length == pytest.approx(np.median(b.branch_length))


def test_isolated_cycle_and_line(spark):
    m = np.zeros((12, 12), bool)
    m[1, 2:5] = m[5, 2:5] = m[2:5, 1] = m[2:5, 5] = True  # octagon ring
    m[9, 2:9] = True
    g = sk.trace_graph(positions(spark, m), images(spark, m.shape))
    b = g.branches.toPandas().sort_values("branch_id")
    assert b.branch_type.tolist() == ["isolated-cycle", "endpoint-endpoint"]
    assert b.branch_length.tolist() == pytest.approx([8 + 4 * 2**0.5, 6]) and b.tortuosity.isna().tolist() == [True, False]


def test_prune_removes_a_spur(spark):
    m = np.zeros((16, 24), bool)
    m[8, 2:22] = True
    m[5:8, 12] = True
    m[7, 12] = False
    m[7, 13] = True
    img, skel = images(spark, m.shape), positions(spark, m)
    g = sk.trace_graph(skel, img)
    kept, new, totals = sk.prune(skel, g, img, 4.0)
    assert totals.first().n_removed >= 1 and new.branches.count() < g.branches.count()
    assert (0, 5, 12) not in place_set(kept) and (0, 8, 2) in place_set(kept)
    with pytest.raises(Exception, match="remove all branches"):
        sk.prune(skel, g, img, 1000.0)[2].collect()
    same, _ = sk.skeletonize(skel, img, 1000.0)  # a minimum that would drop all drops none
    assert same.count() > 0


def test_sholl_against_the_plain_rule(spark, graph):
    n = graph.nodes.toPandas().set_index("pid")
    e = graph.edges.toPandas()
    p = n[["coord_0_scaled", "coord_1_scaled"]]
    centre = p.mean().to_numpy()
    d = np.sqrt(((p - centre) ** 2).sum(axis=1))
    profile, peak = sk.sholl(graph.nodes, graph.edges, step=0.5)
    rows = {r.radius_um: r.intersections for r in profile.collect()}
    radii = np.arange(0.5, d.max() + 1e-9, 0.5)
    assert sorted(rows) == pytest.approx(radii.tolist())
    for r in radii:
        lo, hi = np.minimum(d[e.src].to_numpy(), d[e.dst].to_numpy()), np.maximum(d[e.src].to_numpy(), d[e.dst].to_numpy())
        assert rows[r] == ((lo <= r) & (r <= hi)).sum()
    top = peak.first()
    assert top.peak_intersections == max(rows.values()) and top.center == "centroid"
    assert top.area_under_curve == pytest.approx(np.trapezoid([rows[r] for r in radii], radii))
    with pytest.raises(ValueError):
        sk.sholl(graph.nodes, graph.edges, step=0)
    with pytest.raises(ValueError):
        sk.sholl(graph.nodes, graph.edges, center="1,2,3")


def test_swc_tree_region_and_soma(spark, graph):
    whole = sk.swc_rows(graph.nodes, graph.edges).orderBy("id").toPandas()
    assert (whole.parent == -1).sum() == 1
    split = sk.swc_rows(graph.nodes, graph.edges, box=(1, 4, 4)).orderBy("id").toPandas()
    assert whole.equals(split)
    pos = whole.set_index("id")[["x", "y"]]
    linked = whole[whole.parent > 0]
    step = np.abs(pos.loc[linked.id].to_numpy() - pos.loc[linked.parent].to_numpy()).max()
    assert step <= 0.5  # a parent is a direct neighbour
    point = spark.createDataFrame([("a", 1, 5.0, 5.0), ("a", 0, 5.0, 1.0)], "trace_id string, point_index int, c0 double, c1 double")
    at = sk.soma(point)
    rooted = sk.swc_rows(graph.nodes, graph.edges, at).where("parent = -1").first()
    assert (rooted.x, rooted.y) == (1.0, 5.0)
    assert sk.soma(mask=labels(spark, np.eye(3, dtype=int)), images=images(spark, (3, 3), (1, 2, 1))).first()[1:] == (2.0, 1.0)
    region = np.ones((20, 20), int)
    region[:, 8:] = 2
    assert sk.dominant_region(graph.nodes, labels(spark, region)).first().region == 2
    assert sk.dominant_region(graph.nodes, labels(spark, np.zeros((2, 2), int))).first().region is None


def test_trace_exports(spark, graph, tmp_path):
    rows = sk.swc_rows(graph.nodes, graph.edges)
    project.write_swc(rows, str(tmp_path / "swc"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "swc")).collect()]
    assert sum(line.startswith("#") for line in lines) == 3 and len(lines) == 3 + rows.count()
    project.write_trace_csv(graph.nodes, graph.edges, graph.branches, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv/nodes"), header=True).count() == graph.nodes.count()
    m = y_shape()
    tile = project.skeleton_tiles(positions(spark, m), 16).collect()
    got = {(r.y0 + i // 16, r.x0 + i % 16) for r in tile for i, v in enumerate(r.data) if v == 255}
    assert all(len(r.data) == 256 for r in tile) and got == {(y, x) for _, y, x in true_set(m)}


def test_moving_disks_keep_their_track(spark):
    rows = [("a", t, k, 0.0, 10.0 * k + t, 5.0 + t) for t in range(6) for k in range(4) if not (k == 2 and t == 3)]
    out = tr.track(spark.createDataFrame(rows, SCHEMA), 5.0, 2).toPandas()
    assert out.groupby("label").track_id.nunique().tolist() == [1, 1, 1, 1] and out.track_id.nunique() == 4
    counts = tr.track_counts(tr.track(spark.createDataFrame(rows, SCHEMA), 5.0, 0)).first()
    assert (counts.n_tracks, counts.n_detections) == (5, 23)  # without gaps the third disk is cut in two


def test_mutual_nearest_and_ties(spark):
    rows = [("a", 0, 1, 0.0, 0.0, 0.0), ("a", 1, 1, 0.0, 0.0, 1.0), ("a", 1, 2, 0.0, 0.0, -1.0), ("a", 1, 3, 0.0, 0.0, 90.0)]
    _, links = tr.link(spark.createDataFrame(rows, SCHEMA), 10.0, 0)
    assert [(r.src, r.dst) for r in links.collect()] == [(0, 1)]


def test_detections_are_centroids(spark):
    lab = np.zeros((6, 6), int)
    lab[1:3, 1:4] = 5
    d = tr.detections(labels(spark, lab, t=3)).first()
    assert (d.t, d.label, d.y, d.x) == (3, 5, 1.5, 2.0)


def test_crowded_frames_search_finer_grids(spark, monkeypatch):
    monkeypatch.setattr(tr, "CELL_LIMIT", 3)
    rng = np.random.default_rng(5)
    spots = {t: rng.random((25, 2)) * 12 for t in range(2)}
    rows = [("a", t, k, 0.0, *map(float, p)) for t in spots for k, p in enumerate(spots[t])]
    rows += [("a", 1, 90 + k, 0.0, 3.0, 3.0) for k in range(5)]  # several targets at one place
    dets = spark.createDataFrame(rows, SCHEMA)
    assert len(tr._grid_sizes(dets, 8.0, "yx")) > 1
    found, links = tr.link(dets, 8.0, 0)
    f = found.toPandas()
    one, two = f[f.t == 0], f[f.t == 1]
    gap = np.hypot(one.y.to_numpy()[:, None] - two.y.to_numpy(), one.x.to_numpy()[:, None] - two.x.to_numpy())
    want = {(int(one.id.iloc[i]), int(two.id.iloc[j])) for i, j in enumerate(gap.argmin(1)) if gap[:, j].argmin() == i and gap[i, j] <= 8}
    assert {(r.src, r.dst) for r in links.collect()} == want
