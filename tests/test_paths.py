"""Paths, orders and intensities against plain Python on whole graphs."""

import heapq
import random

import numpy as np
import pytest
from helpers import images, positions, voxels

from fluoroframe.operators import paths, skeleton as sk
from fluoroframe.sources.tiles import tiles_from_voxels

TREE = "trace_id string, pid long, parent long"


def graph_of(spark, m, scale=(1, 0.5, 0.25)):
    img = images(spark, m.shape, scale)
    steps = sk.cut(sk._steps(positions(spark, m), 2))
    n = sk.cut(sk.nodes(positions(spark, m), img, 2, steps))
    return n, sk.cut(sk.edges(n, steps, img))


def dijkstra(edges, starts):
    near = {}
    for a, b, w in edges:
        near.setdefault(a, []).append((b, w))
        near.setdefault(b, []).append((a, w))
    best, queue = {}, [(0.0, s) for s in starts]
    while queue:
        d, v = heapq.heappop(queue)
        if v not in best:
            best[v] = d
            for u, w in near.get(v, ()):
                heapq.heappush(queue, (d + w, u))
    return best


@pytest.mark.parametrize("box", [(1, 9, 11), (16, 256, 256)])
def test_distances_are_the_shortest_in_any_blocks(spark, box):
    m = np.random.default_rng(5).random((18, 21)) < 0.42
    m[0, 0] = True
    n, e = graph_of(spark, m)
    rows = n.collect()
    starts = [r.pid for r in rows if r.node_id in (0, 40)]
    want = dijkstra([(r.src, r.dst, r.edge_length_scaled) for r in e.collect()], starts)
    asked = spark.createDataFrame([("a", p) for p in starts * 2], "trace_id string, pid long")
    got = paths.path_distances(n, e, asked, box)
    found = {r.pid: r.path_distance for r in got.collect()}
    assert set(found) == {r.pid for r in rows} and {p: d for p, d in found.items() if d is not None} == want
    tree = {r.pid: r.parent for r in paths.path_parents(got, e).collect()}
    assert set(tree) == set(want) and {p for p, u in tree.items() if u is None} == set(starts)
    assert all(want[u] < want[p] for p, u in tree.items() if u is not None)


def test_distances_of_a_winding_path_and_without_start(spark):
    m = np.zeros((8, 12), bool)
    m[::2] = True
    m[1::4, -1] = m[3::4, 0] = True
    n, e = graph_of(spark, m, (1, 1, 1))
    start = paths.start_at_soma(n, spark.createDataFrame([("a", 0.0, 0.0)], "trace_id string, c0 double, c1 double"))
    far = paths.path_distances(n, e, start, (1, 8, 4)).toPandas().path_distance
    want = dijkstra([(r.src, r.dst, r.edge_length_scaled) for r in e.collect()], [start.first().pid])
    assert far.max() == max(want.values()) and far.notna().all() and far.max() > 40
    assert paths.path_distances(n, e, start.where("false")).where("path_distance IS NOT NULL").count() == 0


def orders(parent):
    kids, out = {}, {}
    for p, u in parent.items():
        kids.setdefault(u, []).append(p)
    stack = [(r, False) for r in kids.get(None, [])]
    while stack:
        v, ready = stack.pop()
        if not ready:
            stack += [(v, True), *((k, False) for k in kids.get(v, []))]
            continue
        below = sorted((out[k] for k in kids.get(v, [])), reverse=True)
        out[v] = 1 if not below else below[0] + (len(below) > 1 and below[0] == below[1])
    return out


@pytest.mark.parametrize("back", [3, 120])
def test_orders_equal_the_recursive_definition(spark, back):
    rng = random.Random(back)
    parent = {0: None, 1000: None}
    for i in range(1, 120):
        parent[i] = rng.randrange(max(0, i - back), i)
    tree = spark.createDataFrame([("a", p, u) for p, u in parent.items()], TREE)
    got = paths.strahler_order(tree)
    assert {r.pid: r.strahler for r in got.collect()} == orders(parent)
    total = paths.order_summary(got, tree).first()
    assert total.n_nodes == 121 and total.n_tips == sum(p not in parent.values() for p in parent)


def test_full_binary_tree_and_long_chain_end_in_few_rounds(spark, monkeypatch):
    written = []
    monkeypatch.setattr(paths, "cut", lambda df, *done: written.append(1) or sk.cut(df, *done))
    both = spark.range(1, 256).selectExpr("'tree' AS trace_id", "id AS pid", "CASE WHEN id > 1 THEN id div 2 END AS parent")
    chain = spark.range(1, 301).selectExpr("'chain' AS trace_id", "id AS pid", "CASE WHEN id > 1 THEN id - 1 END AS parent")
    got = paths.strahler_order(both.union(chain))
    top = {r.trace_id: r.strahler for r in got.where("pid = 1").collect()}
    assert top == {"tree": 8, "chain": 1} and got.count() == 555
    assert len(written) <= 1 + 4 * 12  # rounds follow the logarithm
    assert paths.strahler_order(both.where("false")).count() == 0


def test_intensity_along_a_process(spark):
    m = np.zeros((9, 30), bool)
    m[4, 3:27] = True
    v = np.arange(270, dtype=float).reshape(9, 30)
    n, e = graph_of(spark, m, (1, 1, 1))
    tiles = tiles_from_voxels(voxels(spark, v), 4, 7)
    at = paths.sample_nodes(n, tiles)
    assert {(r.pid, r.v) for r in at.collect()} == {((4 << 21) + x, v[4, x]) for x in range(3, 27)}
    start = n.where("node_id = 0").select("trace_id", "pid")
    bins = {r["bin"]: r for r in paths.distance_profile(at, paths.path_distances(n, e, start), 10.0).collect()}
    assert {b: r.n_nodes for b, r in bins.items()} == {0: 10, 1: 10, 2: 4} and bins[1].mean_intensity == v[4, 13:23].mean() and bins[2].distance_from == 20
    one = paths.branch_intensity(at, n.select("trace_id", "pid").selectExpr("*", "7 AS branch_id")).first()
    assert (one.branch_id, one.n_nodes, one.min_intensity, one.max_intensity) == (7, 24, v[4, 3], v[4, 26])
    with pytest.raises(Exception, match="no tile"):
        paths.sample_nodes(n, tiles.where("tx < 3")).collect()
