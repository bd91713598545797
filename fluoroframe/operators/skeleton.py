"""Skeletons and their graphs: thinning, nodes, edges, branches, Sholl, SWC.

A trace is one image; ``trace_id`` is its ``image_id``.  Graph tables carry ``pid``,
the packed voxel position, next to the dense ids.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from fluoroframe.operators.components import components_of, label_components
from fluoroframe.plans.blocks import (
    dense,
    neighbour_pairs,
    offsets,
    packed,
    step_column,
    to_blocks,
    unpacked,
)
from fluoroframe.plans.cut import cut
from fluoroframe.plans.ranks import exact_percentiles, number_rows
from fluoroframe.plans.skew import salted_join
from fluoroframe.sources.tiles import VOXEL_KEY

FRAME = ["image_id", "t"]

# Names of the branch type codes.
BRANCH_TYPES = {
    0: "endpoint-endpoint",
    1: "junction-endpoint",
    2: "junction-junction",
    3: "isolated-cycle",
}


# ---------------------------------------------------------------- thinning


def _ring(m: np.ndarray) -> list[np.ndarray]:
    """The eight neighbours of every pixel, clockwise from north."""
    p = np.pad(m, 1)
    n, e, s, w = p[:-2, 1:-1], p[1:-1, 2:], p[2:, 1:-1], p[1:-1, :-2]
    return [n, p[:-2, 2:], e, p[2:, 2:], s, p[2:, :-2], w, p[:-2, :-2]]


def thin_plane(mask: np.ndarray, iterations: int) -> np.ndarray:
    """Up to ``iterations`` rounds of the two-pass parallel thinning of Zhang and Suen."""
    m = mask.astype(np.uint8)
    for _ in range(iterations):
        before = int(m.sum())
        for second in (False, True):
            q = _ring(m)
            count = sum(q)
            turns = sum((a == 0) & (b == 1) for a, b in zip(q, q[1:] + q[:1]))
            n, e, s, w = q[0], q[2], q[4], q[6]
            gate = (n * e * w == 0) & (n * s * w == 0) if second else (n * e * s == 0) & (e * s * w == 0)
            m[(m == 1) & (count >= 2) & (count <= 6) & (turns == 1) & gate] = 0
        if int(m.sum()) == before:
            break
    return m.astype(bool)


_CUBE = [d for d in np.ndindex(3, 3, 3) if d != (1, 1, 1)]


def _adjacency(near) -> np.ndarray:
    pts = np.array(_CUBE)
    gap = np.abs(pts[:, None] - pts[None]).astype(int)
    return near(gap).astype(np.float32)


_TOUCH26 = _adjacency(lambda g: g.max(-1) <= 1)
_TOUCH6 = _adjacency(lambda g: g.sum(-1) <= 1)
_FACE = np.array([sum(abs(v - 1) for v in d) == 1 for d in _CUBE])
_EDGE18 = np.array([sum(abs(v - 1) for v in d) <= 2 for d in _CUBE])


def _one_piece(member: np.ndarray, touch: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """True where all ``seeds`` lie in one connected piece of ``member`` (at least one)."""
    first = np.argmax(seeds, axis=1)
    reach = np.zeros_like(member)
    reach[np.arange(len(member)), first] = seeds.any(axis=1)
    while True:
        grown = ((reach.astype(np.float32) @ touch) > 0) & member
        if np.array_equal(grown, reach):
            break
        reach = grown
    return seeds.any(axis=1) & ~(seeds & ~reach).any(axis=1)


def thin_volume(mask: np.ndarray, iterations: int, parity: tuple[int, int, int]) -> np.ndarray:
    """Thinning by removal of simple border voxels that are not line ends.

    One iteration visits the eight parity classes of the grid in turn.  Voxels of one
    class are never neighbours, so a whole class is decided at once and the result
    does not depend on how the volume is divided into blocks.
    """
    m = np.pad(mask.astype(bool), 1)
    for _ in range(iterations):
        inner = m[1:-1, 1:-1, 1:-1]
        faces = [m[:-2, 1:-1, 1:-1], m[2:, 1:-1, 1:-1], m[1:-1, :-2, 1:-1], m[1:-1, 2:, 1:-1], m[1:-1, 1:-1, :-2], m[1:-1, 1:-1, 2:]]
        border = inner & ~np.logical_and.reduce(faces)
        spots = np.argwhere(border)
        removed = 0
        for k in np.ndindex(2, 2, 2):
            cls = spots[((spots + np.array(parity)) % 2 == np.array(k)).all(axis=1)]
            if not len(cls):
                continue
            hood = np.stack([m[tuple((cls + np.array(d)).T)] for d in _CUBE], axis=1)
            more = hood.sum(axis=1) > 1
            ok = more & _one_piece(hood, _TOUCH26, hood) & _one_piece(~hood & _EDGE18, _TOUCH6, ~hood & _FACE)
            gone = cls[ok] + 1
            m[tuple(gone.T)] = False
            removed += len(gone)
        if not removed:
            break
    return m[1:-1, 1:-1, 1:-1]


def thin(
    mask: DataFrame,
    ndim: int = 2,
    box: tuple[int, int, int] | None = None,
    halo: int | None = None,
) -> DataFrame:
    """Thin a mask to one-voxel-wide curves.

    A thinning pass only looks at direct neighbours, so a block with a halo of h
    voxels can run h passes on its own and still be exact in its core.  Rounds repeat
    with exchanged halos until nothing changes: an object of any size is spread over
    many blocks and no block grows with it.
    """
    box = box or ((1, 256, 256) if ndim == 2 else (48, 48, 48))
    halo = halo or (32 if ndim == 2 else 18)
    per_pass = 2 if ndim == 2 else 9
    iterations = halo // per_pass
    rim = (0, halo, halo) if ndim == 2 else (halo, halo, halo)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        grid, core, origin = dense(pdf, box, rim)
        if not core.any():
            return pdf.loc[core, VOXEL_KEY]
        if ndim == 2:
            left = thin_plane(grid[_plane(grid)] >= 0, iterations)
            rows = grid[_plane(grid)][left]
        else:
            left = thin_volume(grid >= 0, iterations, tuple(o % 2 for o in origin))
            rows = grid[left]
        stay = np.zeros(len(pdf), dtype=bool)
        stay[rows] = True
        return pdf.loc[core & stay, VOXEL_KEY]

    kinds = dict(mask.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in VOXEL_KEY)
    now = cut(mask.select(*VOXEL_KEY).distinct())
    size = now.count()
    while True:
        blocks = to_blocks(now, box, rim)
        now = cut(blocks.groupBy(*FRAME, "bz", "by", "bx").applyInPandas(run, schema))
        left = now.count()
        if left == size:
            return now
        size = left


def _plane(grid: np.ndarray) -> int:
    """The single occupied plane of a two-dimensional block."""
    return int(np.argmax((grid >= 0).any(axis=(1, 2))))


# ---------------------------------------------------------------- graph tables


@dataclass
class TraceGraph:
    """Tables of one skeletonization run, each written once."""

    nodes: DataFrame
    edges: DataFrame
    branches: DataFrame
    components: DataFrame
    members: DataFrame  # trace_id, pid, branch_id: voxels belonging to each branch


def _axes(ndim: int) -> str:
    return "zyx" if ndim == 3 else "yx"


def _spacing(images: DataFrame, ndim: int) -> DataFrame:
    cols = [F.coalesce(F.col(f"voxel_{a}").cast("double"), F.lit(1.0)).alias(f"s_{a}") for a in _axes(ndim)]
    out = images.select(F.col("image_id").alias("trace_id"), *cols)
    apart = [F.abs(F.col(f"s_{a}") - 1.0) > 1e-9 for a in _axes(ndim)]
    physical = apart[0]
    for c in apart[1:]:
        physical = physical | c
    return out.withColumn("physical", physical)


def _steps(skel: DataFrame, ndim: int) -> DataFrame:
    """Neighbouring voxel pairs, each once, earlier voxel first."""
    here = skel.select(F.col("image_id").alias("trace_id"), "z", "y", "x", packed().alias("pid"))
    ahead = here.select(
        "trace_id", F.col("pid").alias("src"), "z", "y", "x", step_column(offsets(ndim, True, True)).alias("s")
    ).select(
        "trace_id",
        "src",
        *[(F.col(a) + F.col(f"s.d{a}")).alias(a) for a in "zyx"],
        *[F.expr(f"s.d{a}").alias(f"d{a}") for a in "zyx"],
    )
    dst = here.select("trace_id", "z", "y", "x", F.col("pid").alias("dst"))
    return ahead.join(dst, ["trace_id", "z", "y", "x"]).select("trace_id", "src", "dst", "dz", "dy", "dx")


def nodes(skel: DataFrame, images: DataFrame, ndim: int = 2, steps: DataFrame | None = None) -> DataFrame:
    """One row per skeleton voxel with degree, component and coordinates (G1)."""
    steps = _steps(skel, ndim) if steps is None else steps
    ends = steps.select("trace_id", F.explode(F.array("src", "dst")).alias("pid"))
    degree = ends.groupBy("trace_id", "pid").agg(F.count("*").cast("int").alias("degree"))
    comp = label_components(skel, ndim, full=True).select(
        F.col("image_id").alias("trace_id"), packed().alias("pid"), "z", "y", "x",
        (F.col("label") - 1).alias("component_id"),
    )
    out = comp.join(degree, ["trace_id", "pid"], "left").na.fill(0, ["degree"])
    out = number_rows(out, ["trace_id"], ["z", "y", "x"], "node_id", start=0)
    out = salted_join(out, _spacing(images, ndim), ["trace_id"], ["pid"])
    cols = ["trace_id", "pid", "node_id", "degree", "component_id"]
    new = []
    for i, a in enumerate(_axes(ndim)):
        scaled = F.col(a) * F.col(f"s_{a}")
        new += [
            F.col(a).alias(f"image_coord_{i}"),
            scaled.alias(f"coord_{i}_scaled"),
            F.when(F.col("physical"), scaled).alias(f"coord_{i}_um"),
        ]
    return out.select(*cols, *new)


def edges(nodes_: DataFrame, steps: DataFrame, images: DataFrame, ndim: int = 2) -> DataFrame:
    """Undirected edges with scaled Euclidean length, numbered by (src, dst)."""
    out = salted_join(steps, _spacing(images, ndim), ["trace_id"], ["src", "dst"])
    length = F.sqrt(sum((F.pow(F.col(f"d{a}") * F.col(f"s_{a}"), 2) for a in _axes(ndim)), F.lit(0.0)))
    out = out.select("trace_id", "src", "dst", "physical", length.alias("edge_length_scaled"))
    ids = nodes_.select("trace_id", "pid", "node_id")
    out = out.join(ids.toDF("trace_id", "src", "node_id_src"), ["trace_id", "src"])
    out = out.join(ids.toDF("trace_id", "dst", "node_id_dst"), ["trace_id", "dst"])
    z, y, x = unpacked("src")
    out = out.withColumns({"_z": z, "_y": y, "_x": x})
    out = number_rows(out, ["trace_id"], ["_z", "_y", "_x", "dst"], "edge_id", start=0)
    um = F.when(F.col("physical"), F.col("edge_length_scaled")).alias("edge_length_um")
    return out.select("trace_id", "edge_id", "node_id_src", "node_id_dst", "edge_length_scaled", um, "src", "dst")


def components(nodes_: DataFrame, edges_: DataFrame) -> DataFrame:
    """Per component: node and edge counts and coordinate ranges."""
    key = ["trace_id", "component_id"]
    coords = [c for c in nodes_.columns if c.startswith("coord_") and c.endswith("_scaled")]
    ranges = [f(c).alias(f"{c}_{n}") for c in coords for n, f in (("min", F.min), ("max", F.max))]
    per_node = nodes_.groupBy(*key).agg(F.count("*").alias("n_nodes"), *ranges)
    owner = nodes_.select("trace_id", F.col("pid").alias("src"), "component_id")
    per_edge = edges_.join(owner, ["trace_id", "src"]).groupBy(*key).agg(F.count("*").alias("n_edges"))
    out = per_node.join(per_edge, key, "left").na.fill(0, ["n_edges"])
    return out.select(*key, "n_nodes", "n_edges", *[c for c in per_node.columns if c not in (*key, "n_nodes")])


def branches(nodes_: DataFrame, edges_: DataFrame, images: DataFrame, ndim: int = 2) -> tuple[DataFrame, DataFrame]:
    """Maximal chains through degree-2 nodes (G4); returns (branches, members).

    The degree-2 voxels fall into connected chains; each chain collects its inner
    edges and the one or two edges that attach it to other nodes.  Edges between two
    non-degree-2 nodes are branches of their own.
    """
    inner = nodes_.where("degree = 2")
    z, y, x = unpacked("pid")
    chain_mask = inner.select(
        F.col("trace_id").alias("image_id"), F.lit(0).alias("t"), z.alias("z"), y.alias("y"), x.alias("x")
    )
    vox, parts = components_of(chain_mask, ndim, full=True)
    chain = vox.join(parts.select(*FRAME, "local", "root"), [*FRAME, "local"]).select(
        F.col("image_id").alias("trace_id"), packed().alias("pid"), "root"
    )
    chain = cut(chain)
    e = edges_.select("trace_id", "src", "dst", F.col("edge_length_scaled").alias("len"))
    e = e.join(chain.toDF("trace_id", "src", "ra"), ["trace_id", "src"], "left")
    e = e.join(chain.toDF("trace_id", "dst", "rb"), ["trace_id", "dst"], "left")
    # chain edges carry the chain root; the end is the voxel outside the chain, if any
    in_chain = e.where("ra IS NOT NULL OR rb IS NOT NULL").select(
        "trace_id",
        F.coalesce("ra", "rb").alias("root"),
        "len",
        F.when(F.col("ra").isNull(), F.col("src")).when(F.col("rb").isNull(), F.col("dst")).alias("end"),
    )
    long = in_chain.groupBy("trace_id", "root").agg(
        F.sum("len").alias("branch_length"),
        F.coalesce(F.min("end"), F.col("root")).alias("p0"),
        F.coalesce(F.max("end"), F.col("root")).alias("p1"),
    )
    short = e.where("ra IS NULL AND rb IS NULL").select(
        "trace_id", F.lit(None).cast("long").alias("root"), F.col("len").alias("branch_length"),
        F.col("src").alias("p0"), F.col("dst").alias("p1"),
    )
    b = long.unionByName(short)
    coord = [f"coord_{i}_scaled" for i in range(ndim)]
    ends = nodes_.select("trace_id", "pid", "node_id", "degree", "component_id", *coord)
    one = ends.toDF("trace_id", "p0", "node_id_src", "d0", "skeleton_component", *[f"a{i}" for i in range(ndim)])
    two = ends.drop("component_id").toDF("trace_id", "p1", "node_id_dst", "d1", *[f"b{i}" for i in range(ndim)])
    b = b.join(one, ["trace_id", "p0"]).join(two, ["trace_id", "p1"])
    code = (
        F.when(F.col("p0") == F.col("p1"), 3)
        .when((F.col("d0") == 1) & (F.col("d1") == 1), 0)
        .when((F.col("d0") == 1) | (F.col("d1") == 1), 1)
        .otherwise(2)
    )
    gap = F.sqrt(sum((F.pow(F.col(f"a{i}") - F.col(f"b{i}"), 2) for i in range(ndim)), F.lit(0.0)))
    b = b.withColumns({"branch_type_code": code, "euclidean_distance": gap})
    z, y, x = unpacked("p0")
    b = b.withColumns({"_z": z, "_y": y, "_x": x, "_first": F.struct("p1", "root")})
    b = cut(number_rows(b, ["trace_id"], ["_z", "_y", "_x", "_first"], "branch_id", start=0).drop("_first"))
    inside = chain.join(b.where("root IS NOT NULL").select("trace_id", "root", "branch_id"), ["trace_id", "root"])
    tips = b.select("trace_id", F.explode(F.array("p0", "p1")).alias("pid"), "branch_id")
    members = inside.select("trace_id", "pid", "branch_id").unionByName(tips).distinct()
    table = salted_join(b, _spacing(images, ndim).select("trace_id", "physical"), ["trace_id"], ["branch_id"])
    return branch_columns(table), members


def branch_columns(b: DataFrame) -> DataFrame:
    """Named type, scaled and micrometre lengths, tortuosity."""
    names = F.create_map(*[F.lit(v) for kv in BRANCH_TYPES.items() for v in kv])
    um = lambda c: F.when(F.col("physical"), F.col(c))
    return b.select(
        "trace_id",
        "branch_id",
        "skeleton_component",
        "node_id_src",
        "node_id_dst",
        "branch_length",
        "branch_type_code",
        F.coalesce(F.try_element_at(names, F.col("branch_type_code")), F.lit("unknown")).alias("branch_type"),
        "euclidean_distance",
        F.col("branch_length").alias("branch_length_scaled"),
        um("branch_length").alias("branch_length_um"),
        F.col("euclidean_distance").alias("euclidean_distance_scaled"),
        um("euclidean_distance").alias("euclidean_distance_um"),
        F.try_divide("branch_length", "euclidean_distance").alias("tortuosity"),
    )


def trace_graph(skel: DataFrame, images: DataFrame, ndim: int = 2) -> TraceGraph:
    """All graph tables of skeleton voxels."""
    steps = cut(_steps(skel, ndim))
    n = cut(nodes(skel, images, ndim, steps))
    e = cut(edges(n, steps, images, ndim))
    b, m = branches(n, e, images, ndim)
    return TraceGraph(n, e, b, components(n, e), m)


def skeletonize(
    mask: DataFrame, images: DataFrame, min_branch_length: float = 0.0, ndim: int = 2
) -> tuple[DataFrame, TraceGraph]:
    """Thin a mask and build its graph; optionally drop short branches, unless that
    would drop every branch of the trace (G5).

    Masks come from ``binary_mask`` or labels.  A trace whose skeleton is empty has no
    rows.
    """
    skel = thin(mask, ndim)
    graph = trace_graph(skel, images, ndim)
    if min_branch_length <= 0:
        return skel, graph
    return _without(skel, graph, F.col("branch_length") < float(min_branch_length), images, ndim)[:2]


def prune(
    skel: DataFrame,
    graph: TraceGraph,
    images: DataFrame,
    min_length: float,
    remove_isolated: bool = True,
    ndim: int = 2,
) -> tuple[DataFrame, TraceGraph, DataFrame]:
    """Remove branches shorter than ``min_length`` in one pass and rebuild.

    Returns the skeleton, its graph, and per trace n_removed, n_paths_before.  Losing
    every branch of a trace is an error.
    """
    short = F.col("branch_length") < float(min_length)
    if not remove_isolated:
        short = short & (F.col("branch_type_code") != 0)
    return _without(skel, graph, short, images, ndim, strict=True)


def _without(skel, graph, short: Column, images, ndim, strict: bool = False):
    marked = graph.branches.withColumn("_short", short)
    totals = marked.groupBy("trace_id").agg(
        F.count_if("_short").alias("n_removed"), F.count("*").alias("n_paths_before")
    )
    if strict:
        ok = F.col("n_removed") < F.col("n_paths_before")
        fail = F.raise_error(F.concat(F.lit("pruning would remove all branches of "), F.col("trace_id")))
        totals = totals.withColumn("n_removed", F.when(ok, F.col("n_removed")).otherwise(fail))
    totals = cut(totals)
    touched = totals.where("n_removed > 0 AND n_removed < n_paths_before").select("trace_id")
    gone = marked.where("_short").join(touched, "trace_id", "left_semi").select("trace_id", "branch_id")
    # junction voxels stay: other branches meet there
    wipe = graph.members.join(gone, ["trace_id", "branch_id"], "left_semi").join(
        graph.nodes.where("degree <= 2").select("trace_id", "pid"), ["trace_id", "pid"], "left_semi"
    )
    z, y, x = unpacked("pid")
    wipe = wipe.select(F.col("trace_id").alias("image_id"), z.alias("z"), y.alias("y"), x.alias("x")).distinct()
    kept = skel.join(wipe, ["image_id", "z", "y", "x"], "left_anti").select(*VOXEL_KEY)
    thinned = thin(kept, ndim)
    return thinned, trace_graph(thinned, images, ndim), totals


def branch_metrics(branches_: DataFrame) -> DataFrame:
    """Branch counts by type and total length per trace."""
    return branches_.groupBy("trace_id", "branch_type").agg(
        F.count("*").alias("n_branches"), F.sum("branch_length").alias("total_length")
    )


# ---------------------------------------------------------------- morphology


def soma(
    points: DataFrame | None = None, mask: DataFrame | None = None, images: DataFrame | None = None, ndim: int = 2
) -> DataFrame:
    """Reference point per trace: the first point, or the scaled mask centre.

    points: trace_id, point_index, c0, c1[, c2].  mask: label voxels (label > 0).
    """
    if points is None and mask is None:
        raise ValueError("give points or a mask")
    cs = [f"c{i}" for i in range(ndim)]
    if points is not None:
        first = F.min_by(F.struct(*cs), "point_index").alias("p")
        return points.groupBy("trace_id").agg(first).select("trace_id", *[F.col(f"p.{c}").cast("double").alias(c) for c in cs])
    rows = mask.where("label > 0") if "label" in mask.columns else mask
    centre = rows.groupBy(F.col("image_id").alias("trace_id")).agg(*[F.avg(a).alias(a) for a in _axes(ndim)])
    if images is None:
        return centre.select("trace_id", *[F.col(a).alias(c) for a, c in zip(_axes(ndim), cs)])
    scaled = centre.join(_spacing(images, ndim), "trace_id")
    return scaled.select("trace_id", *[(F.col(a) * F.col(f"s_{a}")).alias(c) for a, c in zip(_axes(ndim), cs)])


def dominant_region(nodes_: DataFrame, regions: DataFrame, ndim: int = 2) -> DataFrame:
    """Most frequent region under the nodes, smallest id on ties, null if none."""
    reg = regions.where("label > 0").select(
        F.col("image_id").alias("trace_id"), packed().alias("pid"), F.col("label").alias("region")
    )
    hits = nodes_.select("trace_id", "pid").join(reg, ["trace_id", "pid"])
    counts = hits.groupBy("trace_id", "region").agg(F.count("*").alias("n"))
    best = counts.groupBy("trace_id").agg(
        F.max_by("region", F.struct("n", (-F.col("region")).alias("r"))).alias("region")
    )
    return nodes_.select("trace_id").distinct().join(best, "trace_id", "left")


def node_distances(
    nodes_: DataFrame, soma_: DataFrame | None = None, center: str = "soma", ndim: int = 2
) -> DataFrame:
    """trace_id, pid, distance to the centre, and which centre was used."""
    coord = [f"coord_{i}_scaled" for i in range(ndim)]
    cs = [f"c{i}" for i in range(ndim)]
    if center in ("soma", "centroid"):
        mean = nodes_.groupBy("trace_id").agg(*[F.avg(c).alias(m) for c, m in zip(coord, cs)])
        where = mean.withColumn("center", F.lit("centroid"))
        if center == "soma" and soma_ is not None:
            given = soma_.select("trace_id", *[F.col(c).alias(f"_{c}") for c in cs], F.lit(True).alias("_has"))
            where = mean.join(given, "trace_id", "left").select(
                "trace_id",
                *[F.when(F.col("_has"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in cs],
                F.when(F.col("_has"), F.lit("soma")).otherwise(F.lit("centroid")).alias("center"),
            )
        out = salted_join(nodes_.select("trace_id", "pid", *coord), where, ["trace_id"], ["pid"])
    else:
        values = [float(v) for v in center.split(",")]
        if len(values) != ndim:
            raise ValueError(f"center must have {ndim} comma-separated values")
        out = nodes_.select("trace_id", "pid", *coord, F.lit("explicit").alias("center"))
        out = out.withColumns({c: F.lit(v) for c, v in zip(cs, values)})
    gap = F.sqrt(sum((F.pow(F.col(a) - F.col(c), 2) for a, c in zip(coord, cs)), F.lit(0.0)))
    return out.select("trace_id", "pid", gap.alias("distance"), "center")


def sholl(
    nodes_: DataFrame,
    edges_: DataFrame,
    soma_: DataFrame | None = None,
    center: str = "soma",
    step: float = 5.0,
    max_radius: float | None = None,
    ndim: int = 2,
) -> tuple[DataFrame, DataFrame]:
    """Intersections per radius, and peak / area under the curve per trace.

    An edge meets a radius r exactly when r lies between its end distances, so each
    edge lists its own few radii and the rest is a group-by: no range join.
    """
    if step <= 0:
        raise ValueError("step must be positive")
    dist = node_distances(nodes_, soma_, center, ndim)
    far = F.max("distance") if max_radius is None else F.lit(float(max_radius))
    reach = dist.groupBy("trace_id").agg(far.alias("reach"), F.first("center").alias("center"))
    n_radii = F.greatest(F.lit(0), F.ceil((F.col("reach") + 1e-9 - F.lit(step)) / F.lit(step))).cast("int")
    traces = reach.select("trace_id", "center", n_radii.alias("n_radii"))
    d = dist.select("trace_id", "pid", "distance")
    e = edges_.select("trace_id", "src", "dst")
    e = e.join(d.toDF("trace_id", "src", "da"), ["trace_id", "src"])
    e = e.join(d.toDF("trace_id", "dst", "db"), ["trace_id", "dst"])
    e = e.select("trace_id", F.least("da", "db").alias("lo"), F.greatest("da", "db").alias("hi"))
    first = F.greatest(F.lit(1), (F.floor(F.col("lo") / step) - 1).cast("int"))
    last = (F.floor(F.col("hi") / step) + 1).cast("int")
    radius = F.lit(step) + (F.col("k") - 1) * F.lit(step)
    hits = (
        e.withColumns({"_f": first, "_l": last})
        .where("_l >= _f")
        .select("trace_id", "lo", "hi", F.explode(F.sequence("_f", "_l")).alias("k"))
        .where((radius >= F.col("lo")) & (radius <= F.col("hi")))
        .groupBy("trace_id", "k")
        .agg(F.count("*").alias("n"))
    )
    radii = traces.where("n_radii > 0").select("trace_id", F.explode(F.sequence(F.lit(1), F.col("n_radii"))).alias("k"))
    profile = radii.join(hits, ["trace_id", "k"], "left").select(
        "trace_id", radius.alias("radius_um"), F.coalesce("n", F.lit(0)).alias("intersections")
    )
    w = Window.partitionBy("trace_id").orderBy("radius_um")
    strips = profile.withColumn(
        "strip",
        (F.col("intersections") + F.lag("intersections").over(w))
        / F.lit(2.0)
        * (F.col("radius_um") - F.lag("radius_um").over(w)),
    )
    peak = strips.groupBy("trace_id").agg(
        F.max("intersections").alias("peak_intersections"),
        F.max_by("radius_um", F.struct("intersections", (-F.col("radius_um")).alias("r"))).alias("peak_radius_um"),
        F.coalesce(F.sum("strip"), F.lit(0.0)).alias("area_under_curve"),
    )
    peak = traces.join(peak, "trace_id", "left").na.fill(0)
    return profile, peak


def morphology(
    nodes_: DataFrame, branches_: DataFrame, components_: DataFrame, images: DataFrame, ndim: int = 2
) -> DataFrame:
    """Aggregate descriptors per trace."""
    lengths = branches_.groupBy("trace_id").agg(
        F.sum("branch_length").alias("total_length"),
        F.avg("branch_length").alias("mean_branch_length"),
        F.count("*").alias("n_branches"),
        F.count_if(F.col("branch_type_code").isin(0, 1)).alias("n_terminal_branches"),
        F.count_if(F.col("branch_type_code") == 2).alias("n_internal_branches"),
    )
    median = exact_percentiles(branches_, ["trace_id"], "branch_length", {"median_branch_length": 0.5})
    spans = [
        (F.max(f"coord_{i}_scaled") - F.min(f"coord_{i}_scaled")).alias(f"bbox_{i}") for i in range(ndim)
    ]
    shape = nodes_.groupBy("trace_id").agg(
        F.count_if(F.col("degree") == 1).alias("n_endpoints"),
        F.count_if(F.col("degree") > 2).alias("n_junctions"),
        F.count("*").alias("skeleton_voxels"),
        *spans,
    )
    comps = components_.groupBy("trace_id").agg(F.count("*").alias("n_components"))
    size = F.lit(1).cast("double")
    for a in _axes(ndim):
        size = size * F.col(f"size_{a}")
    extent = images.select(F.col("image_id").alias("trace_id"), size.alias("_size")).join(
        _spacing(images, ndim).select("trace_id", "physical"), "trace_id"
    )
    out = shape.join(comps, "trace_id").join(lengths, "trace_id", "left").join(median, "trace_id", "left")
    out = out.join(extent, "trace_id").na.fill(0)
    unit = F.when(F.col("physical"), F.lit("um")).otherwise(F.lit("pixels"))
    return (
        out.withColumn("skeleton_volume_occupancy", F.col("skeleton_voxels") / F.col("_size"))
        .withColumn("length_unit", unit)
        .drop("_size", "physical")
    )


# ---------------------------------------------------------------- tree export rows


def swc_rows(
    nodes_: DataFrame,
    edges_: DataFrame,
    soma_: DataFrame | None = None,
    ndim: int = 2,
    box: tuple[int, int, int] = (64, 256, 256),
) -> DataFrame:
    """Rows of an SWC tree (G9, T3): id, type, x, y, z, radius, parent.

    Hop distances from the root spread block by block (each block runs to its own
    fixpoint, then halos are exchanged), so the number of rounds follows the number of
    blocks a path crosses.  A node's parent is its smallest neighbour one hop nearer;
    nodes outside the root's component become roots of their own.
    """
    coord = [f"coord_{i}_scaled" for i in range(ndim)]
    root = F.coalesce(F.min(F.when(F.col("degree") == 1, F.col("node_id"))), F.lit(0).cast("long"))
    start = nodes_.groupBy("trace_id").agg(root.alias("root"))
    if soma_ is not None:
        gap = node_distances(nodes_.join(soma_.select("trace_id"), "trace_id", "left_semi"), soma_, "soma", ndim)
        near = gap.join(nodes_.select("trace_id", "pid", "node_id"), ["trace_id", "pid"])
        near = near.groupBy("trace_id").agg(F.min_by("node_id", F.struct("distance", "node_id")).alias("_near"))
        start = start.join(near, "trace_id", "left").select("trace_id", F.coalesce("_near", "root").alias("root"))
    z, y, x = unpacked("pid")
    state = salted_join(nodes_.select("trace_id", "pid", "node_id"), start, ["trace_id"], ["pid"])
    state = state.select(
        "trace_id", z.alias("z"), y.alias("y"), x.alias("x"),
        F.when(F.col("node_id") == F.col("root"), F.lit(0)).otherwise(F.lit(-1)).alias("hops"),
    )
    rim = (1, 1, 1) if ndim == 3 else (0, 1, 1)
    forward = offsets(ndim, True, True)
    far = 1 << 40

    def spread(pdf: pd.DataFrame) -> pd.DataFrame:
        grid, core, _ = dense(pdf, box, rim)
        a, b = neighbour_pairs(grid, forward)
        src, dst = np.concatenate([a, b]), np.concatenate([b, a])
        hops = pdf["hops"].to_numpy("int64").copy()
        hops[hops < 0] = far
        while True:
            new = hops.copy()
            np.minimum.at(new, dst, hops[src] + 1)
            if np.array_equal(new, hops):
                break
            hops = new
        hops[hops >= far] = -1
        out = pdf[["trace_id", "z", "y", "x"]].assign(hops=hops, moved=hops != pdf["hops"].to_numpy())
        return out[core]

    schema = "trace_id string, z int, y int, x int, hops int, moved boolean"
    state = cut(state)
    while True:
        blocks = to_blocks(state.select("trace_id", "z", "y", "x", "hops"), box, rim)
        state = cut(blocks.groupBy("trace_id", "bz", "by", "bx").applyInPandas(spread, schema))
        if not state.where("moved").limit(1).count():
            break
    hops = state.select("trace_id", packed().alias("pid"), "hops")
    both = edges_.select("trace_id", "src", "dst", "node_id_src", "node_id_dst")
    both = both.select("trace_id", F.col("src").alias("pid"), F.col("dst").alias("other"), F.col("node_id_dst").alias("oid")).unionByName(
        both.select("trace_id", F.col("dst").alias("pid"), F.col("src").alias("other"), F.col("node_id_src").alias("oid"))
    )
    nearer = both.join(hops, ["trace_id", "pid"]).join(
        hops.toDF("trace_id", "other", "oh"), ["trace_id", "other"]
    ).where("hops > 0 AND oh = hops - 1")
    parent = nearer.groupBy("trace_id", "pid").agg(F.min("oid").alias("parent_id"))
    out = nodes_.select("trace_id", "pid", "node_id", *coord).join(parent, ["trace_id", "pid"], "left")
    zyx = coord if ndim == 3 else [None, *coord]
    zc = F.lit(0.0) if ndim == 2 else F.col(zyx[0])
    return out.select(
        "trace_id",
        (F.col("node_id") + 1).alias("id"),
        F.lit(3).alias("type"),
        F.col(zyx[2]).alias("x"),
        F.col(zyx[1]).alias("y"),
        zc.alias("z"),
        F.lit(0.5).alias("radius"),
        F.coalesce(F.col("parent_id") + 1, F.lit(-1)).alias("parent"),
    )


def trace_summary(traces: DataFrame, trace_qc: DataFrame) -> DataFrame:
    """Trace records with their review state."""
    return traces.join(trace_qc, "trace_id", "left")
