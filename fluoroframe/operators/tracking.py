"""Object detections and frame-to-frame linking."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, functions as F

from fluoroframe.plans.cut import cut
from fluoroframe.plans.graph import connected
from fluoroframe.plans.ranks import number_rows


def detections(labels: DataFrame) -> DataFrame:
    """One row per (image, frame, label) with its centroid."""
    return (
        labels.where("label > 0")
        .groupBy("image_id", "t", "label")
        .agg(F.avg("z").alias("z"), F.avg("y").alias("y"), F.avg("x").alias("x"))
    )


# Most target places a grid cell may hold before a finer grid is searched first, and
# the most grids.
CELL_LIMIT = 16
GRIDS = 22


def _cells(axes: str, size: float) -> list:
    return [F.floor(F.col(a) / size).cast("long").alias(f"c{a}") for a in axes]


def _grid_sizes(dets: DataFrame, radius: float, axes: str) -> list[float]:
    """Cell sizes to search, finest first.

    Every further level halves the cell per axis and is only added while cells hold too
    many places, so crowded places find their neighbour on a fine grid, never meet the
    coarse one, and a source meets few candidates at every density.
    """
    places = dets.select("image_id", "t", *axes).distinct()
    sizes = [radius]
    while len(sizes) < GRIDS:
        cell = places.groupBy("image_id", "t", *_cells(axes, sizes[0])).count()
        if (cell.agg(F.max("count")).first()[0] or 0) <= CELL_LIMIT:
            break
        sizes.insert(0, sizes[0] / 2)
    return sizes


def _nearest(src: DataFrame, dst: DataFrame, gap: int, sizes: list[float], axes: str) -> DataFrame:
    """For every source the closest target ``gap`` frames later within the last size.

    A target closer than one cell lies in the cells around the source, so a hit on a
    fine grid is final and only the rest moves on to the next grid.  Targets at one
    place count once (smallest label).  The minimum is taken by partial aggregation;
    candidate pairs are never collected.  Ties: smaller distance, label, then id; as ids
    follow the labels within a frame, the smallest id is that of the smallest label.
    """
    place = ["image_id", "t", *axes]
    spots = dst.groupBy(*place).agg(F.min("id").alias("who"))
    around = F.explode(
        F.array(
            *[
                F.struct(*[F.lit(v).alias(f"o{a}") for a, v in zip(axes, o)])
                for o in product((-1, 0, 1), repeat=len(axes))
            ]
        )
    )
    best, left = None, src
    for size in sizes:
        here = left.select("image_id", F.col("t") + gap, "id", *axes, *_cells(axes, size), around.alias("o"))
        here = here.toDF("image_id", "t", "src", *[f"s{a}" for a in axes], *[f"c{a}" for a in axes], "o")
        here = here.withColumns({f"c{a}": F.col(f"c{a}") + F.col(f"o.o{a}") for a in axes}).drop("o")
        there = spots.select("image_id", "t", "who", *axes, *_cells(axes, size))
        pairs = here.join(there, ["image_id", "t", *[f"c{a}" for a in axes]])
        dist = F.sqrt(sum((F.pow(F.col(f"s{a}") - F.col(a), 2) for a in axes), F.lit(0.0)))
        hit = pairs.withColumn("d", dist).where(F.col("d") <= size)
        found = hit.groupBy("image_id", "src").agg(F.min(F.struct("d", "who")).alias("m"))
        found = found.select("image_id", "src", F.col("m.who").alias("dst"), "m.d")
        if size != sizes[-1]:
            found = cut(found)  # read by the union and by every coarser grid
        best = found if best is None else best.unionByName(found)
        if size != sizes[-1]:
            left = left.join(found.select("image_id", F.col("src").alias("id")), ["image_id", "id"], "left_anti")
    return best


def link(
    dets: DataFrame, search_radius: float = 50.0, max_lost: int = 5, ndim: int = 2
) -> tuple[DataFrame, DataFrame]:
    """Links between detections: mutual nearest neighbours, frame gap 1 first.

    A gap of g frames only connects track ends left open by all smaller gaps.
    Returns (numbered detections, links).
    """
    axes = "zyx" if ndim == 3 else "yx"
    dets = number_rows(dets, ["image_id"], ["t", "label"], "id", start=0)
    dets = cut(dets)
    sizes = _grid_sizes(dets, float(search_radius), axes)
    links = None
    heads, tails = dets, dets
    for gap in range(1, max_lost + 2):
        ahead = _nearest(heads, tails, gap, sizes, axes)
        # the same search seen from the later frame: its closest earlier open end
        back = _nearest(tails, heads, -gap, sizes, axes)
        back = back.select("image_id", F.col("src").alias("dst"), F.col("dst").alias("src"))
        new = cut(ahead.join(back, ["image_id", "src", "dst"]).select("image_id", "src", "dst", F.lit(gap).alias("gap"), "d"))
        links = new if links is None else links.unionByName(new)
        heads = cut(heads.join(new.select("image_id", F.col("src").alias("id")), ["image_id", "id"], "left_anti"))
        tails = cut(tails.join(new.select("image_id", F.col("dst").alias("id")), ["image_id", "id"], "left_anti"))
    return dets, links


def track(
    dets: DataFrame, search_radius: float = 50.0, max_lost: int = 5, ndim: int = 2
) -> DataFrame:
    """track_id, t[, z], y, x, label per detection (K2).

    Nearest-neighbour linking, not a Bayesian motion model.  Track ids are dense per
    image in the order of each track's first detection.
    """
    dets, links = link(dets, search_radius, max_lost, ndim)
    roots = connected(links, ["image_id"])
    owner = dets.join(roots.withColumnRenamed("node", "id"), ["image_id", "id"], "left")
    owner = cut(owner.withColumn("root", F.coalesce("root", "id")))
    firsts = owner.where("id = root").select("image_id", "root", F.col("t").alias("_t"), F.col("label").alias("_l"))
    ids = number_rows(firsts, ["image_id"], ["_t", "_l"], "track_id", start=1).drop("_t", "_l")
    cols = ["t", "z", "y", "x"] if ndim == 3 else ["t", "y", "x"]
    return owner.join(ids, ["image_id", "root"]).select("image_id", "track_id", *cols, "label")


def track_counts(tracks: DataFrame) -> DataFrame:
    """Distinct tracks and detections per image."""
    return tracks.groupBy("image_id").agg(
        F.count_distinct("track_id").alias("n_tracks"), F.count("*").alias("n_detections")
    )
