"""Connected components of voxel masks and what is built on them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from fluoroframe.plans.blocks import (
    BOX,
    block_keys,
    dense,
    neighbour_pairs,
    offsets,
    step_column,
    unpacked,
)
from fluoroframe.plans.cut import cut
from fluoroframe.plans.graph import connected, merge_pairs
from fluoroframe.plans.ranks import number_rows
from fluoroframe.plans.skew import join_renamed, salted_join
from fluoroframe.sources.tiles import VOXEL_KEY

FRAME = ["image_id", "t"]


def components_of(
    mask: DataFrame, ndim: int = 2, full: bool = False, box: tuple[int, int, int] = BOX
) -> tuple[DataFrame, DataFrame]:
    """Components in two tables, so that no join key is ever a whole component.

    voxels: VOXEL_KEY, local     local = first voxel of the component inside its block
    parts:  image_id, t, local, root, n     root = first voxel of the whole component

    Blocks are labelled on their own; only voxels on block faces are joined across
    block borders; the resulting small graph of block parts is merged by
    ``connected``.
    """
    steps = offsets(ndim, full, forward=True)

    def label_block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["z", "y", "x"], ignore_index=True)
        if len(pdf) and pdf[["z", "y", "x"]].to_numpy().max() >> 21:
            raise ValueError("voxel positions must be below 2097152 on every axis")
        grid, _, _ = dense(pdf, box, (0, 0, 0))
        a, b = neighbour_pairs(grid, steps)
        root = merge_pairs(len(pdf), a, b)
        pid = (
            (pdf["z"].to_numpy("int64") << 42)
            + (pdf["y"].to_numpy("int64") << 21)
            + pdf["x"].to_numpy("int64")
        )
        return pdf[VOXEL_KEY].assign(local=pid[root])

    kinds = dict(mask.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in VOXEL_KEY) + ", local long"
    blocks = mask.select(*VOXEL_KEY, *block_keys(box))
    vox = cut(blocks.groupBy(*FRAME, "bz", "by", "bx").applyInPandas(label_block, schema))

    on_face = " OR ".join(f"{a} % {b} = 0 OR {a} % {b} = {b - 1}" for a, b in zip("zyx", box))
    rim = vox.where(on_face)
    ahead = rim.select(*FRAME, "z", "y", "x", "local", step_column(steps).alias("s")).select(
        *FRAME,
        F.col("local").alias("src"),
        *[(F.col(a) + F.col(f"s.d{a}")).alias(a) for a in "zyx"],
        *[F.expr(f"{a} div {b}").alias(f"_b{a}") for a, b in zip("zyx", box)],
    )
    outside = " OR ".join(f"{a} div {b} != _b{a}" for a, b in zip("zyx", box))
    seams = ahead.where(outside).join(
        rim.select(*FRAME, "z", "y", "x", F.col("local").alias("dst")), [*FRAME, "z", "y", "x"]
    )
    merged = connected(seams.select(*FRAME, "src", "dst").distinct(), FRAME)
    parts = vox.groupBy(*FRAME, "local").agg(F.count("*").alias("n"))
    parts = parts.join(merged.withColumnRenamed("node", "local"), [*FRAME, "local"], "left")
    parts = parts.select(*FRAME, "local", F.coalesce("root", "local").alias("root"), "n")
    return vox, cut(parts)


def _number(parts: DataFrame) -> DataFrame:
    """parts with label 1..n per frame in raster order of the first voxel."""
    z, y, x = unpacked("root")
    sizes = parts.groupBy(*FRAME, "root").agg(F.sum("n").alias("size"))
    sizes = sizes.withColumns({"_z": z, "_y": y, "_x": x})
    numbered = number_rows(sizes, FRAME, ["_z", "_y", "_x"], "label", start=1)
    small = numbered.select(*FRAME, F.col("root").alias("r"), F.col("label").cast("int").alias("label"), "size")
    return join_renamed(parts, small, [*FRAME, "root"], [*FRAME, "r"])


def label_components(
    mask: DataFrame, ndim: int = 2, full: bool = False, box: tuple[int, int, int] = BOX
) -> DataFrame:
    """Label voxels 1..n per (image, t) in raster order; face connectivity by default."""
    vox, parts = components_of(mask, ndim, full, box)
    labelled = _number(parts).select(*FRAME, "local", "label")
    return vox.join(labelled, [*FRAME, "local"]).select(*VOXEL_KEY, "label")


def remove_small(
    mask: DataFrame, min_pixels: int | DataFrame, ndim: int = 2, box: tuple[int, int, int] = BOX
) -> DataFrame:
    """Drop components with fewer voxels than ``min_pixels``: one number, or a table
    image_id, min_pixels."""
    vox, parts = components_of(mask, ndim, box=box)
    sizes = parts.groupBy(*FRAME, "root").agg(F.sum("n").alias("size"))
    if isinstance(min_pixels, DataFrame):
        sizes = salted_join(sizes, min_pixels.select("image_id", "min_pixels"), ["image_id"], ["root"])
        keep = sizes.where("size >= min_pixels")
    else:
        keep = sizes.where(F.col("size") >= int(min_pixels))
    keep = keep.select(*FRAME, F.col("root").alias("r"))
    kept = join_renamed(parts, keep, [*FRAME, "root"], [*FRAME, "r"])
    return vox.join(kept.select(*FRAME, "local"), [*FRAME, "local"], "left_semi").select(*VOXEL_KEY)


def keep_largest(mask: DataFrame, ndim: int = 2, box: tuple[int, int, int] = BOX) -> DataFrame:
    """Labels of the component with the most voxels (first in raster order on ties)."""
    vox, parts = components_of(mask, ndim, box=box)
    sizes = parts.groupBy(*FRAME, "root").agg(F.sum("n").alias("size"))
    best = sizes.groupBy(*FRAME).agg(
        F.max_by("root", F.struct("size", (-F.col("root")).alias("o"))).alias("best")
    )
    kept = salted_join(parts, best, FRAME, ["local"]).where("root = best").select(*FRAME, "local")
    return vox.join(kept, [*FRAME, "local"], "left_semi").select(*VOXEL_KEY, F.lit(1).alias("label"))


def min_size_pixels(images: DataFrame, min_size_um3: float) -> DataFrame:
    """Smallest object in voxels: max(1, ceil(um3 / voxel measure)); 1 per voxel when
    unscaled (F15)."""
    sizes = [F.col(f"voxel_{a}").cast("double") for a in "zyx"]
    physical = sum((F.when(F.abs(s - 1.0) > 1e-9, 1).otherwise(0) for s in sizes), F.lit(0)) > 0
    spatial = F.when(F.col("size_z") > 1, sizes[0] * sizes[1] * sizes[2]).otherwise(sizes[1] * sizes[2])
    measure = F.when(physical, spatial).otherwise(F.lit(1.0))
    pixels = F.greatest(F.lit(1).cast("long"), F.ceil(F.lit(float(min_size_um3)) / measure))
    return images.select("image_id", pixels.alias("min_pixels"))


def image_grid(images: DataFrame, frames: DataFrame) -> DataFrame:
    """All voxel positions of the given (image_id, t) frames."""
    size = frames.select(*FRAME).distinct().join(
        images.select("image_id", "size_z", "size_y", "size_x"), "image_id"
    )
    out = size
    for a in "zyx":
        span = F.sequence(F.lit(0), F.col(f"size_{a}") - 1)
        out = out.withColumn(a, F.explode(span))
        if a == "y":
            # spread planes and rows before the last and largest expansion
            out = out.repartition("image_id", "t", "z", "y")
    return out


def fill_holes(
    mask: DataFrame, images: DataFrame, ndim: int = 2, box: tuple[int, int, int] = BOX
) -> DataFrame:
    """Add background components that do not reach the image border."""
    grid = image_grid(images, mask)
    background = grid.join(mask.select(*VOXEL_KEY), VOXEL_KEY, "left_anti")
    vox, parts = components_of(background.select(*VOXEL_KEY), ndim, box=box)
    axes = "zyx" if ndim == 3 else "yx"
    ends = salted_join(vox, images.select("image_id", *[f"size_{a}" for a in "zyx"]), ["image_id"], ["z", "y", "x"])
    edge = ends.where(" OR ".join(f"{a} = 0 OR {a} = size_{a} - 1" for a in axes))
    open_parts = parts.join(edge.select(*FRAME, "local").distinct(), [*FRAME, "local"], "left_semi")
    open_roots = open_parts.select(*FRAME, F.col("root").alias("r")).distinct()
    reached = join_renamed(parts, open_roots, [*FRAME, "root"], [*FRAME, "r"]).select(*FRAME, "local")
    closed = parts.join(reached, [*FRAME, "local"], "left_anti").select(*FRAME, "local")
    holes = vox.join(closed, [*FRAME, "local"], "left_semi").select(*VOXEL_KEY)
    return mask.select(*VOXEL_KEY).unionByName(holes)


def label_outline(labels: DataFrame, images: DataFrame, ndim: int = 2) -> DataFrame:
    """Outer boundary pixels of a label image.

    A background pixel is on the outline when a face neighbour is labelled; a
    labelled pixel when a face neighbour differs and another object lies among all
    its neighbours.
    """
    axes = "zyx" if ndim == 3 else "yx"
    near = [(0, 0, 0), *offsets(ndim, full=True)]
    sent = labels.where("label > 0").select(*VOXEL_KEY, "label", step_column(near).alias("s"))
    sent = sent.select(
        *FRAME,
        *[(F.col(a) - F.col(f"s.d{a}")).alias(a) for a in "zyx"],
        "label",
        F.expr("abs(s.dz) + abs(s.dy) + abs(s.dx)").alias("far"),
    )
    seen = sent.groupBy(*VOXEL_KEY).agg(
        F.max(F.when(F.col("far") == 0, F.col("label"))).alias("own"),
        F.max(F.when(F.col("far") <= 1, F.col("label"))).alias("face_max"),
        F.min(F.when(F.col("far") <= 1, F.col("label"))).alias("face_min"),
        F.count_if(F.col("far") <= 1).alias("face_n"),
        F.max("label").alias("all_max"),
        F.min("label").alias("all_min"),
    )
    size = images.select("image_id", *[f"size_{a}" for a in "zyx"])
    inside = salted_join(seen, size, ["image_id"], ["z", "y", "x"]).where(
        " AND ".join(f"{a} >= 0 AND {a} < size_{a}" for a in axes)
    )
    around = F.lit(1)
    for a in axes:
        around = around + F.expr(f"int({a} > 0) + int({a} < size_{a} - 1)")
    differs = (F.col("face_max") != F.col("face_min")) | (F.col("face_n") < around)
    background = F.col("own").isNull() & (F.col("face_n") > 0)
    touching = F.col("own").isNotNull() & differs & (F.col("all_max") != F.col("all_min"))
    return inside.where(background | touching).select(*VOXEL_KEY)
