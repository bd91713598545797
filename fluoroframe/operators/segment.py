"""Segmentation chains and label summaries."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from fluoroframe.operators.components import (
    FRAME,
    fill_holes as fill,
    keep_largest as largest,
    label_components,
    min_size_pixels,
    remove_small,
)
from fluoroframe.operators.filters import local_threshold
from fluoroframe.operators.threshold import above_threshold, resolve_threshold
from fluoroframe.plans.blocks import packed
from fluoroframe.plans.cut import cut
from fluoroframe.plans.graph import connected
from fluoroframe.plans.ranks import number_rows, weighted_median
from fluoroframe.plans.skew import join_renamed, salted_join
from fluoroframe.sources.tiles import VOXEL_KEY, tiles_from_voxels


def threshold_mask(
    vox: DataFrame, images: DataFrame, threshold: float | str = "otsu", bins: int | str = 256
) -> tuple[DataFrame, DataFrame]:
    """Mask of one channel and the threshold value per image."""
    mode = str(threshold).lower().strip()
    if mode in ("local", "adaptive"):
        mask = local_threshold(tiles_from_voxels(vox), images)
        side = F.greatest(F.lit(3), F.least(F.lit(31), "size_y", "size_x"))
        block = side - F.when(side % 2 == 0, 1).otherwise(0)
        value = images.select("image_id", F.concat(F.lit("local_block_"), block.cast("string")).alias("threshold_value"))
        return mask, value
    limits = resolve_threshold(vox, threshold, bins, images)
    mask = above_threshold(vox, limits).select(*VOXEL_KEY)
    return mask, limits.select("image_id", F.col("threshold").cast("string").alias("threshold_value"))


def segment_processes(
    vox: DataFrame,
    images: DataFrame,
    threshold: float | str = "otsu",
    min_size_um3: float | None = None,
    fill_holes: bool = False,
    keep_largest: bool = False,
    ndim: int = 2,
    bins: int | str = 256,
) -> tuple[DataFrame, DataFrame]:
    """Threshold, fill, remove small, label, keep the largest.

    ``vox`` holds one channel.  Returns the label voxels and one QC row per image.
    """
    mask, value = threshold_mask(vox, images, threshold, bins)
    if fill_holes:
        mask = fill(cut(mask), images, ndim)
    if min_size_um3 is not None and min_size_um3 > 0:
        mask = remove_small(mask, min_size_pixels(images, min_size_um3), ndim)
    labels = largest(mask, ndim) if keep_largest else label_components(mask, ndim)
    labels = cut(labels)
    return labels, foreground_qc(labels, images, value)


def foreground_qc(labels: DataFrame, images: DataFrame, value: DataFrame) -> DataFrame:
    """Foreground fraction, component count, warnings and status per image."""
    per_frame = labels.groupBy(*FRAME).agg(F.count("*").alias("n"), F.max("label").alias("c"))
    sums = per_frame.groupBy("image_id").agg(F.sum("n").alias("n"), F.sum("c").alias("component_count"))
    total = F.col("size_t").cast("double") * F.col("size_z") * F.col("size_y") * F.col("size_x")
    out = images.select("image_id", total.alias("_all")).join(sums, "image_id", "left").na.fill(0)
    out = out.join(value, "image_id", "left")
    share = F.col("n") / F.col("_all")
    count = F.col("component_count").cast("long")
    # Warning texts and limits.
    warn = F.array_compact(
        F.array(
            F.when(share < 0.0005, F.lit("Foreground fraction is very low; threshold may be too stringent.")),
            F.when(share > 0.35, F.lit("Foreground fraction is high for sparse neural process tracing.")),
            F.when(count == 0, F.lit("No connected process components were found.")),
        )
    )
    status = F.when(count == 0, "fail").when(F.size(warn) > 0, "warning").otherwise("pass")
    return out.select(
        F.col("image_id").alias("source"),
        status.alias("status"),
        warn.alias("warnings"),
        share.alias("foreground_fraction"),
        count.alias("component_count"),
        "threshold_value",
    )


def label_sizes(labels: DataFrame) -> DataFrame:
    return labels.where("label > 0").groupBy("image_id", "label").agg(F.count("*").alias("size"))


def label_qc(labels: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """Object count as the largest label, and area min/median/max over 1..n.

    Unused label numbers count as area 0; they enter the median as one weighted row
    instead of one row per missing number.
    """
    sizes = label_sizes(labels)
    by_size = sizes.groupBy("image_id", "size").agg(F.count("*").alias("n"))
    used = sizes.groupBy("image_id").agg(F.max("label").alias("n_objects"), F.count("*").alias("_used"))
    unused = used.where("n_objects > _used").select(
        "image_id", F.lit(0).cast("long").alias("size"), (F.col("n_objects") - F.col("_used")).alias("n")
    )
    counts = by_size.unionByName(unused)
    median = weighted_median(counts, ["image_id"], "size", "n", "object_area_median")
    span = counts.groupBy("image_id").agg(
        F.min("size").alias("object_area_min"), F.max("size").alias("object_area_max")
    )
    out = used.drop("_used").join(median, "image_id").join(span, "image_id")
    if images is not None:
        out = images.select("image_id").join(out, "image_id", "left").na.fill(0)
    return out.withColumn("empty_mask", F.col("n_objects") == 0)


def segment_with_model(
    tiles: DataFrame,
    images: DataFrame,
    predict: Callable[[np.ndarray], np.ndarray] | None = None,
    do_3d: bool = False,
    load: Callable[[], Callable[[np.ndarray], np.ndarray]] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Labels from a caller's model, tile by tile (I13); returns (labels, label_qc).

    ``predict`` maps a (height, width) array to integer labels; ``load`` builds it once
    per Python worker instead.  Objects cut by a tile border are merged where labelled
    pixels touch across it.  With ``do_3d`` and a Z axis, objects touching between
    planes are merged too.  Movies are refused: pick a frame first.
    """
    if predict is None and load is None:
        raise ValueError("give predict or load")
    still = salted_join(tiles, images.select("image_id", "size_t"), ["image_id"], ["z", "ty", "tx"])
    ok = F.when(F.col("size_t") == 1, F.col("t")).otherwise(
        F.raise_error(F.lit("time series refused: extract one timepoint first"))
    )
    still = still.withColumn("t", ok).drop("size_t")

    def run(batches):
        model = load() if load is not None else predict
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                lab = np.asarray(model(np.asarray(r.data).reshape(r.h, r.w))).astype(np.int64)
                y, x = np.nonzero(lab > 0)
                rows.append(
                    pd.DataFrame(
                        {
                            "image_id": r.image_id, "t": r.t, "z": r.z, "y": y + r.y0, "x": x + r.x0,
                            "ty": r.ty, "tx": r.tx, "part": lab[y, x],
                        }
                    )
                )
            if rows:
                yield pd.concat(rows, ignore_index=True)

    schema = "image_id string, t int, z int, y int, x int, ty int, tx int, part long"
    cols = ["image_id", "t", "z", "y", "x", "ty", "tx"]
    found = still.select(*["image_id", "t", "z", "ty", "tx", "y0", "x0", "h", "w", "data"]).mapInPandas(run, schema)
    # a part is one label of one tile; its id is the packed position of its first pixel
    found = cut(found.withColumn("pid", packed()))
    part_key = ["image_id", "t", "z", "ty", "tx", "part"]
    first = found.groupBy(*part_key).agg(F.min("pid").alias("local"), F.count("*").alias("n"))
    pix = cut(found.join(first.drop("n"), part_key).select(*cols, "local"))
    steps = [(0, 0, 1), (0, 1, 0)] + ([(1, 0, 0)] if do_3d else [])
    ahead = pix.select(
        "image_id", "t", "ty", "tx", F.col("local").alias("src"),
        F.explode(
            F.array(
                *[
                    F.struct(*[(F.col(a) + d).alias(a) for a, d in zip("zyx", s)], F.lit(s[0]).alias("dz"))
                    for s in steps
                ]
            )
        ).alias("p"),
    ).select("image_id", "t", "src", F.col("ty").alias("sy"), F.col("tx").alias("sx"), "p.*")
    here = pix.select("image_id", "t", "z", "y", "x", "ty", "tx", F.col("local").alias("dst"))
    seams = ahead.join(here, VOXEL_KEY).where("dz = 1 OR sy != ty OR sx != tx")
    merged = connected(seams.select(*FRAME, "src", "dst"), FRAME)
    parts = first.select(*FRAME, "local", "n").join(
        merged.withColumnRenamed("node", "local"), [*FRAME, "local"], "left"
    )
    parts = cut(parts.select(*FRAME, "local", F.coalesce("root", "local").alias("root"), "n"))
    low = F.lit(2097151).cast("long")
    objects = parts.select(*FRAME, "root").distinct().select(
        *FRAME, "root",
        F.shiftright("root", 42).alias("_z"),
        F.shiftright("root", 21).bitwiseAND(low).alias("_y"),
        F.col("root").bitwiseAND(low).alias("_x"),
    )
    numbered = number_rows(objects, FRAME, ["_z", "_y", "_x"], "label", start=1)
    numbered = numbered.select(*FRAME, F.col("root").alias("r"), F.col("label").cast("int").alias("label"))
    named = join_renamed(parts, numbered, [*FRAME, "root"], [*FRAME, "r"]).select(*FRAME, "local", "label")
    labels = pix.join(named, [*FRAME, "local"]).select(*VOXEL_KEY, "label")
    return labels, label_qc(labels, images)

