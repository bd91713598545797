"""Voxel and tile tables.

voxels: image_id, channel, t, z, y, x, v           (absent axis = 0)
tiles:  image_id, channel, t, z, ty, tx, y0, x0, h, w, data ARRAY<FLOAT> (row-major)
labels: image_id, t, z, y, x, label                 (label > 0 only)
images: image_id, path, axes, size_t, size_z, size_y, size_x, voxel_z, voxel_y,
        voxel_x, time_interval_s, dtype
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

VOXEL_KEY = ["image_id", "t", "z", "y", "x"]
TILE_KEY = ["image_id", "channel", "t", "z", "ty", "tx"]
AXES = {"t": "size_t", "z": "size_z", "y": "size_y", "x": "size_x"}
TILE_COLUMNS = [*TILE_KEY, "y0", "x0", "h", "w", "data"]
TILE_SCHEMA = (
    "image_id string, channel string, t int, z int, ty int, tx int, "
    "y0 int, x0 int, h int, w int, data array<float>"
)


def axis_column(axis: str | int, axes: str) -> str:
    """Column for an axis given by name or by (possibly negative) position."""
    order = axes.upper().replace("C", "")
    if isinstance(axis, int):
        at = axis if axis >= 0 else len(order) + axis
        if not 0 <= at < len(order):
            raise ValueError(f"axis {axis} out of range for axes {order!r}")
        return order[at].lower()
    code = axis.upper()
    if len(code) != 1 or code not in order:
        raise ValueError(f"axis {axis!r} not found in image axes {order!r}")
    return code.lower()


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Image sets are stored as Parquet tiles or voxels; this is the scan."""
    return spark.read.parquet(path)


def name_channels(vox: DataFrame, images: DataFrame) -> DataFrame:
    """Replace channel positions by names.

    ``vox.channel`` holds the position as text and ``images`` carries
    ``channel_names`` and ``n_channels``; names apply when their number equals the
    channel count, otherwise ``<stem>_ch<i>`` is used.
    """
    from fluoroframe.plans.skew import salted_join

    file_name = F.element_at(F.split("path", "/"), -1)
    stem = F.regexp_replace(file_name, r"\.[^.]*$", "")
    names = images.select(
        "image_id",
        "n_channels",
        F.coalesce("channel_names", F.array().cast("array<string>")).alias("channel_names"),
        stem.alias("_stem"),
    )
    at = F.col("channel").cast("int")
    named = F.when(
        F.size("channel_names") == F.col("n_channels"), F.get(F.col("channel_names"), at)
    ).otherwise(F.concat("_stem", F.lit("_ch"), F.col("channel")))
    spread = [c for c in ("t", "z", "y", "x", "ty", "tx") if c in vox.columns]
    out = salted_join(vox, names, ["image_id"], spread)
    return out.withColumn("channel", named).select(*vox.columns)


def voxels_from_tiles(tiles: DataFrame) -> DataFrame:
    pix = tiles.select(
        "image_id", "channel", "t", "z", "y0", "x0", "w", F.posexplode("data").alias("i", "p")
    )
    return pix.select(
        "image_id",
        "channel",
        "t",
        "z",
        (F.col("y0") + F.expr("i div w")).cast("int").alias("y"),
        (F.col("x0") + F.col("i") % F.col("w")).cast("int").alias("x"),
        F.col("p").cast("double").alias("v"),
    )


def tiles_from_voxels(vox: DataFrame, tile_h: int = 256, tile_w: int = 256) -> DataFrame:
    """Dense voxels to tiles; a group never exceeds tile_h * tile_w pixels.

    A tile with missing or repeated voxels is an error, as values are stored by place.
    """
    keyed = vox.withColumn("ty", F.expr(f"cast(y div {tile_h} as int)")).withColumn(
        "tx", F.expr(f"cast(x div {tile_w} as int)")
    )
    return (
        keyed.groupBy(*TILE_KEY)
        .agg(
            F.min("y").alias("y0"),
            F.min("x").alias("x0"),
            (F.max("y") - F.min("y") + 1).alias("h"),
            (F.max("x") - F.min("x") + 1).alias("w"),
            F.sort_array(F.collect_list(F.struct("y", "x", F.col("v").cast("float").alias("v")))).alias("px"),
        )
        .select(
            *TILE_KEY, "y0", "x0", "h", "w",
            F.when(F.size("px") == F.col("h") * F.col("w"), F.col("px.v"))
            .otherwise(F.raise_error(F.lit("a tile needs one voxel at every place")))
            .alias("data"),
        )
    )


def label_tiles(labels: DataFrame, images: DataFrame, tile_h: int = 256, tile_w: int = 256) -> DataFrame:
    """Sparse labels as tiles of whole numbers (0 where nothing is labelled), for every tile that has a label.

    The tiling is that of ``tiles_from_voxels``: tiles at the end of the image are cut to its size.  A label outside
    the image, two labels at one place, or an image without a size is an error.
    """
    size = images.select("image_id", F.col("size_y").alias("_h"), F.col("size_x").alias("_w"))
    # one row per image beside the labels; a plain join, which adaptive execution splits for an image of very many
    marked = labels.where("label > 0").join(size, "image_id", "left")
    inside = (F.col("y") >= 0) & (F.col("x") >= 0) & (F.col("y") < F.col("_h")) & (F.col("x") < F.col("_w"))
    checked = F.when(inside, F.col("label")).otherwise(F.raise_error(F.lit("shape mismatch: labelled voxel outside the image")).cast("long"))
    placed = marked.select("image_id", "t", "z", "y", "x", "_h", "_w", checked.cast("long").alias("label"), F.expr(f"cast(y div {tile_h} as int)").alias("ty"), F.expr(f"cast(x div {tile_w} as int)").alias("tx"))
    schema = "image_id string, t int, z int, ty int, tx int, y0 int, x0 int, h int, w int, data array<long>"

    def fill(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        image, t, z, ty, tx = key
        y0, x0 = ty * tile_h, tx * tile_w
        h, w = min(tile_h, int(pdf["_h"].iloc[0]) - y0), min(tile_w, int(pdf["_w"].iloc[0]) - x0)
        at = (pdf["y"].to_numpy() - y0) * w + pdf["x"].to_numpy() - x0
        if len(np.unique(at)) < len(at):
            raise ValueError("two labels at one place")
        data = np.zeros(h * w, dtype=np.int64)
        data[at] = pdf["label"].to_numpy()
        return pd.DataFrame({"image_id": [image], "t": t, "z": z, "ty": ty, "tx": tx, "y0": y0, "x0": x0, "h": h, "w": w, "data": [data]})

    return placed.groupBy("image_id", "t", "z", "ty", "tx").applyInPandas(fill, schema)


def layer_catalog(vox: DataFrame, images: DataFrame) -> DataFrame:
    """One row per (image, channel) with its extent and the image metadata."""
    size = vox.groupBy("image_id", "channel").agg(
        *[(F.max(a) + 1).alias(f"n_{a}") for a in AXES]
    )
    meta = images.select("image_id", "axes", "dtype", "voxel_z", "voxel_y", "voxel_x")
    return size.join(meta, "image_id", "left").withColumn("kind", F.lit("image"))


def layer_summary(vox: DataFrame) -> DataFrame:
    """Intensity range of every layer over all its voxels."""
    from fluoroframe.plans.ranks import exact_percentiles

    keys = ["image_id", "channel"]
    plain = vox.groupBy(*keys).agg(F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean"))
    return plain.join(exact_percentiles(vox, keys, "v", {"p1": 0.01, "p99": 0.99}), keys, "left")


def labels_summary(labels: DataFrame, images: DataFrame) -> DataFrame:
    """Largest label of every image over all its voxels, 0 without labels."""
    seen = labels.groupBy("image_id").agg(F.max("label").alias("_m"))
    return images.select("image_id").join(seen, "image_id", "left").select("image_id", F.coalesce("_m", F.lit(0)).alias("n_labels"))


def extract_timepoint(vox: DataFrame, t: int, images: DataFrame | None = None) -> DataFrame:
    """Keep one frame and drop the axis (t becomes 0).

    The frame count is one number from ``images`` (or the largest t of the voxels), so
    an index out of range fails at once and the filter itself stays a plain ``t = k``
    that reaches the scan.
    """
    if images is not None:
        frames = images.agg(F.max("size_t")).first()[0] or 0
    else:
        frames = (vox.agg(F.max("t")).first()[0] or 0) + 1
    if not 0 <= t < frames:
        raise ValueError(f"timepoint {t} out of range for {frames} frames")
    return vox.where(F.col("t") == t).withColumn("t", F.lit(0))


def select_position(vox: DataFrame, position: int) -> DataFrame:
    """Keep one stage position and drop the column."""
    count = (vox.agg(F.max("position")).first()[0] or 0) + 1
    if not 0 <= position < count:
        raise ValueError(f"position index {position} out of range for {count} positions")
    return vox.where(F.col("position") == position).drop("position")


def position_warnings(vox: DataFrame) -> DataFrame:
    """Images with more than one stage position."""
    n = F.count_distinct("position")
    return vox.groupBy("image_id").agg(n.alias("n_positions")).where("n_positions > 1")


def apply_mask(vox: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Voxels under a positive label; without labels all voxels.  A mask outside the image is an error."""
    if labels is None:
        return vox
    wanted = labels.where("label > 0").select(*VOXEL_KEY).distinct()
    met = wanted.join(vox.withColumn("_seen", F.lit(True)), VOXEL_KEY, "left")
    outside = F.raise_error(F.lit("mask shape mismatch: masked voxel outside the image")).cast("string")
    return met.withColumn("channel", F.when(F.col("_seen"), F.col("channel")).otherwise(outside)).select(*vox.columns)


def binary_mask(vox: DataFrame, threshold: float | None = None) -> DataFrame:
    """Mask voxels of an image: above the threshold, or the ones of a 0/1 image (P5)."""
    if threshold is not None:
        return vox.where(F.col("v") > float(threshold)).select(*VOXEL_KEY)
    ok = F.isnan("v") | F.col("v").isNull() | F.col("v").isin(0.0, 1.0)
    checked = F.when(ok, F.col("v") == 1.0).otherwise(
        F.raise_error(F.lit("expected a binary image or labels; pass a threshold for continuous data"))
    )
    return vox.where(checked).select(*VOXEL_KEY)
