"""Maximum projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fluoroframe.sources.tiles import AXES


def max_projection(vox: DataFrame, axis: str = "z") -> DataFrame:
    """Maximum along one named axis; the axis disappears from the result."""
    axis = axis.lower()
    if axis not in AXES:
        raise ValueError(f"axis must be one of {list(AXES)}")
    keep = ["image_id", "channel", *[a for a in AXES if a != axis]]
    return vox.groupBy(*keep).agg(F.max("v").alias("v"))


def orthogonal_views(vox: DataFrame) -> DataFrame:
    """XZ (max over y) and YZ (max over x) views in one pass over the voxels.

    Rows: image_id, channel, t, view, z, u where u is x for XZ and y for YZ.
    """
    sides = F.explode(
        F.array(
            F.struct(F.lit("XZ").alias("view"), F.col("x").alias("u")),
            F.struct(F.lit("YZ").alias("view"), F.col("y").alias("u")),
        )
    )
    rows = vox.select("image_id", "channel", "t", "z", "v", sides.alias("s"))
    return rows.groupBy("image_id", "channel", "t", "s.view", "z", "s.u").agg(F.max("v").alias("v"))
