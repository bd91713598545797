"""Time courses over arriving frames.

The same aggregation as the batch operator: a frame's voxels may arrive in several
files, so the (image, frame, label) groups are kept as streaming state and finished
by the watermark on the acquisition time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def timecourse_stream(
    frames: DataFrame, rois: DataFrame, late: str = "10 minutes", acquired: str = "acquired_at"
) -> DataFrame:
    """Streaming statistics per (image, frame, label) for static regions.

    frames: streaming voxels with an acquisition time; rois: label voxels without ``t``.
    """
    roi = rois.where("label > 0").select("image_id", "z", "y", "x", "label")
    found = frames.withWatermark(acquired, late).join(roi, ["image_id", "z", "y", "x"])
    return found.groupBy("image_id", F.col("channel").alias("image_layer"), F.col("t").alias("time_index"), acquired, "label").agg(
        F.count("*").alias("area"),
        F.avg("v").alias("mean_intensity"),
        F.max("v").alias("max_intensity"),
        F.min("v").alias("min_intensity"),
    )
