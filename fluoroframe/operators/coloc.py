"""Two-channel colocalization."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fluoroframe.operators.threshold import resolve_threshold
from fluoroframe.plans.skew import salted_join
from fluoroframe.sources.tiles import VOXEL_KEY, apply_mask


def channel_pairs(vox: DataFrame, a: str, b: str) -> DataFrame:
    """Both channels side by side: one conditional aggregate instead of a self-join.

    A voxel present in only one channel means the layers differ in shape: an error.
    """
    both = (
        vox.where(F.col("channel").isin(a, b))
        .groupBy(*VOXEL_KEY)
        .agg(
            F.max(F.when(F.col("channel") == a, F.col("v"))).alias("a"),
            F.max(F.when(F.col("channel") == b, F.col("v"))).alias("b"),
            F.count_if(F.col("channel") == a).alias("_na"),
            F.count_if(F.col("channel") == b).alias("_nb"),
        )
    )
    whole = (F.col("_na") > 0) & (F.col("_nb") > 0)
    checked = F.when(whole, F.col("a")).otherwise(
        F.raise_error(F.lit("shape mismatch: voxel present in only one channel"))
    )
    return both.withColumn("a", checked).drop("_na", "_nb")


def manders(
    vox: DataFrame,
    a: str,
    b: str,
    labels: DataFrame | None = None,
    threshold_a: float | str = "otsu",
    threshold_b: float | str = "otsu",
) -> DataFrame:
    """M1 and M2 per image; thresholds are taken inside the mask."""
    if a == b:
        raise ValueError("give two different channels")
    for spec in (threshold_a, threshold_b):
        if isinstance(spec, str) and spec not in ("otsu", "zero"):
            raise ValueError(f"unsupported threshold spec: {spec!r}")
    inside = apply_mask(vox.where(F.col("channel").isin(a, b)), labels)
    if threshold_a == threshold_b:
        # both layers in one pass
        both = resolve_threshold(inside, threshold_a)
        pick = lambda c: F.max(F.when(F.col("channel") == c, F.col("threshold")))
        limits = both.groupBy("image_id").agg(pick(a).alias("threshold_a"), pick(b).alias("threshold_b"))
    else:
        one, two = (
            resolve_threshold(inside.where(F.col("channel") == c), spec).select("image_id", F.col("threshold").alias(name))
            for c, spec, name in ((a, threshold_a, "threshold_a"), (b, threshold_b, "threshold_b"))
        )
        limits = one.join(two, "image_id")
    pairs = salted_join(channel_pairs(inside, a, b), limits, ["image_id"], ["t", "z", "y", "x"])
    sums = pairs.groupBy("image_id", "threshold_a", "threshold_b").agg(
        F.sum("a").alias("sa"),
        F.sum("b").alias("sb"),
        F.sum(F.when(F.col("b") > F.col("threshold_b"), F.col("a")).otherwise(0.0)).alias("sa_in"),
        F.sum(F.when(F.col("a") > F.col("threshold_a"), F.col("b")).otherwise(0.0)).alias("sb_in"),
        F.count("*").alias("n_pixels"),
    )
    share = lambda part, all_: F.coalesce(F.when(F.col(all_) > 0, F.try_divide(part, all_)), F.lit(0.0))
    return sums.select(
        "image_id",
        share("sa_in", "sa").alias("M1"),
        share("sb_in", "sb").alias("M2"),
        "threshold_a",
        "threshold_b",
        "n_pixels",
    )


def pearson(vox: DataFrame, a: str, b: str, labels: DataFrame | None = None) -> DataFrame:
    """Pearson r per image; 0 for fewer than two pixels or a constant channel."""
    pairs = channel_pairs(apply_mask(vox.where(F.col("channel").isin(a, b)), labels), a, b)
    stats = pairs.groupBy("image_id").agg(
        F.count("*").alias("n_pixels"),
        F.covar_pop("a", "b").alias("c"),
        (F.stddev_pop("a") * F.stddev_pop("b")).alias("s"),
    )
    r = F.when((F.col("n_pixels") >= 2) & (F.col("s") > 0), F.try_divide("c", "s"))
    return stats.select("image_id", F.coalesce(r, F.lit(0.0)).alias("r"), "n_pixels")
