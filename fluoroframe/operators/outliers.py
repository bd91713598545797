"""Quality control across runs and frames: counts far from the batch, and jumps between neighbouring frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from fluoroframe.operators.traces import CHUNK, TRACE, _beside, _number
from fluoroframe.plans.ranks import exact_percentiles

#: Fixed value: makes the median deviation comparable with a standard deviation.
NORMAL = 0.6745


def count_outliers(runs: DataFrame, count: str = "n_objects", by: Sequence[str] = (), limit: float = 3.5) -> DataFrame:
    """All runs with ``batch_median``, ``batch_mad``, ``robust_score`` and ``count_verdict`` ("ok", "too few", "too many").

    The batch is all runs with equal ``by``, null counting as a value.  A run is off if its count is more than ``limit``
    robust deviations from the median, or, where half of the batch has one count, if it has another one (score null).
    Runs without a count are "missing" and enter no median.
    """
    by = list(by)
    keys = by or ["_all"]
    rows = runs.withColumn("_v", _number(count))
    rows = rows if by else rows.withColumn("_all", F.lit(0))
    middle = _beside(rows, exact_percentiles(rows, keys, "_v", {"batch_median": 0.5}), keys)
    middle = middle.withColumn("_d", F.abs(F.col("_v") - F.col("batch_median")))
    out = _beside(middle, exact_percentiles(middle, keys, "_d", {"batch_mad": 0.5}), keys)
    score = F.when(F.col("batch_mad") > 0, NORMAL * (F.col("_v") - F.col("batch_median")) / F.col("batch_mad"))
    off = F.when(F.col("batch_mad") > 0, F.abs(score) > limit).otherwise(F.col("_d") > 0)
    side = F.when(F.col("_v") < F.col("batch_median"), "too few").otherwise("too many")
    verdict = F.when(F.col("_v").isNull(), "missing").when(off, side).otherwise("ok")
    return out.withColumns({"robust_score": score, "count_verdict": verdict}).drop("_v", "_d", "_all")


def frame_jumps(
    table: DataFrame, value: str = "mean_intensity", limit: float = 5.0, keys: Sequence[str] = TRACE, order: str = "time_index"
) -> DataFrame:
    """All rows with ``step`` (value minus the one of the frame before that has a value), ``typical_step`` (median size of
    the steps of the trace) and ``is_jump``: a step of more than ``limit`` times the typical one.

    In a trace that rests in half of its frames every step is a jump.  The first value of a trace and rows without a value
    have no step.  Several rows of a frame follow each other by value.  Traces are cut into chunks of frames; the last
    value of a chunk is carried to the next one that has values.
    """
    keys = list(keys)
    rows = table.withColumns({"_o": F.col(f"`{order}`").cast("long"), "_v": _number(value)}).withColumn("_c", F.floor(F.col("_o") / CHUNK).cast("long"))
    real = rows.where("_v IS NOT NULL")
    inside = Window.partitionBy(*keys, "_c").orderBy("_o", "_v")
    seen = real.withColumn("_before", F.lag("_v").over(inside))
    ends = real.groupBy(*keys, "_c").agg(F.max(F.struct("_o", "_v")).alias("_end"))
    carried = ends.select(*keys, "_c", F.lag("_end._v").over(Window.partitionBy(*keys).orderBy("_c")).alias("_carry"))  # one row per chunk
    seen = _beside(seen, carried, [*keys, "_c"]).withColumn("step", F.col("_v") - F.coalesce("_before", "_carry"))
    typical = exact_percentiles(seen.withColumn("_d", F.abs("step")), keys, "_d", {"typical_step": 0.5})
    out = _beside(seen.drop("_before", "_carry").unionByName(rows.where("_v IS NULL").withColumn("step", F.lit(None).cast("double"))), typical, keys)
    jump = F.coalesce(F.abs("step") > limit * F.col("typical_step"), F.lit(False))
    return out.withColumn("is_jump", jump).drop("_o", "_v", "_c")
