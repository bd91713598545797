"""Time courses: baselines, normalization, response features and smoothing per trace.

A trace is the rows of one key (image, layer, label) over time.  Long traces are cut into chunks of consecutive
times: every chunk is summed in order by itself, and only its sums, first and last point meet those of its trace.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

METHODS = ("raw", "baseline_subtract", "f_over_f0", "delta_f_over_f0", "zscore", "minmax")
TRACE = ("image_id", "image_layer", "label")
#: Time steps (of ``order``) in a chunk.
CHUNK = 4096


def _within(time: Column, window: tuple[float, float] | None) -> Column:
    return F.lit(True) if window is None else time.between(*window)


def _number(name: str) -> Column:
    """Value without NaN."""
    v = F.col(f"`{name}`").cast("double")
    return F.when(~F.isnan(v), v)


def _beside(rows: DataFrame, stats: DataFrame, keys: list[str]) -> DataFrame:
    """One row of ``stats`` per trace joined to the rows; keys may be null.  Adaptive execution splits long traces."""
    names = {k: f"_k{i}" for i, k in enumerate(keys)}
    right = stats.withColumnsRenamed(names)
    on = F.lit(True)
    for k, n in names.items():
        on &= rows[k].eqNullSafe(right[n])
    return rows.join(right, on, "left").drop(*names.values())


def normalize_timecourse(
    table: DataFrame, value: str = "mean_intensity", method: str = "delta_f_over_f0", baseline: tuple[float, float] | None = None,
    keys: Sequence[str] = TRACE, time: str = "time_index",
) -> DataFrame:
    """All rows with ``<value>_<method>``, ``baseline_value``, ``baseline_frames`` and ``baseline_status``.

    F0 is the mean of the values at times of the window ``baseline`` (both ends included), which must be given where the
    method needs one; without it ``zscore`` takes the whole trace.  ``minmax`` always takes the whole trace.  The status
    is "ok", "missing" (no value in the window) or "zero" (F0, or the spread of a z-score or of min and max, is 0): the
    new value is then null, never infinite.  Raw values stay; null and NaN values give null and enter no baseline.
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    if baseline is None and method in ("baseline_subtract", "f_over_f0", "delta_f_over_f0"):
        raise ValueError(f"{method} needs a baseline window")
    keys = list(keys)
    v, t = _number(value), F.col(f"`{time}`")
    inside = F.when(_within(t, None if method in ("raw", "minmax") else baseline), v)
    stats = table.groupBy(*keys).agg(
        F.avg(inside).alias("baseline_value"), F.count(inside).alias("baseline_frames"), F.stddev_samp(inside).alias("_sd"), F.min(inside).alias("_lo"), F.max(inside).alias("_hi")
    )
    f0 = F.col("baseline_value")
    divisor = {"f_over_f0": f0, "delta_f_over_f0": f0, "zscore": F.col("_sd"), "minmax": F.col("_hi") - F.col("_lo")}.get(method, F.lit(1.0))
    numerator = {"raw": v, "f_over_f0": v, "minmax": v - F.col("_lo")}.get(method, v - f0)
    status = F.when(F.col("baseline_frames") == 0, "missing").when(divisor == 0, "zero").when(divisor.isNull(), "missing").otherwise("ok")
    if method == "raw":
        status = F.lit("ok")
    out = _beside(table, stats, keys).withColumn("baseline_status", status)
    out = out.withColumn(f"{value}_{method}", F.when(F.col("baseline_status") == "ok", numerator / divisor))
    return out.drop("_sd", "_lo", "_hi")


def timecourse_features(
    table: DataFrame, value: str = "mean_intensity", baseline_window: tuple[float, float] | None = None, response_window: tuple[float, float] | None = None,
    threshold: float | None = None, keys: Sequence[str] = TRACE, time: str = "time_s", order: str = "time_index", keep: Sequence[str] = (),
) -> DataFrame:
    """One row per trace: ``baseline_mean``, ``peak``, ``amplitude``, ``time_to_peak``, ``auc``, ``mean_response``,
    ``threshold``, ``onset``, ``duration_above``, ``decay_time``, ``n_frames``.

    ``time_to_peak`` and ``onset`` (first value at or above the threshold) are counted from the first time of the response
    window that has a value; the earliest of equal peaks counts.  ``auc`` is the trapezoid area of value minus baseline
    mean (0 without a baseline window).  ``threshold`` defaults to the baseline mean plus two standard deviations.
    ``duration_above`` adds the steps between neighbouring times that begin at or above it.  ``decay_time`` runs from the
    peak to the first value at or below half of the amplitude.  Windows are in units of ``time``, both ends included.
    Null and NaN values take no part; of several values at one time the mean counts; a trace without any value in the
    response window has nulls.  ``keep`` columns are constant per trace and are carried along; ``order`` ascends with ``time``.
    """
    keys, keep = list(keys), list(keep)
    rows = table.select(*keys, *keep, F.col(f"`{time}`").cast("double").alias("_t"), F.col(f"`{order}`").cast("long").alias("_o"), _number(value).alias("_v"))
    first = rows.groupBy(*keys).agg(*[F.min(c).alias(c) for c in keep]) if keep else rows.select(*keys).distinct()
    points = rows.where("_v IS NOT NULL AND _t IS NOT NULL").groupBy(*keys, "_t").agg(F.avg("_v").alias("_v"), F.min("_o").alias("_o"))
    base = F.when(_within(F.col("_t"), baseline_window) if baseline_window else F.lit(False), F.col("_v"))
    levels = points.groupBy(*keys).agg(F.avg(base).alias("baseline_mean"), F.stddev_samp(base).alias("_sd"))
    limit = F.lit(float(threshold)) if threshold is not None else F.col("baseline_mean") + 2 * F.coalesce("_sd", F.lit(0.0))
    levels = levels.withColumn("threshold", limit).drop("_sd")
    response = _beside(points.where(_within(F.col("_t"), response_window)), levels, keys).withColumn("_c", F.expr(f"_o div {CHUNK}"))

    chunk = Window.partitionBy(*keys, "_c").orderBy("_t")
    ahead, above = F.lead("_t").over(chunk), F.col("_v") >= F.col("threshold")
    level = F.coalesce("baseline_mean", F.lit(0.0))
    steps = response.withColumns({"_t1": ahead, "_v1": F.lead("_v").over(chunk)})
    step = F.coalesce(F.col("_t1") - F.col("_t"), F.lit(0.0))
    chunks = steps.groupBy(*keys, "_c").agg(
        F.sum(step * ((F.col("_v") + F.coalesce("_v1", "_v")) / 2 - level)).alias("auc"),
        F.sum(F.when(above, step).otherwise(0.0)).alias("duration"),
        F.max(F.struct(F.col("_v"), (-F.col("_t")).alias("nt"))).alias("top"),
        F.min(F.when(above, F.col("_t"))).alias("onset"),
        F.min(F.struct("_t", "_v")).alias("begin"),
        F.max(F.struct("_t", "_v")).alias("end"),
        F.sum("_v").alias("total"), F.count("*").alias("n"), F.first(level).alias("level"), F.first("threshold").alias("limit"),
    )
    trace = Window.partitionBy(*keys).orderBy("_c")  # one row per chunk
    joined = chunks.withColumn("next", F.lead("begin").over(trace))
    gap = F.coalesce(F.col("next._t") - F.col("end._t"), F.lit(0.0))
    merged = joined.groupBy(*keys).agg(
        F.sum(F.col("auc") + gap * ((F.col("end._v") + F.coalesce("next._v", "end._v")) / 2 - F.col("level"))).alias("auc"),
        F.sum(F.col("duration") + F.when(F.col("end._v") >= F.col("limit"), gap).otherwise(0.0)).alias("duration_above"),
        F.max("top").alias("top"), F.min("onset").alias("onset"), F.min("begin._t").alias("begin"), (F.sum("total") / F.sum("n")).alias("mean_response"), F.sum("n").alias("n_frames"),
    )
    merged = merged.select(*keys, "auc", "duration_above", F.col("top._v").alias("peak"), (-F.col("top.nt")).alias("_tp"), F.col("onset").alias("_on"), F.col("begin").alias("_b"), "mean_response", "n_frames")
    falls = _beside(response, merged.select(*keys, "_tp", "peak"), keys)
    half = level + (F.col("peak") - level) / 2
    decay = falls.where((F.col("_t") > F.col("_tp")) & (F.col("_v") <= half)).groupBy(*keys).agg(F.min("_t").alias("_td"))
    out = _beside(_beside(_beside(first, levels, keys), merged, keys), decay, keys)
    return out.select(
        *keys, *keep, "baseline_mean", "peak", (F.col("peak") - level).alias("amplitude"), (F.col("_tp") - F.col("_b")).alias("time_to_peak"), "auc", "mean_response", "threshold",
        (F.col("_on") - F.col("_b")).alias("onset"), "duration_above", (F.col("_td") - F.col("_tp")).alias("decay_time"), F.coalesce("n_frames", F.lit(0)).alias("n_frames"),
    )


SMOOTHERS = ("rolling_mean", "gaussian", "savgol")


def smooth_timecourse(
    table: DataFrame, value: str = "mean_intensity", method: str = "rolling_mean", half_width: int = 2, sigma: float = 1.0, degree: int = 2,
    keys: Sequence[str] = TRACE, order: str = "time_index",
) -> DataFrame:
    """All rows with ``<value>_smooth``, from the values of the trace at most ``half_width`` frames away.

    "rolling_mean" is their mean, "gaussian" their mean weighted by the distance in frames, "savgol" the value of the
    polynomial of ``degree`` fitted to them (of a lower degree where fewer frames are there).  At the ends of a trace
    and beside missing frames the frames that exist count; null and NaN values count as missing and get a value from
    their neighbours, null if there are none.  Chunks of ``CHUNK`` frames overlap by the half width, so one long trace
    is many tasks and the result does not depend on the chunks.
    """
    if method not in SMOOTHERS:
        raise ValueError(f"method must be one of {SMOOTHERS}")
    if half_width < 0 or (method == "gaussian" and not sigma > 0) or degree < 0:
        raise ValueError("half_width and degree must not be negative, sigma must be positive")
    i = F.col(f"`{order}`").cast("long")
    whole = lambda at: F.floor(at / CHUNK).cast("long")
    rows = table.withColumn("_own", whole(i)).withColumn("_c", F.explode_outer(F.sequence(whole(i - half_width), whole(i + half_width))))
    near = Window.partitionBy(*keys, "_c").orderBy(i).rangeBetween(-half_width, half_width)
    v = _number(value)
    point = F.when(v.isNotNull(), F.struct(i.alias("i"), v.alias("v")))
    seen = rows.withColumn("_near", F.collect_list(point).over(near)).where(F.col("_c").eqNullSafe(F.col("_own")))
    if method == "savgol":
        smooth = _fitted(half_width, degree)(i, F.col("_near.i"), F.col("_near.v"))
    else:
        gap = lambda p: (p["i"] - i).cast("double")
        weight = (lambda p: F.lit(1.0)) if method == "rolling_mean" else (lambda p: F.exp(-gap(p) * gap(p) / (2 * sigma * sigma)))
        total = lambda term: F.aggregate("_near", F.lit(0.0), lambda a, p: a + term(p))
        smooth = F.when(F.size("_near") > 0, total(lambda p: weight(p) * p["v"]) / total(weight))
    return seen.withColumn(f"{value}_smooth", smooth).drop("_own", "_c", "_near")


def _fitted(half_width: int, degree: int):
    """Value at the middle of a polynomial fitted to the frames of a window."""
    places = np.arange(-half_width, half_width + 1)
    full = np.linalg.pinv(np.vander(places.astype(float), min(degree, 2 * half_width) + 1, increasing=True))[0]

    @F.pandas_udf("double")
    def fit(middle: pd.Series, frames: pd.Series, values: pd.Series) -> pd.Series:
        out = []
        for m, f, v in zip(middle, frames, values):
            at = np.asarray(f) - m if len(f) else np.zeros(0)
            if len(at) == len(places) and (np.sort(at) == places).all():
                out.append(float(full @ np.asarray(v)[np.argsort(at)]))
            elif len(at):
                most = min(degree, len(np.unique(at)) - 1)
                out.append(float(np.linalg.pinv(np.vander(at.astype(float), most + 1, increasing=True))[0] @ np.asarray(v)))
            else:
                out.append(None)
        return pd.Series(out, dtype="float64")

    return fit
