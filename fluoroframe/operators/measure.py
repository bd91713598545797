"""Per-object measurement, time courses, table filters and summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F, types as T

from fluoroframe.plans.ranks import exact_medians
from fluoroframe.sources.tiles import VOXEL_KEY

# Default property lists of the two measurement operators.
OBJECT_PROPERTIES = ["label", "area", "centroid", "mean_intensity", "max_intensity", "min_intensity"]
TIME_PROPERTIES = ["label", "area", "mean_intensity", "max_intensity", "min_intensity"]

_INTENSITY = {"mean_intensity": F.avg, "max_intensity": F.max, "min_intensity": F.min}
SUMMARY_OPS = ("mean", "median", "sum", "count", "std", "min", "max")


def _spatial(ndim: int) -> list[str]:
    if ndim not in (2, 3):
        raise ValueError("ndim must be 2 or 3")
    return ["y", "x"] if ndim == 2 else ["z", "y", "x"]


def _check_properties(props: Sequence[str]) -> list[str]:
    known = {"label", "area", "centroid", *_INTENSITY}
    bad = [p for p in props if p not in known]
    if bad:
        raise ValueError(f"unknown properties {bad}")
    return [p for p in props if p != "label"]


def _label_voxels(vox: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """Labels with their image values; a label outside the image is an error."""
    marked = vox.select(*keys, "channel", "v", F.lit(True).alias("_seen"))
    found = labels.where("label > 0").join(marked, [*keys, "channel"], "left")
    outside = F.raise_error(F.lit("shape mismatch: labelled voxel outside the image"))
    return found.withColumn("v", F.when(F.col("_seen"), F.col("v")).otherwise(outside)).drop("_seen")


def _object_aggregates(props: list[str], channels: Sequence[str], ndim: int) -> list:
    first = F.col("channel") == channels[0]
    aggs = []
    if "area" in props:
        aggs.append(F.count_if(first).alias("area"))
    if "centroid" in props:
        for i, axis in enumerate(_spatial(ndim)):
            aggs.append(F.avg(F.when(first, F.col(axis))).alias(f"centroid-{i}"))
    for c in channels:
        for p in props:
            if p in _INTENSITY:
                value = F.when(F.col("channel") == c, F.col("v"))
                aggs.append(_INTENSITY[p](value).alias(f"{p}_{c}"))
    return aggs


def measure_intensity(
    vox: DataFrame,
    labels: DataFrame,
    images: DataFrame | None = None,
    channels: Sequence[str] = (),
    properties: Sequence[str] | None = None,
    ndim: int = 2,
) -> DataFrame:
    """Area, centroid and mean/max/min intensity per label and channel.

    One shuffle brings labels and voxels together on the voxel key, one partial +
    final aggregation covers geometry and all channels.  For tiled data use
    ``measure_intensity_tiles``, which moves tiles instead of voxels.
    """
    if not channels:
        raise ValueError("channels must be a non-empty list of channel names")
    props = _check_properties(properties or OBJECT_PROPERTIES) or ["area"]
    wanted = labels.withColumn("channel", F.explode(F.array(*[F.lit(c) for c in channels])))
    found = _label_voxels(vox.where(F.col("channel").isin(list(channels))), wanted, VOXEL_KEY)
    out = found.groupBy("image_id", "label").agg(*_object_aggregates(props, channels, ndim))
    return add_physical_columns(out, images, ndim)


def measure_intensity_tiles(
    tiles: DataFrame,
    label_tiles: DataFrame,
    images: DataFrame | None = None,
    channels: Sequence[str] = (),
    properties: Sequence[str] | None = None,
    ndim: int = 2,
) -> DataFrame:
    """``measure_intensity`` on tiles: join on the tile key, then unpack both arrays.

    The label tiles share the tiling of the image; their data are label numbers, whole
    ones (``label_tiles``) or, below 16777216, floats.  A
    labelled tile without an image tile of a wanted channel is an error.
    """
    if not channels:
        raise ValueError("channels must be a non-empty list of channel names")
    props = _check_properties(properties or OBJECT_PROPERTIES) or ["area"]
    key = ["image_id", "t", "z", "ty", "tx"]
    lab = label_tiles.where(F.exists("data", lambda v: v > 0)).select(
        *key, F.col("data").alias("_lab"), F.explode(F.array(*[F.lit(c) for c in channels])).alias("channel")
    )
    whole = dict(label_tiles.dtypes)["data"] == "array<bigint>"
    number = "long" if whole else "int"
    both = lab.join(tiles.where(F.col("channel").isin(list(channels))), [*key, "channel"], "left")
    mismatch = F.raise_error(F.lit("shape mismatch: label tile and image tile differ in size"))
    absent = F.raise_error(F.lit("shape mismatch: label tile without image tile"))
    fits = F.when(F.size("data") == F.size("_lab"), F.arrays_zip("_lab", "data")).otherwise(mismatch)
    zipped = F.when(F.col("data").isNull(), absent).otherwise(fits)
    pix = both.select(
        "image_id", "channel", "z", "y0", "x0", "w", F.posexplode(zipped).alias("i", "p")
    ).where("p._lab > 0")
    pix = pix.select(
        "image_id",
        "channel",
        F.col("p._lab").cast(number).alias("label"),
        "z",
        (F.col("y0") + F.expr("i div w")).alias("y"),
        (F.col("x0") + F.col("i") % F.col("w")).alias("x"),
        F.col("p.data").cast("double").alias("v"),
    )
    out = pix.groupBy("image_id", "label").agg(*_object_aggregates(props, channels, ndim))
    return add_physical_columns(out, images, ndim)


def add_physical_columns(df: DataFrame, images: DataFrame | None, ndim: int) -> DataFrame:
    """Pixel aliases always; micrometre columns where the image has a real scale.

    A scale whose values are all 1 counts as missing and gives nulls.
    """
    has_area = "area" in df.columns
    if has_area:
        alias = "area_px" if ndim == 2 else "volume_voxels"
        df = df.withColumn(alias, F.col("area").cast("double"))
    if images is None:
        return df
    axes = _spatial(ndim)
    sizes = [F.col(f"voxel_{a}") for a in axes]
    unit = reduce(lambda a, b: a & b, [F.abs(s - 1.0) < 1e-9 for s in sizes])
    scale = images.select(
        "image_id", *[F.when(~unit, s.cast("double")).alias(f"_s{a}") for a, s in zip(axes, sizes)]
    )
    out = df.join(scale, "image_id", "left")
    if has_area:
        voxel = reduce(lambda a, b: a * b, [F.col(f"_s{a}") for a in axes])
        name = "area_um2" if ndim == 2 else "volume_um3"
        out = out.withColumn(name, F.col("area").cast("double") * voxel)
    for i, a in enumerate(axes):
        if f"centroid-{i}" in df.columns:
            out = out.withColumn(f"centroid_{a}_um", F.col(f"`centroid-{i}`") * F.col(f"_s{a}"))
    return out.drop(*[f"_s{a}" for a in axes])


def frame_interval(images: DataFrame) -> DataFrame:
    """First positive finite interval among the known metadata keys, else null."""
    keys = ("time_interval_s", "time_interval", "frame_interval_s", "frame_interval")
    tries = []
    for k in keys:
        if k in images.columns:
            v = F.col(k).try_cast("double")
            tries.append(F.when((v > 0) & (v < float("inf")) & ~F.isnan(v), v))
    value = F.coalesce(*tries) if tries else F.lit(None).cast("double")
    return images.select("image_id", value.alias("interval_s"))


def measure_intensity_over_time(
    vox: DataFrame,
    labels: DataFrame,
    images: DataFrame | None = None,
    channel: str | None = None,
    static: bool | None = None,
    properties: Sequence[str] | None = None,
    ndim: int = 2,
) -> DataFrame:
    """Long table of per-frame statistics for every (frame, label).

    ``static`` labels are one frame applied to all; otherwise each frame has its own.  A label outside the image is an
    error in both forms.
    By default labels without a ``t`` column are static.
    """
    props = _check_properties(properties or TIME_PROPERTIES) or ["mean_intensity"]
    movie = vox if channel is None else vox.where(F.col("channel") == channel)
    static = "t" not in labels.columns if static is None else static
    roi = labels.where("label > 0")
    if static:
        roi = roi.drop("t")
        met = roi.join(movie.withColumn("_seen", F.lit(True)), ["image_id", "z", "y", "x"], "left")
        outside = F.raise_error(F.lit("shape mismatch: labelled voxel outside the image")).cast("string")
        found = met.withColumn("channel", F.when(F.col("_seen"), F.col("channel")).otherwise(outside)).drop("_seen")
    else:
        chans = movie.select("image_id", "channel").distinct() if channel is None else None
        roi = roi.withColumn("channel", F.lit(channel)) if chans is None else roi.join(chans, "image_id")
        found = _label_voxels(movie, roi, VOXEL_KEY)
    aggs = []
    if "area" in props:
        aggs.append(F.count("*").alias("area"))
    if "centroid" in props:
        aggs += [F.avg(a).alias(f"centroid-{i}") for i, a in enumerate(_spatial(ndim))]
    aggs += [_INTENSITY[p]("v").alias(p) for p in props if p in _INTENSITY]
    out = found.groupBy("image_id", F.col("channel").alias("image_layer"), "t", "label").agg(*aggs)
    out = out.withColumn("time_index", F.col("t")).withColumnRenamed("t", "time")
    return add_time_seconds(out, images)


def add_time_seconds(df: DataFrame, images: DataFrame | None) -> DataFrame:
    """time_s = frame index * interval where the image has a valid interval."""
    if images is None:
        return df
    out = df.join(frame_interval(images), "image_id", "left")
    return out.withColumn("time_s", F.col("time_index") * F.col("interval_s")).drop("interval_s")


def timecourse_totals(timecourse: DataFrame, images: DataFrame) -> DataFrame:
    """n_labels seen and n_timepoints (length of the time axis) per image."""
    seen = timecourse.groupBy("image_id").agg(
        F.count("*").alias("n_rows"), F.count_distinct("label").alias("n_labels")
    )
    frames = images.select("image_id", F.col("size_t").alias("n_timepoints"))
    return frames.join(seen, "image_id", "left").na.fill(0, ["n_rows", "n_labels"])


def refresh_measurement(
    spec: Mapping,
    vox: DataFrame,
    labels: DataFrame,
    images: DataFrame | None,
    previous: DataFrame,
) -> tuple[DataFrame, DataFrame]:
    """Re-run a stored measurement; returns the new table and n_rows / delta_rows."""
    if spec.get("tool") != "measure_intensity":
        raise ValueError("only tables made by measure_intensity can be refreshed")
    new = measure_intensity(
        vox, labels, images, spec["channels"], spec.get("properties"), int(spec.get("ndim", 2))
    )
    sizes = new.select(F.lit(1).alias("new"), F.lit(0).alias("old")).unionAll(
        previous.select(F.lit(0), F.lit(1))
    )
    delta = sizes.agg(
        F.coalesce(F.sum("new"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum("new") - F.sum("old"), F.lit(0)).alias("delta_rows"),
    )
    return new, delta


def filter_table(df: DataFrame, expr: str) -> DataFrame:
    """Rows matching a SQL expression; names with hyphens need backticks."""
    try:
        return df.where(expr)
    except Exception as err:
        raise ValueError(f"filter expression failed: {err}") from err


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def intensity_columns(df: DataFrame) -> list[str]:
    return [c for c in numeric_columns(df) if "intensity" in c.lower()]


def size_columns(df: DataFrame) -> list[str]:
    # Column names that hold object sizes.
    names = {"area", "area_px", "area_um2", "volume_voxels", "volume_um3"}
    return [c for c in numeric_columns(df) if c.lower() in names]


def time_column(df: DataFrame) -> str | None:
    # Time columns in order of preference.
    return next((c for c in ("time_index", "time", "time_s", "t", "frame") if c in df.columns), None)


def summarize_table(
    df: DataFrame,
    op: str = "mean",
    group_by: str | None = None,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """One aggregate over numeric columns, optionally per group; null groups drop out, null and NaN values are skipped."""
    if op not in SUMMARY_OPS:
        raise ValueError(f"op must be one of {SUMMARY_OPS}")
    if group_by and group_by not in df.columns:
        raise ValueError(f"group_by {group_by!r} not in columns: {df.columns}")
    cols = [c for c in (columns or numeric_columns(df)) if c != group_by]
    keys = [group_by] if group_by else []
    rows = df.where(F.col(group_by).isNotNull()) if group_by else df
    if op == "median":
        return exact_medians(rows, keys, cols)
    fn = {"mean": F.avg, "sum": F.sum, "count": F.count, "std": F.stddev_samp, "min": F.min, "max": F.max}[op]
    kinds = dict(rows.dtypes)
    shown = lambda c: F.nanvl(F.col(f"`{c}`"), F.lit(None).cast(kinds[c])) if kinds[c] in ("double", "float") else F.col(f"`{c}`")
    aggs = [fn(shown(c)).alias(c) for c in cols]
    return rows.groupBy(*keys).agg(*aggs) if keys else rows.agg(*aggs)


def attach_sample_columns(df: DataFrame, samples: DataFrame, on: str = "image_id") -> DataFrame:
    """Add sample columns that the table does not have yet."""
    # Sample columns carried by measurement tables.
    wanted = ["sample_id", "sample_name", "group", "file_id", "source_file", "source_layer"]
    new = [c for c in wanted if c not in df.columns and c in samples.columns and c != on]
    if not new:
        return df
    return df.join(samples.select(on, *new), on, "left")


def lookup_objects(
    objects: DataFrame, requests: DataFrame, images: DataFrame | None = None, order: Sequence[str] = ()
) -> DataFrame:
    """Centre of the first row of each requested (image, label); a missing label fails (P10).

    Raw centroids are scaled by the layer's voxel size when the image is known; else
    the first complete set of physical centroid columns is used.
    """
    cols = set(objects.columns)
    raw = sorted((c for c in cols if c.startswith("centroid-")), key=lambda c: int(c.split("-")[1]))
    keep = [*order, *[c for c in objects.columns if c not in order]]
    row = F.struct(*[F.col(f"`{c}`") for c in keep])
    first = F.min_by(row, F.struct(*[F.col(f"`{c}`") for c in order])) if order else F.min(row)
    keys = ["image_id", "label"]
    wanted = requests.select(*keys).distinct()
    hits = objects.join(wanted, keys, "left_semi").groupBy(*keys).agg(first.alias("_row"))
    out = wanted.join(hits, keys, "left")
    found = F.when(F.col("_row").isNotNull(), F.col("_row")).otherwise(
        F.raise_error(F.concat(F.lit("label not found: "), F.col("label").cast("string")))
    )
    out = out.withColumn("_row", found)
    if raw:
        axes = _spatial(len(raw))
        parts = [F.col("_row").getField(c).cast("double") for c in raw]
        if images is not None:
            scale = images.select("image_id", *[F.col(f"voxel_{a}").alias(f"_s{a}") for a in axes])
            out = out.join(scale, "image_id", "left")
            parts = [p * F.coalesce(F.col(f"_s{a}"), F.lit(1.0)) for p, a in zip(parts, axes)]
        center = F.array(*parts)
    else:
        # Physical centroid columns in order of preference.
        sets = [
            ("centroid_z_um", "centroid_y_um", "centroid_x_um"),
            ("centroid_y_um", "centroid_x_um"),
            ("z_um", "y_um", "x_um"),
            ("y_um", "x_um"),
        ]
        chosen = next((s for s in sets if cols.issuperset(s)), None)
        if chosen is None:
            center = F.lit(None).cast("array<double>")
        else:
            center = F.array(*[F.col("_row").getField(c).cast("double") for c in chosen])
    return out.select(*keys, center.alias("center"))
