"""Quality-control operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fluoroframe.operators.measure import intensity_columns, size_columns, time_column
from fluoroframe.operators.segment import label_sizes
from fluoroframe.plans.ranks import exact_percentiles, weighted_median
from fluoroframe.plans.skew import salted_join

STATUSES = ("pass", "warning", "fail", "not_checked")
BRANCH_STATUSES = ("accepted", "rejected", "not_checked")


def status_of(failed: Column, warnings: Column) -> Column:
    """fail when failed, warning when there is any warning, else pass."""
    return F.when(failed, "fail").when(F.size(warnings) > 0, "warning").otherwise("pass")


def _texts(*pairs: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in pairs]))


def border_labels(labels: DataFrame, images: DataFrame, ndim: int = 2) -> DataFrame:
    """Labels present in the first or last plane of any axis."""
    size = images.select("image_id", *[f"size_{a}" for a in "zyx"])
    placed = salted_join(labels.where("label > 0"), size, ["image_id"], ["z", "y", "x"])
    axes = "zyx" if ndim == 3 else "yx"
    edge = " OR ".join(f"{a} = 0 OR {a} = size_{a} - 1" for a in axes)
    return placed.where(edge).select("image_id", "label").distinct()


def saturation(vox: DataFrame, images: DataFrame) -> DataFrame:
    """Share of saturated voxels per image and whether it can be interpreted.

    Integer images: voxels at the type's largest value.  Floating point: at least
    0.999 when the image stays within [0, 1]; otherwise voxels at the maximum, which
    is not interpretable.
    """
    limits = F.create_map(
        *[F.lit(v) for b in (8, 16, 32, 64) for s, top in (("u", 2**b), ("", 2 ** (b - 1))) for v in (f"{s}int{b}", float(top - 1))]
    )
    whole = F.try_element_at(limits, F.col("dtype"))
    pix = salted_join(vox, images.select("image_id", whole.alias("_top")), ["image_id"], ["t", "z", "y", "x"])
    finite = F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < float("inf"))
    pix = pix.where(F.col("_top").isNotNull() | finite)
    seen = pix.groupBy("image_id", "_top").agg(
        F.count("*").alias("n"),
        F.max("v").alias("mx"),
        F.count_if(F.col("v") >= F.col("_top")).alias("at_top"),
        F.count_if(F.col("v") >= 0.999).alias("near_one"),
    )
    peak = seen.where("_top IS NULL").select("image_id", "mx")
    at_max = salted_join(pix.where("_top IS NULL"), peak, ["image_id"], ["t", "z", "y", "x"]).where("v >= mx")
    at_max = at_max.groupBy("image_id").agg(F.count("*").alias("at_max"))
    out = seen.join(at_max, "image_id", "left")
    hits = F.when(F.col("_top").isNotNull(), F.col("at_top")).when(F.col("mx") <= 1.0, F.col("near_one")).otherwise(F.col("at_max"))
    return out.select(
        "image_id",
        (hits / F.col("n")).alias("saturation_fraction"),
        (F.col("_top").isNotNull() | (F.col("mx") <= 1.0)).alias("saturation_interpretable"),
    )


def segmentation_qc(
    labels: DataFrame, images: DataFrame, vox: DataFrame | None = None, ndim: int = 2
) -> DataFrame:
    """One QC row per image: sizes, tiny / large / border fractions, saturation."""
    sizes = label_sizes(labels)
    by_size = sizes.groupBy("image_id", "size").agg(F.count("*").alias("n"))
    median = weighted_median(by_size, ["image_id"], "size", "n", "object_size_median")
    edge = border_labels(labels, images, ndim).groupBy("image_id").agg(
        F.count("*").alias("_border"), F.array_sort(F.collect_set("label")).alias("border_touching_labels")
    )
    tiny = F.col("size") < F.greatest(F.lit(1.0), F.col("object_size_median") * 0.25)
    large = F.col("size") > F.col("object_size_median") * 4.0
    # the size histogram stands in for the objects: few rows per image
    stats = by_size.join(median, "image_id").groupBy("image_id", "object_size_median").agg(
        F.sum("n").alias("n_objects"),
        F.min("size").alias("object_size_min"),
        F.max("size").alias("object_size_max"),
        (F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("object_size_mean"),
        (F.sum(F.when(tiny, F.col("n")).otherwise(0)) / F.sum("n")).alias("tiny_object_fraction"),
        (F.sum(F.when(large, F.col("n")).otherwise(0)) / F.sum("n")).alias("large_object_fraction"),
    )
    scale = [F.col(f"voxel_{a}").cast("double") for a in ("zyx" if ndim == 3 else "yx")]
    unit = F.lit(True)
    for s in scale:
        unit = unit & F.coalesce(F.abs(s - 1.0) < 1e-9, F.lit(False))
    missing = unit
    for s in scale:
        missing = missing | s.isNull()
    out = images.select("image_id", missing.alias("_unit")).join(stats, "image_id", "left").join(edge, "image_id", "left")
    out = out.na.fill(0).withColumn(
        "border_touching_labels",
        F.coalesce("border_touching_labels", F.array().cast(labels.select(F.array("label")).dtypes[0][1])),
    )
    out = out.withColumn("border_touching_fraction", F.coalesce(F.try_divide("_border", "n_objects"), F.lit(0.0)))
    full = F.lit(False)
    if vox is not None:
        out = out.join(saturation(vox, images), "image_id", "left")
        full = F.coalesce(F.col("saturation_interpretable") & (F.col("saturation_fraction") > 0.001), F.lit(False))
    some = F.col("n_objects") > 0
    # Warning texts and limits.
    warn = _texts(
        (~some, "No labeled objects were found."),
        (some & F.col("_unit"), "Layer scale is missing or unit-valued; physical sizes may be unavailable."),
        (some & (F.col("tiny_object_fraction") > 0.25), "Many labeled objects are much smaller than the median object size."),
        (some & (F.col("large_object_fraction") > 0.10), "Some labeled objects are much larger than the median object size."),
        (some & (F.col("border_touching_fraction") > 0.10), "Some labeled objects touch the image border."),
        (some & full, "Image has saturated pixels; intensity measurements may be clipped."),
    )
    out = out.withColumn("warnings", warn)
    return out.withColumn("status", status_of(~some, F.col("warnings"))).drop("_unit", "_border")


def measurement_qc(df: DataFrame, name: str = "table") -> DataFrame:
    """One QC row for a measurement table."""
    heat, sizes = intensity_columns(df), size_columns(df)
    cols = df.columns
    q = lambda c: F.col(f"`{c}`")
    floats = {n for n, t in df.dtypes if t in ("double", "float")}

    def gone(c):
        return q(c).isNull() | F.isnan(q(c)) if c in floats else q(c).isNull()

    def real(c):
        return ~gone(c) & (F.abs(q(c)) < float("inf"))

    aggs = [F.count("*").alias("n_rows")]
    aggs.append(sum((F.count_if(gone(c)) for c in cols), F.lit(0)).alias("_nulls"))
    if "label" in cols:
        aggs += [F.count_distinct("label").alias("n_labels"), F.count_if(gone("label")).alias("_null_labels")]
    for i, c in enumerate(heat):
        aggs.append((F.max(F.when(real(c), F.abs(q(c)))) <= 1e-8).alias(f"_zero{i}"))
    for i, c in enumerate(sizes):
        aggs.append(F.count_if(real(c) & (q(c) < 0)).alias(f"_neg{i}"))
        aggs.append(F.count_if(real(c) & (q(c) > 0)).alias(f"_pos{i}"))
    one = df.agg(*aggs).withColumn("_one", F.lit(1))
    for i, c in enumerate(sizes):
        good = df.where(real(c) & (q(c) > 0)).withColumn("_one", F.lit(1))
        p = exact_percentiles(good.select("_one", q(c).alias("v")), ["_one"], "v", {f"_lo{i}": 0.05, f"_hi{i}": 0.95})
        one = one.join(p, "_one", "left")
    yes = lambda flags, names: F.array_compact(F.array(*[F.when(f, F.lit(n)) for f, n in zip(flags, names)])).cast("array<string>")
    zero = yes([F.col(f"_zero{i}") for i in range(len(heat))], heat)
    broad = yes(
        [
            (F.col(f"_pos{i}") >= 3) & (F.col(f"_lo{i}") > 0) & (F.try_divide(f"_hi{i}", f"_lo{i}") > 50)
            for i in range(len(sizes))
        ],
        sizes,
    )
    negative = yes([F.col(f"_neg{i}") > 0 for i in range(len(sizes))], sizes)
    some = F.col("n_rows") > 0
    out = one.withColumns(
        {
            "null_fraction": F.col("_nulls") / F.greatest(F.lit(1), F.col("n_rows") * len(cols)),
            "all_zero_intensity_columns": zero,
            "broad_size_distribution_columns": broad,
            "negative_size_columns": negative,
        }
    )
    if "label" in cols:
        # a missing label counts once as a value of its own when looking for repeats
        distinct = F.col("n_labels") + F.when(F.col("_null_labels") > 0, 1).otherwise(0)
        out = out.withColumn("duplicate_label_rows", F.col("n_rows") - distinct)
        label_warn = (some & (F.col("duplicate_label_rows") > 0), "Measurement table has duplicate label rows.")
    else:
        label_warn = (some, "Measurement table has no label column.")
    # Warning texts.
    warn = _texts(
        (~some, "Measurement table is empty."),
        label_warn,
        (some & (F.col("null_fraction") > 0), "Measurement table contains missing values."),
        (some & F.lit(not heat), "Measurement table has no numeric intensity columns."),
        (some & (F.size("all_zero_intensity_columns") > 0), "One or more intensity columns are all zero."),
        (some & F.lit(not sizes), "Measurement table has no area or volume column."),
        (some & (F.size("negative_size_columns") > 0), "Area or volume columns contain negative values."),
        (some & (F.size("broad_size_distribution_columns") > 0), "Object-size distribution is very broad."),
    )
    failed = ~some | (F.size("negative_size_columns") > 0)
    out = out.withColumn("warnings", warn).withColumn("status", status_of(failed, F.col("warnings")))
    keep = [c for c in out.columns if not c.startswith("_")]
    return out.select(F.lit(name).alias("source"), F.lit(len(cols)).alias("n_columns"), *keep)


def timecourse_qc(df: DataFrame, name: str = "table", by: list[str] | None = None) -> DataFrame:
    """One QC row per table, or per ``by`` key, for a long time-course table.

    Missing pairs are counted as labels * times - present pairs, so the full grid of
    expected pairs is never built.
    """
    by = list(by or [])
    heat, when = intensity_columns(df), time_column(df)
    keys = by or ["_all"]
    data = df if by else df.withColumn("_all", F.lit(0))
    lacking = []
    # Warning texts.
    if "label" not in df.columns:
        lacking.append("Timecourse table has no label column.")
    if when is None:
        lacking.append("Timecourse table has no time column.")
    if not heat:
        lacking.append("Timecourse table has no numeric intensity columns.")
    if lacking:
        n = data.groupBy(*keys).agg(F.count("*").alias("n_rows")) if by else df.agg(F.count("*").alias("n_rows"))
        empty = F.array(F.lit("Timecourse table is empty."))
        warn = F.when(F.col("n_rows") == 0, empty).otherwise(F.array(*[F.lit(w) for w in lacking]))
        return n.withColumn("warnings", warn).withColumn("status", F.lit("fail")).withColumn("source", F.lit(name))
    v = F.col(f"`{heat[0]}`").cast("double")
    real = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    good = F.when(real, v)
    # (key, label, time) first: both distinct counts and the per-label range come from it
    cell = data.groupBy(*keys, "label", F.col(when).alias("_t")).agg(
        F.count("*").alias("_rows"), F.count(good).alias("_n"), F.max(good).alias("_hi"), F.min(good).alias("_lo")
    )
    roi = cell.groupBy(*keys, "label").agg(
        F.sum("_rows").alias("_rows"),
        F.count("_t").alias("_pairs"),
        F.sum("_n").alias("_n"),
        (F.max("_hi") - F.min("_lo")).alias("_range"),
    )
    known = F.col("label").isNotNull()
    per = roi.groupBy(*keys).agg(
        F.sum("_rows").alias("n_rows"),
        F.count("label").alias("n_rois"),
        F.coalesce(F.sum(F.when(known, F.col("_pairs"))), F.lit(0)).alias("_present"),
        F.min(F.when(known, F.col("_n"))).alias("points_per_roi_min"),
        F.max(F.when(known, F.col("_n"))).alias("points_per_roi_max"),
        F.count_if(known & (F.col("_n") >= 2) & (F.col("_range") <= 1e-9)).alias("_flat"),
    )
    times = cell.where("_t IS NOT NULL").select(*keys, "_t").distinct().groupBy(*keys).agg(F.count("*").alias("n_timepoints"))
    out = per.join(times, keys, "left").na.fill(0)
    if not by:
        one = df.sparkSession.range(1).select(F.lit(0).alias("_all"))
        out = one.join(out, "_all", "left").na.fill(0)
    expected = F.col("n_rois") * F.col("n_timepoints")
    out = out.withColumns(
        {
            "missing_roi_time_pairs": expected - F.col("_present"),
            "missing_roi_time_fraction": (expected - F.col("_present")) / F.greatest(F.lit(1), expected),
            "flat_trace_fraction": F.col("_flat") / F.greatest(F.lit(1), F.col("n_rois")),
        }
    )
    some = F.col("n_rows") > 0
    warn = _texts(
        (~some, "Timecourse table is empty."),
        (some & (F.col("missing_roi_time_pairs") > 0), "Some ROI/timepoint measurements are missing."),
        (some & (F.col("flat_trace_fraction") > 0.5), "Most ROI traces are flat; confirm the time axis and ROI mapping."),
    )
    out = out.withColumn("warnings", warn).withColumn("status", status_of(~some, F.col("warnings")))
    keep = [*by, *[c for c in out.columns if not c.startswith("_") and c not in by]]
    return out.select(F.lit(name).alias("source"), *keep)


def missing_pairs(df: DataFrame, by: list[str], time: str) -> DataFrame:
    """(label, time) pairs of each key that have no row.

    The distinct times of a key, at most one per frame, travel to its labels as one
    array; each label lists what it lacks.
    """
    seen = df.where(F.col("label").isNotNull() & F.col(time).isNotNull()).select(*by, "label", F.col(time).alias("_t"))
    seen = seen.distinct()
    have = seen.groupBy(*by, "label").agg(F.collect_list("_t").alias("_have"))
    frames = seen.select(*by, "_t").distinct().groupBy(*by).agg(F.collect_list("_t").alias("_all"))
    both = salted_join(have, frames, by, ["label"])
    return both.select(*by, "label", F.explode(F.array_except("_all", "_have")).alias(time))


# ---------------------------------------------------------------- review state


def upsert_qc(qc: DataFrame, new: DataFrame, order: str = "updated_at") -> DataFrame:
    """One row per source, the latest wins."""
    both = qc.unionByName(new, allowMissingColumns=True)
    rest = [c for c in both.columns if c != "source"]
    last = F.max_by(F.struct(*rest), order).alias("r")
    return both.groupBy("source").agg(last).select("source", "r.*")


def mark_status(qc: DataFrame, reviews: DataFrame, order: str = "updated_at") -> DataFrame:
    """Apply review events: status and notes replaced, warnings and metrics kept (M3).

    reviews: source, status, notes, updated_at.  Unknown sources get a new row.
    """
    ok = F.when(F.col("status").isin(*STATUSES), F.col("status")).otherwise(
        F.raise_error(F.lit("status must be pass, warning, fail, or not_checked"))
    )
    last = reviews.groupBy("source").agg(F.max_by(F.struct("status", "notes"), order).alias("r"))
    last = last.select("source", F.lit(True).alias("_r"), "r.status", F.col("r.notes").alias("_notes"))
    last = last.withColumn("status", ok).withColumnRenamed("status", "_status")
    out = qc.join(last, "source", "full_outer")
    out = out.withColumn("status", F.coalesce("_status", "status"))
    out = out.withColumn("notes", F.when(F.col("_r"), F.col("_notes")).otherwise(F.col("notes")))
    out = out.withColumn("reviewed_by_user", F.coalesce("_r", "reviewed_by_user"))
    none = F.array().cast("array<string>")
    if "warnings" in qc.columns:
        out = out.withColumn("warnings", F.coalesce("warnings", none))
    return out.select(*qc.columns)


def set_branch_qc(branch_qc: DataFrame, events: DataFrame, branches: DataFrame) -> DataFrame:
    """Upsert branch review states (M2).

    events: trace_id, branch_ids ARRAY<INT>, status, reason, updated_at.  An id that is
    no branch of its trace is an error; an empty reason keeps the earlier one.
    """
    ok = F.when(F.col("status").isin(*BRANCH_STATUSES), F.col("status")).otherwise(
        F.raise_error(F.lit("status must be accepted, rejected, or not_checked"))
    )
    ev = events.select("trace_id", F.explode("branch_ids").alias("branch_id"), ok.alias("status"), "reason", "updated_at")
    known = branches.select("trace_id", "branch_id", F.lit(True).alias("_known"))
    ev = ev.join(known, ["trace_id", "branch_id"], "left")
    bad = F.raise_error(F.concat(F.lit("branch id out of range: "), F.col("branch_id").cast("string")))
    ev = ev.withColumn("branch_id", F.when(F.col("_known"), F.col("branch_id")).otherwise(bad)).drop("_known")
    both = branch_qc.select("trace_id", "branch_id", "status", "reason", "updated_at").unionByName(ev)
    told = F.when(F.length("reason") > 0, F.col("updated_at"))
    return both.groupBy("trace_id", "branch_id").agg(
        F.max_by("status", "updated_at").alias("status"),
        F.max_by("reason", told).alias("reason"),
        F.max("updated_at").alias("updated_at"),
    )


def rejected_branches(branch_qc: DataFrame) -> DataFrame:
    return branch_qc.where("status = 'rejected'").select("trace_id", "branch_id")


def accepted_only(branches: DataFrame, branch_qc: DataFrame) -> DataFrame:
    """Branches without the rejected ones."""
    return branches.join(rejected_branches(branch_qc), ["trace_id", "branch_id"], "left_anti")


def review_sources(qc: DataFrame, tables: DataFrame, layers: DataFrame) -> DataFrame:
    """Sources open for review: QC records, tables and label layers, each once.

    qc: source, kind; tables: name; layers: name, kind.
    """
    known = qc.where("source IS NOT NULL AND source != ''").select("kind", "source")
    return (
        known.unionByName(tables.select(F.lit("table").alias("kind"), F.col("name").alias("source")))
        .unionByName(layers.where("kind = 'labels'").select("kind", F.col("name").alias("source")))
        .dropDuplicates(["kind", "source"])
    )
