"""Target-cell analysis and recipes over many samples."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from fluoroframe.functions.text import PREPROCESS_ALIASES
from fluoroframe.operators.channels import resolve_channel, resolve_target
from fluoroframe.operators.filters import auto_contrast, gaussian, rolling_ball
from fluoroframe.operators.measure import measure_intensity
from fluoroframe.operators.segment import label_qc, segment_processes
from fluoroframe.plans.cut import cut
from fluoroframe.plans.skew import salted_join
from fluoroframe.sources.tiles import tiles_from_voxels, voxels_from_tiles

TARGET = "target"
Segmenter = Callable[[DataFrame, DataFrame], DataFrame]


@dataclass
class CellAnalysis:
    """Tables of one analysis run over all images."""

    results: DataFrame  # one row per image: ok, stage, error, counts, warnings
    labels: DataFrame
    objects: DataFrame


def normalise_step(name: str | None) -> str | None:
    """Canonical preprocessing step of a plan argument."""
    key = (name or "").strip().lower().replace("-", "_")
    if key in ("", "none", "off"):
        return None
    step = key if key == "gaussian_denoise" else PREPROCESS_ALIASES.get(key)
    if step is None:
        raise ValueError(f"unknown preprocess step {name!r}")
    return step


def normalise_steps(names: str | Sequence[str] | None) -> list[str]:
    """Canonical steps in order; one name stands for a list of one."""
    given = [names] if names is None or isinstance(names, str) else names
    return [step for step in map(normalise_step, given) if step]


def preprocess_voxels(vox: DataFrame, images: DataFrame, step: str | None) -> DataFrame:
    """One preprocessing step on voxels of one channel."""
    step = normalise_step(step)
    if step is None:
        return vox
    if step == "auto_contrast":
        return auto_contrast(vox).withColumn("v", F.col("v").cast("double"))
    tiles = tiles_from_voxels(vox)
    made = rolling_ball(tiles, images) if step == "rolling_ball" else gaussian(tiles, images)
    return voxels_from_tiles(made)


def default_segmenter(vox: DataFrame, images: DataFrame) -> DataFrame:
    """Otsu threshold and connected components; pass a model through
    ``segment_with_model`` instead where one is available."""
    return segment_processes(vox, images)[0]


def analyze_target_cells(
    vox: DataFrame,
    images: DataFrame,
    layers: DataFrame,
    channels: DataFrame,
    target: str | None = None,
    preprocess: str | Sequence[str] | None = None,
    segment: Segmenter = default_segmenter,
    ndim: int = 2,
) -> CellAnalysis:
    """Resolve, preprocess, segment and measure the target channel of every image.

    Failures are rows of ``results``, never exceptions: an ambiguous channel stops at
    stage resolve_target, a movie or an image without objects at stage segment.
    """
    if target is None:
        chosen = resolve_target(layers, channels)
    else:
        asked = layers.select("image_id").distinct().select("image_id", F.col("image_id").alias("request_id"), F.lit(target).alias("query"))
        chosen = resolve_target(layers, channels, asked).drop("request_id", "query")
    chosen = cut(chosen)
    still = images.where("coalesce(size_t, 1) <= 1").select("image_id")
    picked = chosen.where("status = 'ok'").select("image_id", "layer").join(still, "image_id", "left_semi")
    mine = salted_join(vox, picked.withColumnRenamed("layer", "channel"), ["image_id", "channel"], ["t", "z", "y", "x"])
    # all images go through one plan under a common channel name
    work, wanted = mine.withColumn("channel", F.lit(TARGET)), normalise_steps(preprocess)
    for step in wanted:
        work = cut(preprocess_voxels(work, images, step), work)
    labels = cut(segment(work, images))
    objects = measure_intensity(work, labels, images, [TARGET], ndim=ndim)
    objects = cut(objects.join(picked.withColumnRenamed("layer", "source_layer"), "image_id"))
    found = label_qc(labels)
    out = images.select("image_id", "size_t", *[F.col(f"voxel_{a}").cast("double").alias(f"voxel_{a}") for a in "zyx"])
    out = out.join(chosen, "image_id", "left").join(found, "image_id", "left")
    resolved = F.coalesce(F.col("status") == "ok", F.lit(False))
    moving = F.coalesce(F.col("size_t") > 1, F.lit(False))
    some = F.coalesce(F.col("n_objects") > 0, F.lit(False))
    scale = [F.col(f"voxel_{a}") for a in ("zyx" if ndim == 3 else "yx")]
    plain = F.lit(True)
    for s in scale:
        plain = plain & F.coalesce(F.abs(s - 1.0) < 1e-9, F.lit(True))
    uneven = F.lit(ndim == 3) & ~plain & (F.col("voxel_z") != F.col("voxel_y"))
    warn = F.array_compact(
        F.array(
            F.when(F.col("source") == "inference", F.concat(F.lit("channel "), "layer", F.lit(" was taken as the target because its image has no other; annotate it to be sure"))),
            F.when(some & plain, F.lit("every voxel size is 1, so sizes are counted in voxels; physical columns need voxel sizes")),
            F.when(some & uneven, F.format_string("voxels are not cubes (z %s, y %s, x %s), which stretches shapes in 3-D", "voxel_z", "voxel_y", "voxel_x")),
        )
    )
    results = out.select(
        "image_id",
        (resolved & some).alias("ok"),
        F.when(~resolved, "resolve_target").when(~some, "segment").alias("stage"),
        F.when(~resolved, F.coalesce("note", F.lit("no layers for this image"))).when(moving, F.lit("the image is a movie; keep one frame with extract_timepoint first")).when(~some, F.lit("segmentation produced zero objects on the target channel")).alias("error"),
        F.col("layer").alias("target_channel"),
        F.col("source").alias("target_source"),
        F.lit(", ".join(wanted) or None).cast("string").alias("preprocess"),
        F.coalesce("n_objects", F.lit(0)).alias("n_objects"),
        "object_area_min",
        "object_area_median",
        "object_area_max",
        (some & ~plain).alias("has_physical_units"),
        warn.alias("warnings"),
    )
    return CellAnalysis(cut(results), labels, objects)


def run_recipe(
    recipe: dict,
    samples: DataFrame,
    vox: DataFrame,
    images: DataFrame,
    layers: DataFrame,
    channels: DataFrame,
    files: DataFrame | None = None,
    names: Sequence[str] | None = None,
    segment: Segmenter = default_segmenter,
    ndim: int = 2,
) -> tuple[DataFrame, DataFrame]:
    """Apply a recipe to all (or the named) samples in one plan.

    samples: sample_name, sample_id, group, image_id, file_ids, files.  The target is
    resolved per sample.  Returns (runs, objects with sample columns); a failed sample
    is a failed run and never stops the others.
    """
    use = samples if names is None else samples.where(F.col("sample_name").isin(list(names)))
    ids = use.select("image_id").distinct()
    steps = recipe.get("preprocessing") or []
    only = lambda df: df.join(ids, "image_id", "left_semi")
    done = analyze_target_cells(
        only(vox), only(images), only(layers), channels, recipe.get("target_channel"), [s["step"] for s in steps], segment, ndim
    )
    file_id = F.get("file_ids", F.lit(0))
    rows = use.select("sample_name", "sample_id", "group", "image_id", file_id.alias("file_id"), F.get("files", F.lit(0)).alias("_path"))
    if files is not None:
        rows = rows.join(files.select("file_id", F.col("path").alias("_known")), "file_id", "left")
        source = F.when(F.col("file_id").isNotNull(), F.col("_known")).otherwise(F.col("_path"))
    else:
        source = F.when(F.col("file_id").isNull(), F.col("_path"))
    rows = rows.withColumn("source_file", source).drop("_path", "_known")
    out = rows.join(done.results, "image_id", "left")
    ok = F.coalesce("ok", F.lit(False))
    runs = out.select(
        F.lit(None).cast("string").alias("run_id"),
        "sample_name",
        "sample_id",
        F.coalesce("file_id", F.lit("")).alias("file_id"),
        F.lit(recipe["name"]).alias("recipe_id"),
        F.when(ok, "complete").otherwise("failed").alias("status"),
        F.when(~ok, F.coalesce("error", F.lit("no image for this sample"))).alias("error"),
        F.when(ok, F.col("n_objects")).alias("n_objects"),
        "target_channel",
        F.coalesce("warnings", F.array().cast("array<string>")).alias("warnings"),
        F.current_timestamp().alias("updated_at"),
    )
    objects = done.objects.join(rows, "image_id")
    return runs, objects
