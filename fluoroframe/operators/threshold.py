"""Global thresholds from per-image histograms."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from fluoroframe.plans.ranks import exact_percentiles
from fluoroframe.plans.skew import salted_join

LAYER = ["image_id", "channel"]


def _finite(vox: DataFrame) -> DataFrame:
    return vox.where(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < float("inf")))


def _by_dtype(vox: DataFrame, images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Voxels of images with whole-number pixels, and all others; an image without a dtype is one of the others."""
    kind = images.select("image_id", F.lower("dtype").rlike("^u?int").alias("_whole"))
    marked = vox.join(kind, "image_id", "left")
    whole = F.coalesce("_whole", F.lit(False))
    return marked.where(whole).drop("_whole"), marked.where(~whole).drop("_whole")


def histogram(vox: DataFrame, bins: int | str = 256, images: DataFrame | None = None) -> DataFrame:
    """Bin counts per layer: bin, center, h, plus the value range mn and mx.

    ``bins`` equal bins over [min, max], empty ones included, or "integer" for one bin per grey level.  With ``images``
    layers of integer images have grey levels, all others ``bins``.  Grey levels without a voxel are left out but for
    the two beside each level that has some, which is where a score of the triangle method can be largest; so the rows
    follow the levels that exist, whatever the range is.
    """
    if images is not None and bins != "integer":
        whole, other = _by_dtype(vox, images)
        return histogram(whole, "integer").unionByName(histogram(other, bins))
    pix = _finite(vox)
    span = pix.groupBy(*LAYER).agg(F.min("v").alias("mn"), F.max("v").alias("mx"))
    if bins == "integer":
        got = pix.groupBy(*LAYER, F.floor("v").cast("long").alias("bin")).agg(F.count("*").alias("h"))
        levels = F.explode(F.array(*[F.struct((F.col("bin") + d).alias("bin"), (F.col("h") if d == 0 else F.lit(0).cast("long")).alias("h")) for d in (-1, 0, 1)]))
        near = got.select(*LAYER, levels.alias("n")).select(*LAYER, "n.*").groupBy(*LAYER, "bin").agg(F.max("h").alias("h"))
        out = near.join(span, LAYER).where((F.col("bin") >= F.floor("mn")) & (F.col("bin") <= F.floor("mx")))
        return out.select(*LAYER, "mn", "mx", "bin", "h", F.col("bin").cast("double").alias("center"))
    n = int(bins)
    width = F.col("mx") - F.col("mn")
    at = F.when(width > 0, F.least(F.floor((F.col("v") - F.col("mn")) / width * n), F.lit(n - 1)))
    binned = salted_join(pix, span, LAYER, ["t", "z", "y", "x"])
    got = binned.groupBy(*LAYER, F.coalesce(at, F.lit(0)).cast("long").alias("bin"))
    got = got.agg(F.count("*").alias("h"))
    full = span.withColumn(
        "bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    )
    out = full.join(got, [*LAYER, "bin"], "left").na.fill(0, ["h"])
    return out.withColumn("center", F.col("mn") + (F.col("bin") + 0.5) * width / n)


def _up() -> Window:
    return Window.partitionBy(*LAYER).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)


def _down() -> Window:
    return Window.partitionBy(*LAYER).orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)


def _next(c: str) -> Column:
    return F.lead(c).over(Window.partitionBy(*LAYER).orderBy("bin"))


def _best(scored: DataFrame) -> DataFrame:
    """Centre of the first bin with the largest score; constant layers give their value."""
    pick = F.max_by("center", F.struct("score", (-F.col("bin")).alias("b")))
    top = scored.groupBy(*LAYER).agg(
        pick.alias("_c"), F.max("mn").alias("_mn"), F.max("mx").alias("_mx")
    )
    value = F.when(F.col("_mn") == F.col("_mx"), F.col("_mn")).otherwise(F.col("_c"))
    return top.select(*LAYER, value.alias("threshold"))


def otsu(vox: DataFrame, bins: int | str = 256, images: DataFrame | None = None) -> DataFrame:
    h = histogram(vox, bins, images)
    hc = F.col("h") * F.col("center")
    cum = (
        h.withColumn("w1", F.sum("h").over(_up()).cast("double"))
        .withColumn("s1", F.sum(hc).over(_up()))
        .withColumn("w2", F.sum("h").over(_down()).cast("double"))
        .withColumn("s2", F.sum(hc).over(_down()))
        .withColumn("m1", F.try_divide("s1", "w1"))
        .withColumn("m2", F.try_divide("s2", "w2"))
        .withColumn("w2n", _next("w2"))
        .withColumn("m2n", _next("m2"))
    )
    gap = F.col("m1") - F.col("m2n")
    return _best(cum.withColumn("score", F.coalesce(F.col("w1") * F.col("w2n") * gap * gap, F.lit(-1.0))))


def yen(vox: DataFrame, bins: int | str = 256, images: DataFrame | None = None) -> DataFrame:
    h = histogram(vox, bins, images)
    total = Window.partitionBy(*LAYER)
    p = h.withColumn("p", F.col("h") / F.sum("h").over(total)).withColumn("pp", F.col("p") * F.col("p"))
    cum = (
        p.withColumn("P", F.sum("p").over(_up()))
        .withColumn("Q", F.sum("pp").over(_up()))
        .withColumn("R", F.sum("pp").over(_down()))
        .withColumn("Rn", _next("R"))
    )
    part = F.col("P") * (1 - F.col("P"))
    ratio = F.try_divide(part * part, F.col("Q") * F.col("Rn"))
    return _best(cum.withColumn("score", F.coalesce(F.when(ratio > 0, F.log(ratio)), F.lit(float("-inf")))))


def triangle(vox: DataFrame, bins: int | str = 256, images: DataFrame | None = None) -> DataFrame:
    h = histogram(vox, bins, images)
    shape = h.groupBy(*LAYER).agg(
        F.max_by("bin", F.struct("h", (-F.col("bin")).alias("b"))).alias("k"),
        F.max("h").alias("top"),
        F.min(F.when(F.col("h") > 0, F.col("bin"))).alias("a"),
        F.max(F.when(F.col("h") > 0, F.col("bin"))).alias("b"),
        F.min("bin").alias("first"),
        F.max("bin").alias("last"),
    )
    j = h.join(shape, LAYER)
    flip = (F.col("k") - F.col("a")) < (F.col("b") - F.col("k"))
    end = F.col("first") + F.col("last")
    j = j.withColumn("_flip", flip)
    # mirrored coordinates: position, tail start and peak
    j = j.withColumn("_at", F.when(flip, end - F.col("bin")).otherwise(F.col("bin")))
    j = j.withColumn("_a", F.when(flip, end - F.col("b")).otherwise(F.col("a")))
    j = j.withColumn("_k", F.when(flip, end - F.col("k")).otherwise(F.col("k")))
    x = (F.col("_at") - F.col("_a")).cast("double")
    run = (F.col("_k") - F.col("_a")).cast("double")
    norm = F.sqrt(F.col("top").cast("double") * F.col("top") + run * run)
    score = (F.col("top") / norm) * x - (run / norm) * F.col("h")
    tail = (F.col("_at") >= F.col("_a")) & (F.col("_at") < F.col("_k"))
    scored = j.where(tail | (F.col("mn") == F.col("mx")))
    pick = F.max_by("center", F.struct("score", (-F.col("_at")).alias("b")))
    top = scored.withColumn("score", F.coalesce(F.when(norm > 0, score), F.lit(0.0))).groupBy(*LAYER)
    top = top.agg(pick.alias("_c"), F.max("mn").alias("_mn"), F.max("mx").alias("_mx"))
    value = F.when(F.col("_mn") == F.col("_mx"), F.col("_mn")).otherwise(F.col("_c"))
    return top.select(*LAYER, value.alias("threshold"))


def percentiles(vox: DataFrame, probs: Mapping[str, float]) -> DataFrame:
    """Exact linear-interpolated percentiles of the finite voxels per layer."""
    return exact_percentiles(_finite(vox), LAYER, "v", dict(probs))


def resolve_threshold(vox: DataFrame, spec: float | str, bins: int | str = 256, images: DataFrame | None = None) -> DataFrame:
    """Threshold per layer from a number, "zero", "otsu", "yen" or "triangle"; ``images`` as in ``histogram``."""
    methods = {"otsu": otsu, "yen": yen, "triangle": triangle}
    if isinstance(spec, str) and spec.strip().lower() in methods:
        return methods[spec.strip().lower()](vox, bins, images)
    if isinstance(spec, str) and spec.strip().lower() == "zero":
        value = 0.0
    else:
        try:
            value = float(spec)
        except (TypeError, ValueError) as err:
            raise ValueError(f"unsupported threshold spec: {spec!r}") from err
    return vox.select(*LAYER).distinct().withColumn("threshold", F.lit(value))


def above_threshold(vox: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Voxels strictly above their layer's threshold, infinite ones too."""
    joined = salted_join(vox.where(~F.isnan("v")), thresholds, LAYER, ["t", "z", "y", "x"])
    return joined.where("v > threshold").drop("threshold")
