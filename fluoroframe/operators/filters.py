"""Background, contrast, denoising and ridge filters on tiles."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, functions as F

from fluoroframe.plans.blocks import map_tiles
from fluoroframe.plans.cut import cut
from fluoroframe.plans.ranks import exact_percentiles
from fluoroframe.plans.skew import salted_join
from fluoroframe.sources.tiles import VOXEL_KEY, voxels_from_tiles

LAYER = ["image_id", "channel"]
SLAB = 16  # planes per group of a three-dimensional kernel


def _like_input(values: np.ndarray, dtype: str | None) -> np.ndarray:
    """Cast back to the image type: integers are truncated."""
    return np.trunc(values) if dtype and "int" in dtype else values


def ball_minimum(planes: np.ndarray, radius: float) -> np.ndarray:
    """Rolling-ball background of every plane: the ball is pushed up from below."""
    r = int(math.ceil(radius))
    out = np.full(planes.shape, np.inf)
    ny, nx = planes.shape[1:]
    for dy in range(-r, r + 1):
        for dx in range(-r, r + 1):
            gap = radius * radius - dy * dy - dx * dx
            if gap < 0:
                continue
            lift = radius - math.sqrt(gap)
            y0, y1, x0, x1 = max(0, -dy), ny - max(0, dy), max(0, -dx), nx - max(0, dx)
            part = out[:, y0:y1, x0:x1]
            np.minimum(part, planes[:, y0 + dy : y1 + dy, x0 + dx : x1 + dx] + lift, out=part)
    return out


def rolling_ball(tiles: DataFrame, images: DataFrame, radius: float = 50.0) -> DataFrame:
    """v - background for every plane."""
    r = int(math.ceil(radius))

    def kernel(a, info):
        base = _like_input(ball_minimum(a, radius), info["dtype"])
        return np.where(np.isfinite(a), a, 0.0) - np.where(np.isfinite(base), base, 0.0)

    return map_tiles(tiles, images, kernel, (0, r, r), "inf")


def rescale(df: DataFrame, lo: str = "lo", hi: str = "hi", flat_zero: bool = False) -> DataFrame:
    """(v - lo) / (hi - lo) clipped to [0, 1] as float32 (F16).

    A flat range gives 0 with ``flat_zero``, else v clipped to [0, 1].
    """
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    flat = F.lit(0.0) if flat_zero else clip(F.col("v"))
    v = F.when(F.col(hi) > F.col(lo), clip((F.col("v") - F.col(lo)) / (F.col(hi) - F.col(lo)))).otherwise(flat)
    return df.withColumn("v", v.cast("float"))


def auto_contrast(vox: DataFrame, low_pct: float = 1.0, high_pct: float = 99.0) -> DataFrame:
    """Rescale every layer to its percentile range: two passes, no Python."""
    span = exact_percentiles(vox, LAYER, "v", {"lo": low_pct / 100, "hi": high_pct / 100})
    return rescale(salted_join(vox, span, LAYER, ["t", "z", "y", "x"])).drop("lo", "hi")


def _rescale_tiles(tiles: DataFrame, low: float, high: float) -> DataFrame:
    """The percentile rescaling on tiles; one pass for the ranks, one projection."""
    pix = tiles.select(*LAYER, F.explode("data").alias("v"))
    pix = pix.where(F.abs("v") < float("inf"))
    span = exact_percentiles(pix, LAYER, "v", {"lo": low / 100, "hi": high / 100})
    out = salted_join(tiles, span, LAYER, ["t", "z", "ty", "tx"], "left")
    data = F.expr(
        "transform(data, v -> CASE WHEN hi > lo THEN "
        "cast(greatest(0D, least(1D, (v - lo) / (hi - lo))) AS float) ELSE 0F END)"
    )
    return out.withColumn("data", data).drop("lo", "hi")


def gauss_weights(sigma: float, order: int = 0, radius: int | None = None) -> np.ndarray:
    """Normalised Gaussian or its first / second derivative on the integer grid."""
    r = int(4 * sigma + 0.5) if radius is None else radius
    d = np.arange(-r, r + 1, dtype=float)
    g = np.exp(-0.5 * d * d / (sigma * sigma))
    g /= g.sum()
    if order == 1:
        return -d / sigma**2 * g
    if order == 2:
        return (d * d / sigma**4 - 1 / sigma**2) * g
    return g


def convolve(a: np.ndarray, weights: np.ndarray, axis: int) -> np.ndarray:
    """Correlation with mirrored weights along one axis; the rim of the array is filler."""
    r = len(weights) // 2
    if r == 0:
        return a * weights[0]
    out = np.zeros_like(a)
    n = a.shape[axis]
    for k, w in zip(range(-r, r + 1), weights):
        take = [slice(None)] * a.ndim
        put = [slice(None)] * a.ndim
        take[axis], put[axis] = slice(max(0, -k), n - max(0, k)), slice(max(0, k), n - max(0, -k))
        out[tuple(put)] += w * a[tuple(take)]
    return out


def gaussian(
    tiles: DataFrame, images: DataFrame, sigma: float = 1.0, ndim: int = 2, keep_type: bool = True
) -> DataFrame:
    """Separable Gaussian, cut at 4 sigma, edge values repeated."""
    g = gauss_weights(sigma)
    r = len(g) // 2
    axes = (0, 1, 2) if ndim == 3 else (1, 2)

    def kernel(a, info):
        for axis in axes:
            a = convolve(a, g, axis)
        return _like_input(a, info["dtype"]) if keep_type else a

    halo = (r, r, r) if ndim == 3 else (0, r, r)
    return map_tiles(tiles, images, kernel, halo, "edge", SLAB if ndim == 3 else 1)


def local_threshold(tiles: DataFrame, images: DataFrame, block: int | None = None) -> DataFrame:
    """Mask voxels above the Gaussian-weighted local mean of their plane.

    The default block is min(31, height, width), at least 3 and odd.
    """
    widest = 31 if block is None else block
    halo = int(4 * (widest - 1) / 6 + 0.5)

    def kernel(a, info):
        size = block
        if size is None:
            size = max(3, min(31, *info["size"][1:]))
            size -= size % 2 == 0
        g = gauss_weights((size - 1) / 6)
        mean = convolve(convolve(a, g, 1), g, 2)
        return (a > mean).astype(np.float32)

    flags = map_tiles(tiles, images, kernel, (0, halo, halo), "symmetric")
    return voxels_from_tiles(flags).where("v > 0").select(*VOXEL_KEY)


def hessian_eigenvalues(a: np.ndarray, sigma: float, ndim: int) -> np.ndarray:
    """Eigenvalues of the Gaussian-derivative Hessian, largest first on axis 0."""
    axes = (0, 1, 2) if ndim == 3 else (1, 2)
    h = np.empty((*a.shape, ndim, ndim))
    for i, p in enumerate(axes):
        for j, q in enumerate(axes):
            if j < i:
                continue
            part = a
            for axis in axes:
                order = (axis == p) + (axis == q)
                part = convolve(part, gauss_weights(sigma, order), axis)
            h[..., i, j] = h[..., j, i] = part
    return np.moveaxis(np.linalg.eigvalsh(h)[..., ::-1], -1, 0)


def sato_response(a: np.ndarray, sigmas: Sequence[float], ndim: int) -> np.ndarray:
    """Largest tubeness of bright ridges over the scales."""
    best = np.zeros_like(a)
    for s in sigmas:
        keep = np.maximum(hessian_eigenvalues(-a, s, ndim)[:-1], 0)
        best = np.maximum(best, s * s * np.prod(keep, axis=0) ** (1 / len(keep)))
    return best


def hessian_norm(a: np.ndarray, sigma: float, ndim: int) -> np.ndarray:
    return np.sqrt((hessian_eigenvalues(-a, sigma, ndim) ** 2).sum(axis=0))


def frangi_response(a: np.ndarray, sigmas: Sequence[float], gammas: Sequence[float], ndim: int) -> np.ndarray:
    """Largest vesselness of bright ridges over the scales."""
    alpha = beta = 0.5
    best = np.zeros_like(a)
    for s, gamma in zip(sigmas, gammas):
        e = hessian_eigenvalues(-a, s, ndim)
        e = np.take_along_axis(e, np.abs(e).argsort(axis=0), axis=0)
        large = np.maximum(e[1:], 1e-10)
        rb = np.abs(e[0]) / (large[0] if ndim == 2 else np.sqrt(large[0] * large[1]))
        norm2 = (e**2).sum(axis=0)
        v = np.exp(-(rb**2) / (2 * beta**2)) * (1 - np.exp(-norm2 / (2 * gamma**2)))
        if ndim == 3:
            ra = large[0] / large[1]
            v *= 1 - np.exp(-(ra**2) / (2 * alpha**2))
        best = np.maximum(best, v)
    return best


def enhance_processes(
    tiles: DataFrame,
    images: DataFrame,
    method: str = "tubeness",
    sigmas: float | Sequence[float] | None = None,
    background: str | None = "rolling_ball",
    normalize: bool = True,
    ndim: int = 2,
    radius: float = 50.0,
) -> DataFrame:
    """Background removal, ridge filter and percentile rescaling (I4)."""
    how = method.lower().strip()
    scales = (1.0, 2.0, 3.0) if sigmas is None else tuple(np.atleast_1d(sigmas).astype(float))
    if background in ("rolling_ball", "rolling-ball"):
        tiles = rolling_ball(tiles, images.withColumn("dtype", F.lit("float32")), radius)
    elif background not in (None, "none", ""):
        raise ValueError("background must be rolling_ball, none, or None")
    r = int(4 * max(scales) + 0.5)
    halo = (r, r, r) if ndim == 3 else (0, r, r)
    slab = SLAB if ndim == 3 else 1
    if how in ("none", "raw"):
        out = tiles
    elif how in ("gaussian", "denoise"):
        one = 1.0 if sigmas is None else scales[0]
        out = gaussian(tiles, images, one, ndim, keep_type=False)
    elif how in ("tubeness", "sato"):
        out = map_tiles(tiles, images, lambda a, _: sato_response(a, scales, ndim), halo, "symmetric", slab)
    elif how in ("frangi", "vesselness"):
        tiles = cut(tiles)
        # first pass: half of the largest Hessian norm of each layer, per scale
        peaks = None
        for i, s in enumerate(scales):
            norm = map_tiles(tiles, images, lambda a, _, s=s: hessian_norm(a, s, ndim), halo, "symmetric", slab)
            top = norm.groupBy(*LAYER).agg(F.max(F.array_max("data")).cast("double").alias(f"g{i}"))
            peaks = top if peaks is None else peaks.join(top, LAYER)
        half = [F.when(F.col(f"g{i}") > 0, F.col(f"g{i}") / 2).otherwise(1.0) for i in range(len(scales))]
        gammas = peaks.select(*LAYER, F.array(*half).alias("extra"))
        out = map_tiles(
            tiles, images, lambda a, info: frangi_response(a, scales, info["extra"], ndim), halo, "symmetric", slab, gammas
        )
    else:
        raise ValueError("method must be tubeness, sato, frangi, vesselness, gaussian, or none")
    # the ranks and the projection both read the filtered tiles, so write them once
    return _rescale_tiles(cut(out), 1.0, 99.5) if normalize else out
