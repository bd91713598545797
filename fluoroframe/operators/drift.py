"""Drift of movies: translation of every frame by phase correlation, and corrected layers.

Tiles of a frame and of its reference meet by tile neighbourhood.  Each neighbourhood adds up the cross spectra of its
tiles, and the sums of an image are added in rounds, so a frame of any number of tiles is one spectrum of tile size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from fluoroframe.plans.cut import cut
from fluoroframe.sources.tiles import TILE_COLUMNS, TILE_SCHEMA

#: Tiles (or sums) of an axis that meet in one group.
NEIGHBOURS = 8


def cross_spectrum(moving: np.ndarray, reference: np.ndarray, size: tuple[int, int]) -> np.ndarray:
    """Product of the spectra of two tiles without their means, padded to ``size``."""
    a, b = (np.fft.rfft2(np.nan_to_num(x - np.nanmean(x) if np.isfinite(x).any() else np.zeros_like(x)), size) for x in (moving, reference))
    return b * np.conj(a)


def peak(spectrum: np.ndarray, size: tuple[int, int]) -> tuple[int, int, float]:
    """Shift (dy, dx) that moves the frame onto its reference, and the height of the correlation peak (0 to 1)."""
    strength = np.abs(spectrum)
    phase = np.where(strength > 1e-9 * strength.max(initial=0), spectrum / np.where(strength > 0, strength, 1), 0)
    field = np.fft.irfft2(phase, size)
    dy, dx = np.unravel_index(np.argmax(np.round(field, 9)), size)
    half = [n // 2 for n in size]
    return int(dy) - size[0] * (dy > half[0]), int(dx) - size[1] * (dx > half[1]), float(field[dy, dx])


def estimate_drift(tiles: DataFrame, channel: str, reference_frame: int = 0, against: str = "reference") -> DataFrame:
    """``image_id, channel, t, dy, dx, step_dy, step_dx, score`` of every frame that has tiles.

    ``dy, dx`` (whole pixels) move a frame onto the reference frame.  ``against`` "reference" compares each frame with
    it; "previous" compares neighbours (``step_*``) and adds their shifts up, for content that changes over time.  Planes
    of a stack count together.  Found are shifts of up to half a tile; a frame without contrast, or whose reference has
    no tiles, stays where it is with score 0.
    """
    if against not in ("reference", "previous"):
        raise ValueError("against must be 'reference' or 'previous'")
    mine = tiles.where(F.col("channel") == channel).select("image_id", "t", "z", "ty", "tx", "h", "w", "data")
    facts = mine.agg(F.max("h"), F.max("w"), F.max(F.greatest("z", "ty", "tx"))).first()
    size, cells = (facts[0] or 1, facts[1] or 1), facts[2] or 0
    frames = mine.select("image_id", "t").distinct()
    key = ["image_id", "t", "bz", "by", "bx"]
    if against == "previous":
        earlier = Window.partitionBy("image_id").orderBy("t")  # one row per frame
        pairs = frames.withColumn("r", F.lag("t").over(earlier))
    else:
        pairs = frames.withColumn("r", F.lit(reference_frame))
    sources = mine.withColumnRenamed("t", "r").join(pairs.where("r IS NOT NULL"), ["image_id", "r"]).drop("r").withColumn("moves", F.lit(False))
    both = mine.withColumn("moves", F.lit(True)).unionByName(sources)
    for b, c in (("bz", "z"), ("by", "ty"), ("bx", "tx")):
        both = both.withColumn(b, F.expr(f"cast({c} div {NEIGHBOURS} as int)"))
    spectra = "image_id string, t int, bz int, by int, bx int, re array<double>, im array<double>"

    def spectrum(group: tuple, total: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame([[*group, total.real.ravel(), total.imag.ravel()]], columns=[*key, "re", "im"])

    def tiles_of(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        image = lambda r: np.asarray(r.data, dtype=float).reshape(r.h, r.w)
        fixed = {(r.z, r.ty, r.tx): image(r) for r in pdf[~pdf["moves"]].itertuples()}
        total = np.zeros((size[0], size[1] // 2 + 1), dtype=complex)
        for r in pdf[pdf["moves"]].itertuples():
            if (r.z, r.ty, r.tx) in fixed:
                total += cross_spectrum(image(r), fixed[r.z, r.ty, r.tx], size)
        return spectrum(group, total)

    def sums_of(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return spectrum(group, np.stack(pdf["re"].to_list()).sum(0) + 1j * np.stack(pdf["im"].to_list()).sum(0))

    state = both.groupBy(*key).applyInPandas(tiles_of, spectra)
    cells //= NEIGHBOURS
    while cells:
        for b in key[2:]:
            state = state.withColumn(b, F.expr(f"cast({b} div {NEIGHBOURS} as int)"))
        state, cells = state.groupBy(*key).applyInPandas(sums_of, spectra), cells // NEIGHBOURS

    @F.pandas_udf("step_dy int, step_dx int, score double")
    def peaks(re: pd.Series, im: pd.Series) -> pd.DataFrame:
        found = [peak((np.asarray(a) + 1j * np.asarray(b)).reshape(size[0], -1), size) for a, b in zip(re, im)]
        return pd.DataFrame(found, columns=["step_dy", "step_dx", "score"])

    steps = cut(state.select("image_id", "t", peaks("re", "im").alias("p")).select("image_id", "t", "p.*"))
    dy, dx = F.col("step_dy"), F.col("step_dx")
    if against == "previous":
        so_far = Window.partitionBy("image_id").orderBy("t")
        totals = steps.withColumns({"_y": F.sum("step_dy").over(so_far), "_x": F.sum("step_dx").over(so_far)})
        origin = totals.where(F.col("t") == reference_frame).select("image_id", F.col("_y").alias("_y0"), F.col("_x").alias("_x0"))
        steps = totals.join(origin, "image_id", "left")
        dy, dx = (F.col(c) - F.coalesce(f"{c}0", F.lit(0)) for c in ("_y", "_x"))
    return steps.select("image_id", F.lit(channel).alias("channel"), "t", dy.cast("int").alias("dy"), dx.cast("int").alias("dx"), "step_dy", "step_dx", "score")


def apply_drift_correction(tiles: DataFrame, shifts: DataFrame, suffix: str = "_corrected", fill: float = 0.0) -> DataFrame:
    """A new layer of the same tiling, every frame of ``tiles`` moved by its ``dy, dx`` (image_id, t).

    The new channel has the old name with ``suffix``; the old layer stays.  Pixels moved out of the image are lost and
    places without a source get ``fill``.  Frames without a shift stay as they are.
    """
    grid = tiles.groupBy("image_id").agg(F.max("h").alias("_th"), F.max("w").alias("_tw"))
    moves = shifts.select("image_id", "t", "dy", "dx").dropDuplicates(["image_id", "t"])
    src = tiles.join(moves, ["image_id", "t"], "left").join(grid, "image_id").na.fill(0, ["dy", "dx"])
    src = src.withColumns({"_y": F.col("y0") + F.col("dy"), "_x": F.col("x0") + F.col("dx")})
    for axis, side, length in (("y", "_th", "h"), ("x", "_tw", "w")):
        lo, hi = F.expr(f"cast(floor(_{axis} / {side}) as int)"), F.expr(f"cast(floor((_{axis} + {length} - 1) / {side}) as int)")
        src = src.withColumn(f"_t{axis}", F.explode(F.sequence(lo, hi)))
    src = src.withColumns(
        {
            "_r0": F.expr("greatest(0, _ty * _th - _y)"), "_r1": F.expr("least(h, (_ty + 1) * _th - _y)"),
            "_c0": F.expr("greatest(0, _tx * _tw - _x)"), "_c1": F.expr("least(w, (_tx + 1) * _tw - _x)"),
        }
    ).where("_ty >= 0 AND _tx >= 0")
    piece = F.expr("flatten(transform(sequence(_r0, _r1 - 1), r -> slice(data, r * w + _c0 + 1, _c1 - _c0)))")
    keys = ["image_id", "channel", "t", "z"]
    pieces = src.select(
        *keys, F.col("_ty").alias("ty"), F.col("_tx").alias("tx"), F.expr("_y + _r0").cast("int").alias("y0"), F.expr("_x + _c0").cast("int").alias("x0"),
        F.expr("_r1 - _r0").cast("int").alias("h"), F.expr("_c1 - _c0").cast("int").alias("w"), piece.alias("data"), F.lit(True).alias("piece"),
    )
    frames = tiles.select(*keys, "ty", "tx", "y0", "x0", "h", "w", F.array().cast("array<float>").alias("data"), F.lit(False).alias("piece"))

    def paste(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        target = pdf[~pdf["piece"]]
        if target.empty:  # outside the image
            return pd.DataFrame()
        f = target.iloc[0]
        out = np.full((f.h, f.w), fill, dtype=np.float32)
        for p in pdf[pdf["piece"]].itertuples():
            a, b = max(p.y0, f.y0), min(p.y0 + p.h, f.y0 + f.h)
            c, d = max(p.x0, f.x0), min(p.x0 + p.w, f.x0 + f.w)
            if a < b and c < d:
                block = np.asarray(p.data, dtype=np.float32).reshape(p.h, p.w)
                out[a - f.y0 : b - f.y0, c - f.x0 : d - f.x0] = block[a - p.y0 : b - p.y0, c - p.x0 : d - p.x0]
        row = dict(zip([*keys, "ty", "tx"], key)) | {"y0": f.y0, "x0": f.x0, "h": f.h, "w": f.w, "data": [out.ravel()]}
        return pd.DataFrame({**row, "channel": row["channel"] + suffix})[TILE_COLUMNS]

    return pieces.unionByName(frames).groupBy(*keys, "ty", "tx").applyInPandas(paste, TILE_SCHEMA)
