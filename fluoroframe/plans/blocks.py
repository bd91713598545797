"""Bounded blocks of sparse voxels and of dense tiles, with halos.

A block is a fixed box of the image grid.  Whatever share of the voxels one image
or one object holds, a block never has more voxels than its box.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from fluoroframe.plans.skew import salted_join
from fluoroframe.sources.tiles import TILE_COLUMNS, TILE_SCHEMA

# Box of a sparse block as (z, y, x) extent.
BOX = (16, 256, 256)


def packed(z: str = "z", y: str = "y", x: str = "x") -> Column:
    """Voxel position as one number in raster order, 21 bits per axis; a position beyond them is an error."""
    cols = [F.col(c).cast("long") for c in (z, y, x)]
    number = F.shiftleft(cols[0], 42) + F.shiftleft(cols[1], 21) + cols[2]
    beyond = F.shiftright(F.greatest(*cols), 21) != 0
    return F.when(beyond, F.raise_error(F.lit("voxel positions must be below 2097152 on every axis")).cast("long")).otherwise(number)


def unpacked(pid: str | Column) -> list[Column]:
    p = F.col(pid) if isinstance(pid, str) else pid
    low = F.lit(2097151).cast("long")
    return [
        F.shiftright(p, 42).cast("int"),
        F.shiftright(p, 21).bitwiseAND(low).cast("int"),
        p.bitwiseAND(low).cast("int"),
    ]


def offsets(ndim: int, full: bool, forward: bool = False) -> list[tuple[int, int, int]]:
    """Neighbour steps (dz, dy, dx): face neighbours, or all 8 / 26 with ``full``."""
    zs = (-1, 0, 1) if ndim == 3 else (0,)
    steps = [d for d in product(zs, (-1, 0, 1), (-1, 0, 1)) if any(d)]
    if not full:
        steps = [d for d in steps if sum(map(abs, d)) == 1]
    return [d for d in steps if d > (0, 0, 0)] if forward else steps


def step_column(steps: list[tuple[int, int, int]]) -> Column:
    return F.explode(
        F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(s, ("dz", "dy", "dx"))]) for s in steps])
    )


def block_keys(box: tuple[int, int, int] = BOX) -> list[Column]:
    return [F.expr(f"cast({a} div {b} as int)").alias(f"b{a}") for a, b in zip("zyx", box)]


def to_blocks(df: DataFrame, box: tuple[int, int, int], halo: tuple[int, int, int]) -> DataFrame:
    """Copy every voxel to each block whose box, grown by the halo, contains it."""
    out = df
    for a, b, h in zip("zyx", box, halo):
        if h == 0:
            out = out.withColumn(f"b{a}", F.expr(f"cast({a} div {b} as int)"))
        else:
            lo = F.greatest(F.lit(0), F.expr(f"cast(floor(({a} - {h}) / {b}) as int)"))
            hi = F.expr(f"cast(({a} + {h}) div {b} as int)")
            out = out.withColumn(f"b{a}", F.explode(F.sequence(lo, hi)))
    return out


def dense(pdf: pd.DataFrame, box: tuple[int, int, int], halo: tuple[int, int, int]):
    """Index raster of a block group: row number per cell, -1 where empty; and the
    flag of rows inside the box itself."""
    origin = [int(pdf[f"b{a}"].iloc[0]) * b - h for a, b, h in zip("zyx", box, halo)]
    shape = [b + 2 * h for b, h in zip(box, halo)]
    at = [pdf[a].to_numpy() - o for a, o in zip("zyx", origin)]
    # shrink to the occupied part, keeping one empty cell around it
    low = [max(0, int(a.min()) - 1) for a in at]
    high = [min(s, int(a.max()) + 2) for a, s in zip(at, shape)]
    grid = np.full([h - l for l, h in zip(low, high)], -1, dtype=np.int64)
    grid[tuple(a - l for a, l in zip(at, low))] = np.arange(len(pdf))
    core = np.ones(len(pdf), dtype=bool)
    for a, b, h in zip(at, box, halo):
        core &= (a >= h) & (a < h + b)
    return grid, core, [o + l for o, l in zip(origin, low)]


def neighbour_pairs(grid: np.ndarray, steps: list[tuple[int, int, int]]):
    """Row-number pairs of occupied cells that are one forward step apart."""
    left, right = [], []
    for d in steps:
        a = tuple(slice(max(0, -v), n - max(0, v)) for v, n in zip(d, grid.shape))
        b = tuple(slice(max(0, v), n - max(0, -v)) for v, n in zip(d, grid.shape))
        ga, gb = grid[a], grid[b]
        hit = (ga >= 0) & (gb >= 0)
        left.append(ga[hit])
        right.append(gb[hit])
    return np.concatenate(left), np.concatenate(right)


def map_tiles(
    tiles: DataFrame,
    images: DataFrame,
    kernel: Callable[[np.ndarray, dict], np.ndarray],
    halo: tuple[int, int, int],
    mode: str,
    slab: int = 1,
    extra: DataFrame | None = None,
) -> DataFrame:
    """Apply a neighbourhood kernel to tiles.

    Each tile sends to every tile that needs it only the rows and columns inside
    that tile's halo.  A group is one tile column of ``slab`` planes plus its rim.
    ``mode`` says what lies outside the image: a ``numpy.pad`` mode ("edge",
    "symmetric") or "inf".  The kernel maps a padded (z, y, x) array and facts about
    the image (dtype, size, extra) to an array of the same shape, from which the core
    is cut out.  ``extra`` is a table image_id, channel, extra ARRAY<DOUBLE>.
    """
    hz, hy, hx = halo
    grid = tiles.groupBy("image_id").agg(F.max("h").alias("_th"), F.max("w").alias("_tw"))
    size = images.select("image_id", "size_z", "size_y", "size_x", "dtype").join(grid, "image_id")
    src = salted_join(tiles, size, ["image_id"], ["channel", "t", "z", "ty", "tx"])
    if extra is not None:
        src = salted_join(src, extra, ["image_id", "channel"], ["t", "z", "ty", "tx"])
    else:
        src = src.withColumn("extra", F.lit(None).cast("array<double>"))
    # target tiles along y and x, target slabs along z
    src = src.withColumn("_ny", F.expr(f"cast(ceil({hy} / _th) as int)"))
    src = src.withColumn("_nx", F.expr(f"cast(ceil({hx} / _tw) as int)"))
    ty = F.explode(F.sequence(F.col("ty") - F.col("_ny"), F.col("ty") + F.col("_ny")))
    tx = F.explode(F.sequence(F.col("tx") - F.col("_nx"), F.col("tx") + F.col("_nx")))
    tz = F.explode(
        F.sequence(
            F.greatest(F.lit(0), F.expr(f"cast(floor((z - {hz}) / {slab}) as int)")),
            F.least(
                F.expr(f"cast((z + {hz}) div {slab} as int)"),
                F.expr(f"cast((size_z - 1) div {slab} as int)"),
            ),
        )
    )
    src = src.withColumn("_ty", ty).withColumn("_tx", tx).withColumn("_bz", tz)
    src = src.where("_ty >= 0 AND _ty * _th < size_y AND _tx >= 0 AND _tx * _tw < size_x")
    # rows r0..r1 and columns c0..c1 of this tile that fall into the target's halo
    src = src.withColumn("_r0", F.expr(f"greatest(0, _ty * _th - {hy} - y0)"))
    src = src.withColumn("_r1", F.expr(f"least(h, (_ty + 1) * _th + {hy} - y0)"))
    src = src.withColumn("_c0", F.expr(f"greatest(0, _tx * _tw - {hx} - x0)"))
    src = src.withColumn("_c1", F.expr(f"least(w, (_tx + 1) * _tw + {hx} - x0)"))
    src = src.where("_r1 > _r0 AND _c1 > _c0")
    piece = F.expr(
        "flatten(transform(sequence(_r0, _r1 - 1), r -> slice(data, r * w + _c0 + 1, _c1 - _c0)))"
    )
    src = src.select(
        "image_id", "channel", "t", "_bz", "_ty", "_tx", "_th", "_tw", "size_z", "size_y", "size_x", "dtype", "extra", "z",
        (F.col("y0") + F.col("_r0")).alias("py"),
        (F.col("x0") + F.col("_c0")).alias("px"),
        (F.col("_r1") - F.col("_r0")).alias("ph"),
        (F.col("_c1") - F.col("_c0")).alias("pw"),
        piece.alias("piece"),
    )

    def run(key, pdf):
        image, channel, t, bz, gy, gx = key
        first = pdf.iloc[0]
        nz, ny, nx = int(first.size_z), int(first.size_y), int(first.size_x)
        th, tw = int(first._th), int(first._tw)
        want = [(bz * slab, min(nz, (bz + 1) * slab)), (gy * th, min(ny, (gy + 1) * th)), (gx * tw, min(nx, (gx + 1) * tw))]
        have = [(max(0, a - h), min(n, b + h)) for (a, b), h, n in zip(want, halo, (nz, ny, nx))]
        block = np.full([b - a for a, b in have], np.nan, dtype=np.float64)
        for z, py, px, ph, pw, piece in zip(pdf.z, pdf.py, pdf.px, pdf.ph, pdf.pw, pdf.piece):
            r, c = py - have[1][0], px - have[2][0]
            block[z - have[0][0], r : r + ph, c : c + pw] = np.asarray(piece).reshape(ph, pw)
        pads = [(h - (a - l), h - (u - b)) for (a, b), (l, u), h in zip(want, have, halo)]
        if mode == "inf":
            full = np.pad(block, pads, constant_values=np.inf)
        else:
            full = np.pad(block, pads, mode=mode)
        extra = None if first['extra'] is None else np.asarray(first['extra'], dtype=float)
        out = kernel(full, {"dtype": first['dtype'], "size": (nz, ny, nx), "extra": extra})
        out = out[tuple(slice(h, n - h) for h, n in zip(halo, out.shape))]
        zs = range(want[0][0], want[0][1])
        return pd.DataFrame(
            {
                "image_id": image, "channel": channel, "t": t, "z": list(zs), "ty": gy, "tx": gx,
                "y0": want[1][0], "x0": want[2][0],
                "h": want[1][1] - want[1][0], "w": want[2][1] - want[2][0],
                "data": [plane.astype(np.float32).ravel() for plane in out],
            }
        )[TILE_COLUMNS]

    return src.groupBy("image_id", "channel", "t", "_bz", "_ty", "_tx").applyInPandas(run, TILE_SCHEMA)
