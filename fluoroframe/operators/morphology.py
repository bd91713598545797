"""Shape descriptors of labelled objects: size, moments, axes, perimeter, exposed faces and convex hull.

Objects are measured inside blocks of the image.  A block gives whole-number sums per object (pixels, first and second
moments, perimeter codes, exposed faces) and the hull of its pixels.  Sums are added, hulls are merged, so an object
may lie in any number of blocks and none of its pixels is shuffled twice.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from fluoroframe.operators.measure import add_physical_columns
from fluoroframe.plans.blocks import dense, to_blocks
from fluoroframe.plans.cut import cut

BOX = {2: (1, 512, 512), 3: (32, 128, 128)}
#: Blocks of an axis whose hulls meet in one round.
MERGE = 8
# Classes of border pixels by 1 + 2 * (face neighbours) + 10 * (corner neighbours), and their lengths.
STRAIGHT, DIAGONAL, MIXED = (5, 7, 15, 17, 25, 27), (21, 33), (13, 23)
LENGTHS = {"c1": 1.0, "c2": 2**0.5, "c3": (1 + 2**0.5) / 2}


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull of whole-number (y, x) points, first up the side of smaller x, then back down."""
    pts = np.unique(points, axis=0)
    if len(pts) < 3:
        return pts
    rows = pts.tolist()

    def side(order: list[list[int]]) -> list[list[int]]:
        out: list[list[int]] = []
        for p in order:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out

    one, other = side(rows), side(rows[::-1])
    return np.array(one[:-1] + other[:-1], dtype=np.int64)


def pixels_inside(corners: np.ndarray) -> int:
    """Pixels whose centre is inside or on a hull in half pixels (odd highest and lowest rows)."""
    y, x = corners[:, 0], corners[:, 1]
    low, high = int(y.min()), int(y.max())
    rows = np.arange(low + (low % 2), high + 1, 2)
    first, last = np.full(len(rows), np.iinfo(np.int64).max), np.full(len(rows), np.iinfo(np.int64).min)
    for (y0, x0), (y1, x1) in zip(corners.tolist(), np.roll(corners, -1, axis=0).tolist()):
        if y0 == y1:
            continue
        if y0 > y1:
            y0, x0, y1, x1 = y1, x1, y0, x0
        a, b = np.searchsorted(rows, (y0, y1 + 1))
        at = x0 * (y1 - y0) + (rows[a:b] - y0) * (x1 - x0)
        first[a:b] = np.minimum(first[a:b], -(-at // (2 * (y1 - y0))))
        last[a:b] = np.maximum(last[a:b], at // (2 * (y1 - y0)))
    return int((last - first + 1).clip(min=0).sum())


def _shift(a: np.ndarray, d: Sequence[int]) -> np.ndarray:
    """Value at the place ``d`` further on, 0 outside."""
    out = np.zeros_like(a)
    to = tuple(slice(max(0, -v), n - max(0, v)) for v, n in zip(d, a.shape))
    out[to] = a[tuple(slice(max(0, v), n - max(0, -v)) for v, n in zip(d, a.shape))]
    return out


def _block(pdf: pd.DataFrame, box: tuple[int, int, int], halo: tuple[int, int, int], ndim: int) -> pd.DataFrame:
    """Sums per object of the voxels of one block."""
    grid, core, origin = dense(pdf, box, halo)
    if not core.any():
        return pd.DataFrame()
    names = pdf["label"].to_numpy()
    kinds, code = np.unique(names, return_inverse=True)
    lab = np.where(grid >= 0, code[np.maximum(grid, 0)] + 1, 0)
    places = np.nonzero((grid >= 0) & core[np.maximum(grid, 0)])
    mine = lab[places] - 1
    count = lambda w=None: np.bincount(mine, w, len(kinds)).astype(np.int64)
    axes = "zyx"[3 - ndim :]
    start = {a: origin[i] for i, a in enumerate("zyx")}
    at = {a: p for a, p in zip("zyx", places)}
    out = {"label": kinds, "n": count()}
    for a in axes:
        out[f"s{a}"] = count(at[a]) + out["n"] * start[a]
    for a, b in combinations_with_replacement(axes, 2):
        sa, sb = count(at[a]), count(at[b])
        out[f"s{a}{b}"] = count(at[a] * at[b]) + start[a] * sb + start[b] * sa + out["n"] * start[a] * start[b]
    for a in axes:
        low, high = np.full(len(kinds), 2**31), np.full(len(kinds), -1)
        np.minimum.at(low, mine, at[a])
        np.maximum.at(high, mine, at[a])
        out[f"{a}0"], out[f"{a}1"] = low + start[a], high + start[a]
    unit = {a: tuple(int(a == b) for b in "zyx") for a in axes}
    open_faces = np.zeros(lab.shape, dtype=bool)
    for a in axes:
        ahead = _shift(lab, unit[a]) != lab
        behind = _shift(lab, [-v for v in unit[a]]) != lab
        out[f"f{a}"] = count(ahead[places].astype(int) + behind[places])
        open_faces |= ahead | behind
    if ndim == 2:
        edge = np.where(open_faces, lab, 0)
        near = sum((_shift(edge, (0, dy, dx)) == edge) * (2 if dy * dx == 0 else 10) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx)
        codes = np.where(edge > 0, 1 + near, 0)[places]
        for name, kind in zip(LENGTHS, (STRAIGHT, DIAGONAL, MIXED)):
            out[name] = count(np.isin(codes, kind))
        corners = []
        for k in range(len(kinds)):
            y, x = (p[mine == k] for p in places[1:])
            rows = np.unique(y)
            left, right = np.full(lab.shape[1], 2**31), np.full(lab.shape[1], -1)
            np.minimum.at(left, y, x)
            np.maximum.at(right, y, x)
            ends = np.concatenate([np.stack([rows, left[rows]], 1), np.stack([rows, right[rows]], 1)]) + [start["y"], start["x"]]
            around = [2 * ends + d for d in ((1, 0), (-1, 0), (0, 1), (0, -1))]  # middles of the pixel sides, in half pixels
            corners.append(hull(np.concatenate(around)).ravel().tolist() if len(rows) else [])
        out["hull"] = corners
    return pd.DataFrame(out)[out["n"] > 0]


def _hulls(parts: DataFrame, keys: list[str]) -> DataFrame:
    """``convex_area`` per object: hulls of neighbouring blocks become one, round by round."""

    @F.pandas_udf("array<long>")
    def merged(flat: pd.Series) -> pd.Series:
        return pd.Series([hull(np.asarray(f, dtype=np.int64).reshape(-1, 2)).ravel().tolist() for f in flat])

    @F.pandas_udf("long")
    def area(flat: pd.Series) -> pd.Series:
        return pd.Series([pixels_inside(np.asarray(f, dtype=np.int64).reshape(-1, 2)) for f in flat])

    state = parts.select(*keys, "by", "bx", "hull")
    cells = state.agg(F.max(F.greatest("by", "bx"))).first()[0] or 0
    while cells:
        state = state.withColumns({b: F.expr(f"cast({b} div {MERGE} as int)") for b in ("by", "bx")})
        state = state.groupBy(*keys, "by", "bx").agg(F.flatten(F.collect_list("hull")).alias("hull"))  # at most MERGE * MERGE hulls
        state = state.withColumn("hull", merged("hull"))
        cells //= MERGE
    return state.select(*keys, area("hull").alias("convex_area"))


def _moment(a: str, b: str) -> Column:
    """Central second moment from whole-number sums, exact up to the last division."""
    n, sa, sb, sab = (F.col(c).cast("decimal(38,0)") for c in ("n", f"s{a}", f"s{b}", "s" + "".join(sorted((a, b), key="zyx".index))))
    return (n * sab - sa * sb).cast("double") / (F.col("n").cast("double") * F.col("n"))


def measure_morphology(labels: DataFrame, images: DataFrame | None = None, ndim: int = 2) -> DataFrame:
    """Shape of every object of a label table, one row per image, frame (and plane, if ``ndim`` is 2) and label.

    Always ``area`` (pixels or voxels), centroid, ``bbox-*`` (end not included), ``extent``, ``axis_major_length``,
    ``axis_minor_length``, exposed ``faces_*``.  In two dimensions also ``perimeter`` (border pixels by the kind of their
    neighbours), ``circularity`` (null without perimeter), ``eccentricity`` (0 for a single pixel), ``convex_area`` and
    ``solidity``.  With ``images`` physical columns; ``perimeter_um`` only for square pixels.  Labels of 0 or less are
    background.
    """
    if ndim not in (2, 3):
        raise ValueError("ndim must be 2 or 3")
    axes = "zyx"[3 - ndim :]
    keys = ["image_id", "t", *(["z"] if ndim == 2 else []), "label"]
    box, halo = BOX[ndim], (0, 2, 2) if ndim == 2 else (1, 1, 1)
    sums = ["n", *[f"s{a}" for a in axes], *["s" + a + b for a, b in combinations_with_replacement(axes, 2)], *[f"f{a}" for a in axes]]
    ends = [f"{a}{i}" for a in axes for i in (0, 1)]
    codes = list(LENGTHS) if ndim == 2 else []
    schema = "image_id string, t int, bz int, by int, bx int, label long, " + ", ".join(f"{c} long" for c in [*sums, *ends, *codes])
    schema += ", hull array<long>" if ndim == 2 else ""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = _block(pdf, box, halo, ndim)
        return out if out.empty else out.assign(**dict(zip(("image_id", "t", "bz", "by", "bx"), key)))

    spread = to_blocks(labels.where("label > 0").select("image_id", "t", "z", "y", "x", F.col("label").cast("long").alias("label")), box, halo)
    parts = spread.groupBy("image_id", "t", "bz", "by", "bx").applyInPandas(run, schema)
    if ndim == 2:
        parts = cut(parts.withColumn("z", F.col("bz")))  # sums and hulls both read it
    total = parts.groupBy(*keys).agg(
        *[F.sum(F.col(c).cast("decimal(20,0)") if len(c) == 3 else c).alias(c) for c in [*sums, *codes]],
        *[(F.min if c[1] == "0" else F.max)(c).alias(c) for c in ends],
    )
    if ndim == 2:
        total = total.join(_hulls(parts, keys), keys)
    return _described(total, images, keys, axes, ndim)


def _described(total: DataFrame, images: DataFrame | None, keys: list[str], axes: str, ndim: int) -> DataFrame:
    n = F.col("n").cast("double")
    box = {f"bbox-{i}": F.col(f"{a}0") for i, a in enumerate(axes)} | {f"bbox-{i + ndim}": F.col(f"{a}1") + 1 for i, a in enumerate(axes)}
    sides = [F.col(f"{a}1") - F.col(f"{a}0") + 1 for a in axes]
    volume = sides[0] * sides[1] * (sides[2] if ndim == 3 else 1)
    out = total.withColumns({f"m{a}{b}": _moment(a, b) for a, b in combinations_with_replacement(axes, 2)})
    if ndim == 2:
        gap = F.sqrt((F.col("myy") - F.col("mxx")) ** 2 + 4 * F.col("myx") ** 2)
        out = out.withColumns({"l1": (F.col("myy") + F.col("mxx") + gap) / 2, "l2": F.greatest((F.col("myy") + F.col("mxx") - gap) / 2, F.lit(0.0))})
        major, minor = 4 * F.sqrt("l1"), 4 * F.sqrt("l2")
    else:
        out = out.withColumn("l", _spread_values(*[F.col(f"m{a}{b}") for a, b in combinations_with_replacement(axes, 2)]))
        major = F.sqrt(10 * F.greatest(F.col("l")[0] + F.col("l")[1] - F.col("l")[2], F.lit(0.0)))
        minor = F.sqrt(10 * F.greatest(F.col("l")[1] + F.col("l")[2] - F.col("l")[0], F.lit(0.0)))
    columns = {
        "area": F.col("n"),
        **{f"centroid-{i}": F.col(f"s{a}").cast("double") / n for i, a in enumerate(axes)},
        **box,
        "extent": n / volume,
        "axis_major_length": major,
        "axis_minor_length": minor,
        **{f"faces_{a}": F.col(f"f{a}") for a in axes},
    }
    if ndim == 2:
        perimeter = F.col("c1") + F.col("c2") * LENGTHS["c2"] + F.col("c3") * LENGTHS["c3"]
        columns |= {
            "perimeter": perimeter,
            "circularity": F.when(perimeter > 0, 4 * F.pi() * n / perimeter**2),
            "eccentricity": F.when(F.col("l1") > 0, F.sqrt(1 - F.col("l2") / F.col("l1"))).otherwise(0.0),
            "convex_area": F.col("convex_area"),
            "solidity": n / F.col("convex_area"),
        }
    shaped = out.select(*keys, *[c.alias(name) for name, c in columns.items()])
    shaped = add_physical_columns(shaped, images, ndim)
    return shaped if images is None else _physical(shaped, images, axes, ndim)


def _physical(shaped: DataFrame, images: DataFrame, axes: str, ndim: int) -> DataFrame:
    """Boundary in physical units; null where the image has no real scale (all 1)."""
    sizes = {a: F.col(f"voxel_{a}").cast("double") for a in axes}
    known = images.select("image_id", *[s.alias(f"_{a}") for a, s in sizes.items()])
    real = ~((F.abs(F.col("_y") - 1) < 1e-9) & (F.abs(F.col("_x") - 1) < 1e-9) & (F.abs(F.col("_z") - 1) < 1e-9 if ndim == 3 else F.lit(True)))
    out = shaped.join(known, "image_id", "left")
    if ndim == 2:
        found = {"boundary_um": F.col("faces_y") * F.col("_x") + F.col("faces_x") * F.col("_y"), "perimeter_um": F.when(F.abs(F.col("_y") - F.col("_x")) < 1e-9, F.col("perimeter") * F.col("_y"))}
    else:
        found = {"surface_um2": F.col("faces_z") * F.col("_y") * F.col("_x") + F.col("faces_y") * F.col("_z") * F.col("_x") + F.col("faces_x") * F.col("_z") * F.col("_y")}
    return out.withColumns({name: F.when(real, c) for name, c in found.items()}).drop(*[f"_{a}" for a in axes])


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _spread_values(zz: pd.Series, zy: pd.Series, zx: pd.Series, yy: pd.Series, yx: pd.Series, xx: pd.Series) -> pd.Series:
    """Eigenvalues of the second moments, largest first."""
    tensor = np.stack([np.stack(r, -1) for r in ((zz, zy, zx), (zy, yy, yx), (zx, yx, xx))], -2).astype(float)
    return pd.Series(np.linalg.eigvalsh(tensor)[:, ::-1].clip(min=0).tolist())
