"""Small arrays to tables and back."""

import numpy as np
import pandas as pd

VOX = "image_id string, channel string, t int, z int, y int, x int, v double"
POS = "image_id string, t int, z int, y int, x int"
IMAGES = (
    "image_id string, path string, axes string, size_t int, size_z int, size_y int, size_x int, "
    "voxel_z double, voxel_y double, voxel_x double, time_interval_s double, dtype string"
)


def volume(a):
    a = np.asarray(a)
    return a[(None,) * (3 - a.ndim)] if a.ndim < 3 else a


def voxels(spark, a, channel="g", image="a", t=0):
    a = volume(a)
    rows = [(image, channel, t, *map(int, p), float(a[p])) for p in np.ndindex(a.shape)]
    return spark.createDataFrame(rows, VOX)


def movie(spark, frames, channel="g", image="a"):
    out = None
    for t, f in enumerate(frames):
        one = voxels(spark, f, channel, image, t)
        out = one if out is None else out.unionByName(one)
    return out


def positions(spark, m, image="a", t=0):
    m = volume(m)
    return spark.createDataFrame([(image, t, *map(int, p)) for p in zip(*np.nonzero(m))], POS)


def labels(spark, a, image="a", t=0):
    a = volume(a)
    rows = [(image, t, *map(int, p), int(a[p])) for p in zip(*np.nonzero(a))]
    return spark.createDataFrame(rows, POS + ", label int")


def images(spark, shape, scale=(1.0, 1.0, 1.0), image="a", axes="YX", frames=1, interval=None, dtype="float32"):
    shape = (1,) * (3 - len(shape)) + tuple(shape)
    row = (image, f"/d/{image}.tif", axes, frames, *shape, *map(float, scale), interval, dtype)
    return spark.createDataFrame([row], IMAGES)


def place_set(df):
    return {(r.z, r.y, r.x) for r in df.collect()}


def true_set(m):
    return set(zip(*(c.tolist() for c in np.nonzero(volume(m)))))


def raster(df, shape, value="v"):
    out = np.full(shape, np.nan)
    for r in df.toPandas().itertuples():
        out[r.z, r.y, r.x] = getattr(r, value)
    return out


def two_squares():
    lab = np.zeros((20, 20), int)
    lab[2:8, 2:8], lab[12:18, 12:18] = 1, 2
    a, b = np.zeros((20, 20)), np.zeros((20, 20))
    a[lab == 1], a[lab == 2], b[lab == 1], b[lab == 2] = 100, 50, 10, 200
    return lab, a, b


def flood_labels(m):
    """Face-connected components in raster order, one pixel at a time."""
    m = np.asarray(m)
    out, n = np.zeros(m.shape, int), 0
    for p in zip(*np.nonzero(m)):
        if out[p]:
            continue
        n += 1
        out[p], todo = n, [p]
        while todo:
            q = todo.pop()
            for ax in range(m.ndim):
                for d in (-1, 1):
                    r = q[:ax] + (q[ax] + d,) + q[ax + 1 :]
                    if 0 <= r[ax] < m.shape[ax] and m[r] and not out[r]:
                        out[r] = n
                        todo.append(r)
    return out


def frame(df):
    return df.toPandas() if not isinstance(df, pd.DataFrame) else df
