"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

def _salts(df: DataFrame) -> int:
    wanted = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(2, min(256, wanted))


def salted_join(
    big: DataFrame,
    small: DataFrame,
    keys: list[str],
    spread: list[str],
    how: str = "inner",
) -> DataFrame:
    """Join voxel- or tile-sized rows with a table of few rows per key.

    ``big`` is split over salts by a hash of ``spread`` (deterministic, so a
    retried task sends every row to the same place) and ``small`` is copied to
    every salt.  Spark may still broadcast ``small`` when its measured size is
    under the broadcast threshold.  ``how`` is "inner" or "left".
    """
    n = _salts(big)
    left = big.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(n)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def join_renamed(big: DataFrame, small: DataFrame, big_keys: list[str], small_keys: list[str]) -> DataFrame:
    """Inner join on keys of different names; key columns of ``small`` are dropped.

    A plain join: adaptive execution splits the partition of a key that holds many
    rows of ``big``, as ``small`` has one row per key.
    """
    names = [f"_k{i}" for i in range(len(small_keys))]
    right = small.withColumnsRenamed(dict(zip(small_keys, names)))
    on = reduce(lambda a, b: a & b, [F.col(k) == F.col(n) for k, n in zip(big_keys, names)])
    return big.join(right, on, "inner").drop(*names)
