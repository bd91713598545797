"""Exact order statistics and dense numbering without one-task windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from fluoroframe.plans.cut import cut
from fluoroframe.plans.skew import salted_join

# Largest group for which Spark's own exact percentile (a value -> count map held
# in memory) is used; larger groups are narrowed first.
GROUP_LIMIT = 1_000_000
_ACCURACY = 10_000
# Groups of up to so many rows are not bracketed before their values are counted.
WHOLE = 100_000


def _keyed(df: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str]]:
    if keys:
        return df, list(keys)
    return df.withColumn("_all", F.lit(0)), ["_all"]


def exact_percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: dict[str, float],
    limit: int = GROUP_LIMIT,
) -> DataFrame:
    """Linear-interpolated percentiles per key; null and NaN values are skipped.

    One count of rows per key comes first.  If every group is small the built-in
    exact percentile is used.  Otherwise each wanted rank is bracketed with an
    approximate percentile, only the values inside the bracket are kept, and this
    repeats until the distinct values left in every bracket fit into ``limit``.
    """
    data, ks = _keyed(df, list(keys))
    data = data.select(*ks, F.col(f"`{value}`").cast("double").alias("_v"))
    data = data.where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    largest = data.groupBy(*ks).count().agg(F.max("count")).first()[0] or 0
    if largest <= limit:
        out = data.groupBy(*ks).agg(
            F.percentile("_v", F.array(*[F.lit(float(p)) for p in probs.values()])).alias("_p")
        )
        out = out.select(*ks, *[F.col("_p")[i].alias(n) for i, n in enumerate(probs)])
    else:
        out = _by_narrowing(data, ks, probs, limit)
    return out if keys else out.drop("_all")


def exact_medians(df: DataFrame, keys: Sequence[str], values: Sequence[str], limit: int = GROUP_LIMIT) -> DataFrame:
    """Medians of several columns per key; the group sizes are checked once.

    Without keys the result is one row.
    """
    data, ks = _keyed(df, list(keys))
    sizes = cut(data.groupBy(*ks).count())
    largest = sizes.agg(F.max("count")).first()[0] or 0
    if largest <= limit:
        clean = lambda c: F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double"))
        out = data.groupBy(*ks).agg(*[F.percentile(clean(c), 0.5).alias(c) for c in values])
    else:
        # all columns in the same passes: the column is one more key
        value = lambda i, c: F.struct(F.lit(i).alias("_c"), F.col(f"`{c}`").cast("double").alias("_x"))
        long = data.select(*ks, F.explode(F.array(*[value(i, c) for i, c in enumerate(values)])).alias("_e")).select(*ks, "_e.*")
        long = long.select(*ks, "_c", F.col("_x").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
        found = _by_narrowing(long, [*ks, "_c"], {"_m": 0.5}, limit)
        found = found.groupBy(*ks).agg(*[F.max(F.when(F.col("_c") == i, F.col("_m"))).alias(c) for i, c in enumerate(values)])
        out = sizes.select(*ks).join(found, ks, "left")
    return out if keys else out.drop("_all")


def _bracketed(data: DataFrame, ks: list[str], probs: dict[str, float]) -> tuple[DataFrame, DataFrame] | None:
    """Counted values around each wanted rank, and the rank with the weight below them.

    Two passes with partial aggregation over the data: approximate percentiles choose a
    narrow bracket, then rows are counted as below it, as values inside it or as above.
    Only values inside are ever shuffled or written.  None if a bracket misses its rank.
    """
    gk, e = [*ks, "_j"], 3 / _ACCURACY
    ends = [x for p in probs.values() for x in (max(float(p) - e, 0.0), min(float(p) + e, 1.0))]
    grid = data.groupBy(*ks).agg(
        F.count("*").alias("_total"), F.percentile_approx("_v", F.array(*[F.lit(x) for x in ends]), _ACCURACY).alias("_grid")
    )
    end = lambda k: F.when(F.col("_total") > WHOLE, F.col("_grid")[k])  # null: the whole group is inside
    wanted = F.array(
        *[
            F.struct(F.lit(j).alias("_j"), (F.lit(float(p)) * (F.col("_total") - 1)).alias("_rank"), end(2 * j).alias("_lo"), end(2 * j + 1).alias("_hi"))
            for j, p in enumerate(probs.values())
        ]
    )
    edges = cut(grid.select(*ks, F.explode(wanted).alias("_e")).select(*ks, "_e.*"))
    side = F.when(F.col("_v") < F.col("_lo"), -1).when(F.col("_v") > F.col("_hi"), 1).otherwise(0)
    placed = salted_join(data, edges.drop("_rank"), ks, ["_v"]).withColumn("_side", side)
    placed = placed.withColumn("_v", F.when(F.col("_side") == 0, F.col("_v")))
    counts = cut(placed.groupBy(*gk, "_side", "_v").agg(F.count("*").alias("_n")))
    weight = lambda s: F.coalesce(F.sum(F.when(F.col("_side") == s, F.col("_n"))), F.lit(0))
    sums = counts.groupBy(*gk).agg(weight(-1).alias("_below"), weight(0).alias("_inside"))
    targets = cut(edges.select(*gk, "_rank").join(sums, gk), edges)
    missed = (F.col("_below") > F.floor("_rank")) | (F.col("_below") + F.col("_inside") <= F.ceil("_rank"))
    if targets.where(missed).limit(1).count():
        return None
    return counts.where("_side = 0").select(*gk, "_v", "_n"), targets.select(*gk, "_rank", "_below")


def _counted(data: DataFrame, ks: list[str], probs: dict[str, float]) -> tuple[DataFrame, DataFrame]:
    """The same with every value of the data."""
    wanted = F.array(
        *[
            F.struct(F.lit(i).alias("_j"), F.lit(float(p)).alias("_prob"))
            for i, p in enumerate(probs.values())
        ]
    )
    # value -> count first: integer images collapse to at most one row per grey level
    counts = data.groupBy(*ks, "_v").agg(F.count("*").alias("_n"))
    total = counts.groupBy(*ks).agg(F.sum("_n").alias("_total"))
    targets = total.withColumn("_w", F.explode(wanted)).select(
        *ks,
        F.col("_w._j").alias("_j"),
        (F.col("_w._prob") * (F.col("_total") - 1)).alias("_rank"),
        F.lit(0).cast("long").alias("_below"),
    )
    return cut(salted_join(counts, targets.select(*ks, "_j"), ks, ["_v"])), cut(targets)


def _by_narrowing(data: DataFrame, ks: list[str], probs: dict[str, float], limit: int) -> DataFrame:
    gk = [*ks, "_j"]
    rows, targets = _bracketed(data, ks, probs) or _counted(data, ks, probs)
    while (rows.groupBy(*gk).count().agg(F.max("count")).first()[0] or 0) > limit:
        rows, targets = _narrow(rows, targets, gk)
    w = Window.partitionBy(*gk).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = (
        rows.join(targets, gk)
        .withColumn("_cum", F.col("_below") + F.sum("_n").over(w))
        .groupBy(*gk, "_rank")
        .agg(
            F.min(F.when(F.col("_cum") > F.floor("_rank"), F.col("_v"))).alias("_lo"),
            F.min(F.when(F.col("_cum") > F.ceil("_rank"), F.col("_v"))).alias("_hi"),
        )
    )
    frac = F.col("_rank") - F.floor("_rank")
    picked = ranked.withColumn("_p", F.col("_lo") + frac * (F.col("_hi") - F.col("_lo")))
    return picked.groupBy(*ks).agg(
        *[F.max(F.when(F.col("_j") == i, F.col("_p"))).alias(n) for i, n in enumerate(probs)]
    )


def _narrow(rows: DataFrame, targets: DataFrame, gk: list[str]) -> tuple[DataFrame, DataFrame]:
    size = rows.groupBy(*gk).agg(F.sum("_n").alias("_size"))
    inside = targets.join(size, gk).select(
        *gk, "_rank", "_below", ((F.col("_rank") - F.col("_below")) / F.col("_size")).alias("_share")
    )
    # Approximate quantiles only choose where to cut; the weight up to each cut is
    # counted exactly, so the slot that holds the wanted rank is known for certain.
    steps = F.array(*[F.lit(i / 64) for i in range(65)])
    grid = rows.groupBy(*gk).agg(F.percentile_approx("_v", steps, _ACCURACY).alias("_grid"))
    cuts = grid.select(*gk, F.posexplode("_grid").alias("_i", "_g")).dropDuplicates([*gk, "_g"])
    edges = cuts.groupBy(*gk).agg(F.sort_array(F.collect_list("_g")).alias("_edges"))
    slot = F.expr("aggregate(_edges, 0, (a, e) -> a + CASE WHEN e <= _v THEN 1 ELSE 0 END)")
    binned = salted_join(rows, edges, gk, ["_v"]).withColumn("_slot", slot).drop("_edges")
    binned = cut(binned)
    per_slot = binned.groupBy(*gk, "_slot").agg(F.sum("_n").alias("_c"))
    w = Window.partitionBy(*gk).orderBy("_slot").rowsBetween(Window.unboundedPreceding, 0)
    cum = per_slot.join(inside, gk).withColumn("_upto", F.col("_below") + F.sum("_c").over(w))
    keep = cum.where(
        (F.col("_upto") > F.floor("_rank")) & (F.col("_upto") - F.col("_c") <= F.ceil("_rank"))
    )
    new_targets = keep.groupBy(*gk, "_rank").agg(F.min(F.col("_upto") - F.col("_c")).alias("_below"))
    kept = salted_join(binned, keep.select(*gk, "_slot"), [*gk, "_slot"], ["_v"])
    return cut(kept.select(*gk, "_v", "_n")), cut(new_targets.select(*gk, "_rank", "_below"))


def weighted_median(counts: DataFrame, keys: list[str], value: str, weight: str, name: str) -> DataFrame:
    """Median of values given with multiplicities.

    For object sizes the distinct values per image are few: d different sizes need
    at least d * d / 2 voxels, so the window below never grows with the voxel count
    faster than its square root.
    """
    w = Window.partitionBy(*keys).orderBy(value)
    full = Window.partitionBy(*keys)
    ranked = counts.withColumn(
        "_cum", F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ).withColumn("_rank", (F.sum(weight).over(full) - 1) / F.lit(2.0))
    return ranked.groupBy(*keys).agg(
        (
            (
                F.min(F.when(F.col("_cum") > F.floor("_rank"), F.col(value)))
                + F.min(F.when(F.col("_cum") > F.ceil("_rank"), F.col(value)))
            )
            / F.lit(2.0)
        ).alias(name)
    )


def running_totals(rows: DataFrame, keys: Sequence[str], order: str, weight: str, name: str) -> DataFrame:
    """Sum of ``weight`` up to each row in ascending ``order`` within its keys (rows with distinct keys and order).

    Rows are dealt by ranges, each range sums by itself, and the totals of all earlier ranges (one row per range) are
    added, so one key may hold the whole table.
    """
    keys = list(keys)
    dealt = cut(rows.repartitionByRange(*keys, order).withColumn("_part", F.spark_partition_id()))
    sums = dealt.groupBy(*keys, "_part").agg(F.sum(weight).alias("_s"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(*keys, "_part", F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*keys, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    summed = dealt.withColumn(name, F.sum(weight).over(inside))
    right = bases.withColumnsRenamed({c: f"_k{i}" for i, c in enumerate([*keys, "_part"])})
    on = F.lit(True)
    for i, c in enumerate([*keys, "_part"]):
        on &= summed[c].eqNullSafe(right[f"_k{i}"])
    return summed.join(right, on).withColumn(name, F.col(name) + F.col("_base")).select(*rows.columns, name)


def number_rows(
    df: DataFrame, keys: list[str], levels: list[str], name: str, start: int = 0
) -> DataFrame:
    """Dense numbering of rows per key in the order of ``levels``.

    Counts are cumulated level by level (planes, then rows, then columns), so no
    window holds more rows than one axis is long, times the rows sharing all but
    the last level.
    """
    df = cut(df)
    out = df.withColumn("_off", F.lit(0).cast("long"))
    prefix: list[str] = list(keys)
    for level in levels[:-1]:
        count = df.groupBy(*prefix, level).agg(F.count("*").alias("_c"))
        w = Window.partitionBy(*prefix).orderBy(level).rowsBetween(Window.unboundedPreceding, -1)
        offs = count.select(
            *prefix, level, F.coalesce(F.sum("_c").over(w), F.lit(0)).alias("_o")
        )
        out = out.join(offs, [*prefix, level]).withColumn("_off", F.col("_off") + F.col("_o")).drop("_o")
        prefix.append(level)
    w = Window.partitionBy(*prefix).orderBy(levels[-1])
    return out.withColumn(name, F.col("_off") + F.row_number().over(w) + F.lit(start - 1)).drop("_off")
