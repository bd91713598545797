"""Comparison of groups: Welch's t, Mann-Whitney, one-way analysis of variance, Kruskal-Wallis.

Tests stand on samples by default: the objects of a sample are first averaged, as they are not independent.  Ranks
come from running totals over range-dealt distinct values, so no window ever holds the whole table.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from fluoroframe.plans.ranks import running_totals

TESTS = ("auto", "ttest", "mannwhitney", "anova", "kruskal")


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularized incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    total = d
    for m in range(1, 10_000):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + step * d or 1e-300)
            c = 1 + step / c or 1e-300
            total *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * total


def upper_gamma(a: float, x: float) -> float:
    """Regularized upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-17 * abs(total):
            n += 1
            term *= x / n
            total += term
        return 1 - front * total
    b = x + 1 - a
    c, d = 1e300, 1 / b
    total = d
    for i in range(1, 100_000):
        b += 2
        d = 1 / (b - i * (i - a) * d or 1e-300)
        c = b - i * (i - a) / c or 1e-300
        total *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * total


def _chance(test: str, value: float, df1: float, df2: float) -> float | None:
    """Probability of a statistic at least as extreme if the groups do not differ."""
    if value is None or math.isnan(value):
        return None
    if test == "ttest":
        return incomplete_beta(df1 / 2, 0.5, df1 / (df1 + value * value))
    if test == "mannwhitney":
        return math.erfc(abs(value) / math.sqrt(2))
    if test == "anova":
        return incomplete_beta(df2 / 2, df1 / 2, df2 / (df2 + df1 * value)) if math.isfinite(value) else 0.0
    return upper_gamma(df1 / 2, value / 2)


def _p_value(test: str, statistic: Column, df1: Column, df2: Column) -> Column:
    @F.pandas_udf("double")
    def chance(value: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([_chance(test, *row) for row in zip(value, a, b)], dtype=float)

    return chance(statistic, df1, df2)


def _observations(df: DataFrame, value: str, group: str, sample: str | None, by: list[str], unit: str) -> DataFrame:
    """``by, g, v, objects``: one row per sample and group, or per object."""
    if unit not in ("sample", "object"):
        raise ValueError("unit must be 'sample' or 'object'")
    v = F.col(f"`{value}`").cast("double")
    rows = df.select(*[f"`{b}`" for b in by], F.col(f"`{group}`").alias("g"), v.alias("v"), *([F.col(f"`{sample}`").alias("s")] if unit == "sample" else []))
    rows = rows.where(F.col("g").isNotNull() & F.col("v").isNotNull() & ~F.isnan("v"))
    if unit == "object":
        return rows.withColumn("objects", F.lit(1).cast("long"))
    return rows.groupBy(*by, "g", "s").agg(F.avg("v").alias("v"), F.count("*").alias("objects")).drop("s")


def rank_sums(observations: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Sum of mid-ranks per group (``by, g, rank_sum``), and ``by, ties``: the sum of t^3 - t over equal values."""
    counts = observations.groupBy(*by, "v", "g").agg(F.count("*").alias("c"))
    values = counts.groupBy(*by, "v").agg(F.sum("c").alias("n"))
    ranked = running_totals(values, by, "v", "n", "upto").withColumn("rank", F.col("upto") - (F.col("n") - 1) / 2)
    ties = values.groupBy(*by).agg(F.sum(F.col("n").cast("double") ** 3 - F.col("n")).alias("ties"))
    same = [counts[b].eqNullSafe(ranked[b]) for b in by]
    met = counts.join(ranked, [counts["v"] == ranked["v"], *same]).select(*[counts[b] for b in by], "g", (F.col("c") * F.col("rank")).alias("r"))
    return met.groupBy(*by, "g").agg(F.sum("r").alias("rank_sum")), ties


def compare_groups(
    df: DataFrame, value: str, group: str = "group", sample: str | None = "sample_name", test: str = "auto", unit: str = "sample", by: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """The test, and a table of the groups it compares; one comparison per value of ``by``.

    ``unit`` "sample" compares the means of samples, "object" pools objects.  "auto" takes Welch's t for two groups, else
    the analysis of variance.  Statistics: t of the first group by name minus the second; the normal deviate of
    Mann-Whitney's U with ties and continuity corrected (``u`` is that of the first group); F; H corrected for ties.
    ``p_value`` is two-sided.  A test for two groups raises for other numbers.  Null groups and null or NaN values are
    left out; a statistic without enough samples or variance is null.
    """
    if test not in TESTS:
        raise ValueError(f"test must be one of {TESTS}")
    by, plain = list(by), not by
    if plain:  # one comparison: every row has the same key
        by, df = ["_all"], df.withColumn("_all", F.lit(0))
    seen = _observations(df, value, group, sample, by, unit)
    groups = seen.groupBy(*by, "g").agg(
        F.count("*").alias("n_samples"), F.sum("objects").alias("n_objects"), F.avg("v").alias("mean"), F.var_samp("v").alias("var")
    )
    if test == "auto":
        most = groups.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
        test = "ttest" if most <= 2 else "anova"
    ties = None
    if test in ("mannwhitney", "kruskal"):
        sums, ties = rank_sums(seen, by)
        groups = _join(groups, sums, [*by, "g"])
    result = _tested(groups, ties, by, test)
    table = groups.withColumn("std", F.sqrt("var")).drop("var").withColumnRenamed("g", group)
    return (result.drop(*by), table.drop(*by)) if plain else (result, table)


def _join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Join on keys that may be null."""
    names = {k: f"_{i}" for i, k in enumerate(keys)}
    other = right.withColumnsRenamed(names)
    on = F.lit(True)
    for k, n in names.items():
        on &= left[k].eqNullSafe(other[n])
    return left.join(other, on, "left").drop(*names.values())


def _tested(groups: DataFrame, ties: DataFrame | None, by: list[str], test: str) -> DataFrame:
    n, k = F.col("n_samples").cast("double"), F.col("n_groups").cast("double")
    parts = [F.count("*").alias("n_groups"), F.sum("n_samples").alias("n_samples"), F.sum("n_objects").alias("n_objects")]
    if test in ("ttest", "mannwhitney"):
        fields = F.struct("g", "n_samples", "mean", "var", *(["rank_sum"] if ties is not None else []))
        parts += [F.min_by(fields, "g").alias("a"), F.max_by(fields, "g").alias("b")]
    elif test == "anova":
        within = F.sum(F.when(F.col("n_samples") > 1, F.col("var") * (n - 1)).otherwise(0.0))
        # the spread of the group means around the mean of all, without a second pass over the groups
        between = F.sum(n * F.col("mean") ** 2) - F.sum(n * F.col("mean")) ** 2 / F.sum(n)
        parts += [within.alias("within"), between.alias("between")]
    else:
        parts += [F.sum(F.col("rank_sum") ** 2 / n).alias("squares")]
    total = groups.groupBy(*by).agg(*parts)
    if ties is not None:
        total = _join(total, ties, by)
    none = F.lit(None).cast("double")
    u = none
    if test in ("ttest", "mannwhitney"):
        two = F.col("n_groups") == 2
        na, nb = F.col("a.n_samples").cast("double"), F.col("b.n_samples").cast("double")
    if test == "ttest":
        sa, sb = F.col("a.var") / na, F.col("b.var") / nb
        statistic = F.try_divide(F.col("a.mean") - F.col("b.mean"), F.sqrt(sa + sb))
        df1, df2 = F.try_divide((sa + sb) ** 2, sa**2 / (na - 1) + sb**2 / (nb - 1)), none
    elif test == "mannwhitney":
        u = F.col("a.rank_sum") - na * (na + 1) / 2
        spread = F.sqrt(na * nb / 12 * (n + 1 - F.col("ties") / (n * (n - 1))))
        off = u - na * nb / 2
        statistic = F.try_divide(F.signum(off) * F.greatest(F.abs(off) - 0.5, F.lit(0.0)), spread)
        df1 = df2 = none
    elif test == "anova":
        df1, df2 = k - 1, n - k
        statistic = F.try_divide(F.try_divide(F.col("between"), df1), F.try_divide(F.col("within"), df2))
    else:
        df1, df2 = k - 1, none
        h = F.lit(12.0) * F.col("squares") / (n * (n + 1)) - 3 * (n + 1)
        statistic = F.when(k > 1, F.try_divide(h, 1 - F.try_divide(F.col("ties"), n**3 - n)))
    if test in ("ttest", "mannwhitney"):
        statistic = F.when(two, statistic).otherwise(F.raise_error(F.lit("this test needs exactly two groups")).cast("double"))
    out = total.select(*by, F.lit(test).alias("test"), "n_groups", "n_samples", "n_objects", statistic.alias("statistic"), u.alias("u"), df1.alias("df1"), df2.alias("df2"))
    return out.withColumn("p_value", _p_value(test, F.col("statistic"), F.col("df1"), F.col("df2")))
