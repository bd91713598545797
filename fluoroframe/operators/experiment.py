"""Sample and group summaries and experiment state."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from fluoroframe.plans.ranks import exact_percentiles, number_rows


def stack_tables(tables: Sequence[DataFrame], measurement: str) -> DataFrame:
    """All tables that carry the measurement and the sample columns."""
    needed = {"sample_name", "sample_id", "group", measurement}
    good = [t for t in tables if needed.issubset(t.columns)]
    if not good:
        raise ValueError(f"no measurement tables contain {measurement!r} with sample columns")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), good)


def summarize_experiment(
    tables: Sequence[DataFrame] | DataFrame,
    measurement: str,
    group_by: str = "group",
    sample_col: str = "sample_name",
    row_order: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Per-sample statistics, then group statistics over the samples.

    The first group seen per sample wins (smallest ``row_order``, or smallest group
    name without one).  Null samples and null groups are groups of their own.
    """
    df = tables if isinstance(tables, DataFrame) else stack_tables(tables, measurement)
    m = F.col(f"`{measurement}`").cast("double")
    rows = df.select(
        F.col(sample_col), F.col(group_by), m.alias("_m"), *([F.col(row_order).alias("_o")] if row_order else [])
    ).withColumn("_m", F.when(~F.isnan("_m"), F.col("_m")))
    owner = F.min_by(group_by, "_o") if row_order else F.min(group_by)
    stats = rows.groupBy(sample_col).agg(
        F.count("_m").alias("count"),
        F.avg("_m").alias("mean"),
        F.stddev_samp("_m").alias("std"),
        owner.alias(group_by),
    )
    median = exact_percentiles(rows, [sample_col], "_m", {"median": 0.5}).withColumnRenamed(sample_col, "_s")
    stats = stats.join(median, F.col(sample_col).eqNullSafe(F.col("_s")), "left").drop("_s")
    stats = stats.withColumn("sem", F.col("std") / F.sqrt("count"))
    samples = stats.select(sample_col, "count", "mean", "median", "std", "sem", group_by)
    groups = samples.groupBy(group_by).agg(
        F.count(sample_col).alias("n_samples"),
        F.avg("mean").alias("mean"),
        F.avg("median").alias("median"),
        F.avg("std").alias("std"),
        F.avg("sem").alias("sem"),
    )
    sizes = rows.groupBy(F.col(group_by).alias("_g")).agg(F.count("*").alias("n_objects"))
    groups = groups.join(sizes, F.col(group_by).eqNullSafe(F.col("_g")), "left").drop("_g")
    return samples, groups


def group_conflicts(df: DataFrame, group_by: str = "group", sample_col: str = "sample_name") -> DataFrame:
    """Samples that appear with more than one group."""
    n = F.count_distinct(group_by)
    return df.groupBy(sample_col).agg(n.alias("n_groups")).where("n_groups > 1")


def _latest(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    both = old.unionByName(new, allowMissingColumns=True)
    rest = [c for c in both.columns if c != key]
    return both.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*")


def _required(c: str, message: str) -> Column:
    text = F.trim(c)
    return F.when(F.length(text) > 0, text).otherwise(F.raise_error(F.lit(message)))


def upsert_samples(
    samples: DataFrame, annotations: DataFrame, require_group: bool = False, order: str = "updated_at"
) -> DataFrame:
    """One row per trimmed sample name, the latest annotation wins (M4).

    A blank sample id becomes the name, a blank group becomes null; with
    ``require_group`` a blank group is an error.
    """
    group = F.nullif(F.trim("group"), F.lit(""))
    if require_group:
        group = _required("group", "group must not be empty")
    new = annotations.withColumns(
        {"sample_name": _required("sample_name", "sample_name must not be empty"), "group": group}
    )
    sid = F.nullif(F.trim("sample_id"), F.lit("")) if "sample_id" in new.columns else F.lit(None).cast("string")
    new = new.withColumn("sample_id", F.coalesce(sid, "sample_name"))
    return _latest(samples, new, "sample_name", order)


def upsert_recipes(recipes: DataFrame, new: DataFrame, order: str = "updated_at") -> DataFrame:
    """One row per trimmed recipe name; the id is the name (M9)."""
    named = new.withColumn("name", _required("name", "recipe name must not be empty"))
    named = named.withColumn("recipe_id", F.col("name"))
    return _latest(recipes, named, "name", order)


def upsert_runs(runs: DataFrame, new: DataFrame, order: str = "updated_at") -> DataFrame:
    """Runs keyed by run_id; new rows without an id are numbered on.

    Numbering continues after the largest counter already used.
    """
    known = new.where("run_id IS NOT NULL")
    fresh = new.where("run_id IS NULL").drop("run_id")
    used = runs.unionByName(known, allowMissingColumns=True)
    last = used.agg(F.coalesce(F.max(F.regexp_extract("run_id", r"^run_(\d+)$", 1).try_cast("long")), F.lit(0)).alias("n"))
    block = fresh.withColumns({"_one": F.lit(0), "_at": F.date_trunc("hour", F.col(order))})
    numbered = number_rows(block, ["_one"], ["_at", order], "_n", start=1).drop("_one", "_at")
    n = F.col("_n") + last.scalar()
    fresh = numbered.withColumn("run_id", F.format_string("run_%04d", n)).drop("_n")
    return _latest(used, fresh, "run_id", order)


def run_totals(runs: DataFrame) -> DataFrame:
    """n_samples, n_complete, n_failed per recipe."""
    return runs.groupBy("recipe_id").agg(
        F.count("*").alias("n_samples"),
        F.count_if(F.col("status") == "complete").alias("n_complete"),
        F.count_if(F.col("status") == "failed").alias("n_failed"),
    )


def overview_counts(files: DataFrame, samples: DataFrame, recipes: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """Files, samples, distinct non-empty groups, recipes, failed runs in one row."""
    parts = [
        files.agg(F.count("*").alias("n_files")),
        samples.agg(
            F.count("*").alias("n_samples"), F.count_distinct(F.nullif("group", F.lit(""))).alias("n_groups")
        ),
        recipes.agg(F.count("*").alias("n_recipes")),
    ]
    if runs is not None:
        parts.append(runs.agg(F.count("*").alias("n_runs"), F.count_if(F.col("status") == "failed").alias("n_failed")))
    keyed = [p.withColumn("_one", F.lit(1)) for p in parts]
    return reduce(lambda a, b: a.join(b, "_one"), keyed).drop("_one")


def samples_by_group(samples: DataFrame, position: str) -> DataFrame:
    """Sample names of each group in input order, one row per sample.

    Blank and missing groups are "unassigned".  Rows carry their position, so a group
    of any size stays spread over tasks; ``group_lines`` joins them for reports.
    """
    group = F.coalesce(F.nullif(F.trim("group"), F.lit("")), F.lit("unassigned"))
    return samples.select(group.alias("group"), F.col(position).alias("position"), "sample_name")


def group_lines(samples: DataFrame, position: str) -> DataFrame:
    """One text line per group; the line is a single string by definition."""
    rows = samples_by_group(samples, position)
    names = F.array_sort(F.collect_list(F.struct("position", "sample_name")))
    return rows.groupBy("group").agg(F.array_join(names.getField("sample_name"), ", ").alias("samples"))
