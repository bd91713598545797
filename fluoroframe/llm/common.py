"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fluoroframe.plans.cut import cut


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def filled(column: str | Column) -> Column:
    """Text with null as the empty text."""
    column = F.col(f"`{column}`") if isinstance(column, str) else column
    return F.coalesce(column.cast("string"), F.lit(""))


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is worked out once per row.

    As the only element of an exploded array the value is not copied into the lambdas and filters that use it, which
    would work it out again for every element.
    """
    return df.select("*", F.explode_outer(F.array(value)).alias(name))


def held_out(id_column: str, folds: int, fold: int) -> Column:
    """crc32 of the id as text, modulo ``folds``, equals ``fold``; a null id counts as the empty text."""
    return F.crc32(filled(id_column)) % folds == fold


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label_column: str, folds: int, fold: int, rows: int,
    id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """``text, y`` of the at most ``rows`` labelled ids with the smallest hash, outside the held-out fold.

    Rows without id or label are left out; of several labels of an id the largest counts.
    """
    marks = labels.where(F.col(f"`{label_column}`").isNotNull() & F.col(f"`{id_column}`").isNotNull() & ~held_out(id_column, folds, fold))
    marks = marks.groupBy(F.col(f"`{id_column}`").alias("_id")).agg(F.max(f"`{label_column}`").cast("int").alias("y"))
    chosen = marks.orderBy(F.xxhash64("_id"), "_id").limit(rows)
    texts = docs.select(F.col(f"`{id_column}`").alias("_id"), filled(text_column).alias("text"))
    return cut(texts.join(F.broadcast(chosen), "_id").select("text", "y"))  # at most ``rows`` pairs of numbers are sent


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have yet."""
    taken = {c.lower() for c in df.columns}
    name, n = stem, 0
    while name.lower() in taken:
        n += 1
        name = f"{stem}_{n}"
    return name


def worker_memo(key: object, build: Callable[[], object]) -> object:
    """One object per Python worker process, kept between the tasks that the worker runs, until ``drop_memo``."""
    store = sys.__dict__.setdefault("_fluoroframe_memo", {})
    if key not in store:
        store[key] = build()
    return store[key]


def drop_memo() -> None:
    """Lets go of what this worker remembers for other operators, as a worker outlives them."""
    sys.__dict__.pop("_fluoroframe_memo", None)
