"""Exact top-k search by distributed histogram selection.

All candidates are scored against all queries, block against block.  Each round
adds one histogram per query over all tasks, and the bin that holds the k-th best
score becomes the next range, until the range is one value wide.  The last pass
keeps the scores above that value and, of the scores equal to it, the k smallest
ids of each block; a window over these few rows breaks the ties.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from fluoroframe.plans.cut import cut

BINS = 64
BLOCK_VALUES = 1 << 20  # vector components in a block of candidates
QUERY_BLOCK = 2048  # queries in a block
EXACT_DOUBLE = 1 << 53
EXACT_LONG = 1 << 62
#: Scores of this size or more cannot be ranked as 64-bit integers.
LARGEST = 1 << 61


def quantised(df: DataFrame, id_column: str, vector_column: str, scale: int = 256) -> DataFrame:
    """``id, dim, vec, norm``: components as floor(scale * x) in 64-bit integers.

    Rows with a null id, a null or empty vector, or a null or non-finite component take no part.  A component of 2^62 or
    more is an error.
    """
    x = F.col(f"`{vector_column}`")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    beyond = F.raise_error(F.lit("a vector component is too large for 64-bit integers")).cast("double")
    fits = lambda v: F.when(F.abs(v) < float(EXACT_LONG), v).otherwise(beyond)
    rows = df.where(F.col(f"`{id_column}`").isNotNull() & x.isNotNull() & (F.size(x) > 0) & fine).select(
        F.col(f"`{id_column}`").cast("long").alias("id"),
        F.size(x).alias("dim"),
        F.transform(x, lambda v: F.floor(fits(v.cast("double") * scale)).cast("long")).alias("vec"),
    )
    rows = rows.withColumn("norm", F.aggregate("vec", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")))
    return rows.withColumn("norm", F.ceil(F.least(F.sqrt("norm"), F.lit(float(LARGEST)))) + 1)


def _candidate_blocks(rows: DataFrame) -> DataFrame:
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: dict[int, list] = {}

        def block(dim: int) -> pd.DataFrame:
            ids, vecs = zip(*waiting.pop(dim))
            return pd.DataFrame({"dim": [dim], "ids": [np.array(ids, "<i8").tobytes()], "vecs": [np.stack(vecs).astype("<i8").tobytes()]})

        for frame in batches:
            for i, dim, vec in zip(frame["id"], frame["dim"], frame["vec"]):
                waiting.setdefault(dim, []).append((i, np.asarray(vec, dtype=np.int64)))
                if len(waiting[dim]) * dim >= BLOCK_VALUES:
                    yield block(dim)
        for dim in list(waiting):
            yield block(dim)

    return rows.select("id", "dim", "vec").mapInPandas(pack, "dim int, ids binary, vecs binary")


def _scores(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores of a pair of blocks as (query, candidate), with the ids of both."""
    ids, qids = np.frombuffer(row.ids, "<i8"), np.array([q["id"] for q in row.queries], dtype=np.int64)
    cand = np.frombuffer(row.vecs, "<i8").reshape(len(ids), row.dim)
    query = np.array([q["vec"] for q in row.queries], dtype=np.int64)
    bound = row.dim * max(1, int(np.abs(cand).max(initial=0))) * max(1, int(np.abs(query).max(initial=0)))
    if bound < EXACT_DOUBLE:
        scores = (query.astype(np.float64) @ cand.astype(np.float64).T).astype(np.int64)
    elif bound < EXACT_LONG:
        scores = query @ cand.T
    else:
        wide = query.astype(object) @ cand.astype(object).T  # whole numbers of any size
        if np.abs(wide).max(initial=0) >= LARGEST:
            raise ValueError("a score is too large for 64-bit integers")
        scores = wide.astype(np.int64)
    return scores, qids, ids


def _slices(row) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list]]:
    """Scores of at most 64 queries at a time, so that a task holds few megabytes."""
    queries = list(row.queries)
    for at in range(0, len(queries), 64):
        part = row._replace(queries=queries[at : at + 64])
        yield (*_scores(part), part.queries)


def _pairs(blocks: DataFrame, queries: DataFrame, state: DataFrame) -> DataFrame:
    """Every query block next to every candidate block of its vector length."""
    packed = (
        queries.join(state, "id")
        .groupBy("dim", "part")
        .agg(F.collect_list(F.struct("id", "vec", "lo", "hi", "width")).alias("queries"))
    )
    parts = queries.groupBy("dim").agg(F.collect_set("part").alias("parts"))
    spread = blocks.join(parts, "dim").select("dim", "ids", "vecs", F.explode("parts").alias("part"))
    return spread.join(packed, ["dim", "part"]).select("dim", "ids", "vecs", "queries")


def top_k(
    df: DataFrame,
    queries: DataFrame,
    k: int = 5,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    scale: int = 256,
) -> DataFrame:
    """``query_id, rank, <id>, score`` of the k best rows of ``df`` for every row of ``queries``.

    The score is the integer inner product of the quantised vectors (see ``quantised`` for the rows that take no
    part); equal scores go to the smaller id.  Rows with the query's own id and rows of another vector length are no
    candidates.  Of repeated query ids the smallest vector counts; repeated candidate rows count each.  A query
    without candidates has no row.
    """
    rows = quantised(df, id_column, vector_column, scale)
    blocks = cut(_candidate_blocks(rows))
    asked = quantised(queries, id_column, vector_column, scale)
    asked = asked.groupBy("id").agg(F.min(F.struct("vec", "dim", "norm")).alias("q")).select("id", "q.*")
    parts = max(1, math.ceil(asked.count() / QUERY_BLOCK))
    asked = cut(asked.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")))
    reach = rows.agg(F.max("norm")).first()[0] or 0
    # scores of a query lie in [lo, hi), cut into BINS bins of a width; need: how many of the best in it are still wanted
    limit = F.least(F.col("norm").cast("double") * float(reach) + 1, F.lit(float(LARGEST)))
    state = asked.select(
        "id",
        (-F.ceil(limit)).cast("long").alias("lo"),
        F.ceil(limit).cast("long").alias("hi"),
        F.ceil((limit * 2 + 2) / BINS).cast("long").alias("width"),
        F.lit(k).cast("long").alias("need"),
    )
    # An unlucky range is never wrong: with fewer than `need` scores in it the lowest bin is taken.
    while True:
        state = cut(state)
        if not state.where("width > 0").limit(1).count():
            break
        state = _narrow(blocks, asked, state)
    best = _pairs(blocks, asked, state).mapInPandas(_filter(k), "query_id long, id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", F.col("id").alias(id_column), "score"
    )


def _narrow(blocks: DataFrame, asked: DataFrame, state: DataFrame) -> DataFrame:
    """One round: the bin with the k-th best score becomes the range; width 0 marks a range of one value."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for row in frame.itertuples(index=False):
                for scores, qids, ids, asked_here in _slices(row):
                    lo = np.array([q["lo"] for q in asked_here])[:, None]
                    hi = np.array([q["hi"] for q in asked_here])[:, None]
                    width = np.array([q["width"] for q in asked_here])[:, None]
                    bins = (scores - lo) // np.maximum(width, 1)
                    fit = (scores >= lo) & (scores < hi) & (width > 0) & (qids[:, None] != ids[None, :])
                    at = (bins + np.arange(len(qids))[:, None] * BINS)[fit]
                    sums = np.bincount(at, minlength=len(qids) * BINS).reshape(len(qids), BINS)
                    q, b = np.nonzero(sums)
                    yield pd.DataFrame({"id": qids[q], "bin": b.astype(np.int64), "n": sums[q, b]})

    counted = _pairs(blocks, asked, state).mapInPandas(count, "id long, bin long, n long")
    sums = counted.groupBy("id", "bin").agg(F.sum("n").alias("n")).join(state, "id")
    w = Window.partitionBy("id").orderBy(F.desc("bin"))
    above = sums.withColumn("above", F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # the last bin that still leaves some wanted: it holds the k-th score, or is the lowest with any score
    held = above.where("above < need").groupBy("id").agg(F.min(F.struct("bin", "above")).alias("h"))
    width = F.col("width")
    moved = state.join(held, "id", "left").select(
        "id",
        F.when((width > 0) & F.col("h").isNotNull(), F.col("lo") + F.col("h.bin") * width).otherwise(F.col("lo")).alias("lo"),
        F.when((width > 0) & F.col("h").isNotNull(), F.least("hi", F.col("lo") + (F.col("h.bin") + 1) * width)).otherwise(F.col("hi")).alias("hi"),
        F.when((width <= 1) | F.col("h").isNull(), F.lit(0)).otherwise(F.ceil(width / F.lit(BINS))).cast("long").alias("width"),
        F.when((width > 0) & F.col("h").isNotNull(), F.col("need") - F.col("h.above")).otherwise(F.col("need")).alias("need"),
    )
    return moved


def _filter(k: int):
    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for row in frame.itertuples(index=False):
                for scores, qids, ids, asked_here in _slices(row):
                    for i, q in enumerate(asked_here):
                        other = ids != qids[i]
                        over = np.nonzero((scores[i] > q["lo"]) & other)[0]
                        ties = np.nonzero((scores[i] == q["lo"]) & other)[0]
                        if len(ties) > k:
                            ties = ties[np.argpartition(ids[ties], k - 1)[:k]]
                        at = np.concatenate([over, ties])
                        yield pd.DataFrame({"query_id": np.full(len(at), qids[i]), "id": ids[at], "score": scores[i][at]})

    return keep
