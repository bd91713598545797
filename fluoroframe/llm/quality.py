"""Quality scores from random Fourier features of document statistics.

Each text becomes a short vector of statistics.  Cosines of random projections
approximate a Gaussian kernel over the standardised vectors; every partition adds
up its part of the normal equations, whose size does not depend on the rows, and
the ridge solution gives a raw score.  Isotonic regression over a histogram of the
raw scores turns it into a probability.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from fluoroframe.llm.common import drop_memo, filled, free_name, held_out, labelled_sample
from fluoroframe.plans.cut import cut

#: Most labelled rows that a model is fitted on, those with the smallest hash of the id.
FIT_ROWS = 20_000
WAVES = 256
BINS = 1000
_MARKS = "|!#$%&*"
_STOPS = ".,;:?"


def statistics(text: str) -> list[float]:
    """Numbers that describe the form of a text; defined for the empty text too."""
    words = text.split()
    n, chars = len(words), len(text)
    if not n:
        return [0.0] * STATISTICS
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
    counts = Counter(words)
    common = [c for _, c in counts.most_common(3)]
    pairs = set(zip(words, words[1:]))
    lines = text.split("\n")
    per_word = lambda x: x / n
    upper = sum(map(str.isupper, words))
    marks = [np.log1p(100 * per_word(text.count(m))) for m in _MARKS]
    stops = sum(text.count(m) for m in _STOPS)
    digits = sum(text.count(d) for d in "0123456789")
    repeats = sum(a == b for a, b in zip(words, words[1:]))
    return [
        float(np.log1p(n)), float(np.log1p(chars)), float(lengths.mean()), float(np.log1p(lengths.std())), float(np.log1p(lengths.max())),
        len(counts) / n, float(np.log1p(len(counts))), common[0] / n, sum(common) / n, (len(pairs) + 1) / n, repeats / n,
        upper / n, sum(map(str.istitle, words)) / n, sum(map(str.isalpha, words)) / n, float((lengths <= 3).mean()),
        per_word(stops), float(np.log1p(100 * per_word(digits))), text.count(".") / n,
        float(np.log1p(len(lines))), n / len(lines) / 50, len(set(lines)) / len(lines), *map(float, marks),
    ]


STATISTICS = 21 + len(_MARKS)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def waves(self, x: np.ndarray) -> np.ndarray:
        """Fourier features with a constant."""
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.column_stack([np.ones(len(z)), np.cos(z @ self.directions + self.phases) * np.sqrt(2 / len(self.phases))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.waves(x) @ self.weights

    def score(self, texts: list[str]) -> np.ndarray:
        if not len(texts):
            return np.zeros(0)
        raw = self.raw(np.array([statistics(t) for t in texts]))
        return np.interp(raw, self.knots, self.values)


def isotonic(y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted least-squares fit that never falls: neighbours out of order are pooled."""
    blocks: list[list[float]] = []
    for value, w in zip(y, weight):
        blocks.append([value, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return np.concatenate([np.full(int(n), v) for v, _, n in blocks]) if blocks else np.zeros(0)


def fit(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality",
    width: float = 0.5, ridge: float = 1e-3, seed: int = 7,
) -> Model:
    """A model from labelled rows whose crc32 of the id modulo 3 is not 1; without such rows every score is 1."""
    sample = labelled_sample(docs, labels, label_column, 3, 1, FIT_ROWS, id_column, text_column)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            yield pd.DataFrame({"x": [statistics(t) for t in frame["text"]], "y": (frame["y"] == 1).astype(float)})

    rows = cut(sample.mapInPandas(measure, "x array<double>, y double"), sample)
    columns = [f(F.col("x")[i]).alias(f"{name}{i}") for i in range(STATISTICS) for name, f in (("m", F.avg), ("s", F.stddev_pop))]
    sums = rows.agg(F.count("*").alias("n"), F.avg("y").alias("share"), *columns).first()
    if not sums["n"]:
        zero = np.zeros(STATISTICS)
        return Model(zero, zero + 1, np.zeros((STATISTICS, 1)), np.zeros(1), np.zeros(2), np.array([0.0]), np.array([1.0]))
    random = np.random.default_rng(seed)
    model = Model(
        np.array([sums[f"m{i}"] for i in range(STATISTICS)]),
        np.maximum(np.array([sums[f"s{i}"] for i in range(STATISTICS)]), 1e-6),
        random.normal(size=(STATISTICS, WAVES)) * (width / np.sqrt(STATISTICS)),
        random.uniform(0, 2 * np.pi, WAVES),
        np.zeros(WAVES + 1), np.array([0.0]), np.array([float(sums["share"])]),
    )

    def equations(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((WAVES + 1, WAVES + 2))
        for frame in batches:
            if len(frame):
                z = model.waves(np.stack(frame["x"]))
                total += z.T @ np.column_stack([z, frame["y"].to_numpy()])
        yield pd.DataFrame({"i": np.arange(WAVES + 1), "row": list(total)})

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": frame["i"].iloc[:1], "row": [np.sum(np.stack(frame["row"]), axis=0)]})

    parts = rows.mapInPandas(equations, "i int, row array<double>").groupBy("i").applyInPandas(add, "i int, row array<double>")
    matrix = np.array([r["row"] for r in parts.orderBy("i").collect()])  # WAVES + 1 rows at any size of the input
    n = float(sums["n"])
    model.weights = np.linalg.solve(matrix[:, :-1] + ridge * n * np.eye(WAVES + 1) / (WAVES + 1), matrix[:, -1])

    def bins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            if len(frame):
                at = np.clip((model.raw(np.stack(frame["x"])) + 0.5) / 2 * BINS, 0, BINS - 1).astype(int)
                yield pd.DataFrame({"bin": at, "y": frame["y"]})

    table = rows.mapInPandas(bins, "bin int, y double").groupBy("bin").agg(F.sum("y").alias("y"), F.count("*").alias("n"))
    seen = table.orderBy("bin").toPandas()  # at most BINS rows
    # one row of either kind per bin at the ends keeps the probabilities off 0 and 1
    model.knots = (seen["bin"].to_numpy() + 0.5) / BINS * 2 - 0.5
    values = isotonic((seen["y"] / seen["n"]).to_numpy(), seen["n"].to_numpy(float))
    # within a flat stretch the raw score still orders texts, by a slope too small to change a decision
    model.values = np.clip(values * 0.998 + 0.001 + (model.knots - 0.5) * 1e-4, 0, 1)
    return model


def quality(text: Column, model: Model) -> Column:
    """Probability of label 1 of every text; null counts as empty."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        drop_memo()
        for texts in batches:
            yield pd.Series(model.score(texts.tolist()), dtype=float)

    return scored(filled(text))


def score_documents(
    docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text", threshold: float = 0.5
) -> DataFrame:
    """Per row: id, ``held_out``, ``score`` (0 to 1) and ``predicted`` (1 at ``threshold`` or more).

    Whole texts count; null and empty texts are scored by their zero statistics.  Repeated rows and null ids keep
    their rows.  Other columns are left behind.
    """
    rows = docs.select(F.col(f"`{id_column}`"), held_out(id_column, 3, 1).alias("held_out"), quality(F.col(f"`{text_column}`"), model).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, model: Model, text_column: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` at or above the threshold, columns unchanged."""
    mark = free_name(docs, "_quality")
    scored = docs.withColumn(mark, quality(F.col(f"`{text_column}`"), model))
    return scored.where(F.col(mark) >= threshold).drop(mark)
