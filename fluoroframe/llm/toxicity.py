"""Toxicity by a weighted lexicon over folded text.

Texts are folded first: compatibility forms, case, homoglyphs of other alphabets,
accents, digits and signs that stand for letters, and letters drawn out.  One
Aho-Corasick automaton then finds the entries of the lexicon and the exception
phrases in a single pass.  An entry is a whole word or the beginning of a word; a
hit inside an exception phrase does not count.  The weights of the hits, as a sum
and relative to the number of words, give the score through a logistic curve.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from fluoroframe.llm.common import drop_memo, filled, free_name, held_out, labelled_sample

#: Most labelled rows that a lexicon is learned from, those with the smallest hash of the id.
FIT_ROWS = 20_000
#: Most entries of a lexicon.
LEXICON_ROWS = 20_000

# Letters of other alphabets that look like Latin ones, and digits and signs written for letters.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h",
    "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "ո": "n", "α": "a", "ε": "e", "ο": "o", "ρ": "p", "ι": "i", "κ": "k",
    "ν": "v", "τ": "t", "υ": "u", "χ": "x", "ß": "b", "ø": "o", "ł": "l", "đ": "d", "ı": "i", "ɑ": "a", "ɡ": "g",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i", "€": "e"}
# Harmless phrases with words of a toxic lexicon.
EXCEPTIONS = ("clown fish", "trash can", "trash bin", "idiot proof", "trash talk show", "scum line", "pond scum", "sore loser effect")

_PLAIN = {ord(k): v for k, v in HOMOGLYPHS.items()}
_LOOSE = {ord(k): v for k, v in SUBSTITUTES.items()}
_SIGN = re.compile("[" + re.escape("".join(SUBSTITUTES)) + "]")
_SIGNED = re.compile(r"[^\s" + re.escape("".join(SUBSTITUTES)) + r"]*[" + re.escape("".join(SUBSTITUTES)) + r"]\S*")
_EDGES = re.compile(r"^[^\w@$€]+|[!|.,;:?%&*#\"')\]]+$")
_ACCENTS = re.compile("[\u0300-\u036f]+")
_GAPS = re.compile(r"[\W\d_]+")
_GAPS_ASCII = re.compile(r"[^a-z]+")
_DRAWN = re.compile(r"([^\W\d_])\1{2,}")
_DRAWN_ASCII = re.compile(r"([a-z])\1\1+")


def _read_signs(m: re.Match) -> str:
    """Signs within a word read as letters; plain numbers and punctuation around words stay what they are."""
    word = _EDGES.sub("", m[0])
    return m[0].replace(word, word.translate(_LOOSE)) if any(c.isalpha() for c in word) and _SIGN.search(word) else m[0]


def folded(text: str) -> str:
    """Words of letters only, one space between, before and after; l counts as i, as both are written 1 or |."""
    text = text.lower()
    if not text.isascii():
        text = _ACCENTS.sub("", unicodedata.normalize("NFKD", text)).lower()
        if not text.isascii():
            text = text.translate(_PLAIN)
    if _SIGN.search(text):
        text = _SIGNED.sub(_read_signs, text)
    gaps, drawn = (_GAPS_ASCII, _DRAWN_ASCII) if text.isascii() else (_GAPS, _DRAWN)
    return " " + gaps.sub(" ", drawn.sub(r"\1", text)).strip().replace("l", "i") + " "


def terms(words: Iterable[str], shortest: int = 4, longest: int = 7) -> set[str]:
    """Whole words (a space on both sides) and word beginnings (a space before)."""
    out = set()
    for w in words:
        out.add(f" {w} ")
        for n in range(shortest, min(longest, len(w) - 1) + 1):
            out.add(f" {w[:n]}")
    return out


@dataclass
class Lexicon:
    """Weights by entry, exception phrases, and the logistic curve over the two features of a text."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    curve: tuple[float, float, float] = (-4.0, 1.5, 0.5)

    def automaton(self) -> ahocorasick.Automaton:
        machine = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            machine.add_word(entry, (len(entry), weight))
        for phrase in self.exceptions:
            entry = folded(phrase)
            machine.add_word(entry, (len(entry), 0.0))
        if len(machine):
            machine.make_automaton()
        return machine

    def features(self, machine: ahocorasick.Automaton, text: str) -> tuple[float, float]:
        """Sum of the weights and weight per hundred words, both as log(1 + x)."""
        flat = folded(text)
        hits: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for end, (n, weight) in machine.iter(flat) if len(machine) else ():
            start = end - n + 1
            if weight == 0.0:
                spared.append((start, end))
            elif weight > hits.get(start, 0.0):
                hits[start] = weight
        if spared and hits:
            hits = {s: w for s, w in hits.items() if not any(a <= s < b for a, b in spared)}
        total = sum(hits.values())
        if not total:
            return 0.0, 0.0
        return float(np.log1p(total)), float(np.log1p(100 * total / max(1, flat.count(" ") - 1)))

    def score(self, machine: ahocorasick.Automaton, text: str) -> float:
        a, b = self.features(machine, text)
        z = self.curve[0] + self.curve[1] * a + self.curve[2] * b
        return float(1 / (1 + np.exp(-z)))


def learn(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic",
    evidence: float = 14.0, lift: float = 8.0,
) -> Lexicon:
    """A lexicon from the labelled rows whose crc32 of the id modulo 4 is not 2.

    Entries occur ``lift`` times as often in toxic texts as in others, with a log likelihood ratio of ``evidence`` or
    more against one common rate (14: by chance about one of a million entries); the weight is the smoothed log ratio.
    Without labelled rows the lexicon is empty.
    """
    sample = labelled_sample(docs, labels, label_column, 4, 2, FIT_ROWS, id_column, text_column)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            seen = (Counter(), Counter())
            for text, y in zip(frame["text"], frame["y"]):
                seen[1 if y == 1 else 0].update(terms(set(folded(text).split())))
            toxic = seen[1]
            other = pd.DataFrame({"term": list(seen[0]), "toxic": 0, "clean": list(seen[0].values())})
            yield pd.concat([pd.DataFrame({"term": list(toxic), "toxic": list(toxic.values()), "clean": 0}), other])

    many = sample.groupBy().agg(F.sum(F.when(F.col("y") == 1, 1).otherwise(0)).alias("t"), F.count("*").alias("n")).first()
    t, n = many["t"] or 0, many["n"]
    if not t:
        return Lexicon({})
    counts = sample.mapInPandas(count, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    ratio = ((F.col("toxic") + 0.5) / (t + 1)) / ((F.col("clean") + 0.5) / (n - t + 1))
    both, share = F.col("toxic") + F.col("clean"), t / n
    part = lambda c, rate: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / both / rate)).otherwise(0.0)
    found = counts.withColumn("ratio", ratio).withColumn("llr", part("toxic", share) + part("clean", max(1 - share, 1e-9)))
    found = found.where((F.col("ratio") >= lift) & (F.col("llr") >= evidence))
    rows = found.orderBy(F.desc("llr"), "term").limit(LEXICON_ROWS).collect()
    weights = {r["term"]: float(np.log(r["ratio"])) for r in rows}
    # a longer entry that a shorter one with as good a ratio already covers adds nothing
    for entry in sorted(weights, key=len, reverse=True):
        if any(weights.get(entry[:i], 0.0) >= weights[entry] - 0.7 for i in range(2, len(entry))):
            del weights[entry]
    lexicon = Lexicon(weights)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = lexicon.automaton()
        for frame in batches:
            pairs = [lexicon.features(machine, t) for t in frame["text"]]
            yield pd.DataFrame({"a": [p[0] for p in pairs], "b": [p[1] for p in pairs], "y": frame["y"]})

    data = sample.mapInPandas(measure, "a double, b double, y int").toPandas()  # at most FIT_ROWS rows of numbers
    lexicon.curve = _logistic(data[["a", "b"]].to_numpy(), (data["y"] == 1).to_numpy(float))
    return lexicon


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float, float]:
    """Newton steps for a curve that does not fall in either feature."""
    x1 = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(3)
    for free in ([0, 1, 2], [0, 1], [0, 2]):
        w = np.zeros(3)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x1[:, free] @ w[free], -30, 30)))
            h = (x1[:, free] * (p * (1 - p))[:, None]).T @ x1[:, free] + ridge * np.eye(len(free))
            step = np.linalg.solve(h, x1[:, free].T @ (y - p) - ridge * w[free])
            w[free] += step
            if np.abs(step).max() < 1e-6:
                break
        if (w[1:] >= 0).all():
            break
    return tuple(float(v) for v in np.concatenate([w[:1], np.maximum(w[1:], 0)]))


def toxicity(text: Column, lexicon: Lexicon) -> Column:
    """Score from 0 to 1 of every text; null counts as empty."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        drop_memo()
        machine = lexicon.automaton()
        for texts in batches:
            yield pd.Series([lexicon.score(machine, t) for t in texts], dtype=float)

    return scored(filled(text))


def score_documents(
    docs: DataFrame, lexicon: Lexicon, id_column: str = "doc_id", text_column: str = "text", threshold: float = 0.3
) -> DataFrame:
    """Per row: id, ``held_out``, ``score`` (0 to 1) and ``predicted`` (1 at ``threshold`` or more).

    Whole texts count; null and empty texts get the score of a text without hits.  Repeated rows and null ids keep
    their rows.  Other columns are left behind.
    """
    rows = docs.select(F.col(f"`{id_column}`"), held_out(id_column, 4, 2).alias("held_out"), toxicity(F.col(f"`{text_column}`"), lexicon).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_clean(docs: DataFrame, lexicon: Lexicon, text_column: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` below the threshold, columns unchanged."""
    mark = free_name(docs, "_toxic")
    scored = docs.withColumn(mark, toxicity(F.col(f"`{text_column}`"), lexicon))
    return scored.where(F.col(mark) < threshold).drop(mark)
