"""Spelling variants of words through an index of variable-length grams.

A gram grows from two letters while it is frequent, up to ``LONGEST`` letters, so that the lists of common
beginnings are split and rare ones stay short.  A word is the set of its grams that lie inside no other gram of
it.  For every place of an edit the grams that it can change are known: those across the place, those that could
grow over it and those that a gram across it could swallow.  The largest such number is the bound of the word: of
its rarest ``bound + 1`` grams at least one outlives any one edit, also among the rarest of the other word.

Lists are merged in parts.  A gram that outlives the edit has the edit on one side, so the text on its other side
and the length of the rest agree too, and both go into the key of the list.  A longer rest is cut into pieces of three
letters, one of which holds the edit, and all others go into the key too, so that no part of a list is long.  Words
whose grams may all be changed meet by the pieces of the whole word.  Every pair is verified by its edit distance.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from fluoroframe.llm.common import filled
from fluoroframe.plans.cut import cut

SHORTEST, LONGEST = 2, 4
#: A gram grows while more words than this hold it, or more than the share that keeps the dictionary small.
GROWS_ABOVE = 64
#: Frequent grams of one length are at most this many, as each takes more than this share of all places.
MOST_GRAMS = 100_000
#: Letters of a piece of the rest that one key leaves open, and most pieces of a long rest.
PIECE, PIECES = 3, 4
# Fixed value: maximal runs of these letters are words.
LETTERS = "A-Za-zÀ-ÿ"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def word_counts(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least_letters: int = 7, least_count: int = 2, one_in: int = 31
) -> DataFrame:
    """``word, n``: runs of letters with A-Z lower-cased, of at least that length and number.

    If ``one_in`` divides the crc32 of ``<id>:<run>``, the run loses the letter at that crc32 modulo its length (an
    error planted on purpose; ``one_in=0`` plants none).  Null texts have no words, a null id reads as empty.
    """
    low = F.translate(filled(text_column), CAPITALS, CAPITALS.lower())
    runs = docs.select(
        F.col(f"`{id_column}`").cast("string").alias("id"),
        F.explode(F.regexp_extract_all(low, F.lit(f"[{LETTERS}]{{{least_letters},}}"), F.lit(0))).alias("run"),
    )
    if one_in:
        marked = runs.select("run", F.crc32(F.concat(F.coalesce("id", F.lit("")), F.lit(":"), "run")).alias("h"))
        at = (F.col("h") % F.length("run")).cast("int")
        less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
        runs = marked.select(F.when(F.col("h") % one_in == 0, less).otherwise(F.col("run")).alias("run")).where(F.length("run") >= least_letters)
    return runs.groupBy(F.col("run").alias("word")).agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def frequent_grams(words: DataFrame, column: str = "word") -> tuple[dict[str, int], int]:
    """Grams of 2 to ``LONGEST - 1`` letters at more than ``above`` places of the words, with their counts; ``above``.

    Every part of a frequent gram is frequent.  At most ``MOST_GRAMS`` of a length go to the driver.
    """
    places = words.agg(F.sum(F.greatest(F.length(column) - (SHORTEST - 1), F.lit(0)))).first()[0] or 0
    above = max(GROWS_ABOVE, -(-places // MOST_GRAMS))
    size = F.length(column)
    grams = [
        F.when(size >= q, F.transform(F.sequence(F.lit(1), size - (q - 1)), lambda p, q=q: F.substring(F.col(column), p, F.lit(q))))
        .otherwise(F.array().cast("array<string>"))
        for q in range(SHORTEST, LONGEST)
    ]
    counted = words.select(F.explode(F.concat(*grams)).alias("gram")).groupBy("gram").agg(F.count("*").alias("c"))
    return {r.gram: r.c for r in counted.where(F.col("c") > above).collect()}, above


class Grams:
    """Decomposition of words by the frequent grams."""

    def __init__(self, frequent: dict[str, int], above: int) -> None:
        self.frequent, self.above = frequent, above
        self.tails = {g[k:] for g in frequent for k in range(1, len(g) + 1)}

    def places(self, word: str) -> list[tuple[int, int]]:
        """Begin and end of the grams of a word: the longest one at each letter, if an earlier one does not hold it."""
        out, reach, size, frequent = [], 0, len(word), self.frequent
        for p in range(size - SHORTEST + 1):
            e = p + SHORTEST
            while e < size and e - p < LONGEST and word[p:e] in frequent:
                e += 1
            if e > reach:
                out.append((p, e))
                reach = e
        return out

    def bound(self, word: str, places: list[tuple[int, int]]) -> int:
        """Most grams that one inserted, deleted or replaced letter can change."""
        begins, ends = [p for p, _ in places], [e for _, e in places]  # both ascend
        size, most = len(word), 0
        for left in range(size + 1):
            # the first gram that a longer one could take in from the left of ``left``
            first = next((j for j in range(max(0, left - LONGEST + 1), left - SHORTEST + 1) if word[j:left] in self.frequent), left)
            low = min(bisect_left(begins, first), bisect_right(ends, left))
            for right in (left, left + 1):  # a letter put in at ``left``, or the letter there deleted or replaced
                if right > size:
                    continue
                last = next((e for e in range(min(size, right + LONGEST - 1), right, -1) if word[right : e - 1] in self.tails), right)
                most = max(most, max(bisect_right(ends, last), bisect_left(begins, right)) - low)
        return most

    def longest_list(self, gram: str) -> int:
        """No more places than this have the gram; one value per gram, so that all words rank their grams alike."""
        known = self.frequent.get(gram)
        if known is not None:
            return known
        return min(self.frequent.get(gram[:-1], self.above), self.frequent.get(gram[1:], self.above)) if len(gram) == LONGEST else self.above

    def keys(self, word: str) -> list[str]:
        """Keys of the list parts of a word; words one edit apart share one."""
        places = self.places(word)
        bound = self.bound(word, places)
        ranked = sorted([(self.longest_list(word[p:e]), word[p:e], p, e) for p, e in places])
        keys: list[str] = []
        for _, _, p, e in ranked[: bound + 1]:
            keys += _parts(f"<{word[:e]}", word[e:])
            keys += _parts(f">{word[p:]}", word[:p])
        if len(places) <= bound:
            keys += _parts("", word)
        return keys


def _parts(kept: str, rest: str) -> Iterator[str]:
    """Keys for ``kept`` letters beside a ``rest`` with the edit, as the shorter or equal and as the longer word."""
    for size in range(max(len(rest) - 1, 0), len(rest) + 1):
        piece = max(PIECE, -(-size // PIECES))
        for at in range(0, max(size, 1), piece):
            yield f"{kept}|{size}|{at}|{rest[:at]}|{rest[len(rest) - max(size - at - piece, 0):]}"


def near_pairs(words: DataFrame) -> DataFrame:
    """``word, n, word2, n2``: every two of the distinct ``words`` (word, n) exactly one letter apart, once."""
    frequent, above = frequent_grams(words)
    sent = words.sparkSession.sparkContext.broadcast(Grams(frequent, above))  # at most MOST_GRAMS of each length

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams, digest = sent.value, xxhash.xxh64_intdigest
        for batch in batches:
            for at in range(0, len(batch), 2000):
                part = batch.iloc[at : at + 2000]
                keys = [{digest(k) for k in grams.keys(w)} for w in part["word"]]
                sizes = [len(k) for k in keys]
                flat = np.fromiter((k for ks in keys for k in ks), dtype=np.uint64, count=sum(sizes)).view(np.int64)
                yield pd.DataFrame({"k": flat, "word": part["word"].repeat(sizes).array, "n": part["n"].repeat(sizes).array})

    tasks = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    keyed = words.select("word", "n").repartition(tasks, "word").mapInPandas(spread, "k long, word string, n long")
    # both sides have one form, so that their shuffle is written once and read twice
    one, other = (keyed.select(*[F.col(c).alias(f"{c}{i}") for c in ("k", "word", "n")]) for i in (1, 2))
    # a merge join: Spark takes the keys for as small as the words, but each word has some twenty
    met = one.join(other.hint("merge"), F.col("k1") == F.col("k2")).where((F.col("word1") < F.col("word2")) & one_apart("word1", "word2"))
    return met.select(F.col("word1").alias("word"), F.col("n1").alias("n"), "word2", "n2").distinct()


def one_apart(a: str, b: str) -> Column:
    """Exactly one inserted, deleted or replaced code point."""
    return (F.abs(F.length(a) - F.length(b)) <= 1) & (F.levenshtein(F.col(a), F.col(b), 1) == 1)


def roots(forms: DataFrame) -> DataFrame:
    """``word, form`` -> ``word, root``, the end of the chain of forms; each round doubles the length of the steps."""
    state = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        above = state.select(F.col("word").alias("root"), F.col("root").alias("higher"))
        new = cut(state.join(above, "root", "left").select("word", F.coalesce("higher", "root").alias("root"), F.col("higher").isNotNull().alias("moved")), state)
        state = new.select("word", "root")
        state._cut_path = new._cut_path
        if not new.where("moved").limit(1).count():
            return state


def spelling_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", times: int = 10, **counting: int) -> DataFrame:
    """One row per word of the texts: ``word, form, root, n, n_near, form_n``.

    ``form`` is the near word of largest n (ties: smallest in code-point order) if that is ``times`` its n or more, else
    null, with ``form_n``; ``root`` is the last form of the chain, or the word; ``n_near`` counts near words.
    ``counting`` goes to ``word_counts``, which also says what nulls mean.  An empty table gives no row; rows that
    repeat count each time; other columns are left behind.
    """
    words = cut(word_counts(docs, id_column, text_column, **counting))
    pairs = near_pairs(words)
    sides = F.array(F.struct("word", "n", F.col("word2").alias("near"), F.col("n2").alias("m")), F.struct(F.col("word2").alias("word"), F.col("n2").alias("n"), F.col("word").alias("near"), F.col("n").alias("m")))
    both = pairs.select(F.explode(sides).alias("s")).select("s.*")
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), F.col("near"))).alias("b"))
    found = cut(words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(-F.col("b.m") >= times * F.col("n"), F.col("b")).alias("b")), words)
    ends = roots(found.where("b IS NOT NULL").select("word", F.col("b.near").alias("form")))
    return found.join(ends, "word", "left").select(
        "word", F.col("b.near").alias("form"), F.coalesce("root", "word").alias("root"), "n", "n_near", (-F.col("b.m")).alias("form_n")
    )
