"""SimHash near-duplicates through a covering family of bit masks.

Fingerprints are 64 majority bits over the XXH64 values of word shingles.  For a
radius r, bit i gets a nonzero vector phi(i) of r + 1 bits, and for every nonzero
v the mask of table v holds the bits with an odd overlap of phi(i) and v.  At most
r differing bits give r equations in r + 1 unknowns, so some table masks all of
them out: every pair within the radius shares a bucket of at least one table.

Inside the buckets no pairs are formed.  Two fingerprints differ in at most two
bits exactly if they share a centre, a value at most one bit away from both.  At
most 65 fingerprints share one centre, so the groups are small however large a
bucket is, the work is linear, and no verification is needed.

Two bits find copies and slight changes, but texts with a shingle similarity of 0.8
lie up to some 15 bits apart, where covering masks are no longer selective.
``keep_one`` therefore can add smallest-hash slots of the same shingles.  Texts of
different components that share a band of slots are first compared with one text of
the band by their exact shingle sets, which joins most groups at linear cost.  All
texts that still share a band with another component then meet in a prefix join over
their rarest shingles, which leaves out no similar pair among them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from fluoroframe.llm.common import drop_memo, filled, free_name
from fluoroframe.plans.cut import cut, forget
from fluoroframe.plans.graph import connected

BITS = 64
#: Bands of smallest-hash slots; a pair of similarity 0.8 shares none with a chance of (1 - 0.8^5)^32 < 0.00001.
BANDS, SLOTS = 32, 5
#: Comparisons with one text that share a copy of it.
MATES = 128
#: Turns over the bands before the prefix join; they save pairs there and decide nothing.
TURNS = 2


def fingerprint(text: str, shingle: int = 3, seed: int = 42) -> int:
    """Unsigned fingerprint of a text; 0 without words.

    Only A-Z are lower-cased and words end at space, tab, line feed, vertical tab,
    form feed and carriage return, which is what these methods of bytes do.
    """
    return _majority(_hashes(text, shingle, seed))


def _words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def _hashes(text: str, shingle: int, seed: int) -> np.ndarray:
    """XXH64 of every shingle, repeats included."""
    words = _words(text)
    if len(words) < shingle:
        parts = [b" ".join(words)] if words else []
    else:
        parts = map(b" ".join, zip(*[words[i:] for i in range(shingle)]))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(p, seed) for p in parts), dtype="<u8")


def _majority(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def bands(hashes: np.ndarray, seed: int = 42) -> list[int]:
    """One signed 64-bit value per band of smallest-hash slots; none without shingles."""
    if not len(hashes):
        return []
    random = np.random.default_rng(seed)
    factors = random.integers(0, 1 << 32, BANDS * SLOTS, dtype=np.uint32) | np.uint32(1)
    shifts = random.integers(0, 1 << 32, BANDS * SLOTS, dtype=np.uint32)
    low = np.full(BANDS * SLOTS, 0xFFFFFFFF, dtype=np.uint32)
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), 1024):
        np.minimum(low, (short[at : at + 1024, None] * factors + shifts).min(axis=0), out=low)
    rows = low.reshape(BANDS, SLOTS)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), seed) for r in rows], dtype=np.uint64).view(np.int64).tolist()


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of shingle hashes, each sorted without repeats; 1 for two empty ones."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def fingerprint_column(text: Column, shingle: int = 3, seed: int = 42) -> Column:
    """Fingerprints as signed 64-bit integers; null text counts as empty."""

    @F.pandas_udf("long")
    def prints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            values = np.fromiter((fingerprint(t, shingle, seed) for t in texts), dtype=np.uint64, count=len(texts))
            yield pd.Series(values.view(np.int64))

    return prints(filled(text))


def covering_masks(radius: int) -> list[int]:
    """Masks of the 2^(radius+1) - 1 tables as signed 64-bit integers."""
    vectors = (1 << (radius + 1)) - 1
    phi = [1 + i % vectors for i in range(BITS)]
    masks = [sum(1 << i for i in range(BITS) if bin(phi[i] & v).count("1") % 2) for v in range(1, vectors + 1)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def _bits() -> Column:
    return F.array(*[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(BITS)])


def links(prints: DataFrame, radius: int = 2, column: str = "fingerprint") -> DataFrame:
    """Links ``src, dst`` that connect the distinct fingerprints as all pairs within ``radius`` would.

    ``prints`` holds each fingerprint once.  ``radius`` is 1 or 2.
    """
    if radius not in (1, 2):
        raise ValueError("links needs a radius of 1 or 2")
    fp = prints.select(F.col(column).alias("f"))
    tables = F.array(*[F.struct(F.lit(i).alias("v"), F.lit(m).cast("long").alias("m")) for i, m in enumerate(covering_masks(radius))])
    keyed = fp.select("f", F.explode(tables).alias("t")).select("f", F.col("t.v").alias("v"), F.col("f").bitwiseAND(F.col("t.m")).alias("k"))
    shared = keyed.groupBy("v", "k").agg(F.min("f").alias("lo"), F.max("f").alias("hi")).where("lo <> hi").select("v", "k")
    mates = cut(keyed.join(shared, ["v", "k"], "left_semi").select("f").distinct())
    flipped = F.transform(_bits(), lambda b: F.col("f").bitwiseXOR(b))
    if radius == 1:
        near = mates.select("f", F.explode(flipped).alias("c"))
        return near.join(mates.select(F.col("f").alias("c")), "c").select(F.least("f", "c").alias("src"), F.greatest("f", "c").alias("dst")).distinct()
    centres = mates.select("f", F.explode(F.concat(F.array("f"), flipped)).alias("c"))
    stars = centres.groupBy("c").agg(F.collect_list("f").alias("fs")).where(F.size("fs") > 1)
    return stars.select(F.array_min("fs").alias("src"), F.explode("fs").alias("dst")).where("src <> dst").distinct()


def classes(prints: DataFrame, radius: int = 2) -> DataFrame:
    """``fingerprint, first`` -> ``fingerprint, component``: the smallest ``first`` that links reach."""
    roots = connected(links(prints, radius), []).select(F.col("node").alias("fingerprint"), "root")
    linked = prints.join(roots, "fingerprint")
    smallest = linked.groupBy("root").agg(F.min("first").alias("component"))
    merged = roots.join(smallest, "root").select("fingerprint", "component")
    return prints.join(merged, "fingerprint", "left").select("fingerprint", F.coalesce("component", "first").alias("component"))


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", radius: int = 2, shingle: int = 3
) -> DataFrame:
    """One row per row of ``docs``: id, ``fingerprint`` (16 hex digits) and ``component_id``.

    ``component_id`` is the smallest id in the component of the fingerprint, the own id included.  Null and empty
    texts have fingerprint zero and are linked like any other.  A null id keeps its row; it is never the smallest
    id, so a component of null ids alone has a null id.  Other columns are left behind.
    """
    marked = docs.select(
        F.col(f"`{id_column}`").alias("_id"), fingerprint_column(F.col(f"`{text_column}`"), shingle).alias("fingerprint")
    )
    marked = cut(marked)
    prints = cut(marked.groupBy("fingerprint").agg(F.min("_id").alias("first")))
    found = marked.join(classes(prints, radius), "fingerprint")
    return found.select(
        F.col("_id").alias(id_column),
        F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def _sketched(text: Column, shingle: int, seed: int = 42) -> Column:
    """``f`` (fingerprint), ``key`` (of the word sequence) and ``bands`` of each text."""

    @F.pandas_udf("f long, key binary, bands array<long>")
    def sketch(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        drop_memo()
        for texts in batches:
            hashes = [_hashes(t, shingle, seed) for t in texts]
            prints = np.fromiter(map(_majority, hashes), dtype=np.uint64, count=len(hashes)).view(np.int64)
            keys = [xxhash.xxh3_128_digest(b" ".join(_words(t))) for t in texts]
            yield pd.DataFrame({"f": prints, "key": keys, "bands": [bands(np.unique(h)) for h in hashes]})

    return sketch(filled(text))


def _similar(a: Column, b: Column, shingle: int, seed: int = 42) -> Column:
    @F.pandas_udf("double")
    def measured(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in batches:
            values, last, other = [], None, None
            for x, y in zip(left, right):
                if y != last:  # rows of one pivot often follow each other
                    last, other = y, np.unique(_hashes(y, shingle, seed))
                values.append(similarity(np.unique(_hashes(x, shingle, seed)), other))
            yield pd.Series(values, dtype=float)

    return measured(a, b)


def _shingles(text: Column, shingle: int, seed: int = 42) -> Column:
    @F.pandas_udf("array<long>")
    def distinct(texts: pd.Series) -> pd.Series:
        return pd.Series([np.unique(_hashes(t, shingle, seed)).view(np.int64) for t in texts], dtype=object)

    return distinct(text)


def _shared_bands(texts: DataFrame) -> DataFrame:
    """``key, component`` and ``mates`` (texts of the band) of a text for each of its bands that holds several components."""
    spread = texts.select("key", "component", F.posexplode("bands").alias("band", "slot"))
    several = spread.groupBy("band", "slot").agg(F.count("*").alias("mates"), F.min("component").alias("low"), F.max("component").alias("high"))
    return spread.join(several.where("low <> high").drop("low", "high"), ["band", "slot"])


def _close(texts: DataFrame, bodies: DataFrame, shingle: int, least: float, turn: int) -> DataFrame:
    """``src, dst``: components of ``texts`` (key, component, bands) that hold texts of at least that similarity.

    A text meets one text of each of its bands, never all others, so the work stays linear in a large band.  In turn 0
    that is the text with most mates in all its bands, which is the original of texts that only it is similar to; in
    later turns another one.  ``bodies`` (key, text) has the texts of bands with several components.
    """
    spread = cut(_shared_bands(texts))
    if turn:
        ranked = spread.withColumn("chance", F.xxhash64("key", F.lit(turn)))
    else:
        ranked = spread.join(spread.groupBy("key").agg(F.sum("mates").alias("chance")), "key")
    first = ranked.groupBy("band", "slot").agg(F.max(F.struct("chance", "component", "key")).alias("p"))
    first = first.select("band", "slot", F.col("p.component").alias("src"), F.col("p.key").alias("pivot"))
    met = spread.join(first, ["band", "slot"]).where("component <> src")
    pairs = cut(met.select("key", F.col("component").alias("dst"), "pivot", "src").distinct())
    # a pivot with many mates is laid out once per MATES of them
    forget(spread)
    copies = cut(pairs.groupBy("pivot").agg(F.ceil(F.count("*") / MATES).cast("int").alias("copies")))
    salted = pairs.join(copies, "pivot").withColumn("copy", F.pmod(F.xxhash64("key"), F.col("copies")).cast("int"))
    pivots = copies.join(bodies.withColumnRenamed("key", "pivot").withColumnRenamed("text", "other"), "pivot")
    pivots = pivots.select("pivot", "other", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    beside = salted.join(bodies, "key").join(pivots, ["pivot", "copy"])
    alike = beside.select("src", "dst", _similar(F.col("text"), F.col("other"), shingle).alias("s")).where(F.col("s") >= least)
    return cut(alike.select("src", "dst").distinct(), pairs, copies)


def _meet(sets: DataFrame, least: float) -> DataFrame:
    """``src, dst``: all components of ``sets`` (key, component, hashes) that hold texts of at least that similarity.

    Shingles are ordered by the number of texts that have them, those of one component alone before all others.  Two
    sets of ``n`` shingles and similarity ``least`` share one of the first n - least * n + 1 of each, and as the first
    one shared it leaves enough shingles behind it on both sides.
    """
    spread = sets.select("key", "component", F.size("hashes").alias("n"), F.explode("hashes").alias("h"))
    common = spread.groupBy("h").agg(F.count("*").alias("c"), F.min("component").alias("low"), F.max("component").alias("high"))
    met = spread.join(common.where("low <> high").select("h", "c"), "h")
    ordered = met.groupBy("key", "component", "n").agg(F.array_sort(F.collect_list(F.struct("c", "h"))).alias("o"))
    own = F.col("n") - F.size("o")  # shingles of its component alone, which come first
    length = F.col("n") - F.ceil(F.col("n") * least - 1e-9).cast("int") + 1 - own
    prefix = ordered.where(length > 0).select("key", "component", "n", own.alias("own"), F.posexplode(F.slice("o", F.lit(1), length)).alias("at", "x"))
    prefix = cut(prefix.select("key", "component", F.col("x.h").alias("h"), "n", (F.col("n") - F.col("own") - F.col("at") - 1).alias("rest")))
    other = prefix.select("h", *[F.col(c).alias(f"{c}2") for c in ("key", "component", "n", "rest")])
    enough = 1 + F.least("rest", "rest2") >= (F.col("n") + F.col("n2")) * (least / (1 + least)) - 1e-9
    pairs = prefix.join(other, "h").where((F.col("component") < F.col("component2")) & enough)
    pairs = cut(pairs.select("key", "component", "key2", "component2").distinct(), prefix)
    beside = pairs.join(sets.select("key", "hashes"), "key")
    beside = beside.join(sets.select(F.col("key").alias("key2"), F.col("hashes").alias("hashes2")), "key2")
    both = F.size(F.array_intersect("hashes", "hashes2"))
    alike = beside.where(both / (F.size("hashes") + F.size("hashes2") - both) >= least)
    return cut(alike.select(F.col("component").alias("src"), F.col("component2").alias("dst")).distinct(), pairs, sets)


def _merged(placed: DataFrame, marked: DataFrame, texts_of: DataFrame, shingle: int, least: float) -> DataFrame:
    """``placed`` (fingerprint, first, component) with the components of similar texts made one; ``marked`` has
    f, key, bands and place (a value of its own, so that copies of a text do not share a join key) of every row,
    ``texts_of`` place and text."""
    texts = marked.groupBy("key").agg(F.first("f").alias("fingerprint"), F.first("bands").alias("bands"), F.min("place").alias("place"))
    texts = cut(texts.join(placed.select("fingerprint", "component"), "fingerprint").select("key", "component", "bands", "place"))
    # only texts of shared bands can be joined; merging shares no further ones
    texts = cut(texts.join(_shared_bands(texts).select("key").distinct(), "key", "left_semi"), texts)
    bodies = cut(texts_of.join(texts.select("key", "place"), "place").dropDuplicates(["key"]).select("key", "text"))
    texts = cut(texts.select("key", "component", "bands"), texts)
    for turn in range(TURNS + 1):
        if turn < TURNS:
            found = _close(texts, bodies, shingle, least, turn)
        else:
            left = _shared_bands(texts).select("key", "component").distinct()
            sets = cut(left.join(bodies, "key").select("key", "component", _shingles(F.col("text"), shingle).alias("hashes")), bodies)
            found = _meet(sets, least)
        if found.limit(1).count():
            more = cut(connected(found, []).select(F.col("node").alias("component"), "root"))
            placed, texts = (
                cut(df.join(more, "component", "left").withColumn("component", F.coalesce("root", "component")).drop("root"), df) for df in (placed, texts)
            )
            forget(more)
        forget(found)
    forget(texts)
    return placed


def keep_one(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", radius: int = 2, shingle: int = 5, least: float | None = None
) -> DataFrame:
    """The rows of ``docs`` without near-duplicates, columns unchanged.

    Fingerprints within ``radius`` bits are linked, and, if ``least`` is given, so are all texts whose sets of word
    shingles have a similarity of ``least`` or more and that share bands with others.  Of each component the row with the smallest id stays (null ids last, then
    the smallest text hash); of rows equal in both one stays.  Null texts count as empty.  ``docs`` is read
    several times and has to give the same rows, as a table does.
    """
    order = free_name(docs, "_order")
    rank = F.struct(
        F.col(f"`{id_column}`").isNull().alias("a"), F.col(f"`{id_column}`").alias("b"), F.xxhash64(filled(text_column)).alias("c")
    )
    # sketches only; texts are read again where they are compared, and never written
    sketched = docs.select(rank.alias("place"), _sketched(F.col(f"`{text_column}`"), shingle).alias("m"))
    marked = cut(sketched.select("place", *(["m.*"] if least is not None else ["m.f"])))
    prints = cut(marked.groupBy(F.col("f").alias("fingerprint")).agg(F.min("place").alias("first")))
    near = connected(links(prints, radius), []).select(F.col("node").alias("fingerprint"), "root")
    placed = prints.join(near, "fingerprint", "left").select("fingerprint", "first", F.coalesce("root", "fingerprint").alias("component"))
    placed = cut(placed, prints)
    if least is not None:
        placed = _merged(placed, marked, docs.select(rank.alias("place"), filled(text_column).alias("text")), shingle, least)
    forget(marked)
    groups = placed.groupBy("component").agg(F.min("first").alias(order))
    # a chosen row carries the smallest order value of its component, so the join key is spread
    kept = docs.withColumn(order, rank).join(groups.select(f"`{order}`"), order, "left_semi")
    return kept.dropDuplicates([order]).select(*[f"`{c}`" for c in docs.columns])
