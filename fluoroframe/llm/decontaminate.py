"""Benchmark decontamination by canonical templates.

Everything is DataFrame functions.  Words of a text become template words: numbers,
names (capitalised within a sentence) and units (after a number) turn into typed
placeholders, all else into lower case.  A capitalised word at the beginning of a
sentence can be either, so windows with one are taken in both readings.  Hashes of overlapping template windows of
the benchmark meet those of the documents in a hash join; the share of an item's
windows that a document holds is its coverage.  Where an item has placeholders, its
values are laid beside the document's: the same value must have been replaced by
the same value everywhere, as it is in a question with other parameters.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from fluoroframe.llm.common import filled, free_name, once
from fluoroframe.plans.cut import cut

WINDOW = 8
COVERAGE = 0.5
#: Windows of the benchmark up to this many are sent to every task; beyond, both sides are shuffled by hash.
BROADCAST_WINDOWS = 1_000_000

# Units that follow numbers.
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons "
    "ml l liter liters litre litres gallon gallons ms s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "meter meters metre metres kilometer kilometers percent degree degrees dollar dollars cent cents euro euros mph kmh kph w kw v hz khz mhz ghz kb mb gb tb"
).split()

_TOKEN = r"(\p{N}+(?:[.,:/]\p{N}+)*|[\p{L}\p{M}]+(?:['’][\p{L}\p{M}]+)*|[.!?\n])"
_MARKS = (".", "!", "?", "\n")
# Kinds of tokens.
_PLAIN, _NUMBER, _MARK, _CAPITALS, _CAPITAL = range(5)


def _canonical(rows: DataFrame, text: str) -> DataFrame:
    """Adds ``_c`` (hash of every template word), ``_v`` (hash of the value in each slot, null elsewhere), and both with
    capitalised words at the beginning of a sentence read as names: ``_nc`` and ``_nv``."""
    tokens = once(rows, "_t", F.regexp_extract_all(F.col(text), F.lit(_TOKEN), F.lit(1)))

    def kind(t: Column) -> Column:
        """By the first character, cheapest test first, as expressions inside arrays are worked out node by node."""
        first = F.substring(t, 1, 1)
        return (
            F.when((t >= "a") & (t < "{"), _PLAIN).when((t >= "0") & (t < ":"), _NUMBER).when(t.isin(*_MARKS), _MARK)
            .when(first == F.lower(first), _PLAIN).when(t == F.upper(t), _CAPITALS).otherwise(_CAPITAL)
        )

    # Plain arrays beside each other, as an array of structs is far dearer to write.  A word as it is and the value in a
    # slot are the same hash.
    read = F.struct(F.transform("_t", kind).alias("_k"), F.transform("_t", lambda t: F.xxhash64(F.lower(t))).alias("_h"))
    read = once(tokens, "_r", read).drop("_t").select("*", "_r.*").drop("_r")
    number, name, unit = (F.xxhash64(F.lit(p)) for p in ("#number", "#name", "#unit"))
    units = [F.xxhash64(F.lit(u)) for u in UNITS]

    def placeholder(k: Column, i: Column) -> Column:
        prior = F.get("_k", i - 1)
        return (
            F.when(k == _PLAIN, F.when((prior == _NUMBER) & F.get("_h", i).isin(*units), unit))
            .when(k == _NUMBER, number).when((k == _CAPITAL) & (prior != _MARK), name)
        )

    formed = once(read, "_p", F.transform("_k", placeholder))
    words = lambda x, i: F.get("_k", i) != _MARK
    led = lambda i: F.get("_k", i) == _CAPITAL  # at the beginning of a sentence, where there is no placeholder
    slot = lambda i: F.get("_h", i)
    both = F.struct(
        F.filter(F.transform("_p", lambda p, i: F.coalesce(p, slot(i))), words).alias("_c"),
        F.filter(F.transform("_p", lambda p, i: F.when(p.isNotNull(), slot(i))), words).alias("_v"),
        F.filter(F.transform("_p", lambda p, i: F.coalesce(p, F.when(led(i), name), slot(i))), words).alias("_nc"),
        F.filter(F.transform("_p", lambda p, i: F.when(p.isNotNull() | led(i), slot(i))), words).alias("_nv"),
    )
    return once(formed, "_b", both).select("*", "_b.*").drop("_b", "_p", "_k", "_h", text)


def _windows(length: int, words: str = "_c") -> Column:
    one = lambda i: F.xxhash64(F.lit(length), *[F.element_at(words, i + j) for j in range(length)])
    count = F.size("_c") - (length - 1)
    return F.when(count > 0, F.transform(F.sequence(F.lit(1), count), one)).otherwise(F.array().cast("array<long>"))


def _laid(rows: DataFrame, name: str, lengths: list[int], words: str = "_c") -> DataFrame:
    """Adds the windows of each length, one length after the other; those of ``WINDOW`` words are hashes of two halves, halved again."""
    def joined(parts: str, step: int) -> Column:
        return F.transform(parts, lambda h, i: F.xxhash64(h, F.get(parts, i + step)))

    temp, last = [], words
    if WINDOW in lengths:
        for step in (1, 2, 4):
            temp.append(f"{name}{step}")
            rows = once(rows, temp[-1], joined(last, step))
            last = temp[-1]
    whole = F.slice(last, 1, F.greatest(F.size("_c") - (WINDOW - 1), F.lit(0)))
    return once(rows, name, F.concat(*[whole if n == WINDOW else _windows(n, words) for n in lengths])).drop(*temp)


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id",
    item_text_column: str = "text", coverage: float = COVERAGE,
) -> DataFrame:
    """Per document and benchmark item found in it: id, ``_hash`` of the text, item, ``coverage``, ``slots``
    (placeholders of the item) and ``consistent``.

    Items are found by their template, and each item of a template is judged by its own values and stands under its own
    id, those with equal values under the smallest; of several texts under one id, and of several places in a document,
    a consistent one counts.  An item shorter than a window is one window of its own length; items without words, null and
    empty texts match nothing.  Rows with the same id and text count as one; null ids keep their rows.  Other columns are
    left behind.
    """
    items = benchmark.select(F.col(f"`{item_column}`").alias("_item"), filled(item_text_column).alias("_text"))
    items = _canonical(items, "_text").where(F.size("_c") > 0)
    # a word at the beginning of a sentence is a slot if it is a name elsewhere in the item
    slots = F.zip_with("_v", "_nv", lambda v, n: F.coalesce(v, F.when(F.array_contains(F.array_compact("_v"), n), n)))
    items = items.withColumn("_v", slots).drop("_nv")
    items = items.withColumn("_key", F.md5(F.array_join(F.concat("_c", "_nc").cast("array<string>"), " ").cast("binary")))
    members = cut(items.groupBy("_key", "_c", "_nc", "_v").agg(F.min("_item").alias("_item")))
    items = cut(members.select("_key", "_c", "_nc", F.least(F.size("_c"), F.lit(WINDOW)).alias("_n")).dropDuplicates(["_key"]))
    lengths = [r["_n"] for r in items.select("_n").distinct().orderBy("_n").collect()]  # at most WINDOW numbers
    kind = dict(members.dtypes)["_item"]
    keyed = docs.select(F.col(f"`{id_column}`").alias("_id"), filled(text_column).alias("_text"))
    keyed = keyed.withColumn("_hash", F.xxhash64("_text"))
    words = _canonical(keyed, "_text")
    if not lengths:
        empty = keyed.where("false")
        return empty.select(F.col("_id").alias(id_column), "_hash", F.lit(None).cast(kind).alias(item_column), F.lit(0.0).alias("coverage"), F.lit(0).alias("slots"), F.lit(True).alias("consistent"))
    item_windows = reduce(
        DataFrame.unionByName,
        [
            _laid(_laid(items.where(F.col("_n") == n), "_wa", [n]), "_wb", [n], "_nc").select("_key", "_n", F.posexplode_outer(F.arrays_zip(F.col("_wa").alias("a"), F.col("_wb").alias("b"))).alias("_at", "_both"))
            for n in lengths
        ],
    )
    item_windows = cut(item_windows.select("_key", "_n", "_at", F.explode(F.array_distinct(F.array("_both.a", "_both.b"))).alias("_w")))
    totals = item_windows.groupBy("_key").agg(F.countDistinct("_at").alias("_total"))
    # both readings of each window, one after the other; the second is null where it is the first
    words = _laid(_laid(words, "_wa", lengths), "_wb", lengths, "_nc")
    second = F.zip_with("_wb", "_wa", lambda b, a: F.when(a != b, b))
    words = once(words, "_all", F.concat(F.col("_wa"), second))
    # numbers before the windows are laid out, so that no row of a window carries the words of its text
    words = once(words, "_many", F.struct(F.size("_c").alias("c"), F.size("_wa").alias("w"))).select("_id", "_hash", "_many", "_all")
    doc_windows = words.select("_id", "_hash", "_many", F.posexplode_outer("_all").alias("_pos", "_w")).where("_w is not null")
    doc_windows = doc_windows.select("_id", "_hash", F.col("_many.c").alias("_size"), (F.col("_pos") % F.col("_many.w")).alias("_pos"), "_w")
    small = item_windows.count() <= BROADCAST_WINDOWS
    hits = doc_windows.join(F.broadcast(item_windows) if small else item_windows, "_w")
    # the windows of each length follow those of the shorter lengths
    skipped = [F.when(F.col("_n") > n, F.greatest(F.col("_size") - (n - 1), F.lit(0))).otherwise(0) for n in lengths]
    hits = hits.withColumn("_pos", F.col("_pos") - reduce(lambda a, b: a + b, skipped))
    hits = cut(hits.select("_id", "_hash", "_key", "_at", (F.col("_pos") - F.col("_at")).alias("_shift")).distinct())
    totals = F.broadcast(totals) if small else totals

    def covered(parts: DataFrame, *place: str) -> DataFrame:
        # partial sums per place first: a passage that many documents share stays a few rows of each document
        by_word = parts.groupBy("_id", "_hash", "_key", *place, "_at").agg(F.min("_shift").alias("_shift"))
        by_place = by_word.groupBy("_id", "_hash", "_key", *place).agg(F.count("*").alias("_got"), F.mode("_shift", True).alias("_shift"))
        shares = by_place.join(totals, "_key").withColumn("coverage", F.col("_got") / F.col("_total"))
        return cut(shares.where(F.col("coverage") >= coverage).select("_id", "_hash", "_key", "coverage", "_shift"))

    held = covered(hits)

    # slots: only pairs that are left meet their texts and items again
    slotted = items.join(members.where(F.exists("_v", lambda v: v.isNotNull())).select("_key"), "_key", "left_semi").select("_key", "_c", "_nc")
    # every place that holds enough is judged: each shift, and stretches of the length of the item, which overlap by half,
    # as words put in or left out change the shift
    length = F.size("_c")
    stretches = F.array(
        F.struct(F.lit(0).alias("g"), F.col("_shift").cast("long").alias("b")),
        F.struct(F.lit(1).alias("g"), F.floor(F.col("_shift") / length).alias("b")),
        F.struct(F.lit(2).alias("g"), F.floor(F.col("_shift") / length + 0.5).alias("b")),
    )
    parts = hits.join(slotted, "_key").select("_id", "_hash", "_key", "_at", "_shift", F.explode(stretches).alias("_place"))
    shifts = held.unionByName(covered(parts, "_place")).select("_id", "_hash", "_key", "_shift").distinct()
    pairs = shifts.join(slotted, "_key")
    # written first, so that Spark knows the size of the keys when it picks the join that meets the texts
    keys = held.join(slotted, "_key", "left_semi").select(F.col("_id").alias("_kid"), F.col("_hash").alias("_khash")).distinct()
    left = keyed.join(cut(keys), F.col("_id").eqNullSafe(F.col("_kid")) & (F.col("_hash") == F.col("_khash")), "left_semi")
    doc_words = _canonical(left.dropDuplicates(["_id", "_hash"]), "_text").select(
        F.col("_id").alias("_did"), F.col("_hash").alias("_dhash"), F.col("_c").alias("_dc"), F.col("_nc").alias("_dnc"), F.col("_nv").alias("_dv")
    )
    beside = doc_words.join(pairs, F.col("_id").eqNullSafe(F.col("_did")) & (F.col("_hash") == F.col("_dhash")))

    def laid(c: Column, i: Column) -> Column:
        at = F.col("_shift") + i + 1
        inside = (at > 0) & (at <= F.size("_dc"))
        there = F.greatest(F.least(at, F.size("_dc")), F.lit(1)).cast("int")
        equal = (F.element_at("_dc", there) == c) | (F.element_at("_dnc", there) == F.element_at("_nc", i + 1))
        return F.when(inside & equal, F.element_at("_dv", there))

    # values of the document at the words of the template, so that no whole text meets the items of the template
    places = cut(beside.select("_id", "_hash", "_key", F.transform("_c", laid).alias("_d")).distinct())
    values = members.where(F.exists("_v", lambda v: v.isNotNull())).select("_key", "_v").distinct()
    both = F.zip_with("_v", "_d", lambda v, d: F.when(v.isNotNull() & d.isNotNull(), F.struct(v.alias("a"), d.alias("b"))))
    judged = places.join(values, "_key").withColumn("_p", F.array_distinct(F.filter(both, lambda p: p.isNotNull())))
    judged = judged.withColumn("_same", F.size("_p") == F.size(F.array_distinct(F.transform("_p", lambda p: p["a"]))))
    judged = judged.groupBy("_id", "_hash", "_key", "_v").agg(F.max("_same").alias("_same"))
    judged = judged.withColumnsRenamed({"_id": "_jid", "_hash": "_jhash", "_key": "_jkey", "_v": "_jv"})
    found = held.join(members.select("_key", "_item", "_v"), "_key")
    on = F.col("_id").eqNullSafe(F.col("_jid")) & (F.col("_hash") == F.col("_jhash")) & (F.col("_key") == F.col("_jkey")) & (F.col("_v") == F.col("_jv"))
    slots = F.size(F.filter("_v", lambda v: v.isNotNull()))
    best = F.max(F.struct(F.coalesce("_same", F.lit(True)).alias("consistent"), "coverage", slots.alias("slots")))
    return found.join(judged, on, "left").groupBy("_id", "_hash", "_item").agg(best.alias("_best")).select(
        F.col("_id").alias(id_column), "_hash", F.col("_item").alias(item_column), "_best.coverage", "_best.slots", "_best.consistent",
    )


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options: object) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item with consistent slots, columns unchanged."""
    leaks = find_leaks(docs, benchmark, id_column, text_column, **options).where("consistent")
    leaks = cut(leaks.select(F.col(f"`{id_column}`").alias("_leak_id"), F.col("_hash").alias("_leak_hash")).distinct())
    mark = free_name(docs, "_hash")
    marked = docs.withColumn(mark, F.xxhash64(filled(text_column)))
    same = F.col(f"`{id_column}`").eqNullSafe(F.col("_leak_id")) & (F.col(mark) == F.col("_leak_hash"))
    return marked.join(leaks, same, "left_anti").drop(mark)
