"""Prefix trie of conversations, finished shard by shard.

A turn is a digest of 16 bytes, a conversation the string of its digests, and a node of the trie a beginning of such
strings.  In the order of these strings the members of a node follow each other.  Splitters cut the order into shards;
only a node that is a beginning of a splitter can lie in two shards, and these nodes are the skeleton.  The splitters
and the trie they form (for two neighbours, how many turns they share) go to every task.  A task reads its shard in
order, keeps the nodes on the way to the row it reads, and finishes each other node as it leaves it.  Of a skeleton
node it gives partial sums, and the sums of all shards are added and rolled up along the skeleton.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from fluoroframe.llm.common import filled
from fluoroframe.plans.cut import cut

WIDTH = 16
#: Turns of a splitter; longer beginnings are never cut, so the skeleton has at most this many nodes per splitter.
SPLITTER_TURNS = 256
#: Rows that the splitters are chosen from, per shard, and most shards.
SAMPLE, MOST_SHARDS = 24, 512
#: Bytes of member ids in one partial row.
ENDS_BYTES = 1 << 20
NODE = "node_shard int, node_depth int, parent_shard int, parent_depth int, conv_id long, depth long, parent_conv_id long, n_convs long"
PART = NODE + ", n_children long, n_leaves long, saved_tokens long, words long, ends_sha256 string, shard int, piece long, ends string"


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def paths(turns: DataFrame, block: int = 20, most_shared: int = 4) -> DataFrame:
    """``conv_id, path, words``: each conversation rebuilt, its digests in a row and the words of each turn.

    The first h turns, h = crc32 of the id modulo ``most_shared``, are those of the first conversation of its block
    (``conv_id - conv_id % block``; all if it has fewer, none if it is absent), and its own follow after its first h.
    Turns are in order of ``turn``, null first, then of their digests; null roles and texts are empty; rows without
    ``conv_id`` take no part.  A conversation gathers digests and counts only, never texts.
    """
    role, text = filled("role"), filled("text")
    digest = F.substring(F.sha2(F.encode(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), "UTF-8"), 256), 1, 2 * WIDTH)
    said = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").alias("t"), digest.alias("k"), word_count(text).alias("w")).alias("x"))
    own = said.groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("own"))
    own = own.withColumn("h", (F.crc32(F.col("conv_id").cast("string")) % most_shared).cast("int"))
    heads = own.where(F.col("conv_id") % block == 0).select(F.col("conv_id").alias("base"), F.slice("own", 1, most_shared - 1).alias("head"))
    both = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % block).join(heads, "base", "left")
    none = F.slice("own", 1, F.lit(0))
    kept = F.concat(F.coalesce(F.slice("head", F.lit(1), F.col("h")), none), F.slice("own", F.col("h") + 1, F.greatest(F.size("own") - F.col("h"), F.lit(0))))
    rebuilt = both.select("conv_id", kept.alias("own"))
    return rebuilt.select("conv_id", F.unhex(F.array_join(F.transform("own", lambda x: x["k"]), "")).alias("path"), F.transform("own", lambda x: x["w"]).alias("words"))


def choose_splitters(ordered: DataFrame, shards: int) -> list[tuple[bytes, int]]:
    """At most ``shards - 1`` splitters (path, conv_id) from the rows with the smallest id hashes.

    A path of more than ``SPLITTER_TURNS`` turns is cut to them, and everything with that beginning is then right of
    the splitter.
    """
    size = SPLITTER_TURNS * WIDTH
    rows = ordered.select(F.col("path").substr(1, size).alias("p"), F.when(F.octet_length("path") <= size, F.col("conv_id")).alias("c"), F.xxhash64("conv_id").alias("o"))
    found = sorted((bytes(r.p), -(1 << 63) if r.c is None else r.c) for r in rows.orderBy("o", "c").limit(shards * SAMPLE).collect())
    return sorted({found[len(found) * i // shards] for i in range(1, shards)}) if found else []


def shared_turns(a: bytes, b: bytes) -> int:
    """Turns at the beginning of both paths."""
    size = min(len(a), len(b)) // WIDTH
    low = 0
    while low < size:  # the largest number of turns that agree, by halving
        middle = (low + size + 1) // 2
        low, size = (middle, size) if a[low * WIDTH : middle * WIDTH] == b[low * WIDTH : middle * WIDTH] else (low, middle - 1)
    return low


class Skeleton:
    """The trie of the splitters; a node is named by the first splitter that begins with it and by its depth."""

    def __init__(self, splitters: list[tuple[bytes, int]]) -> None:
        self.splitters = splitters
        self.paths = [p for p, _ in splitters]
        self.shared = [0] + [shared_turns(a, b) for a, b in zip(self.paths, self.paths[1:])]
        self.first: list[list[int]] = []  # per splitter and depth
        for i, (path, shared) in enumerate(zip(self.paths, self.shared)):
            above = self.first[-1][: shared + 1] if i else []
            self.first.append(above + [i] * (len(path) // WIDTH + 1 - len(above)))

    def shard(self, path: bytes, conv_id: int) -> int:
        return bisect_right(self.splitters, (path, conv_id))

    def way(self, path: bytes, shard: int) -> list[int]:
        """Names (first splitters) of the skeleton nodes on a path of that shard, from the root on."""
        ways = [self.first[i][: shared_turns(path, self.paths[i]) + 1] for i in (shard - 1, shard) if 0 <= i < len(self.paths)]
        return max(ways, key=len, default=[0])


    def names(self, first: int, depth: int) -> list[int]:
        """Names of a skeleton node and the nodes above it, from the root on."""
        return self.first[first][: depth + 1] if self.first else [0]


class _Open:
    """A node on the way to the current row."""

    __slots__ = ("name", "depth", "words", "least", "convs", "children", "leaves", "saved", "last", "hash", "ends", "size", "rows", "pieces")

    def __init__(self, name: int | None, depth: int, words: int) -> None:
        self.name, self.depth, self.words = name, depth, words
        self.least, self.convs, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.hash, self.ends, self.size, self.pieces = None, [], 0, 0
        self.rows: list[list] = []  # finished nodes below that wait for the id of their parent

    def end(self, conv_id: int) -> None:
        word = f"{conv_id}" if self.hash is None else f",{conv_id}"
        self.hash = self.hash or hashlib.sha256()
        if self.name is None:
            self.hash.update(word.encode())
        else:
            self.ends.append(str(conv_id))
            self.size += len(word)


def _walk(rows: Iterator[tuple[int, bytes, list[int], int]], skeleton: Skeleton) -> Iterator[list]:
    """Rows of ``PART`` for the rows (conv_id, path, words, shard) of whole shards in order."""
    way: list[_Open] = []
    last, here = b"", -1

    def ends(node: _Open) -> list:
        row = [node.name, node.depth] + [None] * 6 + [0, 0, 0, node.words, None, here, node.pieces, ",".join(node.ends)]
        node.ends, node.size, node.pieces = [], 0, node.pieces + 1
        return row

    def leave(depth: int) -> Iterator[list]:
        """Close the nodes deeper than that."""
        while len(way) > depth + 1:
            node = way.pop()
            above = way[-1] if way else None
            if node.name is not None:  # part of a skeleton node
                if node.ends:
                    yield ends(node)
                up = (above.name, above.depth) if above else (None, None)
                yield [node.name, node.depth, *up, node.least, node.depth, None, node.convs, node.children, node.leaves, node.saved, node.words, None, None, None, None]
                if above:
                    _meet(above, node)
                continue
            node.leaves = node.leaves or 1
            node.saved += (node.convs - 1) * node.words
            digest = (node.hash or hashlib.sha256()).hexdigest()
            row = [None, None, None, None, node.least, node.depth, None, node.convs, node.children, node.leaves, node.saved, node.words, digest, None, None, None]
            for below in node.rows:
                if below[6] is None:
                    below[6] = node.least
            _meet(above, node)
            above.children += 1
            above.leaves += node.leaves
            above.saved += node.saved
            if above.name is None:
                above.rows += [row]
                yield from node.rows
            else:
                row[2], row[3] = above.name, above.depth
                yield row
                yield from node.rows

    def _meet(above: _Open, node: _Open) -> None:
        above.convs += node.convs
        above.least = node.least if above.least is None else min(above.least, node.least)

    for conv_id, path, words, shard in rows:
        if shard != here:
            yield from leave(-1)
            last, here = b"", shard
        shared = shared_turns(path, last)
        yield from leave(shared if way else -1)
        if len(way) <= len(path) // WIDTH:
            names = skeleton.way(path, shard)
            for depth in range(len(way), len(path) // WIDTH + 1):
                way.append(_Open(names[depth] if depth < len(names) else None, depth, words[depth - 1] if depth else 0))
        node = way[-1]
        node.convs += 1
        node.least = conv_id if node.least is None else min(node.least, conv_id)
        node.end(conv_id)
        if node.size > ENDS_BYTES:
            yield ends(node)
        last = path
    yield from leave(-1)


def _frames(rows: Iterator[list]) -> Iterator[pd.DataFrame]:
    kinds = [(f.split(" ")[0], object if f.endswith("string") else "Int64") for f in PART.split(", ")]
    frame = lambda out: pd.DataFrame({name: pd.array(column, dtype=kind) for (name, kind), column in zip(kinds, zip(*out))})
    out: list[list] = []
    for row in rows:
        out.append(row)
        if len(out) == 8192 or row[-1]:
            yield frame(out)
            out = []
    if out:
        yield frame(out)


def _digest_ends(pieces: DataFrame) -> DataFrame:
    """``node_shard, node_depth, ends_sha256`` from the member ids of skeleton nodes, piece after piece."""

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for batch in batches:
            for row in batch.itertuples(index=False):
                if (row.node_shard, row.node_depth) != key:
                    if key is not None:
                        yield pd.DataFrame([(*key, state.hexdigest())], columns=["node_shard", "node_depth", "ends_sha256"])
                    key, state = (row.node_shard, row.node_depth), hashlib.sha256(row.ends.encode())
                else:
                    state.update(b"," + row.ends.encode())
        if key is not None:
            yield pd.DataFrame([(*key, state.hexdigest())], columns=["node_shard", "node_depth", "ends_sha256"])

    whole = pieces.select("node_shard", "node_depth", "shard", "piece", "ends")
    dealt = whole.repartition("node_shard", "node_depth").sortWithinPartitions("node_shard", "node_depth", "shard", "piece")
    return dealt.mapInPandas(digests, "node_shard int, node_depth int, ends_sha256 string")


def prefix_trie(turns: DataFrame, shards: int | None = None) -> DataFrame:
    """One row per node of the trie of the rebuilt conversations of ``turns`` (conv_id, turn, role, text).

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens``, ``ends_sha256``; see ``paths`` for how conversations are rebuilt and what nulls and ties mean.
    An empty table has no node; other columns are left behind.  The digests of one conversation are one row; equal
    conversations, however many, are spread over shards by their ids.
    """
    spark = turns.sparkSession
    rows = cut(paths(turns.select("conv_id", "turn", "role", "text")))
    if shards is None:
        shards = min(MOST_SHARDS, 2 * int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    skeleton = Skeleton(choose_splitters(rows, shards))
    sent = spark.sparkContext.broadcast(skeleton)  # fewer than MOST_SHARDS paths of SPLITTER_TURNS turns

    @F.pandas_udf("int")
    def shard_of(path: pd.Series, conv_id: pd.Series) -> pd.Series:
        return pd.Series([sent.value.shard(bytes(p), c) for p, c in zip(path, conv_id)], dtype="int32")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream = ((int(c), bytes(p), w, int(s)) for b in batches for c, p, w, s in zip(b["conv_id"], b["path"], b["words"], b["shard"]))
        return _frames(_walk(stream, sent.value))

    dealt = rows.withColumn("shard", shard_of("path", "conv_id")).repartition("shard").sortWithinPartitions("shard", "path", "conv_id")
    found = cut(dealt.select("conv_id", "path", "words", "shard").mapInPandas(walk, PART), rows)
    return _finish(found, sent)


def _finish(found: DataFrame, sent: Broadcast) -> DataFrame:
    """Nodes of ``prefix_trie`` from the rows of the shards."""
    name = ["node_shard", "node_depth"]
    parts = found.where("node_shard IS NOT NULL AND n_convs IS NOT NULL")
    sums = parts.groupBy(*name).agg(
        F.first("parent_shard").alias("parent_shard"), F.first("parent_depth").alias("parent_depth"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"),
        F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"), F.first("words").alias("words"),
    )
    below = sums.groupBy(F.col("parent_shard").alias("node_shard"), F.col("parent_depth").alias("node_depth")).agg(F.count("*").alias("more"))
    sums = cut(sums.join(below, name, "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0))).drop("more"))

    @F.pandas_udf("array<int>")
    def above(first: pd.Series, depth: pd.Series) -> pd.Series:
        return pd.Series([sent.value.names(f, d) for f, d in zip(first, depth)])

    # a node of the skeleton adds what it found outside the skeleton to every node above it
    leaves = F.col("n_leaves") + F.when(F.col("n_children") == 0, 1).otherwise(0)
    saved = F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("words")
    told = sums.select(leaves.alias("l"), saved.alias("s"), F.posexplode(above("node_shard", "node_depth")).alias("node_depth", "node_shard"))
    totals = told.groupBy(*name).agg(F.sum("l").alias("n_leaves"), F.sum("s").alias("saved_tokens"))
    ends = _digest_ends(found.where("ends IS NOT NULL"))
    ids = sums.select(F.col("node_shard").alias("parent_shard"), F.col("node_depth").alias("parent_depth"), F.col("conv_id").alias("id"))
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    named = sums.drop("n_leaves", "saved_tokens").join(totals, name).join(ends, name, "left").join(ids, ["parent_shard", "parent_depth"], "left")
    named = named.withColumns({"depth": F.col("node_depth").cast("long"), "parent_conv_id": F.col("id"), "ends_sha256": F.coalesce("ends_sha256", F.sha2(F.lit(""), 256))})
    # the skeleton has fewer than MOST_SHARDS * (SPLITTER_TURNS + 1) nodes
    plain = found.where("node_shard IS NULL").join(F.broadcast(ids), ["parent_shard", "parent_depth"], "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "id"))
    return plain.select(*out).unionByName(named.select(*out))
