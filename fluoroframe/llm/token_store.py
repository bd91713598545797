"""Token ids of documents in word-aligned blocks.

A store is a folder of Parquet rows, one row per block of whole documents in
ascending id order.  The ids of a block are packed into 64-bit words: a 4-bit
selector says how many ids of how many bits follow in the other 60 bits.  An id
of more than 60 bits is an escape: a word with the escape selector, then the id
as a word of its own.  A block carries the lengths of its documents, so a reader
decodes any block alone, with array operations and without a loop over ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from fluoroframe.llm.common import filled, worker_memo

# Bits of an id by selector; 60 // bits ids share a word.  Selector 15 is the escape.
WIDTHS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 16, 20, 30, 60)
ESCAPE = 15
BLOCK_IDS = 1 << 18
#: Most chunks of text whose ids a worker remembers.
CACHE_CHUNKS = 1_000_000
#: Texts cut and gathered at a time.
ROWS = 1024
SCHEMA = "shard int, block long, before long, n_ids long, doc_ids array<long>, lengths array<long>, words binary"


_LIMITS = np.array([(1 << w) - 1 for w in WIDTHS], dtype=np.uint64)
_SMALL = np.searchsorted(_LIMITS, np.arange(1 << 17, dtype=np.uint64)).astype(np.uint8)


def _needs(ids: np.ndarray) -> np.ndarray:
    """Smallest selector that an id fits into; ESCAPE if none."""
    if len(ids) and int(ids.max()) < len(_SMALL):
        return _SMALL[ids.astype(np.int64)]
    return np.searchsorted(_LIMITS, ids).astype(np.uint8)


def pack(ids: np.ndarray) -> bytes:
    """Ids (unsigned, up to 64 bits) as little-endian words; each word takes as many ids as fit."""
    ids = np.asarray(ids, dtype=np.uint64)
    total = len(ids)
    if not total:
        return b""
    need = _needs(ids)
    best = np.full(total, ESCAPE, dtype=np.uint8)
    most = np.concatenate([need, np.zeros(60, dtype=np.uint8)])  # after the last id anything fits
    spans = {1: most}  # by n: the largest need among n ids from each place on

    def span(n: int) -> np.ndarray:
        if n not in spans:
            half = 1 << (n - 1).bit_length() - 1
            a, b = span(half), span(n - half)
            out = a.copy()
            np.maximum(a[: len(a) - half], b[half:], out=out[: len(a) - half])
            spans[n] = out
        return spans[n]

    for s in reversed(range(len(WIDTHS))):
        np.copyto(best, s, where=span(60 // WIDTHS[s])[:total] <= s)
    step = np.array([60 // w for w in WIDTHS] + [1])[best].tolist()
    starts, at = [], 0
    push = starts.append
    while at < total:
        push(at)
        at += step[at]
    starts = np.array(starts)
    selectors = best[starts]
    places = np.arange(len(starts)) + np.concatenate([[0], np.cumsum(selectors == ESCAPE)[:-1]])
    words = np.zeros(len(starts) + int((selectors == ESCAPE).sum()), dtype="<u8")
    padded = np.concatenate([ids, np.zeros(60, dtype=np.uint64)])
    for s in np.unique(selectors):
        at = starts[selectors == s]
        where = places[selectors == s]
        if s == ESCAPE:
            words[where] = np.uint64(ESCAPE << 60)
            words[where + 1] = ids[at]
            continue
        width = WIDTHS[s]
        word = np.full(len(at), int(s) << 60, dtype=np.uint64)
        for j in range(60 // width):
            word |= padded[at + j] << np.uint64(j * width)
        words[where] = word
    return words.tobytes()


def unpack(data: bytes, total: int) -> np.ndarray:
    """The ``total`` ids of ``pack``."""
    words = np.frombuffer(data, dtype="<u8")
    if not total:
        return np.zeros(0, dtype=np.uint64)
    selectors = (words >> np.uint64(60)).astype(np.int64)
    heads = np.ones(len(words), dtype=bool)
    at = 0
    for e in np.nonzero(selectors == ESCAPE)[0]:  # escapes are rare; the word after one is an id
        if e >= at:
            heads[e + 1] = False
            at = e + 2
    where = np.nonzero(heads)[0]
    kinds = selectors[where]
    counts = np.array([60 // w for w in WIDTHS] + [1])[kinds]
    ends = np.cumsum(counts)
    out = np.zeros(int(ends[-1]), dtype=np.uint64)
    for s in np.unique(kinds):
        mine = kinds == s
        first = (ends - counts)[mine]
        if s == ESCAPE:
            out[first] = words[where[mine] + 1]
            continue
        width = WIDTHS[s]
        mask = np.uint64((1 << width) - 1)
        for j in range(60 // width):
            out[first + j] = (words[where[mine]] >> np.uint64(j * width)) & mask
    return out[:total]


class ByteLevelEncoder:
    """Ids of texts from a byte-level tokenizer file of the tokenizers library.

    Such a tokenizer never joins across a space or line end between two visible
    characters, nor a letter with a last comma or full stop.  Texts are cut there, and
    the ids of each different chunk are remembered in one array; a text gathers the
    spans of its chunks.  Texts with other runs of white space, or with the brackets of
    special tokens, hold an odd chunk and go to the library whole.
    """

    # white space next to a cut, the brackets of special tokens, wide or rare white space
    _odd = "^ ?([\t\v\f\r]|$)|[\t\v\f\r]$|<\\||[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

    def __init__(self, path: str, cache_chunks: int = CACHE_CHUNKS) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.most = cache_chunks
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        size = max(vocabulary.values()) + 1
        self.spaces, self.lines = np.zeros(size, dtype=bool), np.zeros(size, dtype=bool)
        # the vocabulary writes the bytes of a space and of a line end as these letters
        self.spaces[[i for t, i in vocabulary.items() if t.startswith("Ġ")]] = True
        self.lines[[i for t, i in vocabulary.items() if t == "Ċ"]] = True
        self._forget()

    def _forget(self) -> None:
        """No chunk known; place 0 stands for every odd chunk."""
        self.places: dict[str, int] = {}
        self.flat = np.zeros(0, dtype="<u4")
        self.starts, self.sizes = np.zeros(1, dtype=np.int64), np.full(1, -1, dtype=np.int64)
        line = self._ids("\n")
        self._keep(["\n"], line, np.zeros(1, dtype=np.int64), np.full(1, len(line)))

    def _ids(self, text: str) -> np.ndarray:
        # without the places of ids in the text, which nothing here reads
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _keep(self, chunks: list[str], ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
        """Remember the spans of ``ids`` that belong to chunks."""
        self.places.update(zip(chunks, range(len(self.sizes), len(self.sizes) + len(chunks))))
        self.starts = np.concatenate([self.starts, len(self.flat) + starts])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.flat = np.concatenate([self.flat, ids])

    def _spans(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of known chunks one after another, and where each ends."""
        sizes = np.maximum(self.sizes[places], 0)
        ends = np.cumsum(sizes)
        return self.flat[np.repeat(self.starts[places] - ends + sizes, sizes) + np.arange(ends[-1])], ends

    def _learn(self, new: np.ndarray) -> None:
        odd = pc.match_substring_regex(pa.array(new, pa.large_string()), self._odd).to_numpy(zero_copy_only=False)
        self.places.update(dict.fromkeys(new[odd], 0))
        plain = new[~odd].tolist()
        tails = {c: c[:-1] for c in plain if c[-1] in ".," and c[-2:-1].isalpha()}
        wanted = {c for c in (*tails.values(), ".", ",") if c not in self.places}
        wanted.update(c for c in plain if c not in tails)
        for opened in (True, False):
            some = [c for c in wanted if (c[0] == " ") == opened and c != "\n"]
            marks, glue, skip = (self.spaces, "", 0) if opened else (self.lines, "\n", 1)
            for at in range(0, len(some), 32768):
                part = some[at : at + 32768]
                ids = self._ids(glue + glue.join(part))
                starts = np.nonzero(marks[ids])[0]
                if len(starts) == len(part) and starts[0] == 0:
                    begins = starts + skip
                    sizes = np.diff(starts, append=len(ids)) - skip
                else:  # some id looks like a mark: one call per chunk
                    each = [self._ids(c) for c in part]
                    ids, sizes = np.concatenate(each), np.array([len(e) for e in each])
                    begins = np.cumsum(sizes) - sizes
                self._keep(part, ids, begins, sizes)
        if tails:
            at = self.places.__getitem__
            both = np.array([p for c, base in tails.items() for p in (at(base), at(c[-1]))])
            ids, ends = self._spans(both)
            ends = ends[1::2]
            sizes = np.diff(ends, prepend=0)
            self._keep(list(tails), ids, ends - sizes, sizes)

    def _gather(self, texts: list[str]) -> list[bytes]:
        # a text with the separator itself becomes two empty chunks, which are odd
        cut = ["\0" if "\0" in t else t.replace("\n", "\0\n\0").replace(" ", "\0 ") for t in texts]
        lists = pc.split_pattern(pa.array(cut, pa.large_string()), "\0")
        coded = lists.values.dictionary_encode()
        chunks = coded.dictionary.to_numpy(zero_copy_only=False)
        mine = np.fromiter(map(self.places.get, chunks, repeat(-1)), dtype=np.int64, count=len(chunks))
        new = chunks[mine < 0]
        if len(new):
            if len(self.places) + len(new) > self.most:
                self._forget()
                new, mine = chunks, np.full(len(chunks), -1)
            self._learn(new)
            mine[mine < 0] = np.fromiter(map(self.places.__getitem__, new), dtype=np.int64, count=len(new))
        at, first = mine[coded.indices.to_numpy()], lists.offsets.to_numpy()
        odd = np.logical_or.reduceat(self.sizes[at] < 0, first[:-1])
        ids, ends = self._spans(at)
        data, cuts = memoryview(ids.tobytes()), (4 * np.concatenate([[0], ends])[first]).tolist()
        return [self._ids(t).tobytes() if o else bytes(data[a:b]) for t, o, a, b in zip(texts, odd, cuts, cuts[1:])]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit integers, per text."""
        return [ids for at in range(0, len(texts), ROWS) for ids in self._gather(texts[at : at + ROWS])]


def write_store(
    docs: DataFrame,
    path: str,
    tokenizer_path: str,
    end_id: int | None = 2,
    id_column: str = "doc_id",
    text_column: str = "text",
    make_encoder: Callable[[str], object] = ByteLevelEncoder,
) -> None:
    """Encode every whole text and write the ids in ascending id order.

    Null texts count as empty (the end id alone); null ids come first; rows with equal ids are ordered by their text
    hash and kept each.  Other columns are left behind.
    """
    rows = docs.select(F.col(f"`{id_column}`").cast("long").alias("id"), filled(text_column).alias("text"))
    ordered = rows.repartitionByRange("id").sortWithinPartitions("id", F.xxhash64("text"))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = worker_memo(("ids", tokenizer_path), lambda: make_encoder(tokenizer_path))
        tail = b"" if end_id is None else np.array([end_id], dtype="<u4").tobytes()
        shard, block, before = TaskContext.get().partitionId(), 0, 0
        ids, data, size = [], [], 0

        def row() -> pd.DataFrame:
            lengths = [len(d) // 4 for d in data]
            whole = np.frombuffer(b"".join(data), dtype="<u4")
            return pd.DataFrame(
                {"shard": [shard], "block": [block], "before": [before], "n_ids": [len(whole)], "doc_ids": [list(ids)], "lengths": [lengths], "words": [pack(whole)]}
            )

        for frame in batches:
            keys = [None if pd.isna(k) else int(k) for k in frame["id"]]
            for at in range(0, len(frame), ROWS):
                for key, one in zip(keys[at : at + ROWS], encoder.encode(frame["text"].iloc[at : at + ROWS].tolist())):
                    ids.append(key)
                    data.append(one + tail)
                    size += len(one) // 4 + 1
                    if size >= BLOCK_IDS:
                        yield row()
                        block, before, ids, data, size = block + 1, before + sum(len(d) // 4 for d in data), [], [], 0
        if ids:
            yield row()

    ordered.mapInPandas(encode, SCHEMA).write.parquet(path)


def read_store(spark: SparkSession, path: str, with_ids: bool = False, id_column: str = "doc_id") -> DataFrame:
    """Per document: id, ``start`` (ids of all documents before it), ``n_tokens``, ``ids_crc32``, and ``ids`` if wanted."""
    blocks = spark.read.schema(SCHEMA).parquet(path)
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per written partition
    bases = totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for row in frame.itertuples(index=False):
                lengths = np.asarray(row.lengths, dtype=np.int64)
                ids = unpack(row.words, int(row.n_ids)).astype("<u4")
                ends = np.cumsum(lengths)
                view = memoryview(ids.tobytes())
                cuts = [(a, b) for a, b in zip((ends - lengths).tolist(), ends.tolist())]
                out = {
                    id_column: pd.array([None if k is None or k != k else int(k) for k in row.doc_ids], dtype="Int64"),
                    "start": row.base + row.before + ends - lengths,
                    "n_tokens": lengths,
                    "ids_crc32": [zlib.crc32(view[4 * a : 4 * b]) for a, b in cuts],
                }
                if with_ids:
                    out["ids"] = [ids[a:b].astype(np.int64) for a, b in cuts]
                yield pd.DataFrame(out)

    schema = f"`{id_column}` long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return blocks.join(F.broadcast(bases), "shard").mapInPandas(decode, schema)  # bases: one row per partition
