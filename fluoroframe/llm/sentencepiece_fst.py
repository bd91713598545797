"""SentencePiece encoding and decoding as weighted finite-state transduction.

A model file is compiled into three machines that are composed lazily with each
input: the normaliser (spaces to the space sign, the dummy prefix), the piece
transducer (a piece's characters in, its id out, with byte fallback for characters
outside the vocabulary), and a bigram acceptor.  The result is the path of least
weight in the tropical semiring.

For unigram models a piece weighs its negative score and the acceptor takes all
pairs.  For BPE models pieces weigh nothing, and a pair of pieces weighs nothing if
merging its own text gives back just this pair, and infinity otherwise.  Merges
inside two neighbouring pieces never depend on what stands outside, so a sequence
is the BPE result exactly if all its neighbours are such pairs: one path remains.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from fluoroframe.llm.common import filled, worker_memo

SPACE = "▁"
# Fixed values of the model format: kinds of pieces and of models.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Most chunks of text whose ids a worker remembers, and most pairs of the acceptor; results do not depend on them.
CACHE_CHUNKS = 300_000
CACHE_PAIRS = 400_000
_UNKNOWN_PENALTY = 10.0


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and values of a protocol buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            size, at = varint(at)
            value, at = data[at : at + size], at + size
        else:
            size = 4 if kind == 5 else 8
            value, at = struct.unpack("<f" if size == 4 else "<d", data[at : at + size])[0], at + size
        yield key >> 3, value


class Transducer:
    """A compiled model; ``encode`` and ``decode`` work on one text."""

    def __init__(self, model: bytes, cache_chunks: int = CACHE_CHUNKS) -> None:
        pieces, self.kind, normal = [], UNIGRAM, {}
        for field, value in _fields(model):
            if field == 1:
                one = dict(_fields(value))
                pieces.append((one.get(1, b"").decode("utf-8"), one.get(2, 0.0), one.get(3, NORMAL)))
            elif field == 2:
                self.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif field == 3:
                normal = dict(_fields(value))
        if self.kind not in (UNIGRAM, BPE) or normal.get(2) or any(k in (USER, UNUSED) for *_, k in pieces):
            raise ValueError("only unigram and BPE models with the identity normaliser and plain pieces are compiled")
        self.prefix, self.squeeze = bool(normal.get(3, 1)), bool(normal.get(4, 1))
        self.ids = {p: i for i, (p, _, k) in enumerate(pieces) if k == NORMAL}
        self.scores = {p: s for p, s, k in pieces if k == NORMAL}
        self.longest = max(map(len, self.ids), default=1)
        self.unknown = next((i for i, (*_, k) in enumerate(pieces) if k == UNKNOWN), 0)
        self.bytes = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(pieces) if k == BYTE}
        self.out = [
            bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else p.replace(SPACE, " ").encode()
            for p, _, k in pieces
        ]
        self.floor = min(self.scores.values(), default=0.0) - _UNKNOWN_PENALTY
        self.begins = {p[:i] for p in self.ids for i in range(2, len(p) + 1)}
        self.inner = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}  # neighbours that a piece joins
        # text may be cut before a space sign only if no piece goes on over one
        self.cuts = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.pairs: dict[str, bool] = {}  # by both pieces, a zero character between them
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.most = cache_chunks

    # normaliser

    def normalise(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return ""
        return (SPACE if self.prefix else "") + text.replace(" ", SPACE)

    # bigram acceptor

    def _merged(self, text: str) -> list[str]:
        """Pieces left when the best-scored neighbours are merged, leftmost first, until none can be."""
        parts, score, never = list(text), self.scores.get, float("-inf")
        gain = [score(a + b, never) for a, b in zip(parts, parts[1:])]
        while gain:
            best = max(gain)
            if best == never:
                break
            at = gain.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del gain[at]
            if at:
                gain[at - 1] = score(parts[at - 1] + parts[at], never)
            if at < len(gain):
                gain[at] = score(parts[at] + parts[at + 1], never)
        return parts

    def _fits(self, left: str, right: str) -> bool:
        key = f"{left}\0{right}"
        good = self.pairs.get(key)
        if good is None:
            if len(self.pairs) >= CACHE_PAIRS:
                self.pairs.clear()
            good = self.pairs[key] = self._merged(left + right) == ([left, right] if left else [right])
        return good

    # shortest path

    def path(self, text: str) -> list[str]:
        """Pieces of the least-weight path over a normalised text; characters outside the vocabulary stand alone."""
        n, ids, longest = len(text), self.ids, self.longest
        if self.kind == BPE:
            # All weights are nothing, so any way through is the path.  As one sequence of pieces at most ends at a
            # place, a place that leads nowhere is never entered again: each is left once.
            begins, known, fits = self.begins, self.pairs.get, self._fits
            out: list[str] = []
            ways: list[list[str]] = []  # by place on the way: longer pieces last
            dead: set[int] = set()
            at, before = 0, ""
            while at < n:
                way, end, most = [text[at]], at + 2, min(n, at + longest)
                while end <= most and (piece := text[at:end]) in begins:
                    if piece in ids:
                        way.append(piece)
                    end += 1
                while True:
                    while way:
                        piece = way.pop()
                        if at + len(piece) in dead:
                            continue
                        good = known(f"{before}\0{piece}")
                        if good is None:
                            good = fits(before, piece)
                        if good:
                            break
                    else:  # a step back
                        dead.add(at)
                        at -= len(out.pop())
                        before, way = out[-1] if out else "", ways.pop()
                        continue
                    break
                out.append(piece)
                ways.append(way)
                at, before = at + len(piece), piece
            return out
        weight, back = [0.0] + [float("inf")] * n, [0] * (n + 1)
        for start in range(n):
            for end in range(start + 1, min(n, start + longest) + 1):
                score = self.scores.get(text[start:end])
                if score is None:
                    if end > start + 1:
                        continue
                    score = self.floor
                if weight[start] - score < weight[end]:
                    weight[end], back[end] = weight[start] - score, start
        out, at = [], n
        while at:
            out.append(text[back[at] : at])
            at = back[at]
        return out[::-1]

    def _emit(self, piece: str) -> list[int]:
        known = self.ids.get(piece)
        if known is not None:
            return [known]
        return [self.bytes[b] for b in piece.encode("utf-8", "replace")] if self.bytes else [self.unknown]

    def _path_ids(self, text: str) -> bytes:
        pieces, get = self.path(text), self.ids.get
        ids = [get(p) for p in pieces]
        if None in ids:
            ids = [i for p in pieces for i in self._emit(p)]
        if not self.bytes and self.unknown in ids:  # neighbouring unknown characters are one
            ids = [i for j, i in enumerate(ids) if i != self.unknown or j == 0 or ids[j - 1] != i]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a chunk.  The last two remembered generations of chunks are known; what is met again moves to the younger."""
        found = self.older.get(chunk)
        if found is None:
            found = self._new(chunk)
        if len(self.known) >= self.most // 2:
            self.known, self.older = {}, self.known
        self.known[chunk] = found
        return found

    def _new(self, chunk: str) -> bytes:
        # marks at the end are cut off where no piece joins the two characters, so that words are known without them
        if self.kind == BPE or self.bytes:
            for i in range(len(chunk) - 1, max(0, len(chunk) - 4), -1):
                if chunk[i - 1 : i + 1] not in self.inner:
                    return b"".join([self.known.get(p) or self.older.get(p) or self._remember(p) for p in (chunk[:i], chunk[i:])])
        return self._path_ids(chunk)

    def _remember(self, part: str) -> bytes:
        found = self.known[part] = self._path_ids(part)
        return found

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        text = self.normalise(text)
        if not text:
            return b""
        if not self.cuts:
            return self._chunk(text)
        if SPACE + SPACE in text or "\0" in text:
            chunks = re.findall(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+", text)
        else:
            chunks = text.replace(SPACE, "\0" + SPACE).split("\0")
        chunk = self._chunk
        return b"".join([self.known.get(c) or chunk(c) for c in chunks if c])

    def decode(self, ids: bytes) -> str:
        out, table = np.frombuffer(ids, dtype="<u4").tolist(), self.out
        text = b"".join([table[i] for i in out]).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


def _machine(path: str) -> Transducer:
    def read() -> Transducer:
        with open(path, "rb") as file:
            return Transducer(file.read())

    return worker_memo(("pieces", path), read)


def encode_documents(docs: DataFrame, model_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id, ``ids`` (little-endian unsigned 32-bit integers), ``n_tokens``, ``decoded`` and ``same``.

    ``decoded`` is the text read back from the ids and ``same`` whether it equals the text; they differ only where the
    model's normaliser changes a text.  Null and empty texts have no ids and decode to the empty text.  Null ids and
    repeated rows keep their rows; other columns are left behind.  ``model_path`` is a file that every executor has.
    """

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = _machine(model_path)
        for frame in batches:
            for at in range(0, len(frame), 512):
                part = frame.iloc[at : at + 512]
                ids = [machine.encode(t) for t in part["text"]]
                decoded = [machine.decode(i) for i in ids]
                same = [a == b for a, b in zip(decoded, part["text"])]
                yield pd.DataFrame({"id": part["id"], "ids": ids, "n_tokens": [len(i) // 4 for i in ids], "decoded": decoded, "same": same})

    rows = docs.select(F.col(f"`{id_column}`").alias("id"), filled(text_column).alias("text"))
    kind = dict(rows.dtypes)["id"]
    found = rows.mapInPandas(encode, f"id {kind}, ids binary, n_tokens long, decoded string, same boolean")
    return found.withColumnRenamed("id", id_column)


def ids_crc32(ids: bytes) -> int:
    return zlib.crc32(ids)
