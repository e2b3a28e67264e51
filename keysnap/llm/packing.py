"""Packing by best-fit decreasing over a segment tree of remaining capacities.

Each document becomes token ids and an end id. What exceeds a window is first cut into full
windows, which need no packing. The remainders of a task are placed by decreasing length, each
into the tightest open window that takes it; a segment tree over remaining capacities finds it in
log2(2048) steps. A task keeps a few integers for each remainder, never the ids, and packs
its own input split, so nothing is shuffled; sequence numbers hold the partition's number and are
the same if a lost task runs again.

A null text is an empty one: its only id is the end id. A very long text is encoded whole, by one task, and cut
like any other. Remainders of equal length are placed in the order of their rows. Repeated rows are
packed each for itself; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

WINDOW = 2048
END = 1
CACHE = 400_000  # words, and pieces of words, whose ids a process remembers


class BestFit:
    """Open windows by remaining capacity, under a segment tree of which capacities exist."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)  # windows below each node
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.used: list[int] = []

    def _add(self, free: int, n: int) -> None:
        node = self.leaves + free
        while node:
            self.count[node] += n
            node >>= 1

    def _tightest(self, size: int) -> int | None:
        """The smallest capacity of at least ``size`` that an open window has."""
        node = self.leaves + size
        if self.count[node]:
            return size
        while node > 1:
            if not node & 1 and self.count[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.count[2 * node] else 2 * node + 1
                return node - self.leaves
            node >>= 1
        return None

    def place(self, size: int) -> tuple[int, int]:
        """(window, offset) for a piece; a new window is opened where none takes it."""
        free = self._tightest(size)
        if free is None:
            window, free = len(self.used), self.capacity
            self.used.append(0)
        else:
            window = self.open[free].pop()
            self._add(free, -1)
        offset = self.used[window]
        self.used[window] += size
        if free > size:
            self.open[free - size].append(window)
            self._add(free - size, 1)
        return window, offset


def _byte_letters() -> list[str]:
    """The letter that byte-level tokenizers write for each byte: itself where it prints."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(others)) for b in range(256)]


class WordEncoder:
    """Text to little-endian 32-bit ids, for a byte-level tokenizer whose pieces never hold white space.

    The tokenizer lower-cases, splits a text into pieces and looks for merges in each piece. Words
    and pieces met before are remembered, up to a bound, and only new pieces are given to its merge
    model. Words whose lower case or composed form depends on neighbouring characters go through the
    whole tokenizer.
    """

    # Fixed value: the pieces of this vocabulary.
    PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.pieces = regex.compile(self.PIECE).findall
        self.letters = _byte_letters()
        self.words: dict[bytes, bytes] = {}
        self.known: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        if not piece.isascii():
            piece = "".join([self.letters[b] for b in piece.encode("utf-8")])
        return np.array([t.id for t in self.model.tokenize(piece)], "<u4").tobytes()

    def _word(self, word: bytes) -> bytes:
        from unicodedata import is_normalized

        text = word.decode("utf-8")
        low = text.lower()
        plain = text.isascii() or (len(low) == len(text) and "\u03a3" not in text and is_normalized("NFC", text))
        if not plain or not low.isprintable() or "<|" in text:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        out, known = [], self.known
        for piece in self.pieces(low):
            ids = known.get(piece)
            if ids is None:
                if len(known) >= CACHE:
                    known.clear()
                ids = known[piece] = self._piece(piece)
            out.append(ids)
        return b"".join(out)

    def __call__(self, text: str | None) -> bytes:
        words = (text or "").encode("utf-8").split()
        known = self.words
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            pass
        if len(known) >= CACHE:
            known.clear()
        out = []
        for w in words:
            ids = known.get(w)
            if ids is None:
                ids = known[w] = self._word(w)
            out.append(ids)
        return b"".join(out)


_encoders: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    """One for each tokenizer and process: what it has learned serves the next task too."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


PIECES = T.StructType(
    [
        T.StructField(c, T.LongType())
        for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens", "padding")
    ]
)


def padding(used: int, window: int) -> int:
    """A sequence whose length is a power of two is not padded."""
    return 0 if used & (used - 1) == 0 else window - used


def pack(
    df: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW,
    end: int = END,
) -> DataFrame:
    """One row per piece: the document, its place there, and its place in a sequence."""
    source = df.select(doc_id, text)
    schema = T.StructType([source.schema[0], *PIECES.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        import zlib

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from pyspark import TaskContext

        encode, last = word_encoder(tokenizer), np.array([end], "<u4").tobytes()
        first = TaskContext.get().partitionId() << 40
        docs: list[pa.Array] = []
        full, rest = [], []  # (row, start, length, crc, tokens)
        row = 0
        for batch in batches:
            docs.append(batch.column(0))
            texts = batch.column(1)
            for at in range(0, batch.num_rows, 256):
                for t in texts.slice(at, 256).to_pylist():
                    ids = encode(t) + last
                    n = len(ids) // 4
                    for start in range(0, n, window):
                        piece = ids[4 * start : 4 * (start + window)]
                        size = len(piece) // 4
                        (full if size == window else rest).append((row, start, size, zlib.crc32(piece), n))
                    row += 1
        if not row:
            return
        bins = BestFit(window)
        order = sorted(range(len(rest)), key=lambda i: -rest[i][2])
        put = [bins.place(rest[i][2]) for i in order]
        pieces = full + [rest[i] for i in order]
        places = [(len(bins.used) + i, 0) for i in range(len(full))] + put
        used = [*bins.used, *[window] * len(full)]
        doc = pa.chunked_array(docs).combine_chunks()
        for at in range(0, len(pieces), 10_000):
            some, where = pieces[at : at + 10_000], places[at : at + 10_000]
            rows, *columns = zip(*some)
            seq, offset = zip(*where)
            total = [used[s] for s in seq]
            columns += [[first + s for s in seq], offset, total, [padding(u, window) for u in total]]
            taken = doc.take(pa.array(rows, pa.int64()))
            arrays = [taken, *[pa.array(c, pa.int64()) for c in columns]]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return source.mapInArrow(run, schema)

