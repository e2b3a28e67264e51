"""Benchmark decontamination by greedy string tiling.

Tokens are lower-cased words without punctuation. A document and a benchmark item that share a
seed of five tokens are compared: the longest common runs of unmarked tokens are marked as tiles,
again and again with shorter search lengths, found by running Karp-Rabin hashes. Tiles may lie in
any order, so reordered passages count; an item is held by a document if tiles cover at least 0.8
of its tokens.

Documents meet the benchmark as a stated query set, in blocks of at most ``BLOCK_BYTES`` of item
text: a block's seeds go to every task, and all whole documents stream past them. Nothing is
shuffled and no pairs are formed but those that share a seed. The number of passes grows with the
benchmark, never with the documents.

Defined results: null or empty texts hold nothing; items of fewer than five tokens are never found
(any prose would hold them); equal items are reported under each of their ids; repeated rows are
reported each for itself. A document of any length is searched whole, by one task. Of equally long matches the
one that comes first in the item, then in the document, is marked. No documents, or no items, give no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SEED_TOKENS = 5
COVERAGE = 0.8
BLOCK_BYTES = 8 << 20
_PRIME = (1 << 61) - 1
_BASE = 1_000_003
_PLAIN = bytes.maketrans(
    bytes(c for c in range(128) if not chr(c).isalnum()), b" " * sum(not chr(c).isalnum() for c in range(128))
)


def tokenize(text: str | None) -> list[bytes]:
    """Lower-cased runs of characters that are neither ASCII space nor ASCII punctuation."""
    return text.lower().encode("utf-8").translate(_PLAIN).split() if text else []


def _runs(marked: list[bool], least: int) -> Iterator[tuple[int, int]]:
    """Stretches of unmarked tokens, of the given length at least."""
    start = 0
    for i, m in enumerate([*marked, True]):
        if m:
            if i - start >= least:
                yield start, i
            start = i + 1


def _rolled(codes: list[int], start: int, end: int, size: int) -> Iterator[tuple[int, int]]:
    """(position, hash) of every window of ``size`` tokens in a stretch."""
    top = pow(_BASE, size - 1, _PRIME)
    h = 0
    for i in range(start, end):
        if i >= start + size:
            h = (h - codes[i - size] * top) % _PRIME
        h = (h * _BASE + codes[i]) % _PRIME
        if i >= start + size - 1:
            yield i - size + 1, h


def tile(item: list, doc: list, least: int = SEED_TOKENS) -> list[tuple[int, int, int]]:
    """(item position, document position, length) of the tiles, longest first.

    A None in ``doc`` is a gap that no tile crosses.
    """
    code = {t: i + 1 for i, t in enumerate(dict.fromkeys(item))}
    a, b = [code[t] for t in item], [code.get(t, 0) for t in doc]
    done_a, done_b = [False] * len(a), [c == 0 for c in b]
    tiles: list[tuple[int, int, int]] = []
    size = max(least, min(len(a), 4 * least))
    while size >= least:
        table: dict[int, list[int]] = {}
        for start, end in _runs(done_a, size):
            for i, h in _rolled(a, start, end, size):
                table.setdefault(h, []).append(i)
        found: list[tuple[int, int, int]] = []
        for start, end in _runs(done_b, size) if table else ():
            for j, h in _rolled(b, start, end, size):
                for i in table.get(h, ()):
                    # Only where the run cannot begin earlier; the hash is no proof.
                    if i and j > start and not done_a[i - 1] and a[i - 1] == b[j - 1]:
                        continue
                    n = 0
                    while i + n < len(a) and j + n < end and not done_a[i + n] and a[i + n] == b[j + n]:
                        n += 1
                    if n >= size:
                        found.append((n, i, j))
        longest = max((n for n, _, _ in found), default=0)
        if longest > 2 * size:
            size = longest  # long matches first
            continue
        cut = False
        for n, i, j in sorted(found, key=lambda m: (-m[0], m[1], m[2])):
            if any(done_a[i : i + n]) or any(done_b[j : j + n]):
                cut = True  # part of it may still be a tile
                continue
            done_a[i : i + n] = done_b[j : j + n] = [True] * n
            tiles.append((i, j, n))
        if not cut:
            size = least if least < size <= 2 * least else size // 2
    return sorted(tiles, key=lambda m: (-m[2], m[0]))


class Index:
    """Seeds of a block of items."""

    def __init__(self, items: list[tuple[object, str | None]]):
        by_tokens: dict[tuple[bytes, ...], list] = {}
        for item_id, text in items:
            tokens = tuple(tokenize(text))
            if len(tokens) >= SEED_TOKENS:
                by_tokens.setdefault(tokens, []).append(item_id)
        self.items = [(list(t), ids) for t, ids in by_tokens.items()]
        self.seeds: dict[bytes, list[int]] = {}
        for k, (tokens, _) in enumerate(self.items):
            for seed in {b" ".join(tokens[i : i + SEED_TOKENS]) for i in range(len(tokens) - SEED_TOKENS + 1)}:
                self.seeds.setdefault(seed, []).append(k)

    def held(self, text: str | None) -> Iterator[tuple[object, int, int, list[tuple[int, int, int]]]]:
        """(item id, its tokens, tokens covered, tiles) for every item that the text holds."""
        tokens = tokenize(text)
        if len(tokens) < SEED_TOKENS:
            return
        line = b" ".join(tokens)
        gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
        starts = [0, *(gaps + 1).tolist()]
        ends = [*gaps.tolist(), len(line)][SEED_TOKENS - 1 :]
        seeds, hits = self.seeds, {}
        for j, (s, e) in enumerate(zip(starts, ends)):
            for k in seeds.get(line[s:e], ()):
                hits.setdefault(k, []).append(j)
        for k, places in sorted(hits.items()):
            item, ids = self.items[k]
            # Every tile consists of seeds, so only the tokens that they cover are compared.
            part: list[bytes | None] = []
            where: list[int] = []
            done = -1
            for j in places:
                if part and j > done:
                    part.append(None)
                    where.append(-1)
                new = range(max(j, done), j + SEED_TOKENS)
                part.extend(tokens[x] for x in new)
                where.extend(new)
                done = j + SEED_TOKENS
            tiles = tile(item, part)
            covered = sum(n for _, _, n in tiles)
            if covered >= COVERAGE * len(item):
                placed = [(i, where[j], n) for i, j, n in tiles]
                for item_id in ids:
                    yield item_id, len(item), covered, placed


def _blocks(benchmark: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[object, str]]]:
    """Items in blocks of bounded size; one partition at a time reaches the driver."""
    block, size = [], 0
    for row in benchmark.where(f"`{text}` is not null").select(item_id, text).toLocalIterator():
        if block and size + len(row[1]) > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((row[0], row[1]))
        size += len(row[1])
    if block:
        yield block


def find_contaminated(
    documents: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """One row per document and item that it holds, with the tiles."""
    spark = documents.sparkSession
    source = documents.select(doc_id, text)
    long = T.LongType()
    tile_type = T.StructType([T.StructField(c, long) for c in ("item_start", "doc_start", "length")])
    schema = T.StructType(
        [
            T.StructField("doc_id", source.schema[0].dataType),
            T.StructField("item_id", benchmark.schema[item_id].dataType),
            T.StructField("item_tokens", long),
            T.StructField("covered_tokens", long),
            T.StructField("tiles", T.ArrayType(tile_type)),
        ]
    )
    out = spark.createDataFrame([], schema)
    for block in _blocks(benchmark, item_id, item_text):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            from pyspark.sql.pandas.types import to_arrow_schema

            arrow = to_arrow_schema(schema)
            index = Index(shared.value)
            for batch in batches:
                rows, found = [], []
                for at in range(0, batch.num_rows, 256):
                    for i, t in enumerate(batch.column(1).slice(at, 256).to_pylist(), at):
                        for item, n, covered, tiles in index.held(t):
                            rows.append(i)
                            found.append((item, n, covered, [dict(zip(tile_type.names, x)) for x in tiles]))
                if rows:
                    columns = [batch.column(0).take(pa.array(rows, pa.int64()))]
                    columns += [pa.array(c, f.type) for c, f in zip(zip(*found), list(arrow)[1:])]
                    yield pa.RecordBatch.from_arrays(columns, names=schema.names)

        out = out.union(source.mapInArrow(run, schema))
    return out


def drop_contaminated(
    documents: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """The documents that hold no item, their other columns as they are."""
    spark = documents.sparkSession
    for block in _blocks(benchmark, item_id, item_text):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = Index(shared.value)
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index(text))
                clean = []
                for at in range(0, batch.num_rows, 256):
                    clean += [next(index.held(t), None) is None for t in texts.slice(at, 256).to_pylist()]
                yield batch.filter(pa.array(clean, pa.bool_()))

        documents = documents.mapInArrow(run, documents.schema)
    return documents
