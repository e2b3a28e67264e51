"""Removal of long repeats by a sparse suffix array, built with a prefix-aware merge sort.

A byte goes if a string of 200 bytes that covers it also starts anywhere else.

*Anchors.* Of each window of 200 bytes the smallest hashed 32-gram is its anchor, the leftmost of
equals: a choice that depends on the window alone, so equal windows have equal anchors at equal
offsets. Windows of one anchor are neighbours; together they cover a stretch of text around it.
Only anchors whose gram occurs twice or more go further: all other windows are unique.

*Sort.* The suffix at an anchor is its stretch to the right, followed by the reversed stretch to
the left. A task sorts its suffixes into runs, one for each part of the grams' hash space, with
equal suffixes collapsed, and front-codes them: only what differs from the preceding suffix is
written, compressed, and exchanged. A part's runs are combined by a loser tree that keeps for each
run the prefix it is known to share, so known prefixes are never compared again.

*Repeats.* Equal neighbours of the merged order repeat in all their windows. Where a gram has
several different suffixes, its windows are compared by digests of 128 bits, in the task while the
gram has at most ``MAX_VARIANTS`` suffixes, else by an aggregation over all windows of such grams.
Equal suffixes are collapsed before the exchange, so a passage that very many documents share
is one entry for each run.

Matches never cross documents. Defined results: a null text counts as empty; texts of fewer than
200 bytes lose nothing; repeated rows are texts of their own and so repeat each other;
an empty table gives no rows. A very long text is hashed in chunks that overlap by a window. Only the id and
the text are read of the documents.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keysnap.llm.common import stored
from keysnap.session import fresh_dir

LENGTH = 200
GRAM = 32
MAX_VARIANTS = 20_000
RUN_BYTES = 48 << 20  # of suffixes that a task holds before it writes its runs
_CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xBF58476D1CE4E5B9)


# Anchors


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2^64."""
    def power(b):
        return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)]))

    return power(_BASE), power(pow(_BASE, -1, 1 << 64))


def _sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` neighbours, from minima of blocks forwards and backwards."""
    n = len(a) - w + 1
    full = np.full(-(-len(a) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    full[: len(a)] = a
    blocks = full.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def anchors(data: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, last window) for the windows of a text, in order."""
    found = []
    powers, inverse = _powers(min(len(data), _CHUNK + length))
    low = np.uint64((1 << 24) - 1)
    for at in range(0, len(data) - length + 1, _CHUNK):
        part = data[at : at + _CHUNK + length - 1]
        n = len(part)
        codes = np.frombuffer(part, np.uint8).astype(np.uint64) + np.uint64(1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(codes * inverse[:n], out=sums[1:])
        h = (sums[gram:] - sums[:-gram]) * powers[: n - gram + 1]
        h ^= h >> np.uint64(29)
        h *= _MIX
        h ^= h >> np.uint64(32)
        key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        best = (_sliding_min(key, length - gram + 1) & low).astype(np.int64)
        cut = np.flatnonzero(np.diff(best)) + 1
        first = np.concatenate([[0], cut])
        last = np.concatenate([cut - 1, [len(best) - 1]])
        found.append((best[first] + at, first + at, last + at))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(c) for c in zip(*found))


# Runs


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which ``known`` bytes need no comparison."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    while known < n:
        x, y = a[known : known + 32], b[known : known + 32]
        if x != y:
            m = min(len(x), len(y), n - known)
            d = int.from_bytes(x[:m], "big") ^ int.from_bytes(y[:m], "big")
            return known + m - (d.bit_length() + 7) // 8
        known += 32
    return n


def front_code(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """(shared prefix lengths, lengths of the rest, the rests) of sorted keys."""
    shared, tails, last = [], [], b""
    for key in keys:
        n = common_prefix(last, key)
        shared.append(n)
        tails.append(key[n:])
        last = key
    sizes = np.fromiter(map(len, tails), np.uint32, len(tails))
    return np.array(shared, np.uint32), sizes, b"".join(tails)


class Run:
    """A front-coded run, read from the front; ``shared`` is the prefix shared with the entry before."""

    def __init__(self, shared: np.ndarray, sizes: np.ndarray, tails: bytes, counts: np.ndarray, rows: np.ndarray,
                 starts: np.ndarray):
        self._entries = zip(shared.tolist(), sizes.tolist(), counts.tolist())
        self._tails, self._rows, self._starts = tails, rows, starts
        self._at = self._next = 0
        self.key: bytes | None = b""
        self.advance()

    def advance(self) -> None:
        entry = next(self._entries, None)
        if entry is None:
            self.key, self.shared = None, 0
            return
        self.shared, size, count = entry
        self.key = self.key[: self.shared] + self._tails[self._at : self._at + size]
        self._at += size
        self.places = (self._next, self._next + count)
        self._next += count

    def occurrences(self) -> list[tuple[int, int]]:
        a, b = self.places
        return list(zip(self._rows[a:b].tolist(), self._starts[a:b].tolist()))


def merge(runs: list[Run]) -> Iterator[tuple[bytes, int, list[tuple[int, int]]]]:
    """(key, prefix shared with the key before, occurrences) over all runs, in order.

    A loser tree. Every run's head is known to share ``known`` bytes with the last key put out.
    Of two heads the one that shares more is the smaller; only if they share equally many are
    they compared, from there on.
    """
    n = len(runs)
    if not n:
        return
    leaves = 1 << (n - 1).bit_length()
    known = [0] * leaves
    heads = [*runs, *[None] * (leaves - n)]

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's known prefix becomes the one it shares with the winner."""
        ra, rb = heads[a], heads[b]
        if ra is None or ra.key is None:
            return b, a
        if rb is None or rb.key is None:
            return a, b
        ka, kb = known[a], known[b]
        if ka != kb:
            return (a, b) if ka > kb else (b, a)
        x, y = ra.key, rb.key
        both = common_prefix(x, y, ka)
        first = len(x) == both or (len(y) != both and x[both] < y[both])
        if first:
            known[b] = both
            return a, b
        known[a] = both
        return b, a

    losers = [0] * leaves
    winners = [0] * leaves + list(range(leaves))
    for node in range(leaves - 1, 0, -1):
        winners[node], losers[node] = play(winners[2 * node], winners[2 * node + 1])
    top = winners[1]
    while (run := heads[top]) is not None and run.key is not None:
        yield run.key, known[top], run.occurrences()
        run.advance()
        known[top] = run.shared
        node = (leaves + top) >> 1
        while node:
            top, losers[node] = play(top, losers[node])
            node >>= 1


# Suffixes at anchors


def suffix(data: bytes, anchor: int, first: int, last: int, length: int = LENGTH) -> bytes:
    """Right of the anchor to the end of its last window, the left reversed, the length of the right."""
    right = data[anchor : last + length]
    return right + data[first:anchor][::-1] + len(right).to_bytes(2, "big")


def windows(key: bytes, length: int = LENGTH) -> tuple[bytes, int]:
    """(the stretch, its number of windows) of a suffix."""
    right = int.from_bytes(key[-2:], "big")
    stretch = key[right:-2][::-1] + key[:right]
    return stretch, len(stretch) - length + 1


class Gram:
    """The suffixes of one gram as they come; tells which windows repeat.

    Rows are (document row, first byte, end, digest); a digest marks a window that is still to be
    compared elsewhere.
    """

    def __init__(self, length: int, most: int):
        self.length, self.most = length, most
        self.items: list[tuple[bytes, tuple[int, int] | None]] = []
        self.open = False  # too many variants: windows go out

    def _digests(self, key: bytes) -> Iterator[tuple[int, bytes]]:
        from xxhash import xxh3_128_digest

        stretch, n = windows(key, self.length)
        for i in range(n):
            yield i, xxh3_128_digest(stretch[i : i + self.length])

    def _send(self, key, place):
        row, start = place or (None, 0)
        for i, d in self._digests(key):
            yield row, start + i, start + i + self.length, d

    def add(self, key: bytes, place: tuple[int, int] | None) -> Iterator[tuple]:
        """A variant; its place if it is not yet known to repeat."""
        if self.open:
            yield from self._send(key, place)
            return
        self.items.append((key, place))
        if len(self.items) > self.most:
            self.open = True
            for item in self.items:
                yield from self._send(*item)
            self.items = []

    def close(self) -> Iterator[tuple]:
        if len(self.items) < 2 or all(place is None for _, place in self.items):
            return
        seen: dict[bytes, tuple[int, int] | None] = {}
        for key, place in self.items:
            for i, d in self._digests(key):
                own = None if place is None else (place[0], place[1] + i)
                if d not in seen:
                    seen[d] = own
                    continue
                for found in (seen[d], own):
                    if found is not None:
                        yield *found, found[1] + self.length, None
                seen[d] = None


def repeats(
    runs: list[Run], length: int = LENGTH, gram: int = GRAM, most: int = MAX_VARIANTS
) -> Iterator[tuple[int | None, int, int, bytes | None]]:
    """What repeats in a part, from its merged suffixes."""
    group: Gram | None = None
    current: tuple[bytes, list[tuple[int, int]], bool] | None = None  # key, first place, repeats

    def ended():
        key, places, twice = current
        return group.add(key, None if twice else places[0])

    for key, shared, places in merge(runs):
        if current is not None and shared == len(key) == len(current[0]):
            old, held, twice = current
            n = windows(key, length)[1] + length - 1
            for row, start in (places if twice else held + places):
                yield row, start, start + n, None
            current = (key, held, True)
            continue
        if current is not None:
            yield from ended()
        if group is None or shared < gram:
            if group is not None:
                yield from group.close()
            group = Gram(length, most)
        twice = len(places) > 1
        if twice:
            n = windows(key, length)[1] + length - 1
            for row, start in places:
                yield row, start, start + n, None
        current = (key, places[:1], twice)
    if current is not None:
        yield from ended()
        yield from group.close()


# Jobs

_RUNS = "part int, shared binary, sizes binary, tails binary, counts binary, rows binary, starts binary"
_FOUND = "row long, start long, stop long, digest binary"


def _to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _write_runs(length: int, gram: int, parts: int):
    """Documents with their shared anchors to front-coded runs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        held: dict[int, dict[bytes, list[tuple[int, int]]]] = {}
        size = 0

        def flush():
            for part, keys in held.items():
                order = sorted(keys)
                shared, sizes, tails = front_code(order)
                places = [keys[k] for k in order]
                flat = [x for p in places for x in p]
                arrays = [
                    pa.array([part], pa.int32()), *[
                        pa.array([v], pa.binary()) for v in (
                            shared.tobytes(), sizes.tobytes(), zlib.compress(tails, 1),
                            np.fromiter(map(len, places), np.uint32, len(places)).tobytes(),
                            np.array([r for r, _ in flat], np.int64).tobytes(),
                            np.array([s for _, s in flat], np.int64).tobytes(),
                        )
                    ],
                ]
                yield pa.RecordBatch.from_arrays(
                    arrays, names=["part", "shared", "sizes", "tails", "counts", "rows", "starts"]
                )
            held.clear()

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for d in batch.slice(at, 64).to_pylist():
                    data, row = d["text"].encode("utf-8"), d["row"]
                    for place in d["places"]:
                        key = suffix(data, place["anchor"], place["first"], place["last"], length)
                        part = xxh64_intdigest(key[:gram]) % parts
                        held.setdefault(part, {}).setdefault(key, []).append((row, place["first"]))
                        size += len(key) + 200
                if size > RUN_BYTES:
                    yield from flush()
                    size = 0
        yield from flush()

    return run


def _merge_runs(length: int, gram: int, most: int):
    """All runs of some parts to what repeats in them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("row", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("digest", pa.binary())])
        parts: dict[int, list[dict]] = {}
        for batch in batches:
            for r in batch.to_pylist():
                parts.setdefault(r["part"], []).append(r)
        rows: list[tuple] = []
        for part in list(parts):
            runs = [
                Run(np.frombuffer(r["shared"], np.uint32), np.frombuffer(r["sizes"], np.uint32),
                    zlib.decompress(r["tails"]), np.frombuffer(r["counts"], np.uint32),
                    np.frombuffer(r["rows"], np.int64), np.frombuffer(r["starts"], np.int64))
                for r in parts.pop(part)
            ]
            for found in repeats(runs, length, gram, most):
                rows.append(found)
                if len(rows) == 20_000:
                    yield _to_batch(rows, schema)
                    rows = []
        yield _to_batch(rows, schema)

    return run


def _find_anchors(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            rows = batch.column(0).to_pylist()
            for at in range(0, batch.num_rows, 256):
                out = [[], [], [], [], []]
                for row, text in zip(rows[at : at + 256], batch.column(1).slice(at, 256).to_pylist()):
                    data = text.encode("utf-8")
                    anchor, first, last = anchors(data, length, gram)
                    if not len(anchor):
                        continue
                    hashes = [xxh64_intdigest(data[a : a + gram]) for a in anchor.tolist()]
                    for c, v in zip(out, (np.full(len(anchor), row), anchor, first, last, np.array(hashes, np.uint64).view(np.int64))):
                        c.append(v)
                if out[0]:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(c), pa.int64()) for c in out],
                        names=["row", "anchor", "first", "last", "gram"],
                    )

    return run


def _spans(places: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted((p["start"], p["stop"]) for p in places):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def repeated_spans(
    documents: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM,
    most: int = MAX_VARIANTS,
) -> DataFrame:
    """(doc_id, text, row, places): every document with its repeated windows, overlapping and unordered.

    The text is shuffled once, into a bucketed table; both joins with what is found read its buckets
    as they are.
    """
    spark = documents.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"keysnap_texts_{uuid.uuid4().hex}"
    (
        documents.select(
            F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("id"), F.coalesce(text, F.lit("")).alias("text")
        )
        .repartition(parts, "row")
        .write.option("compression", "zstd").option("path", fresh_dir(spark, "texts")).bucketBy(parts, "row").saveAsTable(name)
    )
    texts = spark.table(name)
    long = F.octet_length("text") >= length
    places = stored(
        texts.where(long).select("row", "text").mapInArrow(
            _find_anchors(length, gram), "row long, anchor long, first long, last long, gram long"
        ),
        "anchors",
    )
    shared = stored(places.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"), "grams")
    wanted = (
        places.join(shared, "gram")
        .groupBy("row").agg(F.collect_list(F.struct("anchor", "first", "last")).alias("places"))
    )
    runs = texts.join(wanted.hint("shuffle_hash"), "row").select("row", "text", "places").mapInArrow(
        _write_runs(length, gram, 4 * parts), _RUNS
    )
    found = stored(runs.repartition(parts, "part").mapInArrow(_merge_runs(length, gram, most), _FOUND), "repeats")
    left = found.where("digest is not null")
    twice = stored(left.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest"), "digests")
    spans = found.where("digest is null").select("row", "start", "stop").union(
        left.where("row is not null").join(twice, "digest").select("row", "start", "stop")
    )
    gathered = spans.groupBy("row").agg(F.collect_list(F.struct("start", "stop")).alias("places"))
    return texts.join(gathered.hint("shuffle_hash"), "row", "left").select(F.col("id").alias(doc_id), "text", "row", "places")


def _cut(batches: Iterator[pa.RecordBatch], digest: bool) -> Iterator[pa.RecordBatch]:
    from hashlib import sha256

    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            some = batch.slice(at, 256)
            rows = []
            for text, places in zip(some.column(1).to_pylist(), some.column(2).to_pylist()):
                data = text.encode("utf-8")
                spans = _spans(places or [])
                kept, done = [], 0
                for s, e in spans:
                    kept.append(data[done:s])
                    done = e
                left = b"".join([*kept, data[done:]])
                removed = [dict(start=s, stop=e) for s, e in spans]
                rows.append((len(data), len(data) - len(left), removed, sha256(left).hexdigest() if digest else left))
            n, gone, removed, left = zip(*rows)
            span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [some.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(removed, span),
                 pa.array(left, pa.string() if digest else pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "spans", "kept"],
            )


def remove_repeats(
    documents: DataFrame, doc_id: str = "doc_id", text: str = "text", digest: bool = False, **parameters
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept): the bytes that stay, or their SHA-256 in hexadecimal."""
    found = repeated_spans(documents, doc_id, text, **parameters).select(F.col(doc_id).alias("doc_id"), "text", "places")
    schema = T.StructType(
        [
            found.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()),
            T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))),
            T.StructField("kept", T.StringType() if digest else T.BinaryType()),
        ]
    )
    return found.mapInArrow(lambda batches: _cut(batches, digest), schema)
