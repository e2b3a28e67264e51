"""Ranked lexical search over K2-treaps: quadtrees of the grid of terms and documents.

A block of documents is a grid with a row for each term that any item asks for and a column for each
document; a cell holds the impact of the term in the document. Cells are halved both ways, empty
quadrants are left out (a mask of four bits and the place of the first child are all a cell keeps),
and each cell stores the greatest impact below it. An item descends from the root by all its terms'
row paths at once. Its open document ranges lie in a queue by the score that they can reach at most
(weights of the terms below a cell times its maximum, summed over the paths); the best are split
first, and once the k-th best found score exceeds all that is left, nothing more is opened.

Documents are read once to count the terms asked for, and those counts once to build and search blocks
of at most ``BLOCK_POSTINGS`` cells. A task keeps the best k of each item over its blocks, so later
blocks are searched against what earlier ones gave; tasks hand on k rows for each item. Items go in
blocks of about ``BLOCK_TERMS`` terms (an item is never divided), which bounds what is broadcast:
more items mean more passes over the documents.

Defined results: terms are the maximal runs of ASCII letters, digits and non-ASCII characters, with
only A-Z lower-cased. Null and empty texts have none. Rows of an item with the same id are one item
with the terms of all; each row of the documents is a document of its own, also when ids or texts
repeat, and equal scores go by ascending id, null last. Empty tables give no rows. Only the named
columns are used.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keysnap.llm.common import stored

BLOCK_POSTINGS = 1 << 20
BLOCK_TERMS = 1 << 21
# Open ranges split in one step, and the level (64 documents) from which a range is opened to its end.
STEP, FINISH = 64, 6
# Rows lie 2 ** SPACING apart: cells of up to 16 documents hold one term, so their maxima are tight.
SPACING = 4
_NO_ID = np.iinfo(np.int64).max
_WORDS = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
    for c in range(256)
)


def terms_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORDS).split() if text else []


# Counting


def count_terms(documents: DataFrame, vocabulary, doc_id: str, text: str) -> DataFrame:
    """(doc_id, n, terms, times) of documents with a term: the number of all terms, and which of the
    broadcast vocabulary (term to number) occur how often."""
    source = documents.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids, sizes, terms, times = [], [], [], []
                for i, t in zip(part.column(0).to_pylist(), part.column(1)):
                    words = terms_of(t.as_py())
                    if not words:
                        continue
                    counts = Counter(words)
                    found = [(known[w], c) for w, c in counts.items() if w in known]
                    ids.append(i)
                    sizes.append(len(words))
                    terms.append([f for f, _ in found])
                    times.append([c for _, c in found])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())),
                     pa.array(times, pa.list_(pa.int64()))],
                    names=["doc_id", "n", "terms", "times"],
                )

    return source.mapInArrow(run, "doc_id long, n long, terms array<int>, times array<long>")


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(times: np.ndarray, sizes: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    norm = 100 - 90 + (90 * sizes * n_docs) // n_terms
    return (1_000_000_000 * times) // (1000 * times + 8 * norm)


# The tree


def _spread(x: np.ndarray) -> np.ndarray:
    """The lower 32 bits of each number, with a zero before each."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F),
                        (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x


_BELOW = np.array([[bin(m & ((1 << q) - 1)).count("1") for q in range(4)] for m in range(16)], np.uint8)


class Treap:
    """Levels from single cells (0) up to the root; quadrants in the order of row half, column half."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, values: np.ndarray):
        self.height = max(int(rows.max()).bit_length(), int(columns.max()).bit_length(), FINISH + 1)
        cells = (_spread(rows) << np.uint64(1)) | _spread(columns)
        order = np.argsort(cells, kind="stable")
        cells = cells[order]
        self.most = [values[order].astype(np.int64)]
        self.mask: list[np.ndarray | None] = [None]
        self.child: list[np.ndarray | None] = [None]
        for _ in range(self.height):
            parent = cells >> np.uint64(2)
            first = np.flatnonzero(np.concatenate(([True], parent[1:] != parent[:-1])))
            quadrant = np.left_shift(1, (cells & np.uint64(3)).astype(np.int64)).astype(np.uint8)
            self.mask.append(np.bitwise_or.reduceat(quadrant, first))
            self.child.append(first)
            self.most.append(np.maximum.reduceat(self.most[-1], first))
            cells = parent[first]

    def down(self, level: int, nodes: np.ndarray, quadrant: int) -> tuple[np.ndarray, np.ndarray]:
        """Which nodes of a level have that quadrant, and where it lies one level below."""
        mask = self.mask[level][nodes]
        has = (mask >> quadrant) & 1 == 1
        return has, self.child[level][nodes[has]] + _BELOW[mask[has], quadrant]


class Paths:
    """An item's rows as shared paths: at each level the distinct prefixes, the weights below each,
    and where a prefix's two halves lie one level below (-1: no row there)."""

    def __init__(self, rows: np.ndarray, weights: np.ndarray, height: int):
        order = np.argsort(rows)
        prefix, weight = rows[order], weights[order]
        self.weight, self.halves = [weight], [None]
        for _ in range(height):
            up, first = np.unique(prefix >> 1, return_index=True)
            halves = np.full((2, len(up)), -1, np.int64)
            place = np.searchsorted(up, prefix >> 1)
            halves[prefix & 1, place] = np.arange(len(prefix))
            self.halves.append(halves)
            self.weight.append(np.add.reduceat(self.weight[-1], first))
            prefix = up


@dataclass
class Best:
    """The k best (score, document) so far; ``least`` is what another has to reach."""

    k: int
    scores: np.ndarray
    docs: np.ndarray

    @classmethod
    def none(cls, k: int) -> "Best":
        return cls(k, np.empty(0, np.int64), np.empty(0, np.int64))

    @property
    def least(self) -> int:
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def offer(self, scores: np.ndarray, docs: np.ndarray) -> None:
        good = scores >= self.least
        if good.any():
            scores, docs = np.concatenate((self.scores, scores[good])), np.concatenate((self.docs, docs[good]))
            order = np.lexsort((docs, -scores))[: self.k]
            self.scores, self.docs = scores[order], docs[order]


def _split(tree: Treap, paths: Paths, level: int, owner, prefix, node):
    """The row paths of ranges, one level down: (owner doubled by column half, prefix, node)."""
    parts = []
    for row_half in (0, 1):
        below = paths.halves[level][row_half][prefix]
        some = below >= 0
        own, low, at = owner[some], below[some], node[some]
        for column_half in (0, 1):
            has, child = tree.down(level, at, 2 * row_half + column_half)
            parts.append((2 * own[has] + column_half, low[has], child))
    return tuple(np.concatenate(p) for p in zip(*parts))


def _bounds(tree: Treap, paths: Paths, level: int, owner, prefix, node, n: int) -> np.ndarray:
    """The most that each range's documents can score; on level 0 what they do score. Sums stay far
    below 2 ** 53, so doubles are exact."""
    reach = paths.weight[level][prefix] * tree.most[level][node]
    return np.bincount(owner, reach, n).astype(np.int64)


def search_block(tree: Treap, docs: np.ndarray, rows: np.ndarray, weights: np.ndarray, best: Best) -> int:
    """Adds the block's documents to an item's best; returns how many ranges were opened."""
    paths = Paths(rows, weights, tree.height)
    top = tree.height
    # One prefix is left at the root: the height covers all rows.
    reach = int(paths.weight[top][0] * tree.most[top][0])
    queue: list[tuple] = [(-reach, 0, top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    opened = 0
    while queue and -queue[0][0] >= best.least:
        levels: dict[int, list[tuple]] = {}
        # In one step only ranges that reach about as high: the best raise what others have to reach.
        least = max(best.least, -queue[0][0] // 2)
        for _ in range(min(STEP, len(queue))):
            if -queue[0][0] < least:
                break
            _, column, level, prefix, node = heapq.heappop(queue)
            levels.setdefault(level, []).append((column, prefix, node))
        for level, ranges in levels.items():
            opened += len(ranges)
            columns = np.array([r[0] for r in ranges])
            owner = np.repeat(np.arange(len(ranges)), [len(r[1]) for r in ranges])
            state = (owner, np.concatenate([r[1] for r in ranges]), np.concatenate([r[2] for r in ranges]))
            while True:
                state = _split(tree, paths, level, *state)
                level -= 1
                columns = np.repeat(columns * 2, 2) + np.tile((0, 1), len(columns))
                reach = _bounds(tree, paths, level, *state, len(columns))
                if not level or level >= FINISH:
                    break
                # Near the ground: all at once, but only what can still matter.
                live = reach >= best.least
                number = np.cumsum(live) - 1
                keep = live[state[0]]
                state = (number[state[0][keep]], state[1][keep], state[2][keep])
                columns = columns[live]
                if not len(columns):
                    break
            if not len(columns):
                continue
            if not level:
                some = reach > 0
                best.offer(reach[some], docs[columns[some]])
                continue
            order = np.argsort(state[0], kind="stable")
            ends = np.cumsum(np.bincount(state[0], minlength=len(columns)))
            prefix, node = state[1][order], state[2][order]
            for i in np.flatnonzero(reach >= best.least).tolist():
                begin = int(ends[i - 1]) if i else 0
                heapq.heappush(queue, (-int(reach[i]), int(columns[i]), level, prefix[begin : ends[i]], node[begin : ends[i]]))
    return opened


# Searching


@dataclass
class Query:
    """A block of items: ids, and the numbers and weights of each one's terms. ``row`` orders terms
    by frequency, so that cells hold terms alike."""

    ids: list
    terms: list[np.ndarray]
    weights: list[np.ndarray]
    row: np.ndarray
    n_docs: int
    n_terms: int
    k: int


def search_counts(counts: DataFrame, query, item_type: T.DataType, block: int) -> DataFrame:
    """(item_id, doc_id, score): for each task the best documents of each item of the broadcast query."""
    schema = T.StructType([
        T.StructField("item_id", item_type), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        q = query.value
        best = [Best.none(q.k) for _ in q.ids]
        held: list[tuple] = []
        size = 0

        def settle():
            ids, sizes, terms, times, lengths = (np.concatenate(c) for c in zip(*held))
            # Documents of like length lie side by side: their impacts are alike.
            order = np.argsort(sizes, kind="stable")
            column = np.empty(len(order), np.int64)
            column[order] = np.arange(len(order))
            owner = np.repeat(np.arange(len(ids)), lengths)
            if not len(terms):
                return
            values = impacts(times, sizes[owner], q.n_docs, q.n_terms)
            tree, docs = Treap(q.row[terms], column[owner], values), ids[order]
            # Rows that no document of the block has lie beyond the grid, or meet no cell.
            for b, t, w in zip(best, q.terms, q.weights):
                rows = q.row[t]
                inside = rows < 1 << tree.height
                if inside.any():
                    search_block(tree, docs, rows[inside], w[inside], b)

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                ids = part.column(0).fill_null(_NO_ID).to_numpy()
                lists = [part.column(c) for c in (2, 3)]
                flat = [x.flatten().to_numpy(zero_copy_only=False) for x in lists]
                lengths = lists[0].value_lengths().to_numpy(zero_copy_only=False)
                held.append((ids, part.column(1).to_numpy(), *flat, lengths))
                size += len(flat[0]) + part.num_rows
                if size >= block:
                    settle()
                    held.clear()
                    size = 0
        if held:
            settle()
        rows = [(i, None if d == _NO_ID else d, s) for i, b in zip(q.ids, best) for d, s in zip(b.docs.tolist(), b.scores.tolist())]
        arrow = to_arrow_schema(schema)
        columns = list(zip(*rows)) if rows else [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return counts.mapInArrow(run, schema)


def search(
    documents: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text", block: int = BLOCK_POSTINGS, block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item its k highest-scoring documents, fewer if fewer
    share a term with it."""
    spark = documents.sparkSession
    asked = items.select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{item_text}`").cast("string").alias("text"))
    lowered = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = F.array_distinct(F.regexp_extract_all(lowered, F.lit("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"), F.lit(0)))
    by_item = stored(
        asked.select("item_id", F.explode(found).alias("term")).groupBy("item_id").agg(F.collect_set("term").alias("terms")),
        "items",
    )
    total = by_item.agg(F.sum(F.size("terms"))).head()[0] or 0
    blocks = -(-total // block_terms)
    kind = by_item.schema["item_id"].dataType
    place = F.pmod(F.xxhash64("item_id"), F.lit(max(blocks, 1)))
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    out = None
    for b in range(blocks):
        rows = by_item.where(place == b).collect()  # about block_terms terms
        numbers = {t: i for i, t in enumerate(sorted({t for r in rows for t in r["terms"]}))}
        vocabulary = spark.sparkContext.broadcast({t.encode("utf-8", "surrogatepass"): i for t, i in numbers.items()})
        counts = stored(count_terms(documents, vocabulary, doc_id, text), "term-counts")
        all_docs = counts.agg(F.count("*"), F.sum("n")).head()
        n_docs, n_terms = all_docs[0], all_docs[1] or 0
        # One row for each term of the block.
        df = np.zeros(len(numbers), np.int64)
        for r in counts.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
            df[r["term"]] = r["count"]
        row = np.empty(len(df), np.int64)
        row[np.argsort(df, kind="stable")] = np.arange(len(df)) << SPACING
        weight = np.array([term_weight(n_docs, int(d)) for d in df], np.int64)
        terms = [np.array([numbers[t] for t in r["terms"]], np.int64) for r in rows]
        query = spark.sparkContext.broadcast(
            Query([r["item_id"] for r in rows], terms, [weight[t] for t in terms], row, n_docs, n_terms, k)
        )
        found_here = search_counts(counts, query, kind, block).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        done = stored(found_here.select("item_id", "rank", "doc_id", "score"), "found")
        vocabulary.destroy()
        query.destroy()
        out = done if out is None else out.unionByName(done)
    if out is None:
        return spark.createDataFrame([], T.StructType([
            T.StructField("item_id", kind), T.StructField("rank", T.IntegerType()), T.StructField("doc_id", T.LongType()),
            T.StructField("score", T.LongType()),
        ]))
    return out


def oracle_sql(k: int = 10) -> str:
    """The same ranking by joins and sums over all postings."""
    terms = (
        "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
        r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    )
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, {terms} AS words FROM documents WHERE text IS NOT NULL),
    s AS (SELECT r, doc_id, len(words)::HUGEINT AS n FROM d WHERE len(words) > 0),
    total AS (SELECT count(*)::HUGEINT AS docs, sum(n)::HUGEINT AS terms FROM s),
    tf AS (SELECT r, term, count(*)::HUGEINT AS tf FROM (SELECT r, unnest(words) AS term FROM d) GROUP BY r, term),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    q AS (SELECT DISTINCT item_id, unnest({terms}) AS term FROM benchmark),
    w AS (
        SELECT q.item_id, q.term, floor(1000 * ln((2 * total.docs + 2)::DOUBLE / (2 * df.df + 1)))::HUGEINT AS w
        FROM q JOIN df USING (term), total
    ),
    scored AS (
        SELECT w.item_id, s.r, s.doc_id,
            sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (100 - 90 + (90 * s.n * total.docs) // total.terms)))) AS score
        FROM w JOIN tf USING (term) JOIN s USING (r), total GROUP BY ALL
    ),
    ranked AS (
        SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank
        FROM scored WHERE score > 0
    )
    SELECT item_id, rank::INTEGER AS rank, doc_id, score::BIGINT AS score FROM ranked WHERE rank <= {k}
    """
