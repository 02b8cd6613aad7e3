"""Vector code compression: product codebooks by dual-tree Lloyd rounds on integers.

Components become integers and vectors are cut into equal parts; each part position has a codebook. Rows are
worked in blocks. In a block, the parts at a position stand in a tree (halved along the widest component, with
box, count and component sums cached per node), and so do the codebook's entries. A round walks the two
trees together: the least distance between a node's box and an entry box, held against the smallest of the
largest distances, drops whole entry nodes for whole nodes of parts. A node of parts left with one entry is
assigned at once and its cached sums go to the entry. Parts in leaves that stay uncertain are compared with the
entries left to them. All arithmetic is on integers, so bounds are exact and ties go to the lower index: an
entry goes only when it is strictly farther, and of equal entries the first alone stays in the tree.

A round's sums, a row for each position and entry, are the only thing that meets; they number `entries` times
`parts` whatever the table. Vectors are read again in each round from a staged table.

Vectors that are null or hold null or non-finite components take no part. Shorter vectors are filled with zeros
to the longest one's length, rounded up to a positive multiple of the parts. Components beyond 2^24 after
scaling are cut to it, so that squared distances fit 64 bits up to 8,192 components. The first entries are taken by vec_id, null
last, then by vector, where ids repeat. With fewer vectors than entries, codebooks are as short as the table.
An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.llm.common import Stage, join_groups

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Rows of a block; its trees are built and dropped together.
BLOCK_ROWS = 8192
#: Parts in a leaf of the tree over parts, and entries in a leaf of the tree over entries.
LEAF_PARTS = 16
LEAF_ENTRIES = 4
_MOST = 1 << 24

class Tree:
    """Points halved along their widest component, level by level; nodes are stretches of `order`."""

    def __init__(self, points: np.ndarray, leaf: int) -> None:
        self.points, self.order = points, np.arange(len(points))
        #: Per level: begin, end, least and most components, sums, and whether the node is cut. A cut node's
        #: halves are the next level's nodes 2k and 2k + 1, k its rank among the cut ones.
        self.levels: list[tuple[np.ndarray, ...]] = []
        begins, ends = np.array([0]), np.array([len(points)])
        while True:
            lengths = ends - begins
            first = np.cumsum(lengths) - lengths
            at = np.arange(lengths.sum()) + np.repeat(begins - first, lengths)
            own = points[self.order[at]]
            least, most, sums = (call.reduceat(own, first) for call in (np.minimum, np.maximum, np.add))
            widths = most - least
            cut = (lengths > leaf) & (widths.max(axis=1) > 0)
            self.levels.append((begins, ends, least, most, sums, cut))
            if not cut.any():
                return
            node = np.repeat(np.arange(len(begins)), lengths)
            value = own[np.arange(len(at)), widths.argmax(axis=1)[node]]
            self.order[at] = self.order[at][np.lexsort((value, node))]
            middle = (begins + ends) // 2
            begins, ends = np.stack([begins, middle], axis=1)[cut].ravel(), np.stack([middle, ends], axis=1)[cut].ravel()


class EntryTree:
    """The distinct entries of one codebook in a tree, as frontiers from the root down to single entries."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        first = np.sort(np.unique(entries, axis=0, return_index=True)[1])
        tree = Tree(entries[first], LEAF_ENTRIES)
        #: Per frontier: each node's place in the frontier above, and the boxes.
        self.frontiers: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        nodes = [(0, 0)]
        above = np.zeros(1, np.int64)
        while True:
            boxes = [(tree.levels[level][2][node], tree.levels[level][3][node]) for level, node in nodes]
            self.frontiers.append((above, np.stack([b[0] for b in boxes]), np.stack([b[1] for b in boxes])))
            below = []
            for place, (level, node) in enumerate(nodes):
                cut = tree.levels[level][5]
                halves = [(level + 1, 2 * int(cut[:node].sum()) + k) for k in range(2)] if cut[node] else [(level, node)]
                below += [(place, half) for half in halves]
            if len(below) == len(nodes):
                break
            above, nodes = np.array([place for place, _ in below]), [half for _, half in below]
        members = [(place, entry) for place, (level, node) in enumerate(nodes) for entry in tree.order[tree.levels[level][0][node] : tree.levels[level][1][node]]]
        members.sort(key=lambda member: member[1])
        own = entries[first]
        #: The last frontier has the entries themselves, by index.
        self.indexes = first[[entry for _, entry in members]]
        self.frontiers.append((np.array([place for place, _ in members]), own[[entry for _, entry in members]], own[[entry for _, entry in members]]))


def _pruned(alive: np.ndarray, least: np.ndarray, most: np.ndarray, entry_least: np.ndarray, entry_most: np.ndarray) -> np.ndarray:
    """Which entry nodes may still hold the nearest entry of some part in each node, by distances between boxes."""
    low, high = entry_least[None] - most[:, None], least[:, None] - entry_most[None]
    nearest = (np.maximum(np.maximum(low, high), 0) ** 2).sum(axis=2)
    farthest = (np.maximum(np.abs(low), np.abs(high)) ** 2).sum(axis=2)
    return alive & (nearest <= np.where(alive, farthest, np.iinfo(np.int64).max).min(axis=1)[:, None])


def _spread(begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return np.arange(lengths.sum()) + np.repeat(begins - np.cumsum(lengths) + lengths, lengths)


def assigned(tree: Tree, entries: EntryTree, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The nearest entry of every part; sums and counts of the entries grow by their parts."""
    codes, last = np.zeros(len(tree.points), np.int64), len(entries.frontiers) - 1
    rows, alive, depth = np.array([0]), np.ones((1, 1), bool), 0

    def narrowed(alive: np.ndarray, depth: int, rows: np.ndarray) -> np.ndarray:
        above, entry_least, entry_most = entries.frontiers[depth]
        return _pruned(alive[:, above], least[rows], most[rows], entry_least, entry_most)

    def settled(rows: np.ndarray, alive: np.ndarray) -> np.ndarray:
        """Whole nodes with one entry left are assigned by their cached sums."""
        sure = alive.sum(axis=1) == 1
        nodes, chosen = rows[sure], entries.indexes[alive[sure].argmax(axis=1)]
        lengths = (ends - begins)[nodes]
        np.add.at(sums, chosen, node_sums[nodes])
        np.add.at(counts, chosen, lengths)
        codes[tree.order[_spread(begins[nodes], lengths)]] = np.repeat(chosen, lengths)
        return sure

    def compared(rows: np.ndarray, alive: np.ndarray) -> None:
        """Parts of leaves with several entries left meet each of these."""
        lengths = (ends - begins)[rows]
        parts = tree.order[_spread(begins[rows], lengths)]
        open_entries = np.repeat(alive, lengths, axis=0)
        part, entry = np.nonzero(open_entries)
        distance = ((tree.points[parts[part]] - entries.entries[entries.indexes[entry]]) ** 2).sum(axis=1)
        met = open_entries.sum(axis=1)
        first = np.cumsum(met) - met
        nearest = distance == np.repeat(np.minimum.reduceat(distance, first), met)
        chosen = entries.indexes[np.minimum.reduceat(np.where(nearest, entry, len(entries.indexes)), first)]
        codes[parts] = chosen
        np.add.at(sums, chosen, tree.points[parts])
        np.add.at(counts, chosen, 1)

    for begins, ends, least, most, node_sums, cut in tree.levels:
        if not len(rows):
            break
        if depth < last:
            depth += 1
            alive = narrowed(alive, depth, rows)
        else:
            alive = _pruned(alive, least[rows], most[rows], *entries.frontiers[last][1:])
        leaves, leaf_alive = rows[~cut[rows]], alive[~cut[rows]]
        for below in range(depth + 1, last + 1):
            leaf_alive = narrowed(leaf_alive, below, leaves)
        if len(leaves):
            doubtful = ~settled(leaves, leaf_alive)
            if doubtful.any():
                compared(leaves[doubtful], leaf_alive[doubtful])
        rows, alive = rows[cut[rows]], alive[cut[rows]]
        if depth == last and len(rows):
            doubtful = ~settled(rows, alive)
            rows, alive = rows[doubtful], alive[doubtful]
        halves = 2 * (np.cumsum(cut) - 1)[rows]
        rows, alive = np.stack([halves, halves + 1], axis=1).ravel(), np.repeat(alive, 2, axis=0)
    return codes


def integers(vectors: DataFrame, vector: str, keep: list[str], parts: int, stage: Stage) -> tuple[DataFrame, int]:
    """The kept columns and `_ints`, the integer components of all vectors that take part, of one length."""
    value = F.col(vector)
    sound = value.isNotNull() & ~F.exists(value, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    kept = vectors.where(sound)
    longest = kept.agg(F.max(F.size(value))).first()[0]
    width = parts * max(1, -(-(longest or 0) // parts))
    scaled = F.transform(value, lambda x: F.floor(F.greatest(F.least(x.cast("double") * SCALE, F.lit(float(_MOST))), F.lit(float(-_MOST)))).cast("int"))
    filled = F.concat(scaled, F.array_repeat(F.lit(0), width - F.size(value)))
    return stage.put(kept.select(*[F.col(name) for name in keep], filled.alias("_ints")), "integers"), width


def _blocks(batch: pa.RecordBatch, parts: int, width: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for first in range(0, batch.num_rows, BLOCK_ROWS):
        block = batch.slice(first, BLOCK_ROWS)
        ints = block.column(block.num_columns - 1).flatten().to_numpy().astype(np.int64).reshape(-1, width)
        yield block, np.split(ints, parts, axis=1)


def moved(vectors: DataFrame, books: np.ndarray, width: int) -> np.ndarray:
    """The codebooks after one round: floors of the means of each entry's parts; unused entries stay."""
    parts, entries, size = books.shape

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [EntryTree(book) for book in books]
        sums, counts = np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            for _, cuts in _blocks(batch, parts, width):
                for part, points in enumerate(cuts):
                    assigned(Tree(points, LEAF_PARTS), trees[part], sums[part], counts[part])
        used = np.flatnonzero(np.repeat(counts.ravel(), size))
        columns = [used, sums.ravel()[used], np.repeat(counts.ravel(), size)[used]]
        yield pa.RecordBatch.from_arrays([pa.array(column, pa.int64()) for column in columns], names=["cell", "total", "count"])

    found = vectors.select("_ints").mapInArrow(convert, "cell bigint, total bigint, count bigint")
    rows = found.groupBy("cell").agg(F.sum("total"), F.sum("count")).collect()
    after = books.ravel().copy()
    for cell, total, count in rows:
        after[cell] = total // count
    return after.reshape(books.shape)


def coded(vectors: DataFrame, books: np.ndarray, width: int, keep: list[str]) -> DataFrame:
    """The kept columns, `code` and `error` of every vector."""
    parts = len(books)

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [EntryTree(book) for book in books]
        for batch in batches:
            for block, cuts in _blocks(batch, parts, width):
                codes, error = np.zeros((block.num_rows, parts), np.uint8), np.zeros(block.num_rows, np.int64)
                for part, points in enumerate(cuts):
                    book = books[part]
                    codes[:, part] = assigned(Tree(points, LEAF_PARTS), trees[part], np.zeros_like(book), np.zeros(len(book), np.int64))
                    error += ((points - book[codes[:, part]]) ** 2).sum(axis=1)
                text = codes.tobytes().hex()
                shown = [text[k : k + 2 * parts] for k in range(0, len(text), 2 * parts)]
                yield pa.RecordBatch.from_arrays([*(block.column(name) for name in keep), pa.array(shown, pa.string()), pa.array(error)], names=[*keep, "code", "error"])

    kinds = ", ".join([*(f"`{name}` {vectors.schema[name].dataType.simpleString()}" for name in keep), "code string, error bigint"])
    return vectors.select(*[F.col(name) for name in keep], "_ints").mapInArrow(convert, kinds)


def first_books(vectors: DataFrame, entries: int, parts: int) -> np.ndarray:
    """Parts of the first vectors by id as the first entries: an array by part, entry and component."""
    rows = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "_ints").limit(entries).select("_ints").collect()
    return np.stack(np.split(np.array([row[0] for row in rows], np.int64), parts, axis=1))


def compressed(embeddings: DataFrame, vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """One row per vector that takes part: its code, squared error, the error of its label, and the codebooks' digest."""
    stage = Stage(embeddings.sparkSession, "codebooks")
    label = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("null")).alias("_label")
    vectors, width = integers(embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), label, F.col(vector).alias("_vector")), "_vector", ["vec_id", "_label"], parts, stage)
    kinds = "vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string"
    if vectors.isEmpty():
        return embeddings.sparkSession.createDataFrame([], kinds)
    books = first_books(vectors, entries, parts)
    for _ in range(rounds):
        books = moved(vectors, books, width)
    found = stage.put(coded(vectors, books, width, ["vec_id", "_label"]), "coded")
    labels = found.groupBy("_label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("_rows"))
    joined = join_groups(found, stage.put(labels, "labels"), "_label", "_rows", stage, "hot-labels", F.monotonically_increasing_id())
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
