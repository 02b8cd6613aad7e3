"""Word n-gram Jaccard join with several global orders of the shingles.

A document is the set of its distinct word shingles. Take any global order of shingles. If two sets of n and m
shingles link, the first p(n) = n - ceil(least * n) + 1 of one and the first p(m) of the other meet; and the first
p(n) + x and p(m) + y meet in more than min(x, y) shingles. A pair is a candidate only if its prefixes meet under
each of several orders; what the filters of all orders leave is verified on whole sets.

Every order takes rare shingles first: shingles are counted over all documents in a table of fixed size, by
hash slot, and a slot's class is how far its count stands above the rest. Within a class each order goes by
its own hash. The orders only decide speed; any of them gives the same links.

1. `profiled` reads each text once: set size, digest of the set, counts by slot. Equal sets are one node.
2. `prefixes` gives half as many shingles again as the prefix of each node under the first order. Shingles of one
   node alone go, and so do nodes with too few shared ones to link with any size of set.
3. `blocked` sends the whole set of each node left to the block of its commonest shared shingle. A task holds a
   bounded number of shingles at a time, intersects the posting lists of all orders, verifies, and keeps a
   spanning forest. Groups too large for a block are cut, and met again in differently mixed blocks.
4. A pair that links meets in a rare one of its shared shingles. Where such a shingle's nodes lie in several blocks,
   those outside the main one visit it (`visits`) and are compared there in the same way. What is left are pairs of
   two visitors that are not connected yet (`crossing`); `checked` filters them by the other orders and verifies
   the rest, in a grid of blocks, so that no node and no pair list meets in one task.

Sets are compared by 64-bit hashes of their shingles; a wrong comparison needs a collision inside one pair.
Shared shingles are found by as many bits of the hash as the table needs, which can only add candidates.
Rows without a word are linked with nothing and are their own component. Null texts are empty. A null doc_id
is ignored when the least doc_id of a component is taken. Rows that repeat are rows of one node. Extra columns
are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewind.llm.common import Stage, bounded, join_groups, text_bytes
from tradewind.llm.components import roots
from tradewind.llm.words import byte_groups

WORDS = 4
#: Least similarity in percent.
LEAST = 85
ORDERS = 3
#: Slots of the table of counts; 4 bytes each in a task, 1 byte each when given to the tasks as classes.
SLOTS = 1 << 20
#: Shingles that a block holds, and about the most that a task holds at a time.
BLOCK_SHINGLES = 1 << 20
#: Times that groups of several blocks are mixed anew.
MIXES = 2
#: Pairs in a block of the grid.
GRID_PAIRS = 4096
#: Bytes of texts that are hashed together, or one longer text.
CHUNK_BYTES = 1 << 20
#: Spare bits of the hashes that find shared shingles: one in 2^12 is shared by chance.
SPARE_BITS = 12

_TURN, _STIR = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _stirred(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * _STIR
    values = (values ^ (values >> np.uint64(29))) * _TURN
    return values ^ (values >> np.uint64(32))


def _powers(base: np.uint64, count: int) -> np.ndarray:
    powers = np.full(count, base, np.uint64)
    powers[:1] = 1
    return np.cumprod(powers)


def _hashed_words(body: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of some texts and each word's text; texts are stretches of the bytes."""
    body = np.where((body >= 65) & (body <= 90), body + 32, body)
    inside = np.concatenate([[False], (body != 32) & ((body < 9) | (body > 13)), [False]])
    cuts = np.zeros(len(body) + 1, bool)
    cuts[bounds] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | cuts))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | cuts))
    lengths = ends - starts
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.cumsum(lengths) - lengths
    place = np.arange(lengths.sum()) - np.repeat(first, lengths)
    letters = body[place + np.repeat(starts, lengths)].astype(np.uint64) + np.uint64(1)
    sums = [np.add.reduceat(letters * _powers(base, int(lengths.max()))[place], first) for base in (_TURN, _STIR)]
    hashed = _stirred(sums[0]) + _stirred(sums[1] ^ lengths.astype(np.uint64))
    return hashed, np.searchsorted(bounds, starts, "right") - 1


def _joined_words(hashed: np.ndarray, words: int) -> np.ndarray:
    """Hashes of all runs of so many words."""
    joined = np.full(len(hashed) - words + 1, words, np.uint64)
    for k in range(words):
        joined = _stirred(joined) + hashed[k : k + len(joined)]
    return _stirred(joined)


def shingle_sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of each text, ascending."""
    body, offsets = text_bytes(texts)
    flat = np.frombuffer(body, np.uint8)
    for low, high in byte_groups(np.diff(offsets).tolist(), CHUNK_BYTES):
        begin, end = offsets[low], offsets[high]
        hashed, owners = _hashed_words(flat[begin:end], offsets[low : high + 1] - begin)
        bounds = np.searchsorted(owners, np.arange(high - low + 1))
        whole = _joined_words(hashed, words) if len(hashed) >= words else np.zeros(0, np.uint64)
        for first, last in zip(bounds[:-1], bounds[1:], strict=True):
            if last - first >= words:
                found = np.sort(whole[first : last - words + 1])
                yield found[np.concatenate([[True], found[1:] != found[:-1]])]
            else:
                yield _joined_words(hashed[first:last], int(last - first)) if last > first else np.zeros(0, np.uint64)


def prefix_length(size: int, least: int = LEAST) -> int:
    return size - -(-least * size // 100) + 1


def spare_length(size: int, least: int = LEAST) -> int:
    """How many shingles more than the prefix are compared to find nodes that share some."""
    return prefix_length(size, least) // 2


def _prefix_column(size: Column, least: int) -> Column:
    return size - F.ceil(size * least / 100) + 1


def _spare_column(size: Column, least: int) -> Column:
    return F.floor(_prefix_column(size, least) / 2)


class Orders:
    """Global orders of shingles: class of the slot, then a hash of the order's own."""

    def __init__(self, classes: bytes, count: int = ORDERS, least: int = LEAST) -> None:
        self.classes = np.frombuffer(zlib.decompress(classes), np.uint8).astype(np.uint64) << np.uint64(56)
        self.count, self.least = count, least

    def prefix(self, shingles: np.ndarray, order: int, spare: int = 0) -> np.ndarray:
        """The first shingles of a set under one order, in that order, and some more."""
        place = self.classes[shingles & np.uint64(len(self.classes) - 1)]
        place = place | _stirred(shingles ^ np.uint64(order << 48)) >> np.uint64(8)
        return shingles[np.argsort(place, kind="stable")[: prefix_length(len(shingles), self.least) + spare]]


def profiled(docs: DataFrame, words: int) -> DataFrame:
    """Per row doc_id, `_key`, size and digest of its set; besides, per task a row with packed counts by slot."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, waiting, held = np.zeros(SLOTS, np.uint32), [], 0

        def counted() -> None:
            if waiting:
                slots = (np.concatenate(waiting) & np.uint64(SLOTS - 1)).astype(np.int64)
                counts[:] += np.bincount(slots, minlength=SLOTS).astype(np.uint32)

        for batch in batches:
            sizes, digests = [], []
            for shingles in shingle_sets(batch.column("_text"), words):
                sizes.append(len(shingles))
                digests.append(hashlib.sha256(shingles.tobytes()).digest())
                waiting.append(shingles)
                held += len(shingles)
                if held > SLOTS:
                    counted()
                    waiting, held = [], 0
            none = pa.nulls(len(sizes), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), none], names=names)
        counted()
        if counts.any():
            nulls = [pa.nulls(1, kind) for kind in (pa.int64(), pa.int64(), pa.int64(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*nulls, pa.array([zlib.compress(counts.tobytes(), 1)], pa.binary())], names=names)

    names = ["doc_id", "_key", "_size", "_digest", "_slots"]
    return docs.select("doc_id", "_key", F.col("text").alias("_text")).mapInArrow(convert, "doc_id bigint, _key bigint, _size bigint, _digest binary, _slots binary")


def _summed(packed: DataFrame) -> DataFrame:
    """One row with the sum of the counts for each task."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.uint64)
        for batch in batches:
            for part in batch.column(0):
                total += np.frombuffer(zlib.decompress(part.as_py()), np.uint32)
        total = np.minimum(total, np.uint64((1 << 32) - 1)).astype(np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], names=["_slots"])

    return packed.mapInArrow(convert, "_slots binary")


def slot_classes(packed: DataFrame) -> bytes:
    """The class of each slot, packed: 0 near the usual count, more the higher the count stands above it."""
    tasks = int(packed.count() ** 0.5) + 1
    rows = _summed(_summed(packed.repartition(tasks)).repartition(1)).collect()
    counts = np.frombuffer(zlib.decompress(rows[0][0]), np.uint32).astype(float) if rows else np.zeros(SLOTS)
    usual = np.median(counts)
    above = (counts - usual) / max(1.0, usual**0.5)
    classes = np.where(above < 4, 0, np.clip(1 + 8 * np.log2(np.maximum(above, 4) / 4), 1, 255)).astype(np.uint8)
    return zlib.compress(classes.tobytes(), 1)


def node_bytes(rows: DataFrame) -> tuple[int, int]:
    """First byte and number of bytes of the digest that tell all sets apart, few for a small table."""
    digests = rows.select("_digest").distinct()
    width = min(8, -(-(2 * max(1, digests.count()).bit_length() + 8) // 8))
    for first in range(1, 34 - width):
        if digests.groupBy(_node((first, width))).count().where("count > 1").isEmpty():
            return first, width
    raise ValueError("sets cannot be told apart by 8 bytes of their digests")


def _node(part: tuple[int, int]) -> Column:
    return F.conv(F.hex(F.substring("_digest", *part)), 16, -10).cast("bigint").alias("node")


def _own_node(shingles: np.ndarray, part: tuple[int, int]) -> int:
    digest = hashlib.sha256(shingles.tobytes()).digest()[part[0] - 1 : part[0] - 1 + part[1]]
    return int.from_bytes(digest, "big", signed=part[1] == 8)


def prefixes(docs: DataFrame, words: int, least: int, classes: bytes, part: tuple[int, int], bits: int) -> DataFrame:
    """token and node for the prefix and spare shingles of each set under the first order."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders, seen = Orders(classes, 1, least), set()
        for batch in batches:
            tokens, nodes = [np.zeros(0, np.uint64)], []
            for shingles in shingle_sets(batch.column("_text"), words):
                node = _own_node(shingles, part)
                if len(shingles) and node not in seen:
                    seen.add(node)
                    tokens.append(orders.prefix(shingles, 0, spare_length(len(shingles), least)))
                    nodes.append(node)
            flat = (np.concatenate(tokens) >> np.uint64(64 - bits)).view(np.int64)
            owners = np.repeat(np.array(nodes, np.int64), [len(t) for t in tokens[1:]])
            yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(owners, pa.int64())], names=["token", "node"])

    return docs.select(F.col("text").alias("_text")).mapInArrow(convert, "token bigint, node bigint")


def whole_sets(docs: DataFrame, words: int, part: tuple[int, int], keep: list[str]) -> DataFrame:
    """node and packed shingles of each text, with kept columns; a task gives each node once."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            rows, nodes, packed = [], [], []
            for row, shingles in enumerate(shingle_sets(batch.column("_text"), words)):
                node = _own_node(shingles, part)
                if len(shingles) and node not in seen:
                    seen.add(node)
                    rows.append(row)
                    nodes.append(node)
                    packed.append(shingles.tobytes())
            kept = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(packed, pa.binary()), *(kept.column(name) for name in keep)], names=["node", "_set", *keep])

    kinds = ", ".join(["node bigint, _set binary", *(f"{name} {docs.schema[name].dataType.simpleString()}" for name in keep)])
    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(convert, kinds)


class Pool:
    """Whole sets of some nodes, their prefixes under all orders and the components known of them."""

    def __init__(self, sets: list[np.ndarray], parts: np.ndarray, orders: Orders) -> None:
        self.orders = orders
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        found, self.flat = np.unique(np.concatenate(sets), return_inverse=True)
        self.marks = np.zeros(len(found), bool)
        self.parts = np.unique(parts, return_inverse=True)[1]
        self.postings = [self._posted(sets, order) for order in range(orders.count)]

    def _posted(self, sets: list[np.ndarray], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of one order: where each node's shingles begin, their groups, where groups begin, and their nodes."""
        lists = [self.orders.prefix(s, order) for s in sets]
        lengths = np.array([len(part) for part in lists])
        groups = np.unique(np.concatenate(lists), return_inverse=True)[1]
        by_group = np.argsort(groups, kind="stable")
        begins = np.concatenate([[0], np.cumsum(np.bincount(groups))])
        return np.concatenate([[0], np.cumsum(lengths)]), groups, begins, np.repeat(np.arange(len(sets)), lengths)[by_group]

    def meeting(self, node: int, order: int) -> np.ndarray:
        """Marks of the nodes whose prefix meets the node's own under an order."""
        starts, groups, begins, nodes = self.postings[order]
        met = np.zeros(len(self.sizes), bool)
        for group in groups[starts[node] : starts[node + 1]]:
            low, high = begins[group], begins[group + 1]
            if high - low > 1:
                met[nodes[low:high]] = True
        return met

    def overlaps(self, node: int, others: np.ndarray) -> np.ndarray:
        """How many shingles a node shares with each of some others."""
        own = self.flat[self.starts[node] : self.starts[node] + self.sizes[node]]
        self.marks[own] = True
        lengths = self.sizes[others]
        begins = np.cumsum(lengths) - lengths
        at = np.arange(lengths.sum()) + np.repeat(self.starts[others] - begins, lengths)
        shared = np.add.reduceat(self.marks[self.flat[at]], begins, dtype=np.int64)
        self.marks[own] = False
        return shared

    def linked(self, node: int, others: np.ndarray) -> list[int]:
        """Of some others, those that link the node with a component it was not in; components are joined."""
        least, size = self.orders.least, self.sizes[node]
        sizes = self.sizes[others]
        others = others[100 * np.minimum(sizes, size) >= least * np.maximum(sizes, size)]
        joined = []
        if len(others):
            near = (100 + least) * self.overlaps(node, others) >= least * (size + self.sizes[others])
            for other in others[near]:
                if self.parts[other] != self.parts[node]:
                    joined.append(int(other))
                    self.parts[self.parts == self.parts[other]] = self.parts[node]
        return joined

    def links(self) -> list[tuple[int, int]]:
        """Places of linked nodes, one link for each join of two components."""
        found = []
        for node in range(len(self.sizes)):
            others = self.parts != self.parts[node]
            others[:node] = False
            for order in range(self.orders.count):
                if not others.any():
                    break
                others &= self.meeting(node, order)
            found += [(node, other) for other in self.linked(node, np.flatnonzero(others))]
        return found


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([pair[k] for pair in pairs], pa.int64()) for k in range(2)], names=["a", "b"])


def blocked(sets: DataFrame, classes: bytes, least: int, orders: int, tasks: int) -> DataFrame:
    """Links a, b that connect all linked nodes of each block; rows are node, `_set`, `_block` and `_part`."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, pool, held, last = Orders(classes, orders, least), {}, 0, None

        def links() -> pa.RecordBatch:
            nodes = list(pool)
            found = Pool([pool[node][0] for node in nodes], np.array([pool[node][1] for node in nodes]), order).links()
            return _edges([(nodes[a], nodes[b]) for a, b in found])

        for batch in batches:
            for node, packed, block, part in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if block != last and held > BLOCK_SHINGLES:
                    yield links()
                    pool, held = {}, 0
                last = block
                if node not in pool:
                    pool[node] = np.frombuffer(packed, np.uint64), part
                    held += len(packed) // 8
        if pool:
            yield links()

    dealt = sets.select("node", "_set", "_block", "_part").repartition(tasks, "_block").sortWithinPartitions("_block")
    return dealt.mapInArrow(convert, "a bigint, b bigint")


def rarest(met: DataFrame, least: int) -> DataFrame:
    """The rows of each node's rarest shared shingles that a pair must meet in.

    A pair shares more than `spare` of them, for the smallest set that the node can link with. So, with the shingles
    in one order for all nodes, rare ones first, it meets before the last `spare` of each node.
    """
    order = Window.partitionBy("node").orderBy("_nodes", "token")
    held = F.count(F.lit(1)).over(Window.partitionBy("node"))
    fewest = _spare_column(F.ceil(F.col("size") * least / 100), least)
    ranked = met.withColumn("_rank", F.row_number().over(order)).withColumn("_held", held)
    return ranked.where(F.col("_rank") <= F.col("_held") - fewest).drop("_rank", "_held", "_nodes")


def opened(rows: DataFrame, places: DataFrame, parts: DataFrame, stage: Stage) -> DataFrame:
    """The rows of shingles whose nodes lie in several blocks and components, with `_main`, the block that holds most.

    `rows` has token, node and size, `places` the block of each node and `parts` its component.
    """
    placed = rows.join(places, "node").join(parts, "node", "left").withColumn("part", F.coalesce("part", "node"))
    placed = stage.put(placed.select("token", "node", "size", "part", "_block"), "placed")
    groups = placed.groupBy("token", "_block").agg(F.count(F.lit(1)).alias("_nodes"), F.min("part").alias("_low"), F.max("part").alias("_high"))
    open_tokens = groups.groupBy("token").agg(
        F.max(F.struct("_nodes", "_block"))["_block"].alias("_main"), F.count(F.lit(1)).alias("_blocks"), F.sum("_nodes").alias("_nodes"), F.min("_low").alias("_low"), F.max("_high").alias("_high")
    )
    open_tokens = stage.put(open_tokens.where("_blocks > 1 AND _low < _high").select("token", "_main", "_nodes"), "open")
    return join_groups(placed, open_tokens, "token", "_nodes", stage, "open-hot").drop("_nodes")


def visits(rows: DataFrame, places: DataFrame, stage: Stage) -> DataFrame:
    """node and `_block`: nodes outside their shingle's main block meet its nodes there.

    Where they are too many, the block is copied, and each copy gets a part of the visitors.
    """
    guests = stage.put(rows.where("_block <> _main").groupBy("_main", "node").agg(F.max("size").alias("size")), "guests")
    cuts = guests.groupBy("_main").agg(F.ceil(F.sum(F.col("size").cast("bigint")) / BLOCK_SHINGLES).cast("int").alias("_cuts"), F.count(F.lit(1)).alias("_guests"))
    cuts = stage.put(cuts, "guest-cuts")
    dealt = join_groups(guests, cuts, "_main", "_guests", stage, "guest-hot").select("node", F.xxhash64("_main", F.pmod(F.xxhash64("node"), F.col("_cuts")).cast("int")).alias("_block"))
    copies = F.explode(F.sequence(F.lit(0), F.col("_cuts") - 1))
    hosts = places.join(cuts.withColumnRenamed("_main", "_block"), "_block").select("node", "_block", copies.alias("_cut"))
    return dealt.unionByName(hosts.select("node", F.xxhash64("_block", "_cut").alias("_block")))


def crossing(rows: DataFrame, parts: DataFrame, least: int) -> DataFrame:
    """Pairs a, b of different components that meet in a shingle outside its main block and come from different blocks."""
    others = rows.where("_block <> _main").drop("part").join(parts, "node", "left").withColumn("part", F.coalesce("part", "node"))
    first = others.select("token", *[F.col(n).alias(f"{n}_a") for n in ("node", "size", "part", "_block")])
    second = others.select("token", *[F.col(n).alias(f"{n}_b") for n in ("node", "size", "part", "_block")])
    fits = (
        (F.col("part_a") != F.col("part_b"))
        & (F.col("_block_a") != F.col("_block_b"))
        & (F.col("node_a") < F.col("node_b"))
        & (100 * F.least("size_a", "size_b") >= least * F.greatest("size_a", "size_b"))
    )
    pairs = first.join(second, (first["token"] == second["token"]) & fits)
    return pairs.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def checked(pairs: DataFrame, sets: DataFrame, classes: bytes, least: int, orders: int) -> DataFrame:
    """The pairs that pass the filters of the other orders and link, as far as they connect components of a block."""
    side = int((pairs.count() / GRID_PAIRS) ** 0.5) + 1
    row, column = F.pmod(F.xxhash64("a"), F.lit(side)), F.pmod(F.xxhash64("b"), F.lit(side))
    placed = pairs.select("a", "b", (row * side + column).alias("_block"))
    needed = placed.select(F.col("_block").alias("_cell"), F.explode(F.array("a", "b")).alias("node")).distinct()
    needed = needed.join(sets.select("node", "_set"), "node")

    def convert(asked: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        given = given.drop_duplicates("node")
        if not len(asked) or not len(given):
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        place = {node: k for k, node in enumerate(given["node"])}
        pool = Pool([np.frombuffer(packed, np.uint64) for packed in given["_set"]], np.arange(len(given)), Orders(classes, orders, least))
        found = []
        for a, group in asked.groupby("a"):
            node, others = place[a], np.array([place[b] for b in group["b"]])
            for order in range(1, orders):
                others = others[pool.meeting(node, order)[others]]
            others = others[pool.parts[others] != pool.parts[node]]
            found += [(a, given["node"].iloc[other]) for other in pool.linked(node, others)]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return placed.groupBy("_block").cogroup(needed.groupBy("_cell")).applyInPandas(convert, "a bigint, b bigint")


def _tasks(spark, shingles: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-shingles // (4 * BLOCK_SHINGLES)))


def shared_prefixes(docs: DataFrame, rows: DataFrame, classes: bytes, part: tuple[int, int], words: int, least: int, stage: Stage) -> tuple[DataFrame, DataFrame]:
    """token, node and size for prefix shingles that several nodes share, of nodes that share enough of them; and these nodes."""
    sizes = stage.put(rows.groupBy(_node(part)).agg(F.max("_size").alias("size"), F.min("_key").alias("_key")), "sizes")
    every = sizes.agg(F.sum(_prefix_column(F.col("size"), least) + _spare_column(F.col("size"), least))).first()[0] or 0
    bits = min(64, int(every).bit_length() + SPARE_BITS)
    entries = stage.put(prefixes(docs, words, least, classes, part, bits), "prefixes")
    shared = entries.groupBy("token").agg(F.min("node").alias("_least"), F.max("node").alias("_most"), F.count(F.lit(1)).alias("_nodes"))
    shared = stage.put(shared.where("_least <> _most").select("token", "_nodes"), "shared")
    met = join_groups(entries, shared, "token", "_nodes", stage, "shared-hot").select("node", "token")
    met = stage.put(met.repartition("node").distinct(), "met")
    stage.drop("prefixes")
    # The least set that a node can link with has ceil(least * size) shingles.
    fewest = _spare_column(F.ceil(F.col("size") * least / 100), least)
    alive = met.groupBy("node").agg(F.count(F.lit(1)).alias("_shared")).join(sizes, "node").where(F.col("_shared") > fewest)
    alive = stage.put(alive.select("node", "size", "_key"), "alive")
    kept = stage.put(met.join(bounded(alive.select("node", "size"), alive.count(), 24), "node"), "kept")
    several = kept.groupBy("token").agg(F.count(F.lit(1)).alias("_nodes")).where("_nodes > 1")
    return join_groups(kept, stage.put(several, "several"), "token", "_nodes", stage, "several-hot"), alive


def links(docs: DataFrame, rows: DataFrame, classes: bytes, part: tuple[int, int], words: int, least: int, orders: int, stage: Stage) -> DataFrame:
    """Links a, b of nodes that connect all sets that link, directly or by way of others."""
    spark = docs.sparkSession
    met, alive = shared_prefixes(docs, rows, classes, part, words, least, stage)
    met = stage.put(met, "candidates")
    homes = stage.put(met.groupBy("node").agg(F.max(F.struct("_nodes", "token"))["token"].alias("_home"), F.max("size").alias("size")), "homes")
    sizes = homes.groupBy("_home").agg(F.count(F.lit(1)).alias("_homed"), F.ceil(F.sum("size") / BLOCK_SHINGLES).alias("_pieces"))
    homes = stage.put(join_groups(homes, stage.put(sizes, "home-sizes"), "_home", "_homed", stage, "home-hot").drop("_homed"), "homed")
    totals = homes.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max("_pieces"), F.lit(0))).first()

    def block(mix: int) -> Column:
        return F.xxhash64("_home", F.pmod(F.xxhash64("node", F.lit(mix)), F.col("_pieces"))).alias("_block")

    wanted = stage.put(homes.join(alive.select("node", "_key"), "node").select("_key", block(0)), "wanted")
    found = docs.select("_key", "text").join(bounded(wanted, totals[0], 40), "_key")
    sets = stage.put(whole_sets(found, words, part, ["_block"]), "sets")
    tasks = _tasks(spark, totals[1])
    linked = stage.put(blocked(sets.withColumn("_part", F.col("node")), classes, least, orders, tasks), "links-0")
    cut = homes.where("_pieces > 1")
    for number in range(1, MIXES + 1 if totals[2] > 1 else 1):
        parts = roots(linked, Stage(spark, "ngram-mix")).withColumnRenamed("root", "_part")
        mixed = cut.join(parts, "node", "left").select("node", block(number), F.coalesce("_part", "node").alias("_part"))
        more = blocked(sets.drop("_block").join(mixed, "node"), classes, least, orders, tasks)
        linked = linked.unionByName(stage.put(more, f"links-{number}"))
    parts = roots(linked, Stage(spark, "ngram-parts")).select("node", F.col("root").alias("part"))
    places = homes.select("node", block(0))
    left = stage.put(opened(stage.put(rarest(met, least), "rarest"), places, parts, stage), "open-rows")
    met_again = sets.drop("_block").join(visits(left, places, stage).join(parts.withColumnRenamed("part", "_part"), "node", "left"), "node")
    met_again = met_again.withColumn("_part", F.coalesce("_part", "node"))
    linked = linked.unionByName(stage.put(blocked(met_again, classes, least, orders, tasks), "links-visits"))
    parts = roots(linked, Stage(spark, "ngram-visits")).select("node", F.col("root").alias("part"))
    pairs = stage.put(crossing(left, parts, least), "pairs")
    return linked.unionByName(stage.put(checked(pairs, sets, classes, least, orders), "links-last"))


def joined(docs: DataFrame, words: int = WORDS, least: int = LEAST, orders: int = ORDERS) -> DataFrame:
    """One row per document: the size of its set and the smallest doc_id reachable over links, itself included."""
    stage = Stage(docs.sparkSession, "ngram")
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    docs = docs.withColumn("_key", F.xxhash64("doc_id", "text"))
    profile = stage.put(profiled(docs, words), "profile")
    rows = profile.where("_digest IS NOT NULL")
    classes = slot_classes(profile.where("_slots IS NOT NULL").select("_slots"))
    filled = rows.where("_size > 0")
    part = node_bytes(filled)
    tree = roots(stage.put(links(docs, filled, classes, part, words, least, orders, stage), "links"), Stage(docs.sparkSession, "ngram-roots"))
    nodes = filled.groupBy(_node(part)).agg(F.min("doc_id").alias("_least"), F.count(F.lit(1)).alias("_rows"))
    nodes = stage.put(nodes.join(tree, "node", "left").withColumn("root", F.coalesce("root", "node")), "nodes")
    least_ids = nodes.groupBy("root").agg(F.min("_least").alias("component_id"), F.count(F.lit(1)).alias("_nodes"))
    settled = stage.put(join_groups(nodes, stage.put(least_ids, "least"), "root", "_nodes", stage, "root-hot").select("node", "component_id", "_rows"), "settled")
    held = join_groups(filled.select("doc_id", "_size", _node(part)), settled, "node", "_rows", stage, "node-hot", F.monotonically_increasing_id())
    alone = rows.where("_size = 0").select("doc_id", F.col("_size").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return held.select("doc_id", F.col("_size").alias("n_shingles"), "component_id").unionByName(alone)
