"""Near-duplicate groups by SimHash and multi-index hashing.

A fingerprint has 64 bits, each set if it is set in over half of the XXH64 values (seed 42) of the text's
word shingles, repeats included. Fingerprints at most `most` bits apart are linked. The bits are cut into
three segments. If two fingerprints differ in at most four bits, then they differ in at most one bit in
the first or the second segment, or not at all in the third. So each distinct fingerprint is entered in
three tables under its segment values, and looks up the small Hamming balls around them: 1 + 22, 1 + 21
and 1 values. Matches are verified over all 64 bits.

Equal fingerprints are one node, so copies cost nothing. Within a task, verified links are folded into a
spanning forest, so at most one link per fingerprint leaves it and no group gives all its pairs; a table
entry that many fingerprints share is spread over several tasks by splitting the look-ups.

Null and empty texts have fingerprint zero and link like any other. A null doc_id is ignored when the
least doc_id of a component is taken, so a component of only such rows has a null id. Rows that repeat
are fingerprinted one by one. Extra columns are ignored by `near_groups` and kept by `kept_documents`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.llm.common import Stage, bounded, filter_by_keys, whole_rows
from tradewind.llm.components import roots

WORDS = 4
MOST_BITS = 4
SEED = 42
#: First bit, width and ball radius of each segment; the radii plus one add up to MOST_BITS + 1.
SEGMENTS = ((0, 22, 1), (22, 21, 1), (43, 21, 0))
PIECE_ENTRIES = 4096
CHUNK_PAIRS = 1 << 20
TASK_ROWS = 400_000

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_HASHES = 8192


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The unsigned fingerprint of one text."""
    import xxhash

    tokens = _WORD.findall((text or "").encode().lower())
    if not tokens:
        return 0
    hash64 = xxhash.xxh64_intdigest
    count = max(1, len(tokens) - words + 1)
    votes = np.zeros(64, dtype=np.int64)
    for start in range(0, count, _HASHES):
        stop = min(count, start + _HASHES)
        values = np.array([hash64(b" ".join(tokens[k : k + words]), SEED) for k in range(start, stop)], dtype="<u8")
        votes += np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > count, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS, keep: list[str] | None = None) -> DataFrame:
    """The kept columns and `_print`, the fingerprint as a signed long."""
    keep = ["doc_id"] if keep is None else keep

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(text, words) for text in batch.column("_text").to_pylist()]
            prints = pa.array(np.array(values, dtype=np.uint64).view(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(name) for name in keep), prints], names=[*keep, "_print"])

    kinds = ", ".join([*(f"`{name}` {docs.schema[name].dataType.simpleString()}" for name in keep), "_print bigint"])
    return docs.select(*[F.col(name) for name in keep], F.col("text").alias("_text")).mapInArrow(convert, kinds)


class _Forest:
    """Links between fingerprints folded into one tree per group."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, node: int) -> int:
        up = self.up
        top = node
        while (above := up.get(top, top)) != top:
            top = above
        while (above := up.get(node, node)) != top:
            up[node] = top
            node = above
        return top

    def link(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def roots(self, nodes: np.ndarray) -> np.ndarray:
        return np.array([self.root(node) for node in nodes.tolist()], dtype=np.int64)


def _linked(entries: np.ndarray, entry_prints: np.ndarray, keys: np.ndarray, prints: np.ndarray, most: int) -> dict[int, int]:
    """The forest of verified links between look-ups and the entries under their keys."""
    order = np.argsort(entries, kind="stable")
    entries, entry_prints = entries[order], entry_prints[order]
    low, high = np.searchsorted(entries, keys, "left"), np.searchsorted(entries, keys, "right")
    met = np.flatnonzero(high > low)
    low, counts, prints = low[met], (high - low)[met], prints[met]
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    forest = _Forest()
    for start in range(0, total, CHUNK_PAIRS):
        pair = np.arange(start, min(total, start + CHUNK_PAIRS))
        row = np.searchsorted(ends, pair, "right")
        a = prints[row]
        b = entry_prints[low[row] + pair - (ends[row] - counts[row])]
        near = (np.bitwise_count((a ^ b).view(np.uint64)) <= most) & (a != b)
        a, b = a[near], b[near]
        if len(a):
            nodes, places = np.unique(np.concatenate([a, b]), return_inverse=True)
            tops = forest.roots(nodes)[places]
            apart = tops[: len(a)] != tops[len(a) :]
            for x, y in np.unique(np.stack([tops[: len(a)][apart], tops[len(a) :][apart]]), axis=1).T.tolist():
                forest.link(x, y)
    return forest.up


def links(nodes: DataFrame, stage: Stage, most: int = MOST_BITS) -> DataFrame:
    """Links a, b that connect all fingerprints at most `most` bits apart, directly or by way of others."""
    if sum(radius + 1 for _, _, radius in SEGMENTS) <= most:
        raise ValueError(f"the segments find differences of up to {sum(r + 1 for _, _, r in SEGMENTS) - 1} bits")

    def key(number: int, flip: str) -> str:
        first, width, _ = SEGMENTS[number]
        return f"(shiftrightunsigned(_print, {first}) & {(1 << width) - 1}L ^ {flip}) * 4 + {number}"

    own = F.array(*[F.expr(key(n, "0L")) for n in range(len(SEGMENTS))])
    entries = nodes.select(F.explode(own).alias("_key"), "_print")
    balls = [
        F.expr(f"transform(array({', '.join(['0L', *(f'{1 << bit}L' for bit in range(width) if radius)])}), flip -> {key(n, 'flip')})")
        for n, (_, width, radius) in enumerate(SEGMENTS)
    ]
    lookups = nodes.select(F.explode(F.concat(*balls)).alias("_key"), "_print")
    hot = entries.groupBy("_key").agg(F.count(F.lit(1)).alias("_entries")).where(F.col("_entries") > PIECE_ENTRIES)
    hot = stage.put(hot.select("_key", F.ceil(F.col("_entries") / PIECE_ENTRIES).cast("int").alias("_pieces")), "hot")
    hot_count = hot.count()
    zero = F.lit(0)
    if hot_count:
        hot = bounded(hot, hot_count, 16)
        entries = entries.join(hot, "_key", "left").select("_key", "_print", F.explode(F.sequence(zero, F.coalesce("_pieces", F.lit(1)) - 1)).alias("_piece"))
        piece = F.pmod(F.xxhash64("_print"), F.coalesce("_pieces", F.lit(1))).cast("int")
        lookups = lookups.join(hot, "_key", "left").select("_key", "_print", piece.alias("_piece"))
    else:
        entries, lookups = entries.withColumn("_piece", zero), lookups.withColumn("_piece", zero)
    rows = entries.withColumn("_entry", F.lit(True)).unionByName(lookups.withColumn("_entry", F.lit(False)))
    spark = nodes.sparkSession
    per_node = len(SEGMENTS) + sum(1 + width * radius for _, width, radius in SEGMENTS)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-nodes.count() * per_node // TASK_ROWS))

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[np.asarray(batch.column(k)) for k in range(3)] for batch in batches]
        if parts:
            keys, prints, is_entry = (np.concatenate([part[k] for part in parts]) for k in range(3))
            up = _linked(keys[is_entry], prints[is_entry], keys[~is_entry], prints[~is_entry], most)
            yield pa.RecordBatch.from_arrays([pa.array(list(up), pa.int64()), pa.array(list(up.values()), pa.int64())], names=["a", "b"])

    dealt = rows.repartition(tasks, "_key", "_piece").select(F.expr("_key * 1048576 + _piece").alias("_key"), "_print", "_entry")
    return dealt.mapInArrow(convert, "a bigint, b bigint")


def _components(docs: DataFrame, words: int, most: int, stage: Stage, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Rows with their fingerprint and kept columns, and the least doc_id reachable from each fingerprint."""
    rows = stage.put(fingerprints(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", *keep), words, ["doc_id", *keep]), "prints")
    nodes = stage.put(rows.groupBy("_print").agg(F.min("doc_id").alias("_least")), "nodes")
    tree = roots(stage.put(links(nodes.select("_print"), stage, most), "links"), stage)
    rooted = nodes.join(tree.withColumnRenamed("node", "_print"), "_print", "left").withColumn("root", F.coalesce("root", "_print"))
    rooted = stage.put(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min("_least").alias("component_id"))
    return rows, rooted.join(least, "root").select("_print", "component_id")


def near_groups(docs: DataFrame, words: int = WORDS, most: int = MOST_BITS) -> DataFrame:
    """One row per document: its fingerprint and the smallest doc_id reachable over links."""
    rows, found = _components(docs, words, most, Stage(docs.sparkSession, "simhash"))
    return rows.join(found, "_print").select("doc_id", F.lpad(F.lower(F.hex("_print")), 16, "0").alias("fingerprint"), "component_id")


def kept_documents(docs: DataFrame, words: int = WORDS, most: int = MOST_BITS) -> DataFrame:
    """One document of each group, the one with the smallest doc_id, with all its columns.

    Rows without a doc_id stay. Rows with this doc_id in the group all stay; a doc_id with several texts can be
    the least of one group and go from another.
    """
    stage = Stage(docs.sparkSession, "simhash")
    doc_id = F.col("doc_id").cast("bigint")
    key = F.sha2(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit(""))), 256).alias("_key")
    rows, found = _components(docs.select("doc_id", "text", key), words, most, stage, ("_key",))
    away = stage.put(rows.join(found, "_print").where("doc_id <> component_id").select("_key").distinct(), "away")
    return filter_by_keys(docs.select(whole_rows(docs), key), away, ["_key"], "left_anti", away.count(), 100).select("_doc.*")
