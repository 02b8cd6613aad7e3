"""Shards of equal bytes from a k-d tree over document metadata.

The tree starts with all documents and the number of shards. A node of several shards is cut along the
dimension in which its documents spread widest, relative to the spread of all, at the weighted quantile
that gives each side the bytes of its shards; with an even number that is the weighted median. It ends
when every leaf holds one shard, which is the target number of bytes.

All nodes of a level are cut together. One aggregation finds each node's extents and an equal-count
grid of possible cuts for every dimension with quantile sketches of fixed size; another sums the bytes
between neighbouring cuts, in the tasks first. Only these sums reach the driver; their number depends on
the shards alone. A coordinate carries a digest of the document in its low bits, so a value that a third
of all documents share can be cut anywhere.

Slots number the documents of a shard without gaps. They come from counts per shard and digest group, so
that no task orders a whole shard. A null text has no bytes of its own; null metadata count as the
lowest value. Rows that repeat differ by their row number in the digest, so they are placed one by one; which of
them goes where depends on the layout of the table. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewind.llm.common import Stage, bounded

SHARDS = 24
ROW_BYTES = 8
CUTS_PER_SHARD = 256
SKETCH = 20_000
COORDINATE_BITS = 24
DIGEST_BITS = 28
SLOT_GROUPS = 8
SLOT_GROUP_ROWS = 100_000

DIMENSIONS = ("_doc_id", "_size", "_source", "_lang", "_chars")


@dataclass(frozen=True)
class Cut:
    """A node of several shards: documents whose coordinate lies below the value go to the first ones."""

    first: int
    shards: int
    dimension: int
    value: float


def text_size(text: str = "text") -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("bigint")


def _word_code(name: str) -> Column:
    """The first six bytes of a word as a number, in the order of the words."""
    head = F.rpad(F.hex(F.substring(F.encode(F.coalesce(F.col(name).cast("string"), F.lit("")), "utf-8"), 1, 6)), 12, "0")
    return F.conv(head, 16, 10).cast("bigint")


def _items(docs: DataFrame, stage: Stage) -> DataFrame:
    chars = F.col("n_chars").cast("bigint") if "n_chars" in docs.columns else F.lit(None).cast("bigint")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        text_size().alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-1)).alias("_doc_id"),
        text_size().alias("_size"),
        (_word_code("source") if "source" in docs.columns else F.lit(0).cast("bigint")).alias("_source"),
        (_word_code("lang") if "lang" in docs.columns else F.lit(0).cast("bigint")).alias("_lang"),
        F.coalesce(chars, F.lit(-1)).alias("_chars"),
    )
    digest = F.xxhash64("doc_id", "text_crc32", "size", F.monotonically_increasing_id()).bitwiseAND(F.lit((1 << DIGEST_BITS) - 1))
    return stage.put(rows.withColumn("_digest", digest), "items")


def _coordinates(items: DataFrame) -> tuple[DataFrame, int]:
    """Each dimension scaled to the spread of all documents, with the digest in the low bits."""
    extents = items.agg(*[F.min(d).alias(f"{d}_least") for d in DIMENSIONS], *[F.max(d).alias(f"{d}_most") for d in DIMENSIONS], F.count(F.lit(1)).alias("_rows")).first()
    scale = (1 << COORDINATE_BITS) - 1
    columns = []
    for d in DIMENSIONS:
        least, most = extents[f"{d}_least"] or 0, extents[f"{d}_most"] or 0
        share = (F.col(d) - F.lit(least)).cast("double") / F.lit(float(max(1, most - least)))
        place = F.floor(share * F.lit(scale)).cast("bigint")
        columns.append((F.shiftleft(place, DIGEST_BITS) + F.col("_digest")).cast("double").alias(d))
    return items.select("doc_id", "size", "text_crc32", "_digest", *columns), extents["_rows"]


def _descend(columns: list[np.ndarray], cuts: list[Cut], shards: int) -> tuple[np.ndarray, np.ndarray]:
    """First shard and number of shards of the node that each document has reached."""
    first = np.zeros(len(columns[0]), dtype=np.int64)
    count = np.full(len(columns[0]), shards, dtype=np.int64)
    for cut in cuts:
        here = np.flatnonzero((first == cut.first) & (count == cut.shards))
        low = columns[cut.dimension][here] < cut.value
        left = cut.shards // 2
        count[here] = np.where(low, left, cut.shards - left)
        first[here] += np.where(low, 0, left)
    return first, count


def _placed(rows: DataFrame, cuts: list[Cut], shards: int) -> DataFrame:
    """Rows with `_first` and `_shards` of their node."""
    names = rows.columns

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, count = _descend([batch.column(d).to_numpy() for d in DIMENSIONS], cuts, shards)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first, pa.int64()), pa.array(count, pa.int64())], names=[*names, "_first", "_shards"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(convert, f"{fields}, _first bigint, _shards bigint")


def _sums(rows: DataFrame, cuts: list[Cut], grids: dict[tuple[int, int], tuple[int, np.ndarray]], shards: int) -> DataFrame:
    """Bytes between neighbouring cuts of each open node, summed within the tasks."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {node: np.zeros(len(grid) + 1, dtype=np.int64) for node, (_, grid) in grids.items()}
        for batch in batches:
            columns = [batch.column(d).to_numpy() for d in DIMENSIONS]
            size = batch.column("size").to_numpy()
            first, count = _descend(columns, cuts, shards)
            for node, (dimension, grid) in grids.items():
                here = np.flatnonzero((first == node[0]) & (count == node[1]))
                bins = np.searchsorted(grid, columns[dimension][here], "right")
                np.add.at(totals[node], bins, size[here])
        for (start, number), total in totals.items():
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(used), start)), pa.array(np.full(len(used), number)), pa.array(used.astype(np.int64)), pa.array(total[used])],
                names=["_first", "_shards", "_bin", "_bytes"],
            )

    parts = rows.select(*DIMENSIONS, "size").mapInArrow(convert, "_first bigint, _shards bigint, _bin bigint, _bytes bigint")
    return parts.groupBy("_first", "_shards", "_bin").agg(F.sum("_bytes").alias("_bytes"))


def build_tree(rows: DataFrame, shards: int) -> list[Cut]:
    """The cuts of all nodes, upper ones first."""
    cuts: list[Cut] = []
    while True:
        open_rows = _placed(rows.select(*DIMENSIONS, "size"), cuts, shards).where("_shards > 1")
        widest = {}
        extents = open_rows.groupBy("_first", "_shards").agg(*[F.min(d).alias(f"{d}_least") for d in DIMENSIONS], *[F.max(d).alias(f"{d}_most") for d in DIMENSIONS])
        for row in extents.collect():
            spread = [row[f"{d}_most"] - row[f"{d}_least"] for d in DIMENSIONS]
            widest[row["_first"], row["_shards"]] = int(np.argmax(spread))
        if not widest:
            return cuts
        chosen = F.coalesce(*[F.when((F.col("_first") == a) & (F.col("_shards") == b), F.col(DIMENSIONS[d])) for (a, b), d in widest.items()])
        most = max(b for _, b in widest)
        percents = [k / (CUTS_PER_SHARD * most) for k in range(1, CUTS_PER_SHARD * most)]
        found = open_rows.withColumn("_chosen", chosen).groupBy("_first", "_shards").agg(F.percentile_approx("_chosen", percents, SKETCH).alias("_grid"))
        grids = {(r["_first"], r["_shards"]): (widest[r["_first"], r["_shards"]], np.unique(np.array(r["_grid"]))) for r in found.collect()}
        sums: dict[tuple[int, int], np.ndarray] = {node: np.zeros(len(grid) + 1, dtype=np.int64) for node, (_, grid) in grids.items()}
        for row in _sums(rows, cuts, grids, shards).collect():
            sums[row["_first"], row["_shards"]][row["_bin"]] = row["_bytes"]
        level = []
        for (first, number), (dimension, grid) in grids.items():
            upto = np.cumsum(sums[first, number])
            wanted = upto[-1] * (number // 2) / number
            level.append(Cut(first, number, dimension, float(grid[int(np.argmin(np.abs(upto[:-1] - wanted)))])))
        cuts += level


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per document with its shard and its slot there."""
    stage = Stage(docs.sparkSession, "shards")
    rows, total = _coordinates(_items(docs, stage))
    cuts = build_tree(rows, shards)
    groups = max(SLOT_GROUPS, -(-total // (shards * SLOT_GROUP_ROWS)))
    placed = _placed(rows, cuts, shards).select("doc_id", "size", "text_crc32", F.col("_first").alias("_shard"), F.pmod("_digest", F.lit(groups)).alias("_group"), "_digest")
    placed = stage.put(placed, "placed")
    before = Window.partitionBy("_shard").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_shard", "_group").agg(F.count(F.lit(1)).alias("_rows"))
    starts = starts.select("_shard", "_group", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_shard", "_group").orderBy("doc_id", "_digest", "text_crc32"))
    return placed.join(bounded(starts, shards * groups, 48), ["_shard", "_group"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("_shard").cast("int").alias("shard"),
        (F.col("_start") + place - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
