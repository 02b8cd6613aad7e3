"""Positions in one linked list: chains are folded block by block, then unfolded."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.llm.common import Stage
from tradewind.llm.scans import pieces

#: Elements that the last, single block may have.
LAST_ELEMENTS = 1 << 16
BLOCK_ELEMENTS = 1 << 18
#: A round that leaves more than this share of the elements is followed by a splice by coins.
SLOW_SHARE = 0.7

_FOLDED = "id bigint, head bigint, before bigint, next bigint, span bigint"


def folded(ids: np.ndarray, following: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, ...]:
    """Chains of one block: per element its chain's head and the spans before it; heads have the chain's next and span."""
    order = np.argsort(ids)
    ids, following, spans = ids[order], following[order], spans[order]
    at = np.minimum(np.searchsorted(ids, following), len(ids) - 1)
    inner = ids[at] == following
    up, before = np.arange(len(ids)), np.zeros(len(ids), np.int64)
    up[at[inner]] = np.flatnonzero(inner)
    has_previous = np.zeros(len(ids), bool)
    has_previous[at[inner]] = True
    before[at[inner]] = spans[inner]
    while (up[up] != up).any():
        before, up = before + before[up], up[up]
    last = np.flatnonzero(~inner)
    after, total = np.full(len(ids), -1, np.int64), np.zeros(len(ids), np.int64)
    after[up[last]], total[up[last]] = following[last], before[last] + spans[last]
    return ids, ids[up], before, after, total


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [[np.asarray(batch.column(k)) for k in range(3)] for batch in batches]
    if sum(len(part[0]) for part in parts):
        found = folded(*(np.concatenate([part[k] for part in parts]) for k in range(3)))
        yield pa.RecordBatch.from_arrays([pa.array(column) for column in found], names=["id", "head", "before", "next", "span"])


def spliced(elements: DataFrame, round_number: int) -> DataFrame:
    """As a fold of pairs: an element that throws 0 takes in its next if that throws 1; a quarter goes, in the mean."""
    coin = F.pmod(F.xxhash64("id", F.lit(round_number)), F.lit(2))
    thrown = elements.select("id", "next", "span", coin.alias("coin"))
    first = thrown.where("coin = 0").select(F.col("id").alias("head"), F.col("next").alias("id"), F.col("span").alias("before"))
    second = thrown.where("coin = 1").select("id", "next", "span")
    taken = first.join(second, "id")
    members = taken.select("id", "head", "before", F.lit(-1).cast("bigint").alias("next"), F.lit(0).cast("bigint").alias("span"))
    grown = taken.select(F.col("head").alias("id"), F.col("next").alias("_after"), F.col("span").alias("_more"))
    kept = thrown.join(taken.select("id"), "id", "left_anti").join(grown, "id", "left")
    heads = kept.select(
        "id", F.col("id").alias("head"), F.lit(0).cast("bigint").alias("before"), F.coalesce("_after", "next").alias("next"), (F.col("span") + F.coalesce("_more", F.lit(0))).alias("span")
    )
    return members.unionByName(heads)


def ranked(links: DataFrame, stage: Stage, last: int = LAST_ELEMENTS, block: int = BLOCK_ELEMENTS) -> DataFrame:
    """id and position, from 0, of every element; links are id and next, -1 after the last.

    Every round deals the elements to blocks of neighbouring ids and folds what follows each other inside one.
    The heads of the chains go to the next round, until one block can hold them.
    """
    current = links.select("id", "next", F.lit(1).cast("bigint").alias("span"))
    count, rounds = current.count(), []
    while True:
        tasks = pieces(current, block) if not rounds else -(-count // block)
        dealt = current.repartition(1) if rounds and count <= last else current.repartitionByRange(tasks, "id")
        rounds.append(stage.put(dealt.mapInArrow(_fold, _FOLDED), f"round-{len(rounds)}"))
        heads = rounds[-1].where("id = head")
        left = heads.count()
        if left <= 1:
            break
        if left > count * SLOW_SHARE:
            rounds.append(stage.put(spliced(heads, len(rounds)), f"round-{len(rounds)}"))
            heads = rounds[-1].where("id = head")
            left = heads.count()
        current, count = heads.select("id", "next", "span"), left
    places = rounds[-1].select("id", F.col("before").alias("position"))
    for number, members in reversed(list(enumerate(rounds[:-1]))):
        above = places.select(F.col("id").alias("head"), F.col("position").alias("_above"))
        places = stage.put(members.join(above, "head").select("id", (F.col("_above") + F.col("before")).alias("position")), f"places-{number}")
    return places
