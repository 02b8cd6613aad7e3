"""Nearest neighbours by inner product with multi-index hashing.

Vectors become binary codes: scaled to the largest norm, with one more component that fills them up to it,
so that inner product orders like angle; then turned by two rotations learned on a bounded sample (iterative
quantisation) and cut to signs. A code is split into bytes, each byte is the key of a table. A code at most
`radius` bits from the query differs in at most radius / tables bits in one byte at least, so the tables,
probed with the ball of that radius around each byte of the query, give every such code. The probed
postings are bitmaps over a block of vectors; their union is verified on whole codes, and what is within
the radius is ranked by the original vectors in double precision.

The radius is measured: for a bounded number of queries, the exact neighbours among all vectors are found
in blocks, and the radius holds the `recall` share of them. Every vector is indexed and every query visits
every block, as blocks of queries times blocks of vectors, each bounded. A query that finds fewer codes in
a block than it needs ranks the whole block.

Equal vectors are one entry with its k + 1 smallest ids, which is all that a result can show of them, so a
vector that a third of all rows share is searched once. Vectors that are null, zero, or hold null or
non-finite components take no part; vectors meet only vectors of their own length. Rows with the query's
own vec_id are not candidates. Ties go to the smaller vec_id. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewind.llm.common import Stage

NEAREST = 20
QUERY_STEP = 20
SAMPLE = 4000
MEASURED = 64
RECALL = 0.97
BLOCK_VECTORS = 8192
BLOCK_QUERIES = 4096
ROTATIONS = 2
MOST_COMPONENTS = 64
ROUNDS = 25

_FOUND = "_query bigint, _vector bigint, _least bigint, _score double, _bits int"


class Coder:
    """Learned rotated codes for vectors of one length."""

    def __init__(self, sample: np.ndarray, norm: float, seed: int = 7) -> None:
        self.norm = norm
        points = self.filled(sample)
        parts = min(MOST_COMPONENTS, points.shape[1])
        _, _, axes = np.linalg.svd(points.T @ points)
        turned = points @ axes[:parts].T
        rng = np.random.default_rng(seed)
        turns = []
        for _ in range(ROTATIONS):
            turn, _ = np.linalg.qr(rng.standard_normal((parts, parts)))
            for _ in range(ROUNDS):
                u, _, v = np.linalg.svd(np.where(turned @ turn >= 0, 1.0, -1.0).T @ turned)
                turn = (u @ v).T
            turns.append(turn)
        self.matrix = axes[:parts].T @ np.concatenate(turns, axis=1)

    def filled(self, vectors: np.ndarray) -> np.ndarray:
        scaled = vectors / self.norm
        rest = np.sqrt(np.clip(1 - (scaled**2).sum(axis=1), 0, None))
        return np.concatenate([scaled, rest[:, None]], axis=1)

    def _codes(self, points: np.ndarray) -> np.ndarray:
        return np.packbits(points @ self.matrix >= 0, axis=1)

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        return self._codes(self.filled(vectors))

    def query_codes(self, vectors: np.ndarray) -> np.ndarray:
        return self._codes(np.concatenate([vectors, np.zeros((len(vectors), 1))], axis=1))


class Tables:
    """One table per byte of the codes of a block; the postings of a ball are bitmaps."""

    def __init__(self, codes: np.ndarray, radius: int) -> None:
        self.codes, self.radius = codes, radius
        reach = radius // codes.shape[1]
        values = np.arange(256, dtype=np.uint8)[:, None]
        self.balls = np.stack([np.packbits(np.bitwise_count(values ^ codes[None, :, t]) <= reach, axis=1) for t in range(codes.shape[1])])

    def within(self, code: np.ndarray) -> np.ndarray:
        """Places of all codes at most the radius away."""
        union = np.bitwise_or.reduce(self.balls[np.arange(len(code)), code])
        met = np.flatnonzero(np.unpackbits(union, count=len(self.codes)))
        return met[distances(self.codes[met], code) <= self.radius]


def distances(codes: np.ndarray, code: np.ndarray) -> np.ndarray:
    return np.bitwise_count(codes ^ code).sum(axis=1, dtype=np.int64)


def _top(scores: np.ndarray, least: np.ndarray, most: int) -> np.ndarray:
    """The best places, by score and then by smaller id."""
    if len(scores) > most:
        edge = np.partition(scores, len(scores) - most)[len(scores) - most]
        places = np.flatnonzero(scores >= edge)
    else:
        places = np.arange(len(scores))
    return places[np.lexsort((least[places], -scores[places]))][:most]


def block_search(coders: dict[int, Coder], radius: dict[int, int] | None, most: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """The search of one block of queries in one block of vectors; exact without a radius."""

    def search(queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        parts = []
        if len(queries) and len(vectors):
            coder = coders[len(vectors["_data"].iloc[0])]
            data = np.stack(vectors["_data"].to_numpy()).astype(np.float64)
            asked = np.stack(queries["_data"].to_numpy()).astype(np.float64)
            numbers, least = vectors["_vector"].to_numpy(np.int64), vectors["_least"].to_numpy(np.int64)
            codes, asked_codes = coder.codes(data), coder.query_codes(asked)
            tables = None if radius is None else Tables(codes, radius[data.shape[1]])
            everything = np.arange(len(data))
            for number, query, code in zip(queries["_vector"].to_numpy(np.int64), asked, asked_codes, strict=True):
                met = everything if tables is None else tables.within(code)
                if len(met) < most:
                    met = everything
                best = met[_top(data[met] @ query, least[met], most)]
                scores = (data[best] * query).sum(axis=1)
                parts.append((np.full(len(best), number), numbers[best], least[best], scores, distances(codes[best], code)))
        columns = [np.concatenate([part[k] for part in parts]) if parts else np.zeros(0) for k in range(5)]
        return pd.DataFrame(dict(zip(("_query", "_vector", "_least", "_score", "_bits"), columns, strict=True)))

    return search


def taking_part(column: str = "embedding") -> Column:
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.col(column).isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(column, lambda x: x != 0)


def _grid(queries: DataFrame, vectors: DataFrame, query_blocks: int, blocks: int, search: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """Every block of queries with every block of vectors of the same length."""
    by = ["_length", "_asked", "_block"]
    asked = queries.withColumn("_asked", F.pmod(F.xxhash64("_vector"), F.lit(query_blocks)).cast("int"))
    asked = asked.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    held = vectors.withColumn("_block", F.pmod(F.xxhash64("_vector"), F.lit(blocks)).cast("int"))
    held = held.withColumn("_asked", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    return asked.select(*by, "_vector", "_data").groupBy(*by).cogroup(held.select(*by, "_vector", "_least", "_data").groupBy(*by)).applyInPandas(search, _FOUND)


def _best(found: DataFrame, by: str, order: list[Column], most: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return found.withColumn("rank", rank).where(F.col("rank") <= most)


def nearest(vectors: DataFrame, is_query: Column, most: int = NEAREST, recall: float = RECALL, block_vectors: int = BLOCK_VECTORS, sample: int = SAMPLE) -> DataFrame:
    """The nearest rows of each query: query_id, rank, vec_id, score; `is_query` is about vec_id."""
    stage = Stage(vectors.sparkSession, "nearest")
    rows = vectors.where(taking_part()).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("_data"))
    rows = rows.where("vec_id IS NOT NULL")
    first = _best(rows, "_data", [F.col("vec_id")], most + 1).groupBy("_data").agg(F.sort_array(F.collect_list("vec_id")).alias("_ids"))
    first = first.select("_data", "_ids", F.col("_ids")[0].alias("_least"), F.size("_data").alias("_length"))
    distinct = stage.put(first.withColumn("_vector", F.monotonically_increasing_id()), "vectors")
    asked = stage.put(rows.where(is_query).join(distinct.select("_data", "_vector"), "_data").select("vec_id", "_vector"), "queries")
    queries = stage.put(distinct.join(asked.select("_vector").distinct(), "_vector", "left_semi"), "asked")
    lengths = distinct.groupBy("_length").agg(F.count(F.lit(1)), F.max(F.aggregate("_data", F.lit(0.0), lambda a, x: a + x * x))).collect()
    coders, blocks = {}, 1
    for length, count, square in lengths:
        drawn = distinct.where(F.col("_length") == length).orderBy(F.xxhash64("_data"), "_vector").limit(sample).select("_data")
        coders[length] = Coder(np.array([row[0] for row in drawn.collect()]), float(np.sqrt(square)))
        blocks = max(blocks, -(-count // block_vectors))
    measured = queries.orderBy(F.xxhash64("_data", F.lit(1)), "_vector").limit(MEASURED)
    exact = _best(_grid(measured, distinct, 1, blocks, block_search(coders, None, most)), "_query", [F.desc("_score"), F.col("_least")], most)
    own = exact.join(distinct.select(F.col("_vector").alias("_query"), "_length"), "_query")
    reach = own.where("_query <> _vector").groupBy("_length").agg(F.percentile("_bits", F.lit(recall))).collect()
    radius = {length: 8 * ROTATIONS * MOST_COMPONENTS for length, _, _ in lengths} | {length: int(np.ceil(bits)) for length, bits in reach}
    query_blocks = max(1, -(-queries.count() // BLOCK_QUERIES))
    found = stage.put(_grid(queries, distinct, query_blocks, blocks, block_search(coders, radius, most + 1)), "found")
    best = _best(found, "_query", [F.desc("_score"), F.col("_least")], most + 1).select("_query", "_vector", "_score")
    shown = best.join(distinct.select("_vector", "_ids"), "_vector").select("_query", F.explode("_ids").alias("vec_id"), "_score")
    shown = _best(shown, "_query", [F.desc("_score"), F.col("vec_id")], most + 1).drop("rank")
    listed = asked.select(F.col("vec_id").alias("query_id"), F.col("_vector").alias("_query")).join(shown, "_query").where("vec_id <> query_id")
    return _best(listed, "query_id", [F.desc("_score"), F.col("vec_id")], most).select("query_id", "rank", "vec_id", F.col("_score").alias("score"))
