"""The n-gram Jaccard join against all pairs."""

from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import CLASH, ROWS, SCHEMA, lowered
from tradewind.llm import common, ngram_join


def slow_set(text, words=4):
    tokens = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    return {" ".join(tokens[k : k + words]) for k in range(max(1, len(tokens) - words + 1))} if tokens else set()


def slow_join(rows, words=4, least=85):
    """(doc_id, size, component) by all pairs; rows are (doc_id, text)."""
    sets = [slow_set(text, words) for _, text in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and group[i] != group[j] and 100 * len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least_id: dict[int, int] = {}
    for g, (i, _) in zip(group, rows, strict=True):
        if i is not None:
            least_id[g] = min(i, least_id.get(g, i))
    return sorted(str((i, len(s), least_id.get(g))) for (i, _), s, g in zip(rows, sets, group, strict=True))


def fast_join(frame, **how):
    return sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in ngram_join.joined(frame, **how).collect())


def test_odd_rows_and_clashing_columns(spark):
    more = [(20, "a b c"), (21, "A b\tc"), (22, "a b c d"), (23, "   \n"), (24, "x" * 300_000), (25, "a b c a b c a b c a b"), (26, None)]
    rows = [(r[0], r[1]) for r in ROWS] + more
    frame = spark.createDataFrame([*ROWS, *((i, text, "en", "a") for i, text in more)], SCHEMA).repartition(3)
    frame = frame.select("*", *[F.lit(f"x{k}").alias(name) for k, name in enumerate([*CLASH, "node", "token", "_key", "_block"])])
    assert fast_join(frame) == slow_join(rows)
    assert ngram_join.joined(frame.where("doc_id < 0")).count() == 0


def near_copies(seed=3):
    """Chains, stars around a template that is or is not there, shared passages, and copies of one row."""
    rng = np.random.default_rng(seed)
    fresh = lambda n: [f"w{k}" for k in rng.integers(0, 5000, n)]
    texts = []
    for size, edits in ((40, 1), (90, 2), (90, 3), (200, 6)):
        base = fresh(size)
        for _ in range(25):
            own = list(base)
            for place in rng.integers(0, size, edits):
                own[place] = f"e{rng.integers(0, 10**6)}"
            texts.append(" ".join(own))
        if edits != 3:
            texts.append(" ".join(base))
    chain = fresh(120)
    for _ in range(15):
        chain = [*chain[4:], *fresh(4)]
        texts.append(" ".join(chain))
    passage = fresh(60)
    texts += [" ".join([*fresh(int(n)), *passage]) for n in rng.integers(0, 15, 40)]
    texts += [" ".join(fresh(int(n))) for n in rng.integers(1, 30, 60)]
    texts += [texts[0].upper()] * 60
    return [(int(i), text) for i, text in zip(rng.permutation(len(texts)), texts, strict=True)]


@pytest.mark.parametrize("block,grid,groups", [(1 << 20, 4096, 100_000), (2000, 3, 5)])
def test_near_copies_in_large_and_small_blocks(spark, monkeypatch, block, grid, groups):
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", block)
    monkeypatch.setattr(ngram_join, "GRID_PAIRS", grid)
    monkeypatch.setattr(common, "GROUP_ROWS", groups)
    rows = near_copies()
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert fast_join(frame) == slow_join(rows)
    if groups == 5:
        assert fast_join(frame, words=2, least=60, orders=2) == slow_join(rows, 2, 60)


@pytest.mark.parametrize("visited", [False, True])
def test_pairs_left_over_by_blocks_are_found(spark, monkeypatch, visited):
    """Each node in a block of its own leaves every link to visits, or to pairs across blocks where visits link nothing."""
    real, calls = ngram_join.blocked, []

    def linking(sets, *how):
        calls.append(how)
        none = sets.select(F.col("node").alias("a"), F.col("node").alias("b")).where("a <> b")
        return real(sets, *how) if visited and len(calls) > 1 else none

    opened, visits = ngram_join.opened, ngram_join.visits
    alone = lambda places: places.withColumn("_block", F.col("node"))
    monkeypatch.setattr(ngram_join, "blocked", linking)
    monkeypatch.setattr(ngram_join, "opened", lambda rows, places, *rest: opened(rows, alone(places), *rest))
    monkeypatch.setattr(ngram_join, "visits", lambda rows, places, stage: visits(rows, alone(places), stage))
    if not visited:
        crossing = ngram_join.crossing
        monkeypatch.setattr(ngram_join, "crossing", lambda rows, *rest: crossing(rows.withColumn("_main", F.lit(-1).cast("bigint")), *rest))
    rows = near_copies(9)
    assert fast_join(spark.createDataFrame(rows, "doc_id bigint, text string")) == slow_join(rows)


def test_common_shingles_come_last():
    classes = ngram_join.zlib.compress(np.where(np.arange(ngram_join.SLOTS) % 2, 9, 0).astype(np.uint8).tobytes())
    shingles = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 200, dtype=np.uint64))
    for order in range(3):
        first = ngram_join.Orders(classes).prefix(shingles, order)
        assert len(first) == 200 - 170 + 1 and not (first % 2).any()
    assert [ngram_join.prefix_length(n) for n in (1, 6, 7, 100)] == [1, 1, 2, 16]


def test_documents_of_the_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert fast_join(docs) == slow_join([(r.doc_id, r.text) for r in docs.collect()])
