"""Codebooks against plain Lloyd rounds over all pairs of parts and entries."""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tradewind.llm import codebooks


def slow_codes(rows, parts=16, entries=64, rounds=2):
    """Rows are (vec_id, vector, label); the expected (vec_id, code, error, label_error) and the digest."""
    kept = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return [], None
    width = parts * max(1, -(-max(len(v) for _, v, _ in kept) // parts))
    ints = [[max(-(1 << 24), min(1 << 24, math.floor(256 * x))) for x in v] + [0] * (width - len(v)) for _, v, _ in kept]
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, ints[k]))[:entries]
    size = width // parts
    cut = np.array(ints, dtype=np.int64).reshape(len(kept), parts, size)
    books = cut[order].transpose(1, 0, 2).copy()

    def nearest(part):
        return ((cut[:, part, None] - books[part][None]) ** 2).sum(axis=2).argmin(axis=1)

    for _ in range(rounds):
        for part in range(parts):
            codes = nearest(part)
            books[part] = [cut[codes == e, part].sum(axis=0) // (codes == e).sum() if (codes == e).any() else books[part][e] for e in range(len(order))]
    codes = np.stack([nearest(part) for part in range(parts)], axis=1)
    errors = [sum(int(((cut[k, p] - books[p][codes[k, p]]) ** 2).sum()) for p in range(parts)) for k in range(len(kept))]
    labels: dict = defaultdict(int)
    for (_, _, label), error in zip(kept, errors, strict=True):
        labels[label] += error
    found = [str((i, "".join(f"{c:02x}" for c in codes[k]), errors[k], labels[label])) for k, (i, _, label) in enumerate(kept)]
    return sorted(found), hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def fast_codes(frame, **how):
    got = codebooks.compressed(frame, **how).collect()
    digests = {r.codebooks_sha256 for r in got}
    return sorted(str((r.vec_id, r.code, r.error, r.label_error)) for r in got), digests.pop() if digests else None


def made(count, length, seed, spread=0.15):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, spread, (9, length))
    vectors = centres[rng.integers(0, 9, count)] + rng.normal(0, spread / 3, (count, length))
    return [(int(i), [float(np.float32(x)) for x in v], int(i) % 5 if i % 7 else None) for i, v in enumerate(vectors)]


@pytest.mark.parametrize("block", [8192, 50])
def test_odd_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(codebooks, "BLOCK_ROWS", block)
    rows = made(400, 33, 1)
    nan, inf = float("nan"), float("inf")
    rows += [(900, None, 1), (901, [1.0, None], 1), (902, [nan], 1), (903, [inf, 0.0], 1), (904, [-inf], 1), (905, [], 2), (906, [0.5] * 7, None), (907, [3e38, -3e38], 2)]
    rows += [(None, rows[3][1], 1), (2, rows[9][1], 1), (2, rows[8][1], 1)]
    rows += [(5000, [0.25] * 33, 3)] * 250
    frame = spark.createDataFrame([rows[k] for k in np.random.default_rng(0).permutation(len(rows))], "vec_id bigint, embedding array<float>, label int").repartition(3)
    frame = frame.select("*", *[F.lit(f"x{k}").alias(n) for k, n in enumerate(("code", "error", "_label", "_ints", "_vector", "_rows"))])
    assert fast_codes(frame) == slow_codes(rows)
    assert fast_codes(frame, parts=3, entries=5, rounds=3) == slow_codes(rows, 3, 5, 3)


def test_empty_and_tiny_tables(spark):
    schema = "vec_id bigint, embedding array<float>, label int"
    none = codebooks.compressed(spark.createDataFrame([(1, None, 0)], schema))
    assert none.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and none.count() == 0
    rows = made(3, 16, 5)
    assert fast_codes(spark.createDataFrame(rows, schema)) == slow_codes(rows)


def test_vectors_of_the_table(spark, sf):
    frame = spark.read.parquet(f"{sf}/embeddings.parquet")
    assert fast_codes(frame) == slow_codes([(r.vec_id, r.embedding, r.label) for r in frame.collect()])


@pytest.mark.parametrize("spread,size", [(4, 2), (60, 4), (4000, 3)])
def test_trees_assign_like_all_pairs(spread, size):
    """Many ties (few distinct points), repeated points and repeated entries."""
    rng = np.random.default_rng(spread)
    points = rng.integers(-spread, spread, (3000, size))
    points[:900] = points[0]
    entries = points[rng.integers(0, 3000, 64)]
    sums, counts = np.zeros_like(entries), np.zeros(64, np.int64)
    codes = codebooks.assigned(codebooks.Tree(points, 16), codebooks.EntryTree(entries), sums, counts)
    expected = ((points[:, None] - entries[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert (codes == expected).all()
    assert (counts == np.bincount(expected, minlength=64)).all()
    assert all((sums[e] == points[expected == e].sum(axis=0)).all() for e in range(64))


def test_equal_parts_are_assigned_as_one_node():
    entries = np.arange(64)[:, None] * np.array([[10, 0]])
    tree, book = codebooks.Tree(np.tile([[203, 1]], (5000, 1)), 16), codebooks.EntryTree(entries)
    assert len(tree.levels) == 1
    counts = np.zeros(64, np.int64)
    assert (codebooks.assigned(tree, book, np.zeros_like(entries), counts) == 20).all() and counts[20] == 5000
