"""The prefix trie against a walk over all prefixes; list ranking and running sums against loops."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tradewind.llm import common, prefix_trie, scans, tours
from tradewind.llm.common import Stage

FIELDS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def slow_nodes(rows):
    """The expected rows; `rows` are (conv_id, turn, role, text)."""
    tie = lambda role, text: hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).hexdigest()
    own = defaultdict(list)
    for conv, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, tie(r[2], r[3]))):
        own[conv].append((role or "", text or ""))
    built = {}
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 6
        built[conv] = own.get(conv - int(np.fmod(conv, 100)), [])[:h] + turns[h:]
    members, ending = defaultdict(list), defaultdict(list)
    for conv, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(conv)
        ending[tuple(turns)].append(conv)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[c] for c in children[node]) or 1
        saved[node] = (len(members[node]) - 1) * (len(node[-1][1]) if node else 0) + sum(saved[c] for c in children[node])
    return sorted(
        str((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(children[n]), leaves[n], saved[n], hashlib.sha256(",".join(map(str, sorted(ending[n]))).encode()).hexdigest()))
        for n, m in members.items()
    )


def fast_nodes(frame):
    return sorted(str(tuple(r[name] for name in FIELDS)) for r in prefix_trie.nodes(frame).collect())


def conversations(seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for conv in [*range(0, 130), *range(300, 340), 517, 1234567890123, -5, -100]:
        first = "hello" if conv % 3 == 0 else f"t{rng.integers(0, 4)}"
        rows += [(conv, k, "user" if k % 2 == 0 else "assistant", first if k == 0 else f"{rng.integers(0, 3)}" * int(rng.integers(0, 4))) for k in range(int(rng.integers(1, 7)))]
    rows += [(7, 200, "user", "same"), (7, 200, "user", "same"), (7, None, None, "first"), (8, 300, "tool", None), (8, 300, None, "x"), (None, 0, "user", "lost")]
    rows += [(100, 10 + k, "user", "go on 😀") for k in range(400)]
    rows += [(917, k, "user", "alike") for k in range(2)]
    rows += [(c, k, "user", "copy") for c in range(2000, 2060) for k in range(7)]
    return [rows[k] for k in rng.permutation(len(rows))]


@pytest.mark.parametrize("small", [False, True])
def test_odd_conversations(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(common, "GROUP_ROWS", 20)
        monkeypatch.setattr(prefix_trie, "PIECE_IDS", 3)
        monkeypatch.setattr(tours.ranked, "__defaults__", (40, 100))
        monkeypatch.setattr(scans.pieces, "__defaults__", (37,))
    rows = conversations()
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(4)
    frame = frame.select("*", *[F.lit(f"x{k}").alias(name) for k, name in enumerate(("at", "depth", "key", "number", "_piece", "_number", "chars", "n_convs"))])
    assert fast_nodes(frame) == slow_nodes(rows)


def test_empty_table_and_turnless_conversations(spark):
    schema = "conv_id bigint, turn bigint, role string, text string"
    assert prefix_trie.nodes(spark.createDataFrame([], schema)).count() == 0
    turnless = [c for c in range(1000, 1100) if c % 100 and zlib.crc32(str(c).encode()) % 6 > 1][:3]
    rows = [(c, 0, "user", "gone") for c in turnless]
    got = prefix_trie.nodes(spark.createDataFrame(rows, schema)).collect()
    assert [(r.conv_id, r.depth, r.n_convs, r.n_leaves, r.saved_tokens) for r in got] == [(min(turnless), 0, 3, 1, 0)]
    assert fast_nodes(spark.createDataFrame(rows, schema)) == slow_nodes(rows)


def test_conversations_of_the_table(spark, sf):
    frame = spark.read.parquet(f"{sf}/conversations.parquet")
    assert fast_nodes(frame) == slow_nodes([(r.conv_id, r.turn, r.role, r.text) for r in frame.collect()])


@pytest.mark.parametrize("shuffled", [False, True])
def test_list_ranking(spark, shuffled):
    """Neighbouring ids fold in blocks; a shuffled list goes on by splices."""
    count = 3000
    order = np.random.default_rng(2).permutation(count) if shuffled else np.arange(count)
    following = np.full(count, -1)
    following[order[:-1]] = order[1:]
    links = spark.createDataFrame([(int(k), int(n)) for k, n in enumerate(following)], "id bigint, next bigint")
    got = {r.id: r.position for r in tours.ranked(links, Stage(spark, "list"), last=50, block=60).collect()}
    assert got == {int(node): place for place, node in enumerate(order)}


def test_running_sums(spark):
    rng = np.random.default_rng(4)
    rows = [(int(g), int(v), k) for k, (g, v) in enumerate(zip(np.where(rng.random(900) < 0.5, 3, rng.integers(0, 40, 900)), rng.integers(-5, 9, 900), strict=True))]
    stage = Stage(spark, "sums")
    frame = spark.createDataFrame(rows, "g bigint, v bigint, k bigint").repartition(7)
    lined = scans.numbered(frame, [F.col("g").asc(), F.col("k").asc()], stage, "lined")
    got = {(r.g, r.k): (r._number, r.total) for r in scans.running(lined, "g", {"total": F.col("v")}, stage, "sums").collect()}
    sums: dict[int, int] = defaultdict(int)
    for number, (g, v, k) in enumerate(sorted(rows, key=lambda r: (r[0], r[2]))):
        sums[g] += v
        assert got[(g, k)] == (number, sums[g])
