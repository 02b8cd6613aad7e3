"""Static binary-fuse filters over 64-bit keys, built and probed with whole-array operations.

Three slots per key lie in three consecutive segments of one table; a key's 8-bit fingerprint is the
exclusive or of its slots. The table is solved by peeling: slots that only one key uses are taken off
round by round, then filled in the reverse order. A filter never misses a key it was built from; of
other keys about one in 256 passes.
"""

from __future__ import annotations

import math

import numpy as np

_U = np.uint64


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    h = keys + _U(seed)
    h ^= h >> _U(33)
    h = h * _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(33)
    h = h * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def _slots(hashes: np.ndarray, segment: int, segments: int) -> np.ndarray:
    """Three slots per key, one in each of three consecutive segments."""
    first = ((hashes >> _U(32)) * _U(segments * segment)) >> _U(32)
    mask = _U(segment - 1)
    second = (first + _U(segment)) ^ ((hashes >> _U(18)) & mask)
    third = (first + _U(2 * segment)) ^ (hashes & mask)
    return np.stack([first, second, third]).astype(np.int64)


def _fingerprints(hashes: np.ndarray) -> np.ndarray:
    return ((hashes ^ (hashes >> _U(32))) & _U(0xFF)).astype(np.uint8)


def build(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """Seed, segment length, segments and table of a filter over distinct keys."""
    n = len(keys)
    segment = 1 << max(2, int(math.floor(math.log(max(n, 2)) / math.log(3.33) + 2.25)))
    segment = min(segment, 1 << 18)
    room = max(1.125, 0.875 + 0.25 * math.log(1_000_000) / math.log(max(n, 2)))
    segments = max(1, math.ceil(max(n, 1) * room / segment) - 2)
    size = (segments + 2) * segment
    seed = 0
    while True:
        seed += 0x9E3779B97F4A7C15
        seed &= (1 << 64) - 1
        hashes = _mixed(keys.astype(np.uint64), seed)
        slots = _slots(hashes, segment, segments)
        order = _peeled(slots, size)
        if order is not None:
            break
        if seed % 8 == 0:
            segments += 1
            size = (segments + 2) * segment
    table = np.zeros(size, dtype=np.uint8)
    marks = _fingerprints(hashes)
    for rows, own in reversed(order):
        three = slots[:, rows]
        table[own] = 0
        table[own] = marks[rows] ^ table[three[0]] ^ table[three[1]] ^ table[three[2]]
    return seed, segment, segments, table.tobytes()


def _peeled(slots: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """Rounds of keys with the slot that each had for itself; None if some keys cannot be peeled."""
    n = slots.shape[1]
    degree = np.bincount(slots.ravel(), minlength=size)
    users = np.zeros(size, dtype=np.int64)
    for row in slots:
        np.bitwise_xor.at(users, row, np.arange(n))
    order, left = [], n
    alone = np.flatnonzero(degree == 1)
    while len(alone):
        rows, first = np.unique(users[alone], return_index=True)
        own = alone[first]
        order.append((rows, own))
        left -= len(rows)
        touched = slots[:, rows]
        np.subtract.at(degree, touched.ravel(), 1)
        np.bitwise_xor.at(users, touched.ravel(), np.tile(rows, 3))
        near = np.unique(touched.ravel())
        alone = near[degree[near] == 1]
    return order if left == 0 else None


def probe(keys: np.ndarray, seed: int, segment: int, segments: int, table: bytes) -> np.ndarray:
    """Whether each key may be in the filter."""
    hashes = _mixed(keys.astype(np.uint64), seed)
    slots = _slots(hashes, segment, segments)
    marks = np.frombuffer(table, dtype=np.uint8)
    return marks[slots[0]] ^ marks[slots[1]] ^ marks[slots[2]] == _fingerprints(hashes)
