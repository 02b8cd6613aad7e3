"""Order-preserving packing of documents into token sequences of a fixed limit.

Documents keep the order in which the input holds them. Each input partition is one token stream, cut
into windows of at most `limit` tokens. A window may end at a document end for nothing, at a sentence
end for a small penalty, and inside a long sentence for a larger one. Dynamic programming picks the
cuts with the least padding plus penalties: the cost of a window that ends at b is
`limit - (b - a) + penalty(b)`, so the best start a is the minimum of cost(a) + a over the last `limit`
tokens, which a monotone queue gives in constant time per boundary. The stream is solved block by block;
the last window of a block is left open and opens the next one, so memory is bounded by a block and one
document, and padding beyond the cuts' own occurs once per partition. No rows are shuffled.

A null text is an empty one, of which the closing id remains. A document's ids lie in its pieces in
order, each id once. Rows that repeat are packed one by one. A sequence's id is its partition's number
in the high bits and a running number in the low ones. Extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tradewind.llm.words import CACHE_PARTS, VOCABULARY, byte_groups, encoder, parts

LIMIT = 2048
CLOSING_ID = 1
SENTENCE_PENALTY = 6
INNER_PENALTY = 24
#: Inside a sentence longer than this, every so many tokens are a boundary too.
INNER_STEP = 32
BLOCK_TOKENS = 1 << 18
GROUP_BYTES = 1 << 20

SCHEMA = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
)


def window_cuts(bounds: list[int], penalties: list[int], limit: int, closed: bool) -> list[int]:
    """Chosen boundaries by least cost; the first is the stream's start, the last its end.

    Gaps between boundaries are at most `limit`. Without `closed` the last window's padding is free.
    """
    if len(bounds) < 2:
        return list(bounds)
    keys = [bounds[0]]
    back = [0] * len(bounds)
    queue: deque[int] = deque([0])
    last = len(bounds) - 1
    for j in range(1, len(bounds)):
        b = bounds[j]
        low = b - limit
        while bounds[queue[0]] < low:
            queue.popleft()
        i = queue[0]
        back[j] = i
        if j == last:
            break
        key = keys[i] + limit + penalties[j]
        keys.append(key)
        while queue and keys[queue[-1]] >= key:
            queue.pop()
        queue.append(j)
    if not closed:  # the open window may begin at any boundary in reach; its padding does not count
        reach = [i for i in queue if bounds[i] >= bounds[last] - limit]
        back[last] = min(reach, key=lambda i: keys[i] - bounds[i])
    cuts = [last]
    while cuts[-1]:
        cuts.append(back[cuts[-1]])
    return [bounds[i] for i in reversed(cuts)]


def boundaries(ids: np.ndarray, doc_ends: np.ndarray, sentence_end: np.ndarray, step: int = INNER_STEP) -> tuple[np.ndarray, np.ndarray]:
    """Allowed cut positions of a stream with their penalties, from 0 to its end."""
    total = len(ids)
    marks = np.flatnonzero(sentence_end[ids]) + 1
    kinds = np.full(total + 1, -1, dtype=np.int64)
    kinds[marks] = SENTENCE_PENALTY
    kinds[doc_ends] = 0
    kinds[0] = kinds[total] = 0
    found = np.flatnonzero(kinds >= 0)
    gaps = np.diff(found)
    wide = np.flatnonzero(gaps > step)
    if len(wide):
        inner = np.concatenate([np.arange(found[k] + step, found[k + 1], step) for k in wide])
        kinds[inner] = INNER_PENALTY
        found = np.flatnonzero(kinds >= 0)
    return found, kinds[found]


class _Stream:
    """One partition's documents on their way into windows."""

    def __init__(self, limit: int, sentence_end: np.ndarray, first_sequence: int) -> None:
        self.limit, self.sentence_end, self.sequence = limit, sentence_end, first_sequence
        self.docs: list[tuple[int | None, int, int]] = []  # id, ids before what is left, ids in all
        self.ids: list[np.ndarray] = []
        self.tokens = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, 0, len(ids)))
        self.ids.append(ids)
        self.tokens += len(ids)

    def packed(self, closed: bool) -> pa.RecordBatch | None:
        if not self.docs:
            return None
        ids = np.concatenate(self.ids)
        lengths = np.array([len(one) for one in self.ids], dtype=np.int64)
        ends = np.cumsum(lengths)
        starts = ends - lengths
        bounds, penalties = boundaries(ids, ends, self.sentence_end)
        cuts = np.array(window_cuts(bounds.tolist(), penalties.tolist(), self.limit, closed), dtype=np.int64)
        done = len(ids) if closed else int(cuts[-2])
        windows = cuts[:-1] if closed else cuts[:-2]
        points = np.union1d(starts[starts < done], windows)
        if not len(points):
            return None
        upto = np.append(points[1:], done)
        doc = np.searchsorted(starts, points, "right") - 1
        window = np.searchsorted(windows, points, "right") - 1
        before = np.array([one[1] for one in self.docs], dtype=np.int64)
        all_ids = np.array([one[2] for one in self.docs], dtype=np.int64)
        body = memoryview(ids.astype("<u4").tobytes())
        crcs = [zlib.crc32(body[4 * a : 4 * b]) for a, b in zip(points.tolist(), upto.tolist(), strict=True)]
        batch = pa.RecordBatch.from_arrays(
            [
                pa.array([self.docs[k][0] for k in doc.tolist()], pa.int64()),
                pa.array(points - starts[doc] + before[doc], pa.int64()),
                pa.array(upto - points, pa.int64()),
                pa.array(crcs, pa.int64()),
                pa.array(all_ids[doc], pa.int64()),
                pa.array(self.sequence + window, pa.int64()),
                pa.array(points - windows[window], pa.int64()),
            ],
            names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
        )
        self.sequence += len(windows)
        kept = int(np.searchsorted(ends, done, "right"))
        self.docs, self.ids = self.docs[kept:], self.ids[kept:]
        if self.docs and done > starts[kept]:
            cut = done - int(starts[kept])
            doc_id, ahead, total = self.docs[0]
            self.docs[0] = (doc_id, ahead + cut, total)
            self.ids[0] = self.ids[0][cut:]
        self.tokens = sum(map(len, self.ids))
        return batch


def sentence_ends(vocabulary: dict[str, int]) -> np.ndarray:
    """By token id: whether the token closes a word with a point, question or exclamation mark."""
    table = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
    for token, number in vocabulary.items():
        table[number] = token.removesuffix("</w>").endswith((".", "!", "?")) and token.endswith("</w>")
    return table


def pack(
    docs: DataFrame,
    vocabulary: str = VOCABULARY,
    limit: int = LIMIT,
    closing_id: int = CLOSING_ID,
    block_tokens: int = BLOCK_TOKENS,
    cache_parts: int = CACHE_PARTS,
) -> DataFrame:
    """One row per piece of a document, with its place in a sequence."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary, cache_parts)
        table = sentence_ends(own.vocabulary())
        closing = np.array([closing_id], dtype="<u4").tobytes()
        stream = _Stream(limit, table, TaskContext.get().partitionId() << 33)
        for batch in batches:
            texts = [text or "" for text in batch.column("text").to_pylist()]
            numbers = batch.column("doc_id").cast(pa.int64()).to_pylist()
            for first, last in byte_groups([len(text) for text in texts], GROUP_BYTES):
                split = [parts(text) for text in texts[first:last]]
                known = own.known([part for words in split for part in words]).__getitem__
                for doc_id, words in zip(numbers[first:last], split, strict=True):
                    stream.add(doc_id, np.frombuffer(b"".join(map(known, words)) + closing, dtype="<u4"))
                    if stream.tokens >= block_tokens and (done := stream.packed(closed=False)) is not None:
                        yield done
        if (done := stream.packed(closed=True)) is not None:
            yield done

    return docs.select("doc_id", "text").mapInArrow(convert, SCHEMA)
