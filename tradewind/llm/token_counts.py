"""Token counts of whole texts.

Texts reach the workers in Arrow batches. A batch is cut into runs of about the same number of bytes,
each run is encoded in one go and only lengths come back. Long texts are cut at blanks and line feeds,
where no token can span, so a text of any length takes bounded memory beside itself.

Null counts as an empty text with no tokens. Rows that repeat are counted one by one. Extra columns are
not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tradewind.llm.words import VOCABULARY, byte_groups, encoder, parts

GROUP_BYTES = 2 << 20
CUT_CHARS = 1 << 20
LIMIT = 2048

SCHEMA = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"


def safe_cuts(text: str, most: int = CUT_CHARS) -> Iterator[str]:
    """Pieces of about `most` characters that end just before a blank or a line feed."""
    start = 0
    while len(text) - start > most:
        ends = [end for mark in " \n" if (end := text.rfind(mark, start + 1, start + most)) > 0]
        end = max(ends, default=-1)
        if end < 0:
            ends = [end for mark in " \n" if (end := text.find(mark, start + most)) > 0]
            end = min(ends, default=len(text))
        yield text[start:end]
        start = end
    yield text[start:]


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = LIMIT, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """One row per document: bytes, tokens, and whether the tokens exceed the limit."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        for batch in batches:
            texts = [text or "" for text in batch.column("text").to_pylist()]
            sizes = [len(text.encode()) for text in texts]
            counts: list[int] = []
            for first, last in byte_groups(sizes, group_bytes):
                if last - first == 1:
                    pieces = [[parts(piece) for piece in safe_cuts(texts[first])]]
                else:
                    pieces = [[parts(text)] for text in texts[first:last]]
                for text in pieces:
                    total = 0
                    for words in text:
                        total += sum(map(len, map(own.known(words).__getitem__, words))) // 4
                    counts.append(total)
            over = [count > limit for count in counts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array(over, pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select("doc_id", "text").mapInArrow(convert, SCHEMA)
