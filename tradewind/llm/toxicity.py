"""Toxic spans and document scores from a linear-chain conditional random field.

Labels mark whole documents, so token labels are derived first: a word of a toxic training document is
offending if one of its features (the word, a beginning, the ending) occurs in toxic documents far more
often than in clean ones, by the log-likelihood ratio over documents. A chain is then fitted to windows
of these tagged words; its marginals, and not the derived tags, score documents. A document's score is a
logistic function of its highest marginal odds and of its expected number of offending words, fitted to
the training labels at their true shares.

The model is fitted on a bounded sample: at most `toxic_docs` and `clean_docs` labelled documents of at
most `sample_chars` characters each, chosen by a digest of the id among the rows whose
crc32(doc_id as text) mod 5 is not 0. Everything else reads whole texts. Only the text enters a score. A text is
one chain: it is worked in pieces of 64 words, and messages pass between the pieces both ways, so marginals are
those of the whole text.

A null or empty text has no words and gets the score of a document without offending ones. Without labels
of both classes the score is the share of toxic labels, or 0 if there are none. Rows that repeat are
scored one by one; repeated labels of an id count as toxic if one of them is. Rows without an id are not
held out. Extra columns are ignored by `score` and kept by `clean_documents`.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewind.llm import crf
from tradewind.llm.words import byte_groups

TOXIC_DOCS = 1200
CLEAN_DOCS = 1800
SAMPLE_CHARS = 20_000
EVIDENCE = 24.0
PRECISION = 0.98
WINDOW = 24
PIECE = 64
KNOWN_WORDS = 300_000
GROUP_CHARS = 2 << 20
SPAN_ODDS = 0.5

_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Model:
    chain: crf.Chain | None
    share: float
    line: np.ndarray

    def document(self, highest: np.ndarray, expected: np.ndarray) -> np.ndarray:
        if self.chain is None:
            return np.full(len(highest), self.share)
        return 1 / (1 + np.exp(-np.clip(self.line[0] + self.line[1] * highest + self.line[2] * np.log1p(expected), -30, 30)))


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))


def evidence(docs: list[set[str]], toxic: np.ndarray) -> set[str]:
    """Features whose documents are toxic beyond chance and almost without exception."""
    counts = [Counter(), Counter()]
    for names, label in zip(docs, toxic.tolist(), strict=True):
        counts[label].update({feature for word in names for feature in crf.features(word)})
    n1 = int(toxic.sum())
    n0 = len(toxic) - n1
    found = set()
    for feature, k1 in counts[1].items():
        k0 = counts[0].get(feature, 0)
        rate = k1 / n1
        if rate / (rate + k0 / n0) < PRECISION:
            continue
        k, n = k1 + k0, n1 + n0
        cells = ((k1, n1 * k / n), (k0, n0 * k / n), (n1 - k1, n1 * (n - k) / n), (n0 - k0, n0 * (n - k) / n))
        if 2 * sum(seen * np.log(seen / due) for seen, due in cells if seen) >= EVIDENCE:
            found.add(feature)
    return found


def train(texts: list[str], toxic: list[int], share: float) -> Model:
    """A model from labelled texts; `share` is the part of toxic ones among all labels."""
    labels = np.array(toxic, dtype=np.int64)
    if not len(labels) or labels.min() == labels.max():
        return Model(None, share, np.zeros(3))
    docs = [[word.lower() for word in _WORD.findall(text)] for text in texts]
    good = evidence([set(words) for words in docs], labels)
    numbers: dict[str, int] = {}
    windows, tags = [], []
    for place, (words, label) in enumerate(zip(docs, labels.tolist(), strict=True)):
        own = [int(label and any(f in good for f in crf.features(word))) for word in words]
        for start in range(0, len(words), WINDOW):
            part = own[start : start + WINDOW]
            if any(part) or (start // WINDOW + place) % 8 == 0:
                windows.append([numbers.setdefault(word, len(numbers)) for word in words[start : start + WINDOW]])
                tags.append(part)
    names: dict[str, int] = {}
    used = Counter(feature for word in numbers for feature in crf.features(word))
    table = []
    for word in numbers:
        kept = [feature for feature in crf.features(word) if feature in good or used[feature] > 2]
        table.append(np.array([names.setdefault(feature, len(names)) for feature in kept], dtype=np.int64))
    filled, states = np.full((len(windows), WINDOW), -1, dtype=np.int64), np.zeros((len(windows), WINDOW), dtype=np.int64)
    for row, (words, part) in enumerate(zip(windows, tags, strict=True)):
        filled[row, : len(words)], states[row, : len(part)] = words, part
    if not len(windows):
        return Model(None, share, np.zeros(3))
    weights, bias, start, moves = crf.fit(filled, states, table, len(names))
    chain = crf.Chain({name: float(weights[k]) for name, k in names.items()}, bias, start, moves)
    model = Model(chain, share, np.zeros(3))
    highest, expected, _ = Tagger(model).read(texts)
    model.line = _line(highest, expected, labels, share)
    return model


def _line(highest: np.ndarray, expected: np.ndarray, labels: np.ndarray, share: float) -> np.ndarray:
    """Logistic regression of the labels at their true shares."""
    x = np.stack([np.ones(len(labels)), highest, np.log1p(expected)], axis=1)
    part = labels.mean()
    weight = np.where(labels == 1, share / part, (1 - share) / (1 - part))
    line = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ line, -30, 30)))
        slope = x.T @ (weight * (p - labels)) + 0.1 * line
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(3)
        line = line - np.clip(np.linalg.solve(bend, slope), -2, 2)
    return line


class Tagger:
    """Marginals of texts; emissions of recent words are kept, a bounded number."""

    def __init__(self, model: Model) -> None:
        self.chain = model.chain
        self.known: dict[str, float] = {}

    def emissions(self, words: list[str]) -> np.ndarray:
        new = set(words).difference(self.known)
        if len(self.known) + len(new) > KNOWN_WORDS:
            self.known.clear()
            new = set(words)
        self.known.update((word, self.chain.emission(word)) for word in new)
        return np.fromiter(map(self.known.__getitem__, words), dtype=float, count=len(words))

    def read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Per text the highest marginal as log odds, the expected offending words, and all marginals."""
        highest, expected = np.full(len(texts), -12.0), np.zeros(len(texts))
        if self.chain is None:
            return highest, expected, [np.zeros(0)] * len(texts)
        split = [_WORD.findall(text) for text in texts]
        lengths = np.array([len(words) for words in split], dtype=np.int64)
        odds = self.emissions([word for words in split for word in words])
        pieces = -(-lengths // PIECE)
        begin = np.cumsum(lengths) - lengths
        owner = np.repeat(np.arange(len(texts)), pieces)
        inner = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        at = (begin[owner] + inner * PIECE)[:, None] + np.arange(PIECE)
        real = at < (begin + lengths)[owner][:, None]
        if not len(owner):
            return highest, expected, [np.zeros(0)] * len(texts)
        cut = np.where(real, odds[np.where(real, at, 0)], 0.0)
        before, after = crf.messages(cut, real, inner, self.chain.start, self.chain.moves)
        marginal, _ = crf.forward_backward(cut, real, self.chain.start, self.chain.moves, before=before, after=after)
        clipped = np.clip(marginal, 6.1e-6, 1 - 6.1e-6)
        np.maximum.at(highest, owner, np.log(clipped / (1 - clipped)).max(axis=1))
        np.add.at(expected, owner, marginal.sum(axis=1))
        flat = marginal[real]
        return highest, expected, np.split(flat, np.cumsum(lengths)[:-1])


def fitted(docs: DataFrame, labels: DataFrame, toxic_docs: int = TOXIC_DOCS, clean_docs: int = CLEAN_DOCS, sample_chars: int = SAMPLE_CHARS) -> Model:
    """A model of the labelled documents that are not held out."""
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("_toxic"))
    counts = {int(row["_toxic"]): row["count"] for row in known.groupBy("_toxic").count().collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    order = F.xxhash64(F.col("doc_id").cast("bigint"))
    picked = [known.where(F.col("_toxic") == label).orderBy(order, "doc_id").limit(most) for label, most in ((1, toxic_docs), (0, clean_docs))]
    sample = picked[0].unionByName(picked[1]).withColumnRenamed("doc_id", "_id")
    texts = docs.select(F.col("doc_id").alias("_id"), "text").where(F.length("text") <= sample_chars)
    rows = texts.join(F.broadcast(sample), "_id").select("_id", "text", "_toxic").orderBy(F.xxhash64("_id", "text")).limit(toxic_docs + clean_docs).collect()
    return train([row["text"] for row in rows], [int(row["_toxic"]) for row in rows], share)


def scored(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The kept columns, `_score`, and `_spans`: start:end of offending words, in code points."""
    names = [*keep, "_score", "_spans"]

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(model)
        for whole in batches:
            every = [text or "" for text in whole.column("_text").to_pylist()]
            for first, last in byte_groups([len(text) for text in every], GROUP_CHARS):
                texts, batch = every[first:last], whole.slice(first, last - first)
                highest, expected, marginals = tagger.read(texts)
                spans = []
                for text, marginal in zip(texts, marginals, strict=True):
                    hits = set(np.flatnonzero(marginal >= SPAN_ODDS).tolist())
                    spans.append(",".join(f"{m.start()}:{m.end()}" for k, m in enumerate(_WORD.finditer(text)) if k in hits) if hits else "")
                yield pa.RecordBatch.from_arrays([*(batch.column(name) for name in keep), pa.array(model.document(highest, expected)), pa.array(spans, pa.string())], names=names)

    kinds = ", ".join([*(f"`{name}` {docs.schema[name].dataType.simpleString()}" for name in keep), "_score double, _spans string"])
    return docs.select(*[F.col(name) for name in keep], F.col("text").alias("_text")).mapInArrow(convert, kinds)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: its score, the label it predicts and the offsets of offending words."""
    found = scored(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), model, ["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"), F.col("_spans").alias("spans"))


def clean_documents(docs: DataFrame, labelled: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows with a score below one half, with all their columns."""
    model = fitted(labelled, labels)
    place = [name.lower() for name in docs.columns].index("text")

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(model)
        for batch in batches:
            texts = [text or "" for text in batch.column(place).to_pylist()]
            for first, last in byte_groups([len(text) for text in texts], GROUP_CHARS):
                highest, expected, _ = tagger.read(texts[first:last])
                yield batch.slice(first, last - first).filter(pa.array(model.document(highest, expected) < 0.5))

    return docs.mapInArrow(convert, docs.schema)
