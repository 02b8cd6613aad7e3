"""Exact deduplication against immutable snapshots.

Documents arrive in batches. Everything before a batch is an immutable snapshot: a table of distinct
text digests with their group, and one static binary-fuse filter per digest bucket. A new batch is first
grouped by itself, so a text that holds a third of its rows is one digest from then on. Its distinct
digests are screened by the filter of their bucket; only positives are joined with the snapshot's exact
digests, the others are new for certain. Digests that more than one row shares are then checked byte by
byte: least and greatest text of a digest are aggregated before the shuffle and must be the same text.
Digests that fail this are regrouped by their whole texts.

Texts are equal when identical after lower-casing A-Z. Null counts as an empty text, and empty texts
are equal. The row with the largest doc_id stays (null ids come last); of rows that repeat one doc_id
and text a single one stays. Extra columns are ignored by `deduplicate` and kept by `kept_documents`.
An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewind.llm import fuse
from tradewind.llm.common import Stage, filter_by_keys, text_bytes, whole_rows

BUCKET_KEYS = 200_000
BATCHES = 2
DIGEST_BYTES = 32
#: Rows per batch of whole texts on the way back from the workers.
TEXT_BYTES = 8 << 20


def digested(docs: DataFrame, keep: list[str], with_text: bool = False, inside: tuple[str, int] | None = None) -> DataFrame:
    """The kept columns, the SHA-256 of the normalised text, and on demand that text.

    The text is the column of that name, or `inside` a kept struct column the field at a place.
    """
    names = [*keep, "_sha", *(["_norm"] if with_text else [])]

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            step = max(1, int(whole.num_rows * TEXT_BYTES / max(TEXT_BYTES, whole.nbytes)))
            for start in range(0, whole.num_rows, step):
                batch = whole.slice(start, step)
                texts = batch.column(inside[0]).field(inside[1]) if inside else batch.column("_text")
                body, offsets = text_bytes(texts)
                body = body.lower()  # of bytes: A-Z only
                view, at = memoryview(body), offsets.tolist()
                digests = [hashlib.sha256(view[a:b]).digest() for a, b in zip(at, at[1:], strict=False)]
                columns = [*(batch.column(name) for name in keep), pa.array(digests, pa.binary())]
                if with_text:
                    columns.append(pa.array([body[a:b] for a, b in zip(at, at[1:], strict=False)], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    fields = [f"`{name}` {docs.schema[name].dataType.simpleString()}" for name in keep]
    kinds = ", ".join([*fields, "_sha binary", *(["_norm binary"] if with_text else [])])
    texts = [] if inside else [F.col("text").alias("_text")]
    return docs.select(*[F.col(name) for name in keep], *texts).mapInArrow(convert, kinds)


def _key() -> Column:
    return F.xxhash64("_digest")


def build_filters(digests: DataFrame, buckets: int) -> DataFrame:
    """One binary-fuse filter per bucket of distinct digests."""

    def build(group: pd.DataFrame) -> pd.DataFrame:
        keys = np.unique(group["_key"].to_numpy(np.int64).view(np.uint64))
        seed, segment, segments, table = fuse.build(keys)
        return pd.DataFrame({"_bucket": group["_bucket"].iloc[:1], "_seed": [np.uint64(seed).view(np.int64)], "_segment": [segment], "_segments": [segments], "_table": [table]})

    keyed = digests.select(_key().alias("_key")).withColumn("_bucket", F.pmod("_key", F.lit(buckets)))
    return keyed.groupBy("_bucket").applyInPandas(build, "_bucket bigint, _seed bigint, _segment bigint, _segments bigint, _table binary")


def screen(batch: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """A batch of distinct digests with a flag: false means not in the snapshot for certain."""

    def probe(group: pd.DataFrame, filter_rows: pd.DataFrame) -> pd.DataFrame:
        if not len(group):
            return group.assign(_maybe=False)
        maybe = np.zeros(len(group), dtype=bool)
        for row in filter_rows.itertuples(index=False):
            keys = group["_key"].to_numpy(np.int64).view(np.uint64)
            seed = int(np.int64(row[1]).view(np.uint64))
            maybe |= fuse.probe(keys, seed, int(row[2]), int(row[3]), row[4])
        return group.assign(_maybe=maybe)

    keyed = batch.select("_digest", "_rows", "_keep", _key().alias("_key")).withColumn("_bucket", F.pmod("_key", F.lit(buckets)))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keyed.schema)
    return keyed.groupBy("_bucket").cogroup(filters.groupBy("_bucket")).applyInPandas(probe, f"{fields}, _maybe boolean").drop("_bucket", "_key")


def add_batch(snapshot: DataFrame | None, batch: DataFrame, stage: Stage, name: str, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """The next snapshot: the groups of the last one and of the batch's own distinct digests."""
    if snapshot is None:
        return stage.put(batch, name)
    buckets = max(1, -(-snapshot.count() // bucket_keys))
    filters = stage.put(build_filters(snapshot, buckets), f"{name}-filters")
    screened = stage.put(screen(batch, filters, buckets), f"{name}-screened")
    positive = screened.where("_maybe").drop("_maybe")
    hits = positive.join(snapshot.select("_digest"), "_digest", "left_semi")
    fresh = screened.where("NOT _maybe").drop("_maybe").unionByName(positive.join(snapshot.select("_digest"), "_digest", "left_anti"))
    found = hits.select("_digest", F.col("_rows").alias("_more"), F.col("_keep").alias("_other"))
    merged = snapshot.join(found, "_digest", "left").select(
        "_digest", (F.col("_rows") + F.coalesce("_more", F.lit(0))).alias("_rows"), F.greatest("_keep", "_other").alias("_keep")
    )
    return stage.put(merged.unionByName(fresh.select("_digest", "_rows", "_keep")), name)


def differing_digests(docs: DataFrame, shared: DataFrame, digest_bytes: int) -> DataFrame:
    """Of the digests that several rows share, those whose texts are not the same byte for byte."""
    texts = digested(docs, [], with_text=True).select(F.substring("_sha", 1, digest_bytes).alias("_digest"), "_norm")
    texts = filter_by_keys(texts, shared, ["_digest"], "left_semi", shared.count())
    checked = texts.groupBy("_digest").agg(F.min("_norm").alias("_least"), F.max("_norm").alias("_most"))
    return checked.where("_least <> _most").select("_digest")


def decisions(docs: DataFrame, batches: int = BATCHES, bucket_keys: int = BUCKET_KEYS, digest_bytes: int = DIGEST_BYTES) -> DataFrame:
    """doc_id, _sha, keep_id, group_size and kept of every row."""
    stage = Stage(docs.sparkSession, "dedup")
    numbered = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    rows = digested(numbered, ["doc_id"]).withColumn("_row", F.monotonically_increasing_id())
    rows = stage.put(rows, "rows").withColumn("_digest", F.substring("_sha", 1, digest_bytes))
    by_batch = rows.groupBy(F.pmod(F.xxhash64("doc_id"), F.lit(batches)).alias("_batch"), "_digest").agg(
        F.count(F.lit(1)).alias("_rows"), F.max(F.struct("doc_id", "_row")).alias("_keep")
    )
    by_batch = stage.put(by_batch, "batches")
    snapshot = None
    for number in range(batches):
        batch = by_batch.where(F.col("_batch") == number).drop("_batch")
        snapshot = add_batch(snapshot, batch, stage, f"snapshot-{number}", bucket_keys)
    shared = stage.put(snapshot.where("_rows > 1").select("_digest"), "shared")
    differing = stage.put(differing_digests(numbered, shared, digest_bytes), "differing")
    settled = snapshot.withColumnRenamed("_rows", "group_size")
    result = ["doc_id", "_sha", "_row", "_keep", "group_size"]
    if differing.isEmpty():
        found = rows.join(settled, "_digest").select(result)
    else:
        found = rows.join(settled.join(differing, "_digest", "left_anti"), "_digest").select(result)
        texts = digested(numbered, ["doc_id"], with_text=True).withColumn("_digest", F.substring("_sha", 1, digest_bytes))
        texts = texts.join(differing, "_digest", "left_semi").withColumn("_row", F.monotonically_increasing_id())
        texts = stage.put(texts, "texts")
        classes = texts.groupBy("_norm").agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct("doc_id", "_row")).alias("_keep"))
        found = found.unionByName(texts.join(classes, "_norm").select(result))
    return found.select("doc_id", "_sha", F.col("_keep.doc_id").alias("keep_id"), "group_size", (F.col("_row") == F.col("_keep._row")).alias("kept"))


def deduplicate(docs: DataFrame, batches: int = BATCHES, bucket_keys: int = BUCKET_KEYS, digest_bytes: int = DIGEST_BYTES) -> DataFrame:
    """One row per document: the row that stays for its text, the group's size, and whether it is that row.

    Fewer `digest_bytes` make digests collide; texts are told apart all the same.
    """
    found = decisions(docs, batches, bucket_keys, digest_bytes)
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("_sha")).alias("text_sha256"))


def kept_documents(docs: DataFrame, batches: int = BATCHES, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """The rows that stay, with all their columns."""
    stage = Stage(docs.sparkSession, "dedup-keys")
    keys = ["_id", "_none", "_sha"]
    marks = [F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_none")]
    found = decisions(docs, batches, bucket_keys).select(*marks, "_sha", "kept")
    tally = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), F.max("kept").alias("_kept"))
    away = stage.put(tally.where("NOT _kept OR _rows > 1"), "away")
    place = [name.lower() for name in docs.columns].index("text")
    tagged = digested(docs.select(whole_rows(docs), *marks), ["_doc", "_id", "_none"], inside=("_doc", place))
    left = filter_by_keys(tagged, away.select(keys), keys, "left_anti", away.count())
    again = away.where("_kept")
    if not again.isEmpty():
        left = left.unionByName(tagged.join(again.select(keys), keys, "left_semi").dropDuplicates(keys))
    return left.select("_doc.*")
