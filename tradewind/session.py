"""Session construction and the shared scratch folder."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.sources.partitionOverwriteMode": "static",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app_name: str = "tradewind", master: str | None = None, **settings: str) -> SparkSession:
    """Return a session with adaptive execution on and UTC as session zone."""
    builder = SparkSession.builder.appName(app_name)
    if master is not None:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_held: dict[str, tuple[int, str | None]] = {}
_holding = threading.Lock()


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A session setting for the plans made within; of several threads within, the last one restores it."""
    with _holding:
        users, before = _held.get(name) or (0, spark.conf.get(name, None))
        _held[name] = users + 1, before
        spark.conf.set(name, value)
    try:
        yield
    finally:
        with _holding:
            users, before = _held.pop(name)
            if users > 1:
                _held[name] = users - 1, before
            elif before is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, before)


def freed_shuffles(spark: SparkSession) -> AbstractContextManager[None]:
    """Jobs within remove their shuffle files when they end, instead of when the driver next collects its garbage."""
    return setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder; a local temporary one only when none is set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    root = tempfile.mkdtemp(prefix="tradewind-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh, not yet existing path under the shared folder."""
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
