"""Loads that run side by side: turns, shared settings, files that are still being written."""

from __future__ import annotations

import struct
import threading
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pytest

from checks.load_queries import Turns
from tradewind.operators.skew import colocated
from tradewind.session import scratch_path
from tradewind.sources import storage


def test_turns_keep_their_order_whoever_comes_first():
    turns, done = Turns([10, 11, 10, 11]), []

    def load(platform_id):
        for _ in range(2):
            with turns.of(platform_id):
                done.append(platform_id)

    with ThreadPoolExecutor(2) as pool:
        for part in [pool.submit(load, p) for p in (11, 10)]:
            part.result(20)
    with turns.of(12):
        done.append(12)
    assert done == [10, 11, 10, 11, 12]


def test_a_marketplace_that_ends_early_holds_nobody_up():
    turns = Turns([10, 11, 10, 11])
    turns.end(10)
    with turns.of(11), turns.of(11):
        pass


def test_overlapping_joins_restore_the_setting(spark):
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name, None)
    first, second = colocated(spark), colocated(spark)
    first.__enter__()
    second.__enter__()
    first.__exit__(None, None, None)
    assert spark.conf.get(name) == "false"
    second.__exit__(None, None, None)
    assert spark.conf.get(name, None) == before


def test_a_numbered_file_is_read_once_its_checksum_is_there(spark):
    folder = Path(scratch_path(spark, "numbers"))
    folder.mkdir(parents=True)
    (folder / "000000000001").write_text("5")
    crc = folder / ".000000000001.crc"
    crc.write_bytes(b"crc\0" + struct.pack(">ii", 512, 0))
    with pytest.raises(Exception, match="hecksum"):
        storage.read_text(spark, str(folder / "000000000001"))
    threading.Timer(1, crc.unlink).start()
    assert storage.last_numbered(spark, str(folder)) == (1, "5")
