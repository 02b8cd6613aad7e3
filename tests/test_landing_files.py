"""Landing files of few records: written by the tasks themselves, with the bytes of Spark's writer."""

from __future__ import annotations

import gzip
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tradewind.session import scratch_path, setting
from tradewind.sinks import files
from tradewind.sources import storage


def lines(path):
    return (gzip.open if path.endswith(".gz") else open)(path, "rb").read().splitlines(keepends=True)


def odd_rows(spark, rows, tasks):
    number = F.col("id")
    return spark.range(0, rows, 1, tasks).select(
        number,
        F.when(number % 3 == 0, None).otherwise(F.concat(F.lit('ä "\\\n  ₫ '), number)).alias("text"),
        F.array(F.struct((number / 7).alias("share"), F.lit(None).cast("string").alias("none"))).alias("list"),
        F.when(number % 2 == 0, F.struct(F.lit("2024-07-21 01:02:03").cast("timestamp").alias("at"), (number * 2).cast("decimal(15,2)").alias("price"))).alias("data"),
    )


@pytest.mark.parametrize("compressed", [False, True])
def test_small_files_hold_what_sparks_writer_writes(spark, compressed):
    df, folder, plain = odd_rows(spark, 203, 3), scratch_path(spark, "small"), scratch_path(spark, "plain")
    with setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", "7"):
        paths = files.write_chunks(df, folder, "list", "2024-07-21", 10, compressed=compressed)
    df.write.option("ignoreNullFields", False).json(plain)
    wanted = [line for part in sorted(Path(plain).glob("part-*")) for line in lines(str(part))]
    assert [line for path in paths for line in lines(path)] == wanted
    sizes = [len(lines(path)) for path in paths]
    assert max(sizes) == 10 and len(sizes) == 7 + 7 + 7 and sum(sizes) == 203
    ending = ".json.gz" if compressed else ".json"
    assert sorted(os.listdir(folder)) == sorted(f"list-2024-07-21-{n}{ending}" for n in range(1, 22))


def test_without_records_one_empty_file_is_landed(spark):
    folder = scratch_path(spark, "none")
    for rows in (5, 5_000):
        for df in (odd_rows(spark, 0, 2), odd_rows(spark, 9, 3).where("id > 3")):
            paths = files.write_chunks(df, f"{folder}-{rows}", "list", "2024-07-21", rows)
            assert lines(paths[0]) == []
    assert len(os.listdir(f"{folder}-5")) == len([n for n in os.listdir(f"{folder}-5000") if n.endswith(".json")]) == 4


def test_local_files_are_renamed_with_their_checksums(spark):
    folder = scratch_path(spark, "names")
    for name in ("a", "b"):
        storage.create_new(spark, f"{folder}/{name}", name)
    assert storage.local_path(spark, f"file://{folder}/a b") == f"{folder}/a b"
    os.unlink(f"{folder}/.a.crc")
    storage.rename_all(spark, f"file://{folder}", folder, [("b", "c"), ("a", "d"), ("c", "e")])
    assert sorted(os.listdir(folder)) == [".e.crc", "d", "e"]
    assert [storage.read_text(spark, f"{folder}/{name}") for name in "de"] == ["a", "b"]
    with pytest.raises(OSError):
        storage.rename_all(spark, folder, folder, [("none", "x")])
