"""Tables in which a third of all rows are one row: shards and mixes still come out even."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tradewind.llm import mixing, sharding

SCHEMA = "doc_id bigint, text string, lang string, source string"


def table(spark, repeats, others, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(int(k), "w " * int(n), "en", f"s{k % 2}") for k, n in enumerate(rng.integers(1, 60, others))]
    rows += [(-7, "one row of ten words that comes again and again", "de", "s0")] * repeats
    return spark.createDataFrame([rows[k] for k in rng.permutation(len(rows))], SCHEMA).repartition(4), rows


def test_shards_stay_even_when_a_third_of_the_rows_are_one(spark):
    frame, rows = table(spark, 15_000, 30_000)
    got = sharding.shard(frame).groupBy("shard").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"), F.max("slot").alias("last"), F.count_distinct("slot").alias("slots")).collect()
    sizes = [r.bytes for r in got]
    assert len(got) == 24 and sum(r.rows for r in got) == len(rows)
    assert max(sizes) < 1.03 * min(sizes)
    assert all(r.last == r.rows - 1 and r.slots == r.rows for r in got)


@pytest.mark.parametrize("repeats", [2, 601, 1500])
def test_mixes_cut_among_equal_rows(spark, repeats):
    frame, rows = table(spark, repeats, 900)
    got = mixing.mix(frame).collect()
    assert len(got) == len(rows)
    for source in ("s0", "s1"):
        mine = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= max(r.size for r in mine)
        assert all(r.taken % r.size == 0 and r.taken <= 3 * r.size for r in mine)
    assert sorted(str((r.doc_id, r.taken)) for r in mixing.mix(frame.repartition(7)).collect()) == sorted(str((r.doc_id, r.taken)) for r in got)
    assert mixing.mixed_documents(frame).count() == sum(r.copies for r in got)


def test_a_source_of_equal_rows_alone(spark):
    rows = [(1, "ten words are in this text as one can count", "en", "a")] * 600 + [(2, "x " * 20, "en", "b")] * 900
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    for source in ("a", "b"):
        mine = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= mine[0].size
