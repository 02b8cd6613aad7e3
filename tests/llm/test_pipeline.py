"""The pipeline over the smallest tables, stage by stage against brute force."""

from __future__ import annotations

import corpus_pipeline
import numpy as np

from tests.llm.test_operators import lowered, slow_components, slow_print
from tradewind.llm import toxicity
from tradewind.llm.words import PartEncoder


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    steps = dict(corpus_pipeline.STAGES)
    model = toxicity.fitted(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    rejected = {r.doc_id for r in toxicity.score(docs, model).where("predicted = 1").collect()}
    path = f"{spark.conf.get('spark.checkpoint.dir')}/stages"
    results = {}
    for name, step in corpus_pipeline.STAGES:
        step(spark, docs, sf).write.mode("overwrite").parquet(f"{path}/{name}")
        docs = spark.read.parquet(f"{path}/{name}")
        results[name] = docs
        assert name == "packing" or docs.columns == columns
    every = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    left = {i: r for i, r in every.items() if i not in rejected}
    assert {r.doc_id for r in results["toxicity"].collect()} == set(left)
    newest: dict[str, int] = {}
    for i, r in left.items():
        newest[lowered(r.text)] = max(i, newest.get(lowered(r.text), i))
    assert {r.doc_id for r in results["exact_dedup"].collect()} == set(newest.values())
    ids = sorted(newest.values())
    least = slow_components(ids, [slow_print(every[i].text) for i in ids])
    assert sorted(r.doc_id for r in results["near_dedup"].collect()) == sorted(set(least))
    mixed = [r.doc_id for r in results["mixing"].collect()]
    assert set(mixed) <= set(least) and max(np.unique(mixed, return_counts=True)[1]) <= 3
    own = PartEncoder().library
    pieces = results["packing"].collect()
    assert sum(p.length for p in pieces) == sum(len(own.encode(every[i].text or "", add_special_tokens=False).ids) + 1 for i in mixed)
    assert list(steps) == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]
