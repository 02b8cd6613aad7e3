"""Mixing sources to target weights by hash-threshold histograms.

A document's size is its number of words. The sources, in code-point order with null last, weigh 5, 2, 1
in turn and share all words; a source's target stops at `most_times` its own words, and what is above is
shared again by weight among the others until none is above. Every document of a source is taken as many
whole times as the target holds the source, and once more if its hash lies below the source's threshold.

Thresholds come from histograms: words are summed by source and the leading bits of the hash, the bucket
in which the running sum passes the budget is found, and only the rows of that bucket are kept and summed again
by the next bits, until one document or rows alike are left. Of these as many are taken as bring the sum nearest.
Nothing is sorted, each round reads a smaller part, and the hash depends on the document alone, so reruns agree.

A null or empty text has no words; its row follows the same rule with size zero. Rows that repeat share one hash;
where a threshold falls among them, they are numbered and the first ones taken, so reruns agree but for which of
equal rows these are. Extra columns are ignored by `mix` and kept by `mixed_documents`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewind.llm.common import Stage, bounded, whole_rows
from tradewind.llm.scans import numbered

WEIGHTS = (5.0, 2.0, 1.0)
MOST_TIMES = 3
#: Bits of the hash that each round looks at; together 63.
ROUNDS = (12, 12, 12, 12, 15)
RANKED_ROWS = 200_000

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def _source_key() -> Column:
    """The source with its place in the order: null after every name."""
    return F.coalesce(F.concat(F.lit("a"), F.col("source").cast("string")), F.lit("b"))


def row_hash() -> Column:
    """63 bits that depend on the document alone."""
    return F.shiftrightunsigned(F.xxhash64(F.col("doc_id").cast("bigint"), _source_key(), F.col("text").cast("string")), 1)


def ranked(sources: DataFrame, stage: Stage) -> DataFrame:
    """Sources with their place in code-point order, numbered by ranges, not in one task."""
    count = sources.count()
    ranges = max(1, -(-count // RANKED_ROWS))
    parted = stage.put(sources.repartitionByRange(ranges, "_source").withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = parted.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows"))
    starts = starts.select("_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy("_source"))
    return parted.join(F.broadcast(starts), "_range").select("_source", "_words", (F.col("_start") + place - 1).alias("_place"))


def targets(sources: DataFrame, stage: Stage, weights: tuple[float, ...] = WEIGHTS, most_times: int = MOST_TIMES) -> DataFrame:
    """Words to take from each source; the rounds only bring sums to the driver."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("_place", F.lit(len(weights))) + 1).cast("int"))
    table = stage.put(ranked(sources, stage).withColumn("_weight", weight), "weights")
    cap = F.col("_words") * F.lit(most_times)
    total = table.agg(F.coalesce(F.sum("_words"), F.lit(0))).first()[0]
    level, full = 0.0, -1
    while True:
        above = F.col("_weight") * F.lit(level) > cap
        found = table.agg(
            F.count_if(above), F.coalesce(F.sum(F.when(above, cap)), F.lit(0)), F.coalesce(F.sum(F.when(~above, F.col("_weight"))), F.lit(0.0))
        ).first()
        if found[0] == full or not found[2]:
            break
        full, level = found[0], (total - found[1]) / found[2]
    target = F.least(F.col("_weight") * F.lit(level), cap.cast("double"))
    return table.select("_source", "_words", target.alias("_target"))


def thresholds(items: DataFrame, budgets: DataFrame, stage: Stage) -> DataFrame:
    """Per source the hash below which its documents are taken, and how many of the rows at that hash (`_few` of `_alike`).

    Together they sum up to the budget, to the nearest row. `budgets` has `_source` and `_left`; sources whose
    budget is zero or less get no row.
    """
    state = stage.put(budgets.where("_left > 0").select("_source", F.lit(0).cast("bigint").alias("_prefix"), "_left"), "open-0")
    settled: DataFrame | None = None
    shift = 63
    for number, bits in enumerate(ROUNDS, 1):
        width, shift = shift, shift - bits
        part = items.join(bounded(state, state.count(), 64), "_source").where(F.shiftright("_hash", width) == F.col("_prefix"))
        sums = part.groupBy("_source", "_left", F.shiftright("_hash", shift).alias("_bucket")).agg(
            F.sum("_size").alias("_sum"), F.count(F.lit(1)).alias("_rows"), F.min("_hash").alias("_hash"), F.max("_hash").alias("_last")
        )
        running = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        edge = sums.withColumn("_rest", F.col("_left") - F.sum("_sum").over(running) + F.col("_sum")).where("_rest >= 0 AND _rest < _sum")
        alike = F.col("_hash") == F.col("_last")
        everything = F.shiftleft(F.col("_prefix") + 1, width) if width < 63 else F.lit((1 << 63) - 1)
        step = state.select("_source", "_prefix").join(edge.drop("_left"), "_source", "left")
        below = F.when(F.col("_bucket").isNull(), everything).when(alike, F.col("_hash"))
        few = F.when(F.col("_bucket").isNull(), 0).when(alike, F.floor(F.col("_rest") * F.col("_rows") / F.col("_sum") + 0.5)).cast("bigint")
        step = step.select("_source", "_bucket", "_rest", below.alias("_below"), few.alias("_few"), F.coalesce("_rows", F.lit(0)).alias("_alike"))
        step = stage.put(step, f"round-{number}")
        done = step.where("_below IS NOT NULL").select("_source", "_below", "_few", "_alike")
        settled = done if settled is None else settled.unionByName(done)
        state = stage.put(step.where("_below IS NULL").select("_source", F.col("_bucket").alias("_prefix"), F.col("_rest").alias("_left")), f"open-{number}")
        count = state.count()
        if not count:
            break
        left = items.join(bounded(state.select("_source", "_prefix"), count, 64), "_source").where(F.shiftright("_hash", shift) == F.col("_prefix"))
        items = stage.put(left.select("_source", "_size", "_hash"), f"items-{number}")
    return settled


def _planned(items: DataFrame, stage: Stage, weights: tuple[float, ...], most_times: int) -> DataFrame:
    """Per source its words, target, whole times, and threshold; items have `_source`, `_size` and `_hash`."""
    sources = stage.put(items.groupBy("_source").agg(F.sum("_size").alias("_words")), "sources")
    plan = stage.put(targets(sources, stage, weights, most_times), "targets")
    times = F.when(F.col("_words") > 0, F.least(F.floor(F.col("_target") / F.col("_words")), F.lit(most_times))).otherwise(0)
    plan = plan.withColumn("_times", times.cast("int"))
    limits = thresholds(items, plan.withColumn("_left", F.col("_target") - F.col("_times") * F.col("_words")), stage)
    return stage.put(plan.join(limits, "_source", "left"), "plan")


def _copied(rows: DataFrame, plan: DataFrame, stage: Stage, most_times: int) -> DataFrame:
    """Rows with what the plan says of their source and `_copies`; rows alike at a threshold are numbered to take a part of them."""
    joined = rows.join(bounded(plan, plan.count(), 112), "_source")
    at = F.coalesce(F.col("_hash") == F.col("_below"), F.lit(False))
    split = F.coalesce((F.col("_few") > 0) & (F.col("_few") < F.col("_alike")), F.lit(False))
    more = F.coalesce(F.col("_hash") < F.col("_below"), F.lit(False)) | (at & F.coalesce(F.col("_few") > 0, F.lit(False)))
    copies = F.least(F.col("_times") + more.cast("int"), F.lit(most_times)).alias("_copies")
    if plan.where(split).isEmpty():
        return joined.select("*", copies)
    alike = joined.where(at & split).withColumn("_row", F.monotonically_increasing_id())
    lined = numbered(alike, [F.col("_source").asc(), F.col("_row").asc()], stage, "alike")
    first = stage.put(lined.groupBy("_source").agg(F.min("_number").alias("_first")), "alike-first")
    lined = lined.join(bounded(first, first.count(), 64), "_source")
    taken = (F.col("_number") - F.col("_first") < F.col("_few")).cast("int")
    part = lined.select(*joined.columns, F.least(F.col("_times") + taken, F.lit(most_times)).alias("_copies"))
    return joined.where(~(at & split)).select("*", copies).unionByName(part)


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most_times: int = MOST_TIMES) -> DataFrame:
    """One row per document: its words, its source's words and target, and the words taken of it."""
    stage = Stage(docs.sparkSession, "mix")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", _source_key().alias("_source"), word_count().alias("_size"), row_hash().alias("_hash"))
    rows = stage.put(rows, "rows")
    found = _copied(rows, _planned(rows.select("_source", "_size", "_hash"), stage, weights, most_times), stage, most_times)
    return found.select(
        "doc_id",
        F.col("_size").alias("size"),
        F.col("_words").alias("source_size"),
        F.col("_target").alias("target"),
        (F.col("_size") * F.col("_copies")).alias("taken"),
        "source",
        F.col("_copies").alias("copies"),
    )


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most_times: int = MOST_TIMES) -> DataFrame:
    """The documents taken, each as many times as the mix takes it, with all their columns."""
    stage = Stage(docs.sparkSession, "mix")
    tagged = docs.select(whole_rows(docs), _source_key().alias("_source"), row_hash().alias("_hash"))
    items = stage.put(docs.select(_source_key().alias("_source"), word_count().alias("_size"), row_hash().alias("_hash")), "rows")
    copied = _copied(tagged, _planned(items, stage, weights, most_times), stage, most_times).where("_copies > 0")
    return copied.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_doc.*")
