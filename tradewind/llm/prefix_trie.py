"""The trie of conversation prefixes, measured by the Euler-tour technique.

A node is a distinct sequence of first turns. Its place is told by its depth and two exact sums of 60-bit
digests, one digest for each position and turn; running sums over the turns give them for every prefix
without holding a conversation. The node's number is its rank by smallest member and depth.

Every node has an enter and an exit arc. An enter arc leads to the enter arc of the first child, or to the
node's own exit; an exit arc leads to the next sibling's enter arc, or to the parent's exit. Children go by
smallest member. The list of arcs is ranked by `tours.ranked`; a node's subtree is the stretch between its
arcs, so leaves and savings of a subtree are differences of prefix sums at the two positions.

Rows without a conv_id take no part. Null roles and texts are empty. Turns go by number, null first; turns that
tie go by the digest of role and text, so rows that repeat are turns of their own. An empty table has no
nodes, not even a root. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.llm.common import Stage, join_groups
from tradewind.llm.scans import numbered, pieces, running
from tradewind.llm.tours import ranked

#: A conversation takes fewer turns than this from the one that its hundred starts with.
MOST_TAKEN = 6
FAMILY = 100
#: Members in one piece of an ends list.
PIECE_IDS = 4096
ROOT_KEY = "0:0:0"


def rebuilt(conversations: DataFrame, stage: Stage) -> tuple[DataFrame, DataFrame]:
    """All turns of the rebuilt conversations, and all conversations with `_length` after rebuilding."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        "turn",
        F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256).alias("_turn"),
        F.length(text).cast("bigint").alias("chars"),
    )
    order = [F.col("conv_id").asc(), F.col("turn").asc_nulls_first(), F.col("_turn").asc()]
    turns = running(numbered(turns, order, stage, "turns"), "conv_id", {"at": F.lit(1).cast("bigint")}, stage, "placed")
    taken = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(MOST_TAKEN)).cast("bigint")
    first = F.col("conv_id") - F.col("conv_id") % FAMILY
    convs = stage.put(turns.groupBy("conv_id").agg(F.max("at").alias("_own")).select("*", taken.alias("_taken"), first.alias("_family")), "conversations")
    heads = turns.where((F.col("at") < MOST_TAKEN) & (first == F.col("conv_id"))).select(F.col("conv_id").alias("_family"), "at", "_turn", "chars")
    lengths = heads.groupBy("_family").agg(F.max("at").alias("_given"))
    convs = convs.join(lengths, "_family", "left").withColumn("_given", F.least("_taken", F.coalesce("_given", F.lit(0))))
    convs = stage.put(convs.withColumn("_length", F.col("_given") + F.greatest(F.col("_own") - F.col("_taken"), F.lit(0))), "lengths")
    given = heads.join(convs, "_family").where("at <= _taken").select("conv_id", "at", "_turn", "chars", (F.col("at") == F.col("_length")).alias("_last"))
    own = join_groups(turns.select("conv_id", "at", "_turn", "chars"), convs, "conv_id", "_own", stage, "long").where("at > _taken")
    own = own.withColumn("at", F.col("at") - F.col("_taken") + F.col("_given")).select("conv_id", "at", "_turn", "chars", (F.col("at") == F.col("_length")).alias("_last"))
    return given.unionByName(own), convs.select("conv_id", "_length")


def _digits(first: int):
    return F.conv(F.substring("_place", first, 15), 16, 10).cast("decimal(38,0)")


def prefixes(turns: DataFrame, stage: Stage) -> DataFrame:
    """Per rebuilt turn the keys of the prefix that ends with it and of the one before."""
    place = F.sha2(F.concat(F.col("at").cast("string"), F.lit(":"), F.col("_turn")), 256).alias("_place")
    turns = turns.select("conv_id", "at", "chars", "_last", place).withColumns({"_one": _digits(1), "_two": _digits(17)}).drop("_place")
    order = [F.col("conv_id").asc(), F.col("at").asc()]
    sums = running(numbered(turns, order, stage, "rebuilt"), "conv_id", {"one": F.col("_one"), "two": F.col("_two")}, stage, "prefixes")

    def key(depth, one, two):
        return F.concat_ws(":", depth.cast("string"), one.cast("decimal(38,0)").cast("string"), two.cast("decimal(38,0)").cast("string"))

    at, one, two = F.col("at"), F.col("one"), F.col("two")
    return sums.select("conv_id", at.alias("depth"), "chars", "_last", key(at, one, two).alias("key"), key(at - 1, one - F.col("_one"), two - F.col("_two")).alias("up"))


def ends(members: DataFrame) -> DataFrame:
    """Per key the digest of the ascending, comma-joined conv_ids; long lists are joined in pieces, then hashed as a stream."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def piece() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key]), pa.array([held[0]], pa.int64()), pa.array([",".join(map(str, held))])], names=["key", "first", "ids"])

        for batch in batches:
            for own, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held and (own != key or len(held) == PIECE_IDS):
                    yield piece()
                    held = []
                key = own
                held.append(conv)
        if held:
            yield piece()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key]), pa.array([state.hexdigest()])], names=["key", "ends_sha256"])

        for batch in batches:
            for own, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if own != key and state is not None:
                    yield done()
                state = hashlib.sha256() if own != key else state
                state.update((ids if own != key else "," + ids).encode())
                key = own
        if state is not None:
            yield done()

    tasks = pieces(members)
    joined = members.repartitionByRange(tasks, "key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(join, "key string, first bigint, ids string")
    return joined.repartition(tasks, "key").sortWithinPartitions("key", "first").mapInArrow(digest, "key string, ends_sha256 string")


def _arcs(nodes: DataFrame, stage: Stage) -> tuple[DataFrame, DataFrame]:
    """Nodes with their parent's conv_id and number of children, and the tour's arcs as a linked list."""
    families = nodes.where("depth > 0").groupBy("up").agg(F.count(F.lit(1)).alias("n_children"), F.min("number").alias("_child"))
    known = nodes.join(families.withColumnRenamed("up", "key"), "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    known = stage.put(known, "known")
    parents = known.where("n_children > 0").select(F.col("key").alias("up"), F.col("number").alias("_parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("_family"))
    children = join_groups(nodes.where("depth > 0").select("up", "number"), parents, "up", "_family", stage, "families").select("number", "_parent", "parent_conv_id")
    lined = numbered(children, [F.col("_parent").asc(), F.col("number").asc()], stage, "siblings")
    after = lined.select((F.col("_number") - 1).alias("_number"), F.col("number").alias("_after"), F.col("_parent").alias("_of"))
    sibling = F.when(F.col("_of") == F.col("_parent"), F.col("_after"))
    lined = stage.put(lined.join(after, "_number", "left").select("number", "_parent", "parent_conv_id", sibling.alias("_sibling")), "lined")
    known = stage.put(known.join(lined, "number", "left"), "nodes-known")
    enter, leave = F.col("number") * 2, F.col("number") * 2 + 1
    onward = F.coalesce(F.col("_child") * 2, leave)
    back = F.coalesce(F.col("_sibling") * 2, F.col("_parent") * 2 + 1, F.lit(-1))
    arcs = known.select(F.explode(F.array(F.struct(enter.alias("id"), onward.alias("next")), F.struct(leave.alias("id"), back.alias("next")))).alias("_arc")).select("_arc.*")
    return known, stage.put(arcs, "arcs")


def measured(nodes: DataFrame, positions: DataFrame, stage: Stage) -> DataFrame:
    """Per node number the leaves and savings of its subtree: differences of prefix sums at its two arcs."""
    size = -(-positions.count() // pieces(positions)) or 1
    arcs = positions.select((F.col("id") % 2).alias("_leave"), F.floor(F.col("id") / 2).alias("number"), F.col("position").alias("_number"))
    own = nodes.select("number", (F.col("n_children") == 0).cast("bigint").alias("_leaf"), ((F.col("n_convs") - 1) * F.col("chars")).alias("_saved"))
    own = own.withColumn("_leave", F.lit(0).cast("bigint"))
    arcs = arcs.join(own, ["number", "_leave"], "left").withColumns({"_piece": F.floor(F.col("_number") / size), "_tour": F.lit(0)})
    arcs = arcs.withColumns({name: F.coalesce(name, F.lit(0)) for name in ("_leaf", "_saved")})
    sums = running(stage.put(arcs, "weights"), "_tour", {"leaves": F.col("_leaf"), "saved": F.col("_saved")}, stage, "tour")

    def within(total: str, weight: str):
        change = F.when(F.col("_leave") == 1, F.col(total)).otherwise(F.col(weight) - F.col(total))
        return F.sum(change)

    return sums.groupBy("number").agg(within("leaves", "_leaf").alias("n_leaves"), within("saved", "_saved").alias("saved_tokens"))


def nodes(conversations: DataFrame) -> DataFrame:
    """One row per node: members, parent, children, leaves and savings of the subtree, and who ends there."""
    stage = Stage(conversations.sparkSession, "trie")
    turns, convs = rebuilt(conversations, stage)
    found = prefixes(turns, stage)
    inner = found.groupBy("depth", "key").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("chars").alias("chars"), F.max("up").alias("up"))
    zero = F.lit(0).cast("bigint")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    root = root.select(zero.alias("depth"), F.lit(ROOT_KEY).alias("key"), "conv_id", "n_convs", zero.alias("chars"), F.lit(None).cast("string").alias("up"))
    every = numbered(inner.unionByName(root), [F.col("conv_id").asc(), F.col("depth").asc()], stage, "nodes")
    every = every.withColumnRenamed("_number", "number").drop("_piece")
    known, arcs = _arcs(every, stage)
    subtrees = stage.put(measured(known, ranked(arcs, Stage(conversations.sparkSession, "tour")), stage), "subtrees")
    last = found.where("_last").select("key", "conv_id").unionByName(convs.where("_length = 0").select(F.lit(ROOT_KEY).alias("key"), "conv_id"))
    ended = stage.put(ends(last), "ends")
    nobody = F.lit(hashlib.sha256(b"").hexdigest())
    return known.join(subtrees, "number").join(ended, "key", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nobody).alias("ends_sha256")
    )
