"""Category trees: flattening, leaves, parent ids, subtrees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewind import functions as X
from tradewind.operators.skew import join_large
from tradewind.schemas import P11, TREE_P11, UNKNOWN_CODE


#: Levels that one round of a flattening opens; deeper trees take more rounds.
LEVELS_AT_ONCE = 8


def _opened(rows: DataFrame) -> DataFrame:
    """Every closed node as itself, now open, and its children, closed, one level below."""
    node = F.col("node.tree")
    code = F.try_variant_get(node, "$.category_id", "bigint")
    children = F.coalesce(F.try_variant_get(node, "$.children", "array<variant>"), F.array().cast("array<variant>"))
    own = F.struct(node.alias("tree"), F.col("node.parent").alias("parent"), F.col("node.level").alias("level"), F.lit(True).alias("open"))
    below = F.transform(
        children,
        lambda child: F.struct(child.alias("tree"), code.alias("parent"), (F.col("node.level") + 1).alias("level"), F.lit(False).alias("open")),
    )
    opened = F.when(F.col("node.open"), F.array(own)).when(code.isNotNull(), F.concat(F.array(own), below))
    return rows.select(F.explode(opened).alias("node"))


def flatten_tree(df: DataFrame, body: str, platform_id: int) -> DataFrame:
    """Rows of category trees of any depth, one JSON array of roots per input row.

    Bodies are parsed once and opened level by level in one pass; only while closed nodes are left does another
    round follow. A body that is null, empty or no array of nodes gives no rows; a node without a number as its
    id is left out with all below it.
    """
    roots = F.explode(F.try_variant_get(F.try_parse_json(body), "$", "array<variant>"))
    fields = [F.col("tree"), F.lit(UNKNOWN_CODE).cast("bigint").alias("parent"), F.lit(0).alias("level"), F.lit(False).alias("open")]
    rows = df.select(roots.alias("tree")).select(F.struct(*fields).alias("node"))
    while True:
        for _ in range(LEVELS_AT_ONCE):
            rows = _opened(rows)
        closed = rows.where(~F.col("node.open"))
        if closed.isEmpty():
            break
    node = F.col("node.tree")
    return rows.select(
        F.try_variant_get(node, "$.category_id", "bigint").alias("category_code"),
        F.lit(platform_id).cast("int").alias("platform_id"),
        F.try_variant_get(node, "$.category_name", "string").alias("category_name"),
        F.coalesce(F.try_variant_get(node, "$.category_urlKey", "string"), F.lit("")).alias("category_url"),
        F.col("node.parent").alias("parent_code"),
        F.col("node.level").alias("level"),
    )


def flatten_tree3(df: DataFrame, body: str, platform_id: int = P11) -> DataFrame:
    """Rows of three-level trees in one pass: each body becomes one array of rows, exploded once."""

    def code(c: Column) -> Column:
        return F.coalesce(X.to_type(c, "bigint"), F.lit(UNKNOWN_CODE).cast("bigint"))

    def row(own: Column, name: Column, url: Column, parent: Column, level: int) -> Column:
        return F.struct(
            code(own).alias("category_code"),
            F.lit(platform_id).cast("int").alias("platform_id"),
            name.alias("category_name"),
            url.alias("category_url"),
            parent.alias("parent_code"),
            F.lit(level).alias("level"),
        )

    def kids(items: Column, make) -> Column:
        return F.flatten(F.transform(F.coalesce(items, F.array()), make))

    def third(parent: Column):
        return lambda n: F.array(row(n.categoryId, n.categoryName, n.categoryUrl, code(parent), 2))

    def second(parent: Column):
        return lambda n: F.concat(
            F.array(row(n.categoryId, n.categoryName, n.categoryUrl, code(parent), 1)),
            kids(n.level3TabList, third(n.categoryId)),
        )

    def first(n: Column) -> Column:
        return F.concat(
            F.array(row(n.id, n.categoryName, F.lit(""), F.lit(UNKNOWN_CODE).cast("bigint"), 0)),
            kids(n.level2TabList, second(n.id)),
        )

    tree = F.from_json(body, TREE_P11)
    return df.select(F.explode(F.flatten(F.transform(tree, first))).alias("node")).select("node.*")


def leaves(tree: DataFrame) -> DataFrame:
    """Nodes that are no node's parent."""
    parents = tree.select(F.col("parent_code").alias("category_code"), "platform_id").distinct()
    return join_large(tree, parents, ["category_code", "platform_id"], "left_anti")


def _named(tree: DataFrame, level: int, names: list[str]) -> DataFrame:
    return tree.where((F.col("level") == level) & F.lower(F.trim("category_name")).isin(names))


def leaves_under(tree: DataFrame, l1_names: list[str], l2_names: list[str]) -> DataFrame:
    """What to crawl below the allowed names: the third level, or the node itself when it ends there.

    A first-level node without children stands for itself; with children only allowed second-level
    nodes count.
    """
    keys = ["category_code", "platform_id"]

    def children_of(nodes: DataFrame) -> DataFrame:
        ids = nodes.select(F.col("category_code").alias("parent_code"), "platform_id").distinct()
        return join_large(tree, ids, ["parent_code", "platform_id"], "left_semi").select(*tree.columns)

    def childless(nodes: DataFrame) -> DataFrame:
        parents = tree.select(F.col("parent_code").alias("category_code"), "platform_id").distinct()
        return join_large(nodes, parents, keys, "left_anti").select(*tree.columns)

    first = _named(tree, 0, l1_names)
    second = _named(children_of(first), 1, l2_names)
    return childless(first).unionByName(childless(second)).unionByName(children_of(second))


def resolve_parents(tree: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """parent_code to parent_id with one join: every node already carries its category_id.

    Parents are looked for among the nodes themselves and, when given, the known categories.
    """
    nodes = ["category_code", "platform_id", "category_id"]
    candidates = tree.select(*nodes) if known is None else tree.select(*nodes).unionByName(known.select(*nodes))
    parents = candidates.where(F.col("category_code") != UNKNOWN_CODE).select(
        F.col("category_code").alias("parent_code"), "platform_id", F.col("category_id").alias("parent_id")
    )
    joined = join_large(tree, parents, ["parent_code", "platform_id"], "left")
    return joined.select(
        "category_id", "category_code", "platform_id", "category_name", "category_url", "parent_id", "level"
    )


def subtree(dim_category: DataFrame, platform_id: int | None, category_id: int | None) -> DataFrame:
    """Ids of a category and of three levels below it; without platform or category no ids.

    The root belongs to the platform. Its descendants are found by parent id alone.
    """
    if platform_id is None or category_id is None:
        return dim_category.where(F.lit(False)).select("category_id")
    links = dim_category.select("category_id", "parent_id")
    level = dim_category.where((F.col("category_id") == category_id) & (F.col("platform_id") == platform_id)).select(
        "category_id"
    )
    found = level
    for _ in range(3):
        above = level.select(F.col("category_id").alias("parent_id"))
        level = links.join(above, "parent_id", "left_semi").select("category_id")
        found = found.union(level)
    return found.distinct()
