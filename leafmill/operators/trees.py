"""Trees and graphs of objects: level by level with joins, so neither depth nor row limits of recursive queries bind.

Each level is written to the shared checkpoint folder where there is one, and else kept by Spark; the loops end
when a level adds nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _cut(df: DataFrame) -> DataFrame:
    if df.sparkSession.conf.get("spark.checkpoint.dir", None):
        return df.checkpoint()
    return df.persist()


def descend(roots: DataFrame, edges: DataFrame, limit: int = 1000) -> DataFrame:
    """(node, depth, path) of all nodes under the roots. ``roots``: node; ``edges``: parent, node, sort key seq.
    Paths hold the keys from the root down, so ordering by them is preorder. A node already on the path to
    itself is not followed again; a tree of more than ``limit`` levels is an error."""
    level = _cut(roots.select("node", F.lit(1).alias("depth"), F.array("seq").alias("path"), F.array("node").alias("seen")))
    out = level
    for _ in range(limit):
        e = edges.select(F.col("parent").alias("_p"), F.col("node").alias("_n"), F.col("seq").alias("_s"))
        level = level.join(e, F.col("node") == F.col("_p")).where(~F.array_contains("seen", F.col("_n")))
        level = _cut(level.select(F.col("_n").alias("node"), (F.col("depth") + 1).alias("depth"), F.concat("path", F.array("_s")).alias("path"), F.concat("seen", F.array("_n")).alias("seen")))
        if level.isEmpty():
            return out.drop("seen")
        out = out.unionByName(level)
    raise ValueError(f"the tree has more than {limit} levels")


def reachable(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """The distinct nodes that edges (src, dst) reach from the roots (node), roots included."""
    found = frontier = _cut(roots.select("node").distinct())
    while not frontier.isEmpty():
        step = frontier.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        frontier = _cut(step.join(found, "node", "left_anti"))
        found = found.unionByName(frontier)
    return found


def garbage(nodes: DataFrame, roots: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that nothing reaches."""
    return nodes.join(reachable(roots, edges), "node", "left_anti")


def inherit(nodes: DataFrame, value: str, limit: int = 1000) -> DataFrame:
    """(node, value): a node's own value or that of its nearest ancestor with one; more than ``limit`` levels
    without a value are an error. ``nodes``: node, parent, value."""
    own = nodes.select(F.col("node"), F.col("parent").alias("up"), F.col(value))
    up = nodes.select(F.col("node").alias("_n"), F.col("parent").alias("_p"), F.col(value).alias("_v"))
    for _ in range(limit):
        if own.where(F.col(value).isNull() & F.col("up").isNotNull()).isEmpty():
            return own.select("node", value)
        step = own.join(up, F.when(F.col(value).isNull(), F.col("up")) == F.col("_n"), "left")
        own = _cut(step.select("node", F.when(F.col(value).isNull(), F.col("_p")).otherwise(F.col("up")).alias("up"), F.coalesce(value, "_v").alias(value)))
    raise ValueError(f"more than {limit} levels have no value")
