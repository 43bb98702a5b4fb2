"""Connected components of an edge table, by hooking and contraction.

In each round every node with a smaller neighbour hooks onto the smallest one; hooks are followed to
their ends by pointer doubling; edges are renamed to the ends and those within one end vanish. Rounds go
on until no edge is left. All tables stay in Spark and are written to the shared folder between steps, so
lineage stays short and a lost executor costs one step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import materialize


def _renamed(df: DataFrame, col: str, names: DataFrame) -> DataFrame:
    """``df`` with the values of ``col`` replaced where ``names`` (root, to) has them."""
    others = [c for c in df.columns if c != col]
    n = names.select(F.col("root").alias("_root"), F.col("to").alias("_to"))
    joined = df.join(n, df[col] == n["_root"], "left")
    return joined.select(*others, F.coalesce("_to", F.col(col)).alias(col))


def _followed(hooks: DataFrame) -> DataFrame:
    """Hooks (root, to) with ``to`` at the end of each chain."""
    while True:
        ahead = hooks.select(F.col("root").alias("_root"), F.col("to").alias("_next"))
        step = hooks.join(ahead, hooks["to"] == ahead["_root"], "left")
        step = materialize(step.select("root", F.coalesce("_next", "to").alias("to"), F.col("_next").isNotNull().alias("moved")), "hooks")
        hooks = step.select("root", "to")
        if step.filter("moved").isEmpty():
            return hooks


def components(edges: DataFrame) -> DataFrame:
    """``edges``: (a, b) longs. Returns (node, component) of every node of an edge; component is its least node."""
    a, b = F.least("a", "b"), F.greatest("a", "b")
    cur = materialize(edges.filter("a <> b").select(a.alias("a"), b.alias("b")).distinct(), "edges")
    labels = cur.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("component"))
    labels = materialize(labels, "labels")
    while not cur.isEmpty():
        hooks = _followed(materialize(cur.groupBy(F.col("b").alias("root")).agg(F.min("a").alias("to")), "hooks"))
        labels = materialize(_renamed(labels, "component", hooks), "labels")
        moved = _renamed(_renamed(cur, "a", hooks), "b", hooks)
        cur = materialize(moved.filter("a <> b").select(a.alias("a"), b.alias("b")).distinct(), "edges")
    return labels
