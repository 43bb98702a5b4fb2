"""Digests of tables as trees over ranges of a whole-number key, so that two runs that differ name the ranges in which they do.

A leaf is ``LEAF`` consecutive keys; its digest is the number of its rows and two sums of their hashes, which no order of rows changes. A node above stands for
``FAN`` children and hashes their digests in order. Trees are made by one aggregation of the rows and small ones of digests, and
compared from the top: only children of nodes that differ are looked at.

Defined results: rows without a key lie in a leaf of their own, which is named by null; repeated rows count; columns are compared by name, and their values
as text; empty tables are equal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAF, FAN = 64, 64


def tree(df: DataFrame, key: str, levels: int = 4) -> list[DataFrame]:
    """One table (node, digest) a level, leaves first; ``levels`` of them."""
    shown = F.to_json(F.struct(*[F.col(f"`{c}`").cast("string").alias(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"})
    rows = df.select(F.floor(F.col(key) / LEAF).cast("long").alias("node"), shown.alias("_row"))
    sums = [F.sum(h.cast("decimal(38,0)")).cast("string") for h in (F.xxhash64("_row"), F.conv(F.left(F.sha2("_row", 256), F.lit(15)), 16, 10))]
    out = [rows.groupBy("node").agg(F.concat_ws(":", F.count("*").cast("string"), *sums).alias("digest"))]
    for _ in range(levels - 1):
        out.append(_above(out[-1]))
    return out


def _above(level: DataFrame) -> DataFrame:
    kids = F.array_sort(F.collect_list(F.struct("node", "digest")))
    return level.groupBy(F.floor(F.col("node") / FAN).cast("long").alias("parent")).agg(F.sha2(F.to_json(kids), 256).alias("digest")).withColumnRenamed("parent", "node")


def write(df: DataFrame, key: str, folder: str, levels: int = 4) -> None:
    """Store the tree of a run's table."""
    for i in range(levels):
        below = df.sparkSession.read.parquet(f"{folder}/level={i - 1}") if i else None
        (tree(df, key, 1)[0] if below is None else _above(below)).write.parquet(f"{folder}/level={i}")


def differing(one: list[DataFrame], two: list[DataFrame]) -> DataFrame:
    """(first_key, last_key) of the leaves that differ; both null for the rows without a key."""
    found = None
    for a, b in zip(reversed(one), reversed(two), strict=True):
        if found is not None:
            near = found.select(F.col("node").alias("_parent"))
            within = lambda t: t.join(near, F.floor(F.col("node") / FAN).cast("long").eqNullSafe(F.col("_parent")), "left_semi")  # noqa: B023, E731
            a, b = within(a), within(b)
        a, b = a.withColumnsRenamed({"node": "_a", "digest": "_da"}), b.withColumnsRenamed({"node": "_b", "digest": "_db"})
        both = a.join(b, F.col("_a").eqNullSafe(F.col("_b")), "full_outer")
        found = both.filter(~F.col("_da").eqNullSafe(F.col("_db"))).select(F.coalesce("_a", "_b").alias("node"))
    return found.select((F.col("node") * LEAF).alias("first_key"), (F.col("node") * LEAF + LEAF - 1).alias("last_key"))


def read(spark, folder: str, levels: int = 4) -> list[DataFrame]:
    return [spark.read.parquet(f"{folder}/level={i}") for i in range(levels)]
